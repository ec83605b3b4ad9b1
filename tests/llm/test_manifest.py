"""Operator 11 against a plain recursive Merkle tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factorframe.llm import manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join(field(v) for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes, fan):
    """Levels of a tree, and for each leaf its siblings level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + fan])) for i in range(0, len(levels[-1]), fan)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = i // fan * fan
            path.append(("".join(level[run:i]), "".join(level[i + 1:run + fan])))
            i //= fan
        paths.append(path)
    return levels[-1][0], paths


def brute(rows, fan=2):
    groups = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        told = own
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            told = leaf(doc_id, source, lang, None if n_chars is None else n_chars + 1, text)
        groups[lang].append((doc_id is not None, doc_id or 0, own, told))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    below = {}
    for name in names:
        groups[name].sort()
        below[name] = tree([x[2] for x in groups[name]], fan)
    root, above = tree([below[x][0] for x in names], fan) if names else (None, [])
    out = []
    for name, top in zip(names, above):
        for (has, doc_id, own, told), path in zip(groups[name], below[name][1]):
            path, node = path + top, told
            for a, b in path:
                node = sha(a + node + b)
            out.append((doc_id if has else None, name, own, below[name][0], root, sha("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def check(docs, block=4096, fan=2):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = manifest.manifest(docs, manifest.tampered(), block, fan)
    columns = ["doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = got.select(*columns, "proof").collect()
    assert sorted((tuple(r)[:-1] for r in found), key=str) == brute(rows, fan)
    for r in found[:50]:
        assert manifest.fold(r.leaf, manifest._read(r.proof)) == r.root
    return found


def test_small(small):
    found = check(small)
    assert 0 < sum(not r.verified for r in found) < len(found)


@pytest.mark.parametrize("block, fan", [(2, 2), (4, 2), (9, 3)])
def test_many_stages(small, block, fan):
    check(small.limit(60), block, fan)


def test_odd(odd, none, spark):
    check(odd)
    assert manifest.manifest(none, manifest.tampered()).collect() == []
    one = spark.createDataFrame([(7, "x", None, None, "lonely")], "doc_id long, source string, lang string, n_chars long, text string")
    (r,) = check(one)
    assert r.root == r.leaf == r.subroot and r.proof == "" and r.verified


def test_ids_of_any_kind(spark):
    """Negative, huge and sparse ids, one id on a third of the rows, equal rows, a language for almost every row."""
    ids = [None, -(2**63), 2**63 - 1, -1, 0, 63, 64, -64, -65, 65535, 65536, 10**15]
    rows = [(ids[i % 12] if i % 3 else 42, f"s{i % 5}", (None, "", "a", "ä", "Z", f"l{i}")[i % 6], i % 4 if i % 5 else 2**63 - 1, f"t{i % 7}") for i in range(240)]
    check(spark.createDataFrame(rows + rows[:20], "doc_id long, source string, lang string, n_chars long, text string"), 8, 2)


def test_ranks_without_sorting_documents(spark, small):
    """The plan that places documents with distinct ids has no window and no sort over them."""
    leaves = small.select(F.coalesce("lang", F.lit("")).alias("g"), "doc_id", F.lit(b"x").alias("leaf")).dropDuplicates(["doc_id"])
    out = manifest.ranked(leaves)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort [" not in plan
    places = {(r.g, r.doc_id): r.slot for r in out.collect()}
    for g in {g for g, _ in places}:
        own = sorted(d for x, d in places if x == g)
        assert [places[g, d] for d in own] == list(range(len(own)))
