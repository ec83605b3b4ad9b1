"""Operators 1 and 4 against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from factorframe.llm import jaccard_join, topk
from factorframe.llm.common import small_batches

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return set() if not w else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute_components(rows, k, percent):
    """doc_id -> (set size, smallest id reachable) over rows (doc_id, text) with different ids."""
    sets = {d: shingles(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def family(seed, n, words, edits):
    """n copies of a text with up to ``edits`` words changed each."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = base[:]
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_components_equal_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    for seed, (n, words, edits) in enumerate([(25, 60, 3), (25, 200, 9), (20, 12, 1), (20, 400, 14)]):
        rows += [(10_000 + 1000 * seed + i, t) for i, t in enumerate(family(seed, n, words, edits))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent, lean in ((3, 90, False), (5, 80, True)):  # as the query and as the pipeline calls it
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, k, percent, lean).collect()}
        assert got == brute_components(rows, k, percent)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (80, 90, 95):
        for n in (3, 9, 10, 14, 15, 16, 40, 200, 1500):
            for _ in range(15):
                a = rng.integers(1, 2**63, n).astype(np.uint64)
                gone, new = rng.integers(0, n // 8 + 1), rng.integers(0, n // 8 + 1)
                b = np.concatenate([a[gone:], rng.integers(1, 2**63, new).astype(np.uint64)])
                both = n - gone
                a, b = np.unique(a), np.unique(b)
                if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    assert np.intersect1d(jaccard_join.signatures(a, percent), jaccard_join.signatures(b, percent)).size


def test_sets_are_shipped_once_to_a_block_pair(spark, monkeypatch):
    rng = np.random.default_rng(3)
    pool = np.sort(rng.integers(-2**62, 2**62, 130))
    rows = [(i, sorted(rng.choice(pool, 100, replace=False).tolist())) for i in range(1, 61)]
    sets = spark.createDataFrame(rows, "cls long, s array<long>")
    pairs = spark.createDataFrame([(i, j) for i in range(1, 61) for j in range(i + 1, 61)], "u long, v long")
    near = {(i, j) for i, a in rows for j, b in rows if i < j and 100 * len({*a} & {*b}) >= 63 * len({*a} | {*b})}
    assert 10 < len(near) < 1760
    for elements, most in ((10_000, 60), (1_500, 60 * 12)):  # one block; blocks of about 15 sets
        monkeypatch.setattr(jaccard_join, "ELEMENTS", elements)
        got = jaccard_join._shipped(pairs, sets)
        assert got.where("v is null").count() <= most and got.where("v is not null").count() == 1770
        found = [(r.u, r.v) for r in jaccard_join._verified(pairs, sets, 63).collect()]
        assert len(found) == len(near) and set(found) == near


def test_large_sets_with_little_in_common_are_no_candidates():
    rng = np.random.default_rng(7)
    for percent, n in ((80, 400), (80, 5_000), (80, 20_000), (90, 20_000)):
        base = rng.integers(1, 2**63, n).astype(np.uint64)
        sketches = []
        for own in (0, n // 40, n // 2, n):  # elements that only this set has
            s = np.append(base[own:], rng.integers(1, 2**63, own).astype(np.uint64))
            sketches.append(jaccard_join._parity(s, jaccard_join._bits(len(s), percent)))
        far = jaccard_join._apart(np.array(sketches, dtype=object), np.array([0, 0, 0]), np.array([1, 2, 3]))
        assert far[0] <= n // 20 and ((100 + percent) * far <= (100 - percent) * 2 * n).tolist() == [True, False, False]
    s = rng.integers(1, 2**63, 3_000).astype(np.uint64)
    wide = np.array([jaccard_join._parity(s, 8192)], dtype=object)
    assert jaccard_join._sketches(wide, 16).tobytes() == jaccard_join._parity(s, 1024)


def test_members_of_a_bucket_are_compared_with_all_of_other_components(spark, monkeypatch):
    rng, rows = np.random.default_rng(11), []
    base = np.unique(rng.integers(1, 2**63, 2_200).astype(np.uint64))
    sets = {}
    for cls in range(1, 81):  # copies with 5 to 119 elements exchanged, of sizes whose sketches are 1,024 and 2,048 bits wide
        own = int(rng.integers(5, 120))
        sets[cls] = np.append(base[own:int(rng.integers(1_400, 1_700))], rng.integers(1, 2**63, own).astype(np.uint64))
        rows.append((int(cls > 75), cls, cls // 3, len(sets[cls]), jaccard_join._parity(sets[cls], jaccard_join._bits(len(sets[cls]), 80))))
    assert {len(r[4]) for r in rows} == {128, 256}
    for few, blocks in ((64, 1), (64, 3), (128, 1), (128, 3)):
        monkeypatch.setattr(jaccard_join, "FEW", few)
        mixed = spark.createDataFrame([(*r, blocks) for r in rows], "sig long, cls long, label long, n long, sketch binary, blocks long")
        got = {(r.u, r.v) for r in jaccard_join._across(mixed, 80).collect()}
        sharp = lambda i, j: 180 * len(np.setxor1d(sets[i], sets[j])) <= 20 * (len(sets[i]) + len(sets[j]))
        near = {(i, j) for i in sets for j in sets if i < j and (i > 75) == (j > 75) and i // 3 != j // 3 and sharp(i, j)}
        assert near and near <= got and all(i < j and i // 3 != j // 3 and (i > 75) == (j > 75) for i, j in got)
        fixed = got if few == 64 and blocks == 1 else fixed
        assert got == fixed


def test_arrow_batches_are_bounded_in_bytes(spark):
    def rows(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(name) for name in names]
    with small_batches(spark, 1_000, 1 << 20):  # sets of 80,000 elements
        wide = spark.range(0, 40, 1, 1).select(F.sequence(F.lit(1).cast("long"), F.lit(80_000).cast("long")).alias("s"))
        got = [r.n for r in wide.mapInArrow(rows, "n long").collect()]
    assert sum(got) == 40 and max(got) <= 3
    assert [spark.conf.get(name) for name in names] == before


def test_components_of_odd_rows(odd, none):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(odd, 3, 90).collect())
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]
    assert [g for g in got if g[0] in (4, 5)] == [(4, 1, 4), (5, 1, 4), (5, 1, 4)]
    assert [g[2] for g in got if g[0] in (7, 8)] == [7, 7] and [g[2] for g in got if g[0] == 0] == [None]
    assert jaccard_join.jaccard_components(none, 3, 90).count() == 0
    kept = jaccard_join.one_of_each(odd, 5, 80)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 7, 9, 10, 11]
    again = jaccard_join.one_of_each(odd.where("doc_id = 5"), 5, 80)
    assert again.count() == 1


def test_components_label_propagation(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 201), (7, 7)]
    got = {r.node: r.label for r in jaccard_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and {got[100 + i] for i in range(1, 30)} == {100} and got[201] == 200


def brute_top(rows, k=10):
    clean, found = [], {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            clean.append((i, tuple(int(np.floor(1024 * float(x))) for x in v)))
    for q, a in clean:
        if q % 100 == 0:
            found.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q and len(b) == len(a))
    return sorted((q, r, i, -s) for q, x in found.items() for r, (s, i) in enumerate(sorted(x)[:k], 1))


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1500)]
    rows += [(i, rows[i % 40][1]) for i in range(1500, 1700)]  # ties
    rows += [(2000, [0.0] * 8), (2100, [1.5, 2.5]), (2101, [0.5, 0.5]), (2200, None), (2300, []), (None, [1.0] * 8), (2400, [1.0, None]), (2401, [float("nan")] * 8),
             (2402, [float("inf")] * 8), (2500, [1e6] * 8), (2501, [-1e6] * 8), (1500, rows[3][1]), (100, rows[100][1]), *((7, [9.0 + j] * 8) for j in range(4)), (7, [9.0] * 8)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    monkeypatch.setattr(topk, "BLOCK", 7)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_branch_and_bound_visits_few_leaves():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8)) * 5000
    v = np.floor(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 8)) * 50).astype(np.int64)
    tree = topk.BallTree(v, np.arange(4000))
    asked = []
    products = tree.products
    tree.products = lambda rows, q: asked.append(rows) or products(rows, q)
    got = tree.search(v[17], 17, 10, None)
    want = sorted(((int(v[i] @ v[17]), -i) for i in range(4000) if i != 17), reverse=True)[:10]
    assert got == [(s, -i) for s, i in want] and len(asked) < len(tree.nodes) // 4
    assert tree.search(v[17], 17, 10, got[-1][0]) == got  # a shared kth score loses nothing
