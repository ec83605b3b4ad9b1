"""Operators 2, 5, 8, 9 and the pipeline against brute force, invariants and exact round trips."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from factorframe.llm import mixing, packing, pii, sharding
from factorframe.llm.common import stored
from tests.llm.test_pairs_and_search import brute_components

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute_targets(sizes):
    """Source -> target: share by weight, stop at three times the size, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        total = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / total > 3 * sizes[s]] if free else []
        if not above:
            return fixed | {s: left * weight[s] / total for s in free}
        fixed |= {s: 3.0 * sizes[s] for s in above}


def check_mix(rows, docs):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sums = Counter()
    for (_, _, s), n in zip(rows, size):
        sums[s] += n
    want = brute_targets(sums)
    by_id = defaultdict(list)
    for (d, _, s), n in zip(rows, size):
        by_id[d].append((n, sums[s], s))
    taken, largest = Counter(), max(size, default=0)
    for r in got.itertuples():
        d = None if r.doc_id != r.doc_id else int(r.doc_id)
        one = next(x for x in by_id[d] if x[0] == r.size and x[1] == r.source_size)
        assert abs(r.target - want[one[2]]) < 1e-6 * max(1, r.target) and r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
        taken[one[2]] += r.taken
    assert sum(taken.values()) <= sum(size)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    assert got.sort_values(["doc_id", "size", "taken"]).taken.tolist() == mixing.mix(docs).toPandas().sort_values(["doc_id", "size", "taken"]).taken.tolist()
    return got


def test_mix(spark, small, odd, none):
    docs = small.select("doc_id", "text", "source")
    check_mix([tuple(r) for r in docs.collect()], docs)
    rows = [(i, "w " * (1 + i * 7 % 50), "hot" if i % 3 else f"s{i % 31}") for i in range(400)] + [(900, "x " * 3000, "tiny"), (901, "", "empty"), (902, "a b", None)]
    got = check_mix(rows, spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert (got.taken > got["size"]).any() and (got.taken == 0).any()
    check_mix([(r.doc_id, r.text, r.source) for r in odd.collect()], odd.withColumn("size", F.lit("clash")))
    assert mixing.mix(none).count() == 0
    out = mixing.mixed(odd)
    assert out.columns == odd.columns
    times = mixing.mix(odd).groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    assert {r.doc_id: r.n for r in times} == {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}


def test_packing_is_an_exact_round_trip(spark, small, odd, none):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = [(-1, "a  b\n\n  c\t d   e   f  g ", "x"), (-2, "<|endoftext|> 's we'll 12345 ñandú", "x"),
             (-5, "a <|endoftext|> b  <|endoftext|><|endoftext|>\n c<|endoftext", "x"), (-3, " lead and trail ", "x"), (-4, "\r\n\r\n", "x")]
    docs = small.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = packing.pack(docs).toPandas()
    place = defaultdict(list)
    for r in got.itertuples():
        ids = tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [1]
        part = np.array(ids[r.start:r.start + r.length], dtype="<u4")
        assert r.doc_tokens == len(ids) and len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32
        place[r.sequence_id].append((r.offset, r.length))
    for pieces in place.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    for d, x in got.groupby("doc_id"):
        x = x.sort_values("start")
        assert x.start.tolist() == [0, *x.length.cumsum().tolist()[:-1]] and x.length.sum() == x.doc_tokens.iloc[0]
    assert set(got.doc_id) == set(texts) and got.length.sum() / (2048 * len(place)) > 0.95
    odd_rows = packing.pack(odd).toPandas()
    assert odd_rows.length.sum() == sum(x.doc_tokens.iloc[0] * (2 if d == 5 else 1) for d, x in odd_rows.groupby("doc_id", dropna=False))
    assert odd_rows[odd_rows.doc_id.isin([1, 2])].doc_tokens.tolist() == [1, 1] and odd_rows.doc_id.isna().any()
    assert packing.pack(none).count() == 0


def test_packer_keeps_bounded_space():
    rng = np.random.default_rng(1)
    packer, total, closed = packing.Packer(100, 4, 5), 0, []
    for i, n in enumerate(rng.integers(1, 260, 3000).tolist()):
        total += n
        closed += list(packer.put(n, i))
        assert len(packer.open) <= 4
    closed += list(packer.rest())
    assert sum(w[0] for w in closed) == total and all(sum(x[2] for x in w[1]) == w[0] <= 100 for w in closed)


def check_shards(docs, shards=24):
    got = sharding.shard(docs, shards).toPandas()
    n = got.groupby("shard").slot.agg(["size", "min", "max", "nunique"])
    counts = [int(n["size"].get(s, 0)) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and (n["min"] == 0).all() and (n["max"] + 1 == n["size"]).all() and (n["nunique"] == n["size"]).all()
    return got


def test_shards(spark, small, odd, none):
    got = check_shards(small)
    rows = {r.doc_id: r.text for r in small.collect()}
    for r in got.itertuples():
        raw = rows[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    # no link is cut while groups fit; a group larger than a shard takes as few shards as can be
    groups = [(g * 100 + i, f"group {g}") for g in range(40) for i in range(2 + g % 4)] + [(10_000 + i, "hot") for i in range(150)] + [(20_000 + i, f"lone {i}") for i in range(250)]
    docs = spark.createDataFrame(groups, "doc_id long, text string")
    got = check_shards(docs, 12).merge(docs.toPandas(), on="doc_id")
    spread = got.groupby("text").shard.nunique()
    assert (spread.drop("hot") == 1).mean() > 0.95 and spread["hot"] <= -(-150 // (len(groups) // 12)) + 1
    cut = sum((got.groupby("text").size() - got.groupby(["text", "shard"]).size().groupby("text").max()).drop("hot"))
    random = docs.toPandas().assign(shard=lambda x: x.doc_id % 12)
    before = sum((random.groupby("text").size() - random.groupby(["text", "shard"]).size().groupby("text").max()).drop("hot"))
    assert cut < 0.1 * before
    odd_rows = check_shards(odd)
    assert len(odd_rows) == 12 and odd_rows[odd_rows.doc_id == 1][["size", "text_crc32"]].values.tolist() == [[8, 0]]
    assert sharding.shard(none).count() == 0


def brute_propagation(blocks, room):
    """One process, the same rules: groups' smaller blocks ask for the largest open one, the best gain is served first."""
    blocks = dict(blocks)
    while True:
        held = Counter()
        for (_, label), n in blocks.items():
            held[label] += n
        moved = 0
        quota = {b: r - held[b] for b, r in enumerate(room)}
        for key in sorted({k for k, _ in blocks}, key=lambda k: -max(n for (x, _), n in blocks.items() if x == k)):
            own = {label: n for (k, label), n in blocks.items() if k == key and n}
            open_labels = [label for label in own if quota[label] > 0]
            if open_labels:
                to = max(open_labels, key=lambda label: own[label])
                for label, n in own.items():
                    go = min(n, quota[to]) if label != to and n <= own[to] else 0
                    blocks[key, label] -= go
                    blocks[key, to] += go
                    quota[to] -= go
                    moved += go
        if not moved:
            return blocks


def test_propagation_cuts_no_more_than_brute_force(spark):
    rng = np.random.default_rng(6)
    blocks = {(f"g{g}", int(s)): int(rng.integers(1, 6)) for g in range(60) for s in rng.choice(8, rng.integers(1, 6), replace=False)}
    room = [sum(blocks.values()) // 8 + 8] * 8
    kept = lambda b: sum(max([n for (k, _), n in b.items() if k == g]) for g in {k for k, _ in b})
    df = spark.createDataFrame([(k, s, n) for (k, s), n in blocks.items()], "key string, label int, n long")
    got = {(r.key, r.label): r.n for r in sharding.propagate(df, room).collect()}
    assert sum(got.values()) == sum(blocks.values())
    held = Counter()
    for (_, label), n in got.items():
        held[label] += n
    start = Counter()
    for (_, label), n in blocks.items():
        start[label] += n
    assert all(held[b] <= max(room[b], start[b]) for b in range(8))
    assert kept(got) >= 0.95 * kept(brute_propagation(blocks, room))


def test_surrogates(spark, odd, none):
    rows = [(1, "Call Mr. John Smith at +1 (743) 555-3824 or write to John.Smith@mail.example.com."), (2, "JOHN.SMITH@MAIL.EXAMPLE.COM; 10.20.3.4, 10.20.3.4"),
            (3, "Frau Maria Huber, Госпожа Анна Иванова, +1-743-555-3824"), (4, "card 4785 3805 9239 1139 = 4785380592391139, ssn 123-45-6789, DE89370400440532013000"),
            (5, "nothing here, 1.2.3 and 2024-01-02"), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymised(docs, "k").collect()}
    assert [got[i].n_entities for i in range(1, 8)] == [3, 3, 3, 4, 0, 0, 0] and [got[i].text for i in (5, 6, 7)] == [rows[4][1], None, ""]
    old = ["John", "Smith", "555-3824", "10.20.3.4", "Maria", "Huber", "Анна", "Иванова", "0592", "123-45-6789", "3704"]
    assert not [x for r in got.values() for x in old if r.text and x in r.text]
    mail = re.search(r"\S+@\S+\.com", got[1].text).group()
    assert mail.upper() in got[2].text and re.fullmatch(r"[a-z]{4}\.[a-z]{5}@[a-z]{4}\.[a-z]{7}\.com", mail)  # one person, one address
    phone = re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", got[1].text).group()
    other = re.search(r"\+\d-\d{3}-\d{3}-\d{4}", got[3].text).group()
    assert re.sub(r"\D", "", phone) == re.sub(r"\D", "", other) and phone[1] == "1"
    a, b = re.search(r"card (.{19}) = (\d{16})", got[4].text).groups()
    assert a.replace(" ", "") == b and re.search(r"ssn \d{3}-\d{2}-\d{4}, DE\d{20}$", got[4].text)
    given = lambda t, title: re.search(title + r" (\w+) \w+", t).group(1)
    assert given(got[1].text, r"Mr\.") in pii._GIVEN["latin", "m"] and given(got[3].text, "Frau") in pii._GIVEN["latin", "f"]
    assert given(got[3].text, "Госпожа") in pii._GIVEN["cyrillic", "f"]
    assert {r.doc_id: r.text for r in pii.pseudonymised(docs, "k").collect()} == {i: r.text for i, r in got.items()}
    assert pii.pseudonymised(docs, "other").where("doc_id = 1").first().text != got[1].text
    assert pii.pseudonymised(odd).count() == 12 and pii.pseudonymised(none).count() == 0


def test_surrogates_stay_distinct_when_formats_are_small(spark):
    values = [f"{a}.{b}.{c}.{d}" for a in range(1, 7) for b in range(1, 7) for c in range(1, 7) for d in range(1, 7)]
    got = pii.surrogates(spark.createDataFrame([("ip", v) for v in values], "kind string, normal string"), "k").toPandas()
    assert len(got) == len(values) and got.surrogate.nunique() == len(values) and not set(got.surrogate) & set(values)


def test_pipeline(spark, small):
    """Each stage on its own input, then the whole run."""
    docs, steps = small, {}
    for name, stage in corpus_pipeline.STAGES:
        steps[name] = docs, (docs := stored(stage(spark, docs, "")))
        assert name == "packing" or docs.columns == small.columns
    before, after = steps["language_id"]
    assert {r.doc_id for r in before.where(F.col("text").rlike(r"\p{L}")).collect()} >= {r.doc_id for r in after.collect()}
    before, after = steps["ngram_jaccard_join"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    parts = brute_components(rows, 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in parts.items() if d == c)
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in steps["secret_scan"])
    secret = re.compile(r'(token = ")[0-9a-f]{40}|(password=)[0-9a-f]{16,}|()AKIA[0-9A-Z]{16}')
    assert after == {d: secret.sub(lambda m: next((g for g in m.groups() if g is not None), "") + "<SECRET>", t) for d, t in before.items()}
    before, after = steps["mixing"]
    times = {r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies}
    assert times == dict(Counter(r.doc_id for r in after.collect())) and after.join(before, small.columns, "left_anti").count() == 0
    last = docs.toPandas()
    assert last.groupby("doc_id").length.sum().to_dict() == {d: n * times[d] for d, n in last.groupby("doc_id").doc_tokens.first().items()}
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    total = lambda x: x.drop_duplicates("doc_id").set_index("doc_id").doc_tokens.sort_index().to_dict()
    assert total(whole) == total(last) and whole.length.sum() == last.length.sum() and set(key) <= set(whole.columns)
