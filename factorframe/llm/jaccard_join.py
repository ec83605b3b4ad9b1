"""N-gram Jaccard join by PartEnum signatures (operator 4).

A document is the set of its distinct word shingles.  Sets are dealt into bands of nearly equal size.  In a band two
sets with Jaccard similarity of ``percent`` / 100 or more differ in at most ``k`` elements.  The feature domain is cut
into first-level parts and each part into ``n2``; leaving out ``k2`` of the ``n2`` in every possible way gives the
signatures.  By the pigeonhole principle one first-level part has at most ``k2`` differences, so a similar pair shares a
signature.  Spare first-level parts let a document leave out its nearly empty parts, whose signatures say nothing,
without losing a pair.

Candidates are never expanded into all pairs: each bucket first links its members to one hub, if they share more buckets
than sets of their size do by chance; components of the verified links follow; only members of a bucket that are still in
different components are compared with each other, block by block, and only pairs passing an exact bound on the symmetric
difference leave the task.  The bound is as tight for large sets as for small ones, for a sketch is as wide as its set asks.
Every link between components is found, so the components are exact.

Defined results: null or wordless texts have 0 shingles and are their own component; repeated rows and equal sets are one
component; a null doc_id never becomes a component's name unless all ids of the component are null; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm.common import mix, pieces, released, repeated, shingle_hashes, small_batches, stored, with_list, word_hashes, word_spans

#: Ratio of the largest and the smallest set of a band.
BAND = 1.5
#: Fewest bits of the parity sketch (odd sketch).  Two sketches differ in at most as many bits as the sets differ in elements.
BITS = 1024
#: Bits for each element in which similar sets may differ.  Sketches of sets with little in common differ in half their bits,
#: which says nothing if similar sets may differ in as many elements.
SPREAD = 3
#: Elements of a block of sets that are verified together (a larger set is one block).
ELEMENTS = 500_000
#: Rows of an Arrow batch, which bounds what executor and worker hold of texts and sets.
ROWS = 1_000
#: Bytes of text that are hashed at once (a longer text is one piece).
PIECE = 500_000
#: Members of a bucket compared with each other in one task.
BLOCK = 2048
#: Members up to which buckets are compared many at a time.
FEW = 64
#: A pair meets at a hub if it shares a bucket for each so many elements; the others wait for the comparison in blocks.
RARE = 150
#: Rounds that link the members of a bucket to one of them before the rest is compared.
STARS = 2
#: Hubs of a bucket in every round but the first.
HUBS = 4


_BANDS: dict[tuple[int, int], list] = {}


def bands(percent: int, largest: int = 1 << 40) -> list[tuple[int, int, int, int, int, int]]:
    """(smallest, largest, first-level parts, n2, k2, spare) of each band of set sizes."""
    if (percent, largest) in _BANDS:
        return _BANDS[percent, largest]
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND))
        k = 2 * high * (100 - percent) // (100 + percent)
        k2, n2, least = (1, 3, 2) if percent >= 85 else (0, 1, 1)
        base, spare = -(-(k + 1) // (k2 + 1)), 0
        for _ in range(20):  # spare parts make parts emptier: iterate to the fixed point
            n1 = base + spare * (1 + (k2 > 0))
            mean = low * (n2 - k2) / n2 / n1
            few = min(1.0, n2 * np.exp(-mean) * (1 + mean * (least > 1)))
            need = int(np.ceil(n1 * few + 3 * np.sqrt(n1 * few)))
            if need <= spare or n1 > 2 * base:
                break
            spare = need
        out.append((low, high, base + spare * (1 + (k2 > 0)), n2, k2, spare))
        low = high + 1
    _BANDS[percent, largest] = out
    return out


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """Signatures of one set of 64-bit element hashes."""
    n, out = len(elements), []
    for number, (low, high, n1, n2, k2, spare) in enumerate(bands(percent)):
        if low > n and n * 100 < percent * low:
            break
        if n > high or 2 * high * (100 - percent) < 100 + percent:  # in the smallest bands similar sets are equal
            continue
        lane = (elements >> np.uint64(32)) * np.uint64(n1 * n2) >> np.uint64(32)
        cell = lane.astype(np.int64)
        filled = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        sums = np.zeros(n1 * n2, dtype=np.uint64)
        np.add.at(sums, cell, mix(elements + np.uint64(1)))
        sums = sums.reshape(n1, n2)
        poor = filled.sum(1) - (filled.max(1) if k2 else 0) < (2 if k2 else 1)
        keep = ~poor if poor.sum() <= spare else np.ones(n1, dtype=bool)
        part = np.arange(n1, dtype=np.uint64)
        for j, chosen in enumerate(combinations(range(n2), n2 - k2)):
            content = sums[:, list(chosen)].sum(1, dtype=np.uint64)
            tag = mix(part * np.uint64(64) + np.uint64(j) + (np.uint64(number) << np.uint64(48)) + np.uint64(percent) * np.uint64(1 << 56))
            out.append(mix(content ^ tag)[keep])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(column, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a few texts at a time, which bounds a task's arrays."""
    for at in range(0, len(column), 512):
        for _, data, offsets in pieces(column.slice(at, 512), PIECE):
            starts, ends, rows = word_spans(data, offsets)
            hashes, own = shingle_hashes(word_hashes(data, starts, ends), rows, k, len(offsets) - 1)
            cut = np.searchsorted(own, np.arange(len(offsets)))
            for i in range(len(offsets) - 1):
                yield np.unique(hashes[cut[i]:cut[i + 1]])


def _bits(n: int, percent: int) -> int:
    """Bits of the sketch of a set of ``n`` elements, a power of two."""
    return max(BITS, 1 << (SPREAD * 2 * n * (100 - percent) // (100 + percent)).bit_length())


def _parity(s: np.ndarray, bits: int) -> bytes:
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _name(s: np.ndarray) -> int:
    """64-bit name of a set; 0 for the empty one."""
    return int(mix(np.array([s.sum(dtype=np.uint64) ^ np.uint64(len(s) * 0x9E3779B97F4A7C15 & (2**64 - 1))]))[0].view(np.int64)) if len(s) else 0


def signed(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row a document: doc_id, text_hash, n_shingles, cls (names its set; 0: no shingle), sketch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sizes, names, sketches = [], [], []
            for s in _sets(batch.column("text"), words):
                sizes.append(len(s))
                names.append(_name(s))
                sketches.append(_parity(s, _bits(len(s), percent)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(sketches, pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "cls", "sketch"])

    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return thin.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, cls long, sketch binary")


def _buckets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(sig, cls) of every set.  Signatures go straight to the exchange, for they are more bytes than the texts; a task lists
    those of equal sets once."""

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                names, lists = [], []
                for s in _sets(batch.column("text").slice(at, 512), words):
                    name = _name(s)
                    if name and name not in seen:
                        seen.add(name)
                        lists.append(_signed(signatures(s, percent)))
                        names.append(np.full(len(lists[-1]), name, dtype=np.int64))
                if lists:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists)), pa.array(np.concatenate(names))], names=["sig", "cls"])

    return docs.select("text").mapInArrow(run, "sig long, cls long")


def components(edges: DataFrame, lean: bool = False) -> DataFrame:
    """(node, label): the smallest node reachable, by alternating large-star and small-star joins over (u, v)."""
    both = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state = stored(both(edges))
    seen = None
    while True:
        rows = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("h")).first()
        if tuple(rows) == seen or not rows["n"]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = tuple(rows)
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        ways = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both(ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        before, state = state, stored(both(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))))
        if lean:
            released(edges.sparkSession, before)


def _participants(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, s): the sets of the wanted classes, from the text of one document each."""
    ids = stored(classes.join(wanted, "cls", "left_semi").select("doc_id", "text_hash").distinct())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = list(_sets(part.column("text"), words))
                names = [_name(s) for s in sets]
                offsets = np.zeros(len(sets) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in sets], out=offsets[1:])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(_signed(np.concatenate(sets)), pa.int64()))], names=["cls", "s"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    rows = with_list(texts, ids, ["doc_id", "text_hash"], "left_semi").select("text")
    return stored(rows.mapInArrow(run, "cls long, s array<long>").dropDuplicates(["cls"]))


def _shipped(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(g, u, v, s): in each group g the sets ``s`` of the classes u (v null) and the pairs (u, v) of them.  Sets lie in
    blocks by their smallest partner, so near copies of one text lie together, and a set is shipped once to each pair of
    blocks, however many pairs it has there."""
    ways = pairs.select(F.col("u").alias("cls"), "v").unionByName(pairs.select(F.col("v").alias("cls"), F.col("u").alias("v")))
    homes = ways.groupBy("cls").agg(F.least("cls", F.min("v")).alias("home")).join(sets.select("cls", F.size("s").cast("long").alias("n")), "cls")
    room = homes.groupBy("home").agg(F.ceil(F.sum("n") / ELEMENTS).cast("long").alias("blocks"))
    homes = stored(homes.join(room, "home").select("cls", F.xxhash64("home", F.pmod(F.xxhash64("cls"), "blocks")).alias("home")))
    side = lambda c: homes.select(F.col("cls").alias(c), F.col("home").alias(f"h{c}"))
    dealt = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    dealt = stored(dealt.select(F.xxhash64(F.least("hu", "hv"), F.greatest("hu", "hv")).alias("g"), "u", "v"))
    needed = dealt.select("g", F.col("u").alias("cls")).union(dealt.select("g", F.col("v").alias("cls"))).distinct()
    rows = needed.join(sets, "cls").select("g", F.col("cls").alias("u"), F.lit(None).cast("long").alias("v"), "s")
    return rows.unionByName(dealt.select("g", "u", "v", F.lit(None).cast("array<long>").alias("s")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that are similar enough."""

    def run(batches):
        import pyarrow as pa

        group, held = None, {}
        for batch in batches:
            found = [], []
            values, offsets = batch.column("s").values.to_numpy(), batch.column("s").offsets.to_numpy()
            for i, (g, u, v) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "u", "v")))):
                if g != group:
                    group, held = g, {}
                if v is None:  # the sets of a group come before its pairs
                    held[u] = np.sort(values[offsets[i]:offsets[i + 1]])
                    continue
                a, b = sorted((held[u], held[v]), key=len)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if 100 * both >= percent * (len(a) + len(b) - both):
                    found[0].append(u)
                    found[1].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["u", "v"])

    return _shipped(pairs, sets).repartition("g").sortWithinPartitions("g", F.col("v").asc_nulls_first()).mapInArrow(run, "u long, v long")


def _sketches(column, words: int) -> np.ndarray:
    """Sketches as columns of ``words`` 64-bit words.  Wider ones are folded, which gives the set's narrower sketch."""
    size, out = np.fromiter(map(len, column), np.int64, len(column)) // 8, np.empty((words, len(column)), np.uint64)
    for wide in np.unique(size):
        at = np.flatnonzero(size == wide)
        out[:, at] = np.bitwise_xor.reduce(np.frombuffer(b"".join(column[at]), np.uint64).reshape(len(at), -1, words), axis=1).T
    return out


def _apart(sketch: np.ndarray, l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Bits in which the sketches at ``l`` and ``r`` differ, as wide as the narrower of the two."""
    size, out = np.fromiter(map(len, sketch), np.int64, len(sketch)) // 8, np.zeros(len(l), np.int64)
    least = np.minimum(size[l], size[r])
    for words in np.unique(least):
        at = np.flatnonzero(least == words)
        rows, back = np.unique(np.append(l[at], r[at]), return_inverse=True)
        x = np.ascontiguousarray(_sketches(sketch[rows], int(words)).T)
        for i in range(0, len(at), 8192):
            some = slice(i, min(i + 8192, len(at)))
            out[at[some]] = np.bitwise_count(x[back[some]] ^ x[back[len(at):][some]]).sum(1, dtype=np.int64)
    return out


def _linked(pairs: DataFrame, links: DataFrame | None, labels: DataFrame | None, docs: DataFrame, classes: DataFrame, words: int, percent: int, lean: bool) -> tuple[DataFrame, DataFrame]:
    """All links so far and their components.  Of the stored ``pairs`` (u, v, times) each v first meets the u with which it
    shares most buckets; the others are verified only if that has not connected them already."""
    best = Window.partitionBy("v").orderBy(F.col("times").desc(), "u")
    first = stored(pairs.withColumn("i", F.row_number().over(best)).where("i = 1").select("u", "v"))
    for turn in range(2):
        if turn:
            side = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
            rest = pairs.select("u", "v").join(first, ["u", "v"], "left_anti").join(side("u"), "u", "left").join(side("v"), "v", "left")
            before, first = first, stored(rest.where(F.coalesce("lu", "u") != F.coalesce("lv", "v")).select("u", "v"))
            if lean:
                released(docs.sparkSession, before)
        if links is not None and first.isEmpty():
            continue
        sets = _participants(docs, classes, first.select(F.col("u").alias("cls")).union(first.select("v")).distinct(), words)
        found = _verified(first, sets, percent)
        links = stored(found if links is None else links.unionByName(found))
        if lean:
            released(docs.sparkSession, sets)
        labels = components(links, lean)
    return links, labels


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs that share buckets enough, and whose sizes and sketches allow the similarity."""

    def run(frames):
        for x in frames:
            if len(x):
                at = np.arange(len(x))
                far = _apart(np.append(x["su"].to_numpy(), x["sv"].to_numpy()), at, at + len(x))
                x = x[(100 + percent) * far <= (100 - percent) * (x["nu"] + x["nv"]).to_numpy()]
            yield x[["u", "v", "times"]]

    sides = [classes.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "uv"]
    both = pairs.join(sides[0], "u").where(RARE * F.col("times") >= F.col("nu")).join(sides[1], "v").where(
        (100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")))
    return both.mapInPandas(run, "u long, v long, times long")


def _near(n: np.ndarray, label: np.ndarray, sketch: np.ndarray, side: np.ndarray | None, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one large bucket's members in different components (and blocks, if ``side`` is given) that sizes and sketches allow."""
    order = np.argsort(n, kind="stable")
    n, label, sketch = n[order], label[order], sketch[order]
    last = np.searchsorted(n * percent, n * 100, "right")
    size = np.fromiter(map(len, sketch), np.int64, len(sketch)) // 8  # ascends with n
    for words in np.unique(size):
        begin, end = np.searchsorted(size, [words, words + 1])
        x = _sketches(sketch[begin:last[end - 1]], int(words))
        for i in range(begin, end):
            to = np.flatnonzero(label[i + 1:last[i]] != label[i]) + i + 1
            if side is not None:
                to = to[side[order[to]] != side[order[i]]]
            if len(to):
                others = x[:, i + 1 - begin:last[i] - begin] if len(to) == last[i] - i - 1 else x[:, to - begin]
                far = np.bitwise_count(others ^ x[:, i - begin, None]).sum(0, dtype=np.int32)
                to = to[(100 + percent) * far <= (100 - percent) * (n[i] + n[to])]
                yield np.full(len(to), order[i]), order[to]


def _across(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket in different components that sizes and sketches allow; blocks of at most about BLOCK members
    meet in one task.  mixed: sig, cls, label, n, sketch, blocks."""
    cut = mixed.withColumn("i", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("a", F.least("i", F.col("j").cast("int"))).withColumn("b", F.greatest("i", F.col("j").cast("int")))

    def run(frames):
        import pandas as pd

        rest = None
        for x in itertools.chain(frames, [None]):
            if x is not None:
                x = x if rest is None else pd.concat([rest, x], ignore_index=True)
                if not len(x):
                    continue
                tail = (x[["sig", "a", "b"]] == x[["sig", "a", "b"]].iloc[-1]).all(axis=1).to_numpy()
                x, rest = x[~tail], x[tail]  # the last bucket may go on in the next batch
            else:
                x = rest
            if x is None or not len(x):
                continue
            sig, a, b, n, label, cls, i, sketch = (x[c].to_numpy() for c in ("sig", "a", "b", "n", "label", "cls", "i", "sketch"))
            starts = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            ends = np.append(starts[1:], len(x))
            end = np.repeat(ends, ends - starts)
            found, at = [], np.flatnonzero(np.repeat(ends - starts <= FEW, ends - starts))
            for shift in range(1, FEW):
                at = at[at + shift < end[at]]
                to = at + shift
                ok = (label[at] != label[to]) & ((a[at] == b[at]) | (i[at] != i[to]))
                ok &= 100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to])
                found.append((at[ok], to[ok]))
                if not len(at):
                    break
            l, r = (np.concatenate(side) for side in zip(*found))
            near = (100 + percent) * _apart(sketch, l, r) <= (100 - percent) * (n[l] + n[r])
            found = [(l[near], r[near])]
            for start, stop in zip(starts.tolist(), ends.tolist()):
                if stop - start > FEW:
                    one = slice(start, stop)
                    found += [(l + start, r + start) for l, r in _near(n[one], label[one], sketch[one], None if a[start] == b[start] else i[one], percent)]
            l, r = (np.concatenate(side) for side in zip(*found))
            if len(l):
                yield pd.DataFrame({"u": np.minimum(cls[l], cls[r]), "v": np.maximum(cls[l], cls[r])}).drop_duplicates()

    dealt = cut.select("sig", "a", "b", "i", "cls", "label", "n", "sketch").repartition("sig", "a", "b").sortWithinPartitions("sig", "a", "b")
    return dealt.mapInPandas(run, "u long, v long")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, lean: bool = False) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for each row of ``docs`` (doc_id, text).  ``lean``: with less
    disk: tables and shuffles go once what came of them is written."""
    with small_batches(docs.sparkSession, ROWS):
        rows, labels = _labelled(docs, words, percent, lean)
    named = rows.select("doc_id", "text_hash", "n_shingles", "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    named = named.withColumn("label", F.when(F.col("cls") != 0, F.coalesce("label", "cls")))
    names = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return named.join(names, "label", "left").select(
        "doc_id", "text_hash", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _labelled(docs: DataFrame, words: int, percent: int, lean: bool) -> tuple[DataFrame, DataFrame]:
    """The rows of ``signed`` and the component (node, label) of their classes, both stored."""
    rows = stored(signed(docs, words, percent))
    classes = rows.where("cls <> 0").groupBy("cls").agg(
        F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"),
        F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_hash")).alias("one")).select(
        "cls", "n", "sketch", "one.doc_id", "one.text_hash")
    bucket = Window.partitionBy("sig")
    members = _buckets(docs, words, percent).withColumn("hub", F.min("cls").over(bucket)).withColumn("most", F.max("cls").over(bucket))
    members = stored(members.where("hub <> most").select("sig", "cls", "hub").distinct())
    if lean:
        released(docs.sparkSession)
    known = members.select("sig", "cls", "hub", F.col("cls").alias("label"))
    stars, links, labels = None, None, None
    for turn in range(STARS):  # other hubs each time; members already linked to one are left out
        if turn:
            one = lambda i: F.min_by(F.struct("cls", "label"), F.xxhash64("cls", F.lit(i)))
            mixed = known.groupBy("sig").agg(F.array_distinct(F.array(*[one(i) for i in range(HUBS)])).alias("hubs"),
                                             F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
            known = known.drop("hub").join(mixed.select("sig", "hubs"), "sig").withColumn("h", F.explode("hubs")).where(
                "label <> h.label").select("sig", "cls", F.col("h.cls").alias("hub"), "label")
        pairs = known.where("cls <> hub").groupBy(F.least("hub", "cls").alias("u"), F.greatest("hub", "cls").alias("v")).agg(F.count(F.lit(1)).alias("times"))
        pairs = pairs if stars is None else pairs.join(stars, ["u", "v"], "left_anti")
        pairs = stored(_bounded(pairs, classes, percent))
        links, labels = _linked(pairs, links, labels, docs, classes, words, percent, lean)
        stars = pairs.select("u", "v") if stars is None else stars.unionByName(pairs.select("u", "v"))
        known = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))

    mixed = known.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("m"),
                                      F.bit_xor(F.xxhash64("cls")).alias("h"), F.sum(F.hash("cls").cast("long")).alias("g")).where("x <> y")
    mixed = mixed.groupBy("m", "h", "g", "x", "y").agg(F.min("sig").alias("sig"))  # buckets of the same members count once
    mixed = mixed.select("sig", F.ceil(F.col("m") / BLOCK).cast("long").alias("blocks"))
    mixed = known.join(mixed, "sig").join(classes.select("cls", "n", "sketch"), "cls")
    pairs = _across(mixed.select("sig", "cls", "label", "n", "sketch", "blocks"), percent)
    pairs = stored(pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("times")).join(stars, ["u", "v"], "left_anti"))
    _, labels = _linked(pairs, links, labels, docs, classes, words, percent, lean)
    return rows, stored(labels)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the one with the smallest doc_id; of rows repeated with
    their id and text one stays.  Rows without shingles or doc_id all stay."""
    found = jaccard_components(docs, words, percent, lean=True)
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    counts = found.groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.when(alone, F.lit(2)).when(F.col("doc_id") == F.col("component_id"), 1).otherwise(0)).alias("kind"))
    return repeated(docs, stored(counts.select("doc_id", "text_hash", "rows", F.when(F.col("kind") == 2, F.col("rows")).otherwise(
        F.col("kind").cast("long")).alias("times"))))
