"""Merkle manifest of a dataset by bitmap-rank indexing (operator 11).

Every document is a leaf; the leaves of a language form a tree, the subroots of the languages form another one on top.
A leaf's place is found by rank, not by sorting documents:

* ids become compressed bitmaps, one row for each (language, 64 ids) that occurs, merged with ``bit_or`` map-side;
* a popcount directory gives each word the number of documents before it: running sums over superblocks of 1,024 words,
  then within the superblock;
* a document's slot is its word's figure plus the popcount of the bits below its own.

Slots are then keyed arrays: ``block`` neighbouring slots meet in one task, which puts each digest at its slot and
reduces all levels that the block covers; the few remaining digests go on in the same way.  Proofs come back from
the top: a block's path to the root is one row, joined to the block's slots, so no path is stored for each document.

Hot languages are as many blocks as they have; superblock sums go over range-dealt parts.  A word whose ids repeat is
ordered by (id, digest) in range-dealt parts, so one id on a third of all rows is not one task.

Defined results: a null field is ``-``, another its UTF-8 byte count, ``:`` and value; null ids come first in their
language and are never tampered with; rows with one id are ordered by digest, equal rows are leaves of their own; null
is a language of its own, before all others; empty texts count 0 bytes; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm.common import ordered, running, stored

#: Children of a node, and slots that meet in one task (a power of the former).
FAN, BLOCK = 2, 4096
#: Word number of the documents without an id: below those of all ids.
NO_ID = -(1 << 58)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column | None = None) -> Column:
    """Digest of a row of documents (32 bytes); ``n_chars`` stands for the column of that name."""
    values = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") if n_chars is None else n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256))


def ranked(leaves: DataFrame) -> DataFrame:
    """Adds ``slot`` (place in the group from 0) and ``width`` (leaves of the group) to ``leaves`` (g, doc_id, leaf, ...)."""
    keyed = leaves.withColumn("_word", F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_ID))).withColumn(
        "_bit", F.coalesce(F.col("doc_id").bitwiseAND(63), F.lit(0)).cast("int"))
    words = stored(keyed.groupBy("g", "_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("bits"), F.count(F.lit(1)).alias("n")))

    words = words.withColumn("_super", F.shiftright("_word", 10))
    held = words.groupBy("g", "_super").agg(F.sum("n").alias("held"))
    base = running(ordered(held, [F.col("g"), F.col("_super")]), ["g"], [F.col("_super")], F.col("held"), "upto")
    inside = Window.partitionBy("g", "_super").orderBy("_word").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("upto") - F.col("held") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    directory = words.join(base.select("g", "_super", "upto", "held"), ["g", "_super"]).withColumn("before", before)
    directory = directory.join(words.groupBy("g").agg(F.sum("n").alias("width")), "g")
    directory = stored(directory.select("g", "_word", "bits", "before", "width", (F.col("n") > F.bit_count("bits")).alias("crowded")))

    found = keyed.join(directory, ["g", "_word"])
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, _bit)"))
    columns = [*leaves.columns, "slot", "width"]
    out = found.where("not crowded").withColumn("slot", F.col("before") + below).select(*columns)
    if not directory.where("crowded").isEmpty():  # ids on several rows: a bit for each id does not tell them apart
        many = found.where("crowded").withColumn("_row", F.monotonically_increasing_id())
        order = [F.col(c) for c in ("_bit", "leaf", "_row")]
        many = running(ordered(many, [F.col("g"), F.col("_word"), *order]), ["g", "_word"], order, F.lit(1).cast("long"), "place")
        out = out.unionByName(many.withColumn("slot", F.col("before") + F.col("place") - 1).select(*columns))
    return out


# ---- slot arrays, inside tasks ------------------------------------------------------------------------------------


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(frame, block: int, fan: int) -> list[list[str]]:
    """Digests of one slot array, level by level, from its rows (slot, width, digest)."""
    width, start = int(frame["width"].iloc[0]), int(frame["slot"].min()) // block * block
    slots: list = [None] * min(block, width - start)
    for at, digest in zip(frame["slot"].tolist(), frame["digest"]):
        slots[at - start] = bytes(digest).hex()
    out, covered = [slots], 1
    while width > 1 and covered < block:
        out.append([_sha("".join(out[-1][i:i + fan])) for i in range(0, len(out[-1]), fan)])
        width, covered = -(-width // fan), covered * fan
    return out


def _path(levels: list[list[str]], at: int, fan: int) -> list[tuple[str, str]]:
    """What stands left and right of the node in its run, for each level of the array."""
    out = []
    for nodes in levels[:-1]:
        run = at // fan * fan
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1:run + fan])))
        at //= fan
    return out


def _written(path) -> str:
    return "".join(f"{a}|{b};" for a, b in path)


def _read(path: str) -> list[list[str]]:
    return [p.split("|") for p in path.split(";")[:-1]]


def fold(digest: str, path) -> str:
    """The root that a digest and its siblings give."""
    for a, b in path:
        digest = _sha(a + digest + b)
    return digest


def reduced(nodes: DataFrame, block: int = BLOCK, fan: int = FAN) -> list[DataFrame]:
    """All stages of the trees over ``nodes`` (g, slot, width, digest): the last has one node a group, its root."""
    power = fan
    while power < block:
        power *= fan
    if power != block or fan < 2:
        raise ValueError("block must be a power of fan")

    def step(frame):
        import pandas as pd

        top = _levels(frame, block, fan)[-1]
        width = -(-int(frame["width"].iloc[0]) // block)
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "slot": [int(frame["slot"].min()) // block], "width": [width], "digest": [bytes.fromhex(top[0])]})

    stages = [nodes]
    while (stages[-1].agg(F.max("width")).first()[0] or 1) > 1:
        keyed = stages[-1].select("g", "slot", "width", "digest", F.expr(f"slot div {block}").alias("_block"))
        stages.append(stored(keyed.groupBy("g", "_block").applyInPandas(step, "g string, slot long, width long, digest binary")))
    return stages


def paths(stages: list[DataFrame], tops: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """(g, slot, path, subroot, root) for the slot arrays of the first stage, a row each; ``tops``: the same for the last."""

    def step(key, nodes, above):
        import pandas as pd

        levels, up = _levels(nodes, block, fan), above.iloc[0]
        start = int(nodes["slot"].min()) // block * block
        own = [_written(_path(levels, i, fan)) + up["path"] for i in range(len(levels[0]))]
        return pd.DataFrame({"g": key[0], "slot": range(start, start + len(own)), "path": own, "subroot": up["subroot"], "root": up["root"]})

    for stage in reversed(stages[1:-1]):
        left = stage.select("g", "slot", "width", "digest", F.expr(f"slot div {block}").alias("_block"))
        tops = left.groupBy("g", "_block").cogroup(tops.withColumnRenamed("slot", "_block").groupBy("g", "_block")).applyInPandas(
            step, "g string, slot long, path string, subroot string, root string")
    return tops


def manifest(docs: DataFrame, claim: Column | None = None, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """doc_id, lang, slot, leaf, subroot, root, proof (``left|right;`` for each level), proof_sha256, folded_root, verified
    for each row of ``docs`` (doc_id, source, lang, n_chars, text).  ``claim``: the leaf to be verified with the proof
    where it is not null, as ``leaf(...)`` gives it; else the leaf itself is."""
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # null sorts first
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text", group.alias("g"))
    claim = F.lit(None).cast("binary") if claim is None else claim
    leaves = stored(thin.select("doc_id", "g", leaf().alias("leaf"), claim.alias("claim")))
    placed = stored(ranked(leaves).withColumn("digest", F.col("leaf")))

    stages = reduced(placed.select("g", "slot", "width", "digest"), block, fan)
    subroots = stages[-1].select("g", "digest")
    line = running(ordered(subroots, [F.col("g")]), [], [F.col("g")], F.lit(1).cast("long"), "place")
    crown = stored(line.select(F.lit("").alias("g"), (F.col("place") - 1).alias("slot"), "digest", F.col("g").alias("of")))
    crown = crown.withColumn("width", F.lit(crown.count()).cast("long"))
    tops = reduced(crown.select("g", "slot", "width", "digest"), block, fan)
    root = F.lower(F.hex("digest")).alias("root")
    upper = paths(tops, tops[-1].select("g", "slot", F.lit("").alias("path"), F.lit("").alias("subroot"), root), block, fan)

    def crowned(key, nodes, above):
        import pandas as pd

        levels, up = _levels(nodes, block, fan), above.iloc[0]
        start = int(nodes["slot"].min()) // block * block
        own = [_written(_path(levels, int(s) - start, fan)) + up["path"] for s in nodes["slot"]]
        return pd.DataFrame({"g": nodes["of"], "slot": 0, "path": own, "subroot": [bytes(x).hex() for x in nodes["digest"]], "root": up["root"]})

    def climbed(of: DataFrame, down: DataFrame, fn, schema: str, lone: bool) -> DataFrame:
        """Slot arrays of ``of`` with the rows of what stands above them; ``lone``: every tree is a single node."""
        at = F.col("slot") if lone else F.expr(f"slot div {block}")
        left = of.withColumn("_block", at).groupBy("g", "_block")
        return left.cogroup(down.withColumnRenamed("slot", "_block").groupBy("g", "_block")).applyInPandas(fn, schema)

    low = climbed(crown, upper, crowned, "g string, slot long, path string, subroot string, root string", len(tops) == 1)
    low = stored(paths(stages, low, block, fan))

    def proved(key, nodes, above):
        import pandas as pd

        levels, up = _levels(nodes, block, fan), above.iloc[0]
        start, high = int(nodes["slot"].min()) // block * block, _read(up["path"])
        plain, known = "".join(a + b for a, b in high), {}
        rows = []
        for doc_id, slot, digest, told in zip(nodes["doc_id"], nodes["slot"].tolist(), nodes["digest"], nodes["claim"]):
            own = _path(levels, slot - start, fan)
            mine = bytes(digest).hex()
            near = fold(mine if told is None else bytes(told).hex(), own)
            if near not in known:  # equal digests fold alike from here on
                known[near] = fold(near, high)
            rows.append((doc_id, key[0], slot, mine, up["subroot"], up["root"], _written(own) + up["path"],
                         _sha("".join(a + b for a, b in own) + plain), known[near], known[near] == up["root"]))
        return pd.DataFrame(rows, columns=["doc_id", "g", "slot", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"])

    schema = ("doc_id string, g string, slot long, leaf string, subroot string, root string, proof string, proof_sha256 string, "
              "folded_root string, verified boolean")
    thin = placed.select("g", "slot", "width", "digest", "claim", F.col("doc_id").cast("string").alias("doc_id"))
    out = climbed(thin, low, proved, schema, len(stages) == 1)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("g") != "-", F.expr("substring(g, 2)")).alias("lang"),
                      *[c for c in out.columns if c not in ("doc_id", "g")])


def tampered(every: int = 7) -> Column:
    """The leaf of a row whose ``n_chars`` was raised by one, where ``every`` divides the crc32 of the id; else null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return F.when(chosen, leaf((F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")))
