"""Sharding by balanced label propagation (operator 9, DataFrame operations only).

Linked documents (equal texts) move towards the shard where most of their neighbours are.  Documents start in the shard
of their id's hash.  In each round a group's smaller blocks ask to join its largest block whose shard has room; requests
are granted in order of gain while the shard's quota lasts, the last one in part, so no shard ever gets more linked
documents than it may hold.  Rounds end when nothing moves.  Documents without a link fill what is left, so the law
``rows`` holds exactly: shard sizes differ by at most one row.

The state is one row for each (group, shard), never one for each link; a group that holds a third of all rows is at most
``shards`` rows of it.  Positions come from running sums over range-dealt parts, so no group or shard is one task.

Defined results: null texts have no links, empty texts are equal texts; null texts count 8 bytes and crc32 0; repeated
rows are separate members; null ids are allowed; fewer documents than shards leave shards empty; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.llm.common import ordered, running, stored

#: Rounds at most; a group larger than one shard fills one shard a round.
ROUNDS = 30


def _at(values: list[int], label: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), label + 1)


def _loads(blocks: DataFrame, shards: int) -> list[int]:
    held = {r["label"]: r["n"] for r in blocks.groupBy("label").agg(F.sum("n").alias("n")).collect()}  # one row a shard
    return [int(held.get(b, 0)) for b in range(shards)]


def propagate(blocks: DataFrame, room: list[int]) -> DataFrame:
    """(key, label, n) after balanced label propagation; ``room``: linked documents that each shard may hold."""
    shards = len(room)
    blocks = stored(blocks)
    for _ in range(ROUNDS):
        quota = [max(0, r - x) for r, x in zip(room, _loads(blocks, shards))]
        if not any(quota):
            return blocks
        weight = F.struct(F.col("n"), F.xxhash64("key", "label"))
        group = Window.partitionBy("key")
        open_label = F.when(_at(quota, F.col("label")) > 0, weight)
        asked = (blocks.withColumn("most", F.max(open_label).over(group))
                 .withColumn("to", F.max_by("label", open_label).over(group))
                 .where(F.col("most").isNotNull() & (weight < F.col("most")))
                 .select("key", "label", "n", "to", (-F.col("most.n")).alias("rank")))
        asked = ordered(asked, [F.col(c) for c in ("to", "rank", "key", "label")])
        order = [F.col(c) for c in ("rank", "key", "label")]
        granted = running(asked, ["to"], order, F.col("n"), "sum").withColumn(
            "moved", F.greatest(F.lit(0), F.least(F.col("n"), _at(quota, F.col("to")) - (F.col("sum") - F.col("n")))))
        granted = stored(granted.where("moved > 0").select("key", "label", "to", "moved"))
        if granted.isEmpty():
            return blocks
        changes = granted.select("key", "label", (-F.col("moved")).alias("n")).unionByName(
            granted.select("key", F.col("to").alias("label"), F.col("moved").alias("n")))
        blocks = stored(blocks.unionByName(changes).groupBy("key", "label").agg(F.sum("n").alias("n")).where("n > 0"))
    return blocks


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(F.col("text").cast("binary")).alias("key"))
    dealt = ordered(thin, [F.col("key"), F.col("doc_id")])
    total = dealt.count()
    room = [total // shards + (b < total % shards) for b in range(shards)]

    start = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    blocks = dealt.where("key is not null").groupBy("key", start.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    linked = blocks.groupBy("key").agg(F.sum("n").alias("all")).where("all > 1").select("key")
    blocks = propagate(blocks.join(linked, "key", "left_semi"), room)

    # what a shard was given beyond its room at the start joins the documents without links
    by_size = [F.col("rank"), F.col("key")]
    kept = ordered(blocks.withColumn("rank", -F.col("n")), [F.col("label"), *by_size])
    kept = running(kept, ["label"], by_size, F.col("n"), "sum").withColumn("base", F.col("sum") - F.col("n"))
    kept = kept.withColumn("n", F.greatest(F.lit(0), F.least(F.col("n"), _at(room, F.col("label")) - F.col("base")))).where("n > 0")
    kept = stored(kept.select("key", "label", "n", "base"))
    held = _loads(kept, shards)
    run = Window.partitionBy("key").orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    ranges = kept.withColumn("to", F.sum("n").over(run)).groupBy("key").agg(
        F.collect_list(F.struct(F.col("label"), (F.col("to") - F.col("n")).alias("from"), "to", "base")).alias("ranges"))  # a row a shard at most
    ranges = stored(ranges)

    # places first, the map after: the join may then split a hot group
    member = running(dealt, ["key"], [F.col("doc_id"), F.col("size")], F.lit(1).cast("long"), "place").withColumn("place", F.col("place") - 1)
    own = F.try_element_at(F.filter("ranges", lambda r: (r["from"] <= F.col("place")) & (F.col("place") < r["to"])), F.lit(1))
    placed = stored(member.join(ranges, "key", "left").withColumn("own", own).select(
        "doc_id", "size", "text_crc32", "key", "_part", F.col("own.label").alias("shard"), (F.col("own.base") + F.col("place") - F.col("own.from")).alias("slot")))
    free = running(placed.where("shard is null").drop("shard", "slot"), [], [F.col("key"), F.col("doc_id"), F.col("size")], F.lit(1).cast("long"), "place")
    ends, at = [], 0
    for b in range(shards):
        at += room[b] - held[b]
        ends.append(at)
    place = F.col("place") - 1
    free = free.withColumn("shard", F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= place)))
    starts = [e - (room[b] - held[b]) - held[b] for b, e in enumerate(ends)]
    free = free.withColumn("slot", place - _at(starts, F.col("shard")))
    columns = ["doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
               F.lit(None).cast("int").alias("grown_shard")]
    return placed.where("shard is not null").select(*columns).unionByName(free.select(*columns))
