"""Mixing sources to target weights by weighted fair queueing (operator 2, DataFrame operations only).

Every shuffled document gets a virtual finish time: the cumulative words of its source divided by the source's target.
All documents are sorted by that time over the whole mix and the list is cut at the total budget, so every source ends
within one document of its target.  A source whose target is above its size is queued again, up to ``most`` times.

Sources weigh 1, 2, 3, repeating in code-point order with null last; targets share the budget by weight, stop at
``most`` times the source's size, and the excess goes to the others by weight (found in one pass: sources ordered by
ceiling per weight; those under the water level take their ceiling).

Hot sources: running sums go over range-dealt parts, so a source with a third of all rows is a third of all tasks.

Defined results: null, empty and wordless texts have size 0 and are never taken; a source of such texts has target 0;
null is a source of its own; repeated rows queue separately; ties in the shuffle go by doc_id, then size; other columns
pass through ``mixed`` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.llm.common import WORD, ordered, repeated, running, stored


def targets(sizes: DataFrame, most: int = 3) -> DataFrame:
    """source, source_size, place, target from one row a source (source, source_size)."""
    by_name = [F.col("source").asc_nulls_last()]
    placed = running(ordered(sizes, by_name), [], by_name, F.lit(1).cast("long"), "place")
    placed = placed.select("source", "source_size", "place", ((F.col("place") - 1) % 3 + 1).cast("double").alias("weight"))
    placed = placed.withColumn("ceiling", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    dealt = ordered(placed, [F.col("ratio"), F.col("place")])
    whole = dealt.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    budget, weights = float(whole["n"] or 0), float(whole["w"] or 0)
    order = [F.col("ratio"), F.col("place")]
    dealt = running(running(dealt, [], order, F.col("ceiling"), "caps"), [], order, F.col("weight"), "weighed")
    level = F.try_divide(budget - (F.col("caps") - F.col("ceiling")), weights - (F.col("weighed") - F.col("weight")))
    dealt = stored(dealt.withColumn("capped", F.col("ratio") <= level))
    used = dealt.where("capped").agg(F.sum("ceiling").alias("c"), F.sum("weight").alias("w")).first()
    left = weights - float(used["w"] or 0)
    share = (budget - float(used["c"] or 0)) / left if left else 0.0
    return dealt.select("source", "source_size", "place", F.when(F.col("capped"), F.col("ceiling")).otherwise(
        F.least("ceiling", F.col("weight") * share)).alias("target"))


def mix(docs: DataFrame, seed: int = 7, most: int = 3) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, taken, copies for each row of ``docs`` (doc_id, text, source)."""
    thin = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64("text").alias("text_hash"),
                              F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    goals = targets(thin.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    goals = stored(goals.withColumnRenamed("source", "_source"))
    thin = thin.join(goals, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "text_hash", "size", "place", "source_size", "target", F.xxhash64("doc_id", F.lit(seed)).alias("turn"))
    order = [F.col(c) for c in ("turn", "doc_id", "size", "text_hash")]
    queue = running(ordered(thin, [F.col("place"), *order]), ["place"], order, F.col("size"), "done")
    again = F.least(F.lit(most - 1), F.floor(F.try_divide("target", "source_size"))).cast("int")
    queue = stored(queue.withColumn("again", F.when((F.col("size") > 0) & (F.col("target") > 0), again).otherwise(F.lit(-1))))

    work = lambda turn: turn * F.col("source_size") + F.col("done")
    copies = queue.where("again >= 0").select("size", "place", "target", "source_size", "done", F.explode(F.sequence(F.lit(0), F.col("again"))).alias("turn"))
    copies = copies.select("size", "place", work(F.col("turn").cast("long")).alias("work"), "target")
    copies = copies.withColumn("finish", F.try_divide("work", "target")).drop("target")
    line = [F.col(c) for c in ("finish", "place", "work")]
    line_up = running(ordered(copies, line), [], line, F.col("size"), "total")
    budget = goals.agg(F.sum("source_size")).first()[0] or 0
    cut = line_up.where(F.col("total") <= budget).agg(F.max(F.struct(*line)).alias("x")).first()["x"]

    taken = F.lit(0)
    if cut is not None:
        last = F.struct(F.lit(float(cut["finish"])), F.lit(int(cut["place"])).cast("long"), F.lit(int(cut["work"])).cast("long"))
        for turn in range(most):
            now = work(F.lit(turn).cast("long"))
            taken = taken + F.when((F.col("again") >= turn) & (F.struct(F.try_divide(now, F.col("target")), F.col("place"), now) <= last), 1).otherwise(0)
    return queue.withColumn("copies", taken.cast("long")).select(
        "doc_id", "text_hash", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = 7, most: int = 3) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them."""
    counts = mix(docs, seed, most).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("times"))
    return repeated(docs, stored(counts))
