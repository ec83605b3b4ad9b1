"""Joins on time that have no DataFrame operator of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _union(left: DataFrame, right: DataFrame, keys, on, values):
    """Both sides in one frame; ``_v`` holds the right row (null on left rows), right sorts first on a tie."""
    row = F.struct(F.col(on).alias("_on"), *[F.col(v) for v in values])
    r = right.select(*keys, F.col(on), row.alias("_v"), F.lit(0).alias("_side"))
    l = left.withColumn("_side", F.lit(1))
    return l.unionByName(r, allowMissingColumns=True)


def asof(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], on: str = "date",
         matched: str | None = None) -> DataFrame:
    """Last right row at or before each left row.  One shuffle on the keys; each key holds at most a calendar of rows."""
    both = _union(left, right, keys, on, values)
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_hit", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    extra = [F.col("_hit._on").alias(matched)] if matched else []
    return hit.select(*left.columns, *[F.col(f"_hit.{v}").alias(v) for v in values], *extra)


def asof_both(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], on: str = "date") -> DataFrame:
    """Left rows with structs ``before`` (last at or before) and ``after`` (first at or after) of the right side."""
    both = _union(left, right, keys, on, values)
    back = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead = looking back in the reversed order, which keeps the frame a cheap running one
    ahead = (Window.partitionBy(*keys).orderBy(F.desc(on), "_side").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("before", F.last("_v", ignorenulls=True).over(back)).withColumn(
        "after", F.last("_v", ignorenulls=True).over(ahead)
    )
    return out.where("_side = 1").select(*left.columns, "before", "after")


def asof_within(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], on: str = "date",
                back_days: int = 30, ahead_days: int = 14, fall_back_to_latest: bool = True,
                matched: str = "matched_date") -> DataFrame:
    """At or before within back_days, else after within ahead_days, else the newest row of the key (optional)."""
    out = asof_both(left, right, keys, values, on)
    near = F.when(F.datediff(F.col(on), F.col("before._on")) <= back_days, F.col("before"))
    next_ = F.when(F.datediff(F.col("after._on"), F.col(on)) <= ahead_days, F.col("after"))
    pick = F.coalesce(near, next_)
    if fall_back_to_latest:
        row = F.struct(F.col(on).alias("_on"), *[F.col(v) for v in values])
        newest = right.groupBy(*keys).agg(F.max_by(row, on).alias("_newest"))
        out = out.join(newest, keys, "left")
        pick = F.coalesce(pick, F.col("_newest"))
    out = out.withColumn("_pick", pick)
    return out.select(*left.columns, F.col("_pick._on").alias(matched), *[F.col(f"_pick.{v}").alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], on: str = "date",
            matched: str = "matched_date") -> DataFrame:
    """Right row with the smallest distance in days; the earlier one on a tie."""
    out = asof_both(left, right, keys, values, on)
    gap_b = F.datediff(F.col(on), F.col("before._on"))
    gap_a = F.datediff(F.col("after._on"), F.col(on))
    pick = F.when(gap_b.isNull() | (gap_a < gap_b), F.col("after")).otherwise(F.col("before"))
    out = out.withColumn("_pick", pick)
    return out.select(*left.columns, F.col("_pick._on").alias(matched), *[F.col(f"_pick.{v}").alias(v) for v in values])


def next_in_time(df: DataFrame, key: str, order: list[str], bucket, values: list[str], prefix: str = "next_") -> DataFrame:
    """Each row's successor within its key, for keys of any size.

    Rows are ordered inside (key, time bucket); only the first row of every
    bucket crosses to the bucket before it, so a hot key is spread over its buckets.
    """
    df = df.withColumn("_bucket", bucket)
    row = F.struct(*order, *[v for v in values if v not in order])
    firsts = df.groupBy(key, "_bucket").agg(F.min(row).alias("_first"))
    firsts = firsts.select(
        key, "_bucket", F.lead("_first").over(Window.partitionBy(key).orderBy("_bucket")).alias("_carry")
    )
    w = Window.partitionBy(key, "_bucket").orderBy(*order)
    out = df.withColumn("_n", F.lead(row).over(w)).join(firsts, [key, "_bucket"])
    nxt = F.coalesce(F.col("_n"), F.col("_carry"))
    out = out.withColumn("_n", nxt)
    return out.select(*[c for c in df.columns if c != "_bucket"], *[F.col(f"_n.{v}").alias(prefix + v) for v in values])
