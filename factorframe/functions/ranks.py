"""Ranks and exact quantiles of groups of any size.

A window over a whole cross-section sends it to one task, and ``percentile``
keeps every distinct value of a group in one buffer.  Here equal values are
counted first (map-side combine, so ties collapse), every group is cut into
value buckets, and ordering happens per bucket.  A value is a cut if its hash
says so, which holds in every evaluation and on every machine; a bucket has
about ``PER_PART`` different values, so more data is more buckets, and a small
group is one.  The cuts only steer the split; ranks and quantiles are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Different values of a bucket on average.  Cuts are one value in as many: 30 MB for 10^12 different values.
PER_PART = 1 << 18


def _keyed(df: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), ["_all"])


def _number_below(cuts: Column, value: Column) -> Column:
    """How many of the sorted cuts are less than the value, by halving."""

    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        less = F.get(cuts, middle) < value
        return F.struct(F.when(less, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(less, s["hi"]).otherwise(middle).alias("hi"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), halve, lambda s: s["lo"])
    return F.when(cuts.isNull(), 0).otherwise(found)


def _tag_buckets(df: DataFrame, by: list[str], value: str, single: bool) -> DataFrame:
    picked = F.pmod(F.xxhash64(value), F.lit(PER_PART)) == 0
    cuts = df.where(picked).groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("_cuts"))  # no row for a group without cuts
    if single:  # at most one row, of the size stated above
        cuts = F.broadcast(cuts)
    return df.join(cuts, by, "left").withColumn("_bucket", _number_below(F.col("_cuts"), F.col(value))).drop("_cuts")


def ordered_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per (by, value): ``n`` rows have it, ``before`` have less, ``total`` in the group (nulls left out)."""
    single = not by
    df, keys = _keyed(df, by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    tagged = _tag_buckets(counts, keys, value, single)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_size"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_offset"),
        F.sum("_size").over(Window.partitionBy(*keys)).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = (
        tagged.withColumn("_upto", F.sum("n").over(inside))
        .join(sizes, keys + ["_bucket"])
        .select(*keys, value, "n", (F.col("_offset") + F.col("_upto") - F.col("n")).alias("before"), "total")
    )
    return out.drop("_all")


def rank_columns(df: DataFrame, by: list[str], value: str, **outputs: Column) -> DataFrame:
    """Join expressions over (n, before, total) back to the rows; null values get null."""
    stats = ordered_counts(df, by, value).select(*by, value, *[e.alias(o) for o, e in outputs.items()])
    return df.join(stats, by + [value], "left")


def average_rank() -> Column:
    return F.col("before") + (F.col("n") + 1) / 2


def percent_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Average-method rank / count of non-null values, in (0, 1]."""
    return rank_columns(df, by, value, **{name: average_rank() / F.col("total")})


def quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float], calendar_bound=False) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one row per group.

    ``calendar_bound`` says that a group has at most one row per day (a symbol's
    bars, a strategy's returns); such groups fit the buffer of ``percentile``.
    """
    if calendar_bound:
        at = F.lit(list(probs.values()))
        got = df.groupBy(*by).agg(F.percentile(value, at).alias("_q"))
        return got.select(*by, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    oc = ordered_counts(df, by, value)
    aggs = []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("total") - 1)
        pick = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col(value)))
        lo, hi = pick(F.floor(at)), pick(F.ceil(at))
        frac = F.max(at - F.floor(at))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return oc.groupBy(*by).agg(*aggs)


def row_numbers(df: DataFrame, by: list[str], value: str, ties: list[str], name: str = "row_num") -> DataFrame:
    """Exact row_number over (by order by value, ties) without a single-task sort; value must not be null.  Buckets are cut at
    (value, ties), so the rows of one value are split as well."""
    single = not by
    df, keys = _keyed(df, by)
    tagged = _tag_buckets(df.withColumn("_order", F.struct(value, *ties)), keys, "_order", single)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(upto), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value, *ties)
    return (
        tagged.withColumn("_rn", F.row_number().over(inside))
        .join(sizes, keys + ["_bucket"])
        .withColumn(name, F.col("_rn") + F.col("_offset"))
        .drop("_rn", "_offset", "_bucket", "_all", "_order")
    )


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, name: str | None = None) -> DataFrame:
    """First n rows of every group; Spark cuts each partition to n per group before the shuffle."""
    if not by:
        out = df.orderBy(*order).limit(n)
        return out
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn(name or "_top", F.row_number().over(w)).where(F.col(name or "_top") <= n)
    return out if name else out.drop("_top")


def with_group_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Attach group aggregates to every row: partial aggregation, then a join AQE may broadcast or split."""
    if not by:  # the totals are one row
        totals = df.agg(*[e.alias(k) for k, e in aggs.items()]).withColumn("_all", F.lit(0))
        return df.withColumn("_all", F.lit(0)).join(F.broadcast(totals), "_all").drop("_all")
    return df.join(df.groupBy(*by).agg(*[e.alias(k) for k, e in aggs.items()]), by)
