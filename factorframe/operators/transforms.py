"""Time-series transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.functions import pairs, ranks
from factorframe.functions.windows import (
    c, change, compounded, lagged, log_change, ordered, ratio, rolling_max, rolling_mean, rolling_min, rolling_ranks,
    rolling_std, running, whole,
)


def returns(bars: DataFrame, method: str = "simple", col="close", name="ret") -> DataFrame:
    """P1."""
    return bars.withColumn(name, {"simple": change, "log": log_change}[method](col))


def scaled_volatility(df: DataFrame, n=252, col="ret", name="volatility") -> DataFrame:
    """Rolling deviation times the root of the window."""
    return df.withColumn(name, rolling_std(col, n) * n**0.5)


def normalize(df: DataFrame, col: str, method: str, by=("symbol",), name="normalized") -> DataFrame:
    """Zscore, minmax or robust (median and MAD), over groups of any size."""
    by = list(by)
    if method == "zscore":
        out = ranks.with_group_stats(df, by, _a=F.avg(col), _s=F.stddev_samp(col))
        return out.withColumn(name, ratio(c(col) - c("_a"), "_s")).drop("_a", "_s")
    if method == "minmax":
        out = ranks.with_group_stats(df, by, _a=F.min(col), _s=F.max(col))
        return out.withColumn(name, ratio(c(col) - c("_a"), c("_s") - c("_a"))).drop("_a", "_s")
    if method == "robust":
        out = _attach(df, mad_table(df, col, by), by)
        return out.withColumn(name, ratio(c(col) - c("_med"), "_mad")).drop("_med", "_mad")
    raise ValueError(f"unknown method {method!r}")


def mad_table(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Median ``_med`` and median absolute deviation ``_mad`` per group."""
    bound = by in (["symbol"], ["strategy"])  # at most a calendar of rows each
    med = ranks.quantiles(df, by, col, {"_med": 0.5}, bound)
    dev = _attach(df.select(*by, col), med, by).withColumn("_dev", F.abs(c(col) - c("_med")))
    return _attach(med, ranks.quantiles(dev, by, "_dev", {"_mad": 0.5}, bound), by)


def _attach(df, table, by):
    if by:
        return df.join(table, by)
    return df.withColumn("_all", F.lit(0)).join(F.broadcast(table.withColumn("_all", F.lit(0))), "_all").drop("_all")


def fill(df: DataFrame, col: str, method: str, keys=("symbol",), order="date", name=None) -> DataFrame:
    """forward_fill, backward_fill, interpolate (by row, flat after the last value) or drop; never across keys."""
    name = name or col
    if method == "drop":
        return df.where(c(col).isNotNull())
    back = running(keys, [order])
    ahead = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    if method == "forward_fill":
        return df.withColumn(name, F.last(col, True).over(back))
    if method == "backward_fill":
        return df.withColumn(name, F.last(col, True).over(ahead))
    if method == "interpolate":
        out = df.withColumn("_i", F.row_number().over(ordered(keys, [order])))
        at = F.when(c(col).isNotNull(), F.struct("_i", c(col).alias("v")))
        out = out.withColumn("_at", at)
        out = out.withColumn("_b", F.last("_at", True).over(back)).withColumn("_n", F.last("_at", True).over(ahead))
        step = (c("_i") - c("_b._i")) / F.nullif(c("_n._i") - c("_b._i"), F.lit(0))
        value = F.coalesce(c(col), c("_b.v") + (c("_n.v") - c("_b.v")) * step, F.when(c("_n").isNull(), c("_b.v")))
        return out.withColumn(name, value).drop("_i", "_at", "_b", "_n")
    raise ValueError(f"unknown method {method!r}")


def null_policy(df: DataFrame, cols: list[str], medians: DataFrame | None = None, max_null=0.95, keys=("symbol",),
                order="date") -> DataFrame:
    """P5: drop nearly empty columns, fill forward then backward per symbol, then the learned median, then 0; clip.

    ``medians`` is a fitted table (feature, median), see ``fit_medians``.
    """
    share = df.agg(*[F.avg(c(x).isNull().cast("double")).alias(x) for x in cols]).first()
    kept = [x for x in cols if share[x] is not None and share[x] <= max_null]
    out = df.drop(*[x for x in cols if x not in kept])
    for x in kept:
        out = fill(fill(out, x, "forward_fill", keys, order), x, "backward_fill", keys, order)
    learned: dict[str, float] = {}
    if medians is not None:  # one row per feature column
        learned = {r["feature"]: r["median"] for r in medians.where(c("feature").isin(kept)).collect()}
    for x in kept:
        v = F.when(c(x) == float("inf"), 1e10).when(c(x) == float("-inf"), -1e10).otherwise(F.nanvl(c(x), F.lit(None)))
        v = F.coalesce(v, F.lit(learned.get(x)).cast("double"))
        out = out.withColumn(x, F.coalesce(F.greatest(F.least(v, F.lit(1e9)), F.lit(-1e9)), F.lit(0.0)))
    return out


def fit_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5, fitting: exact median per feature."""
    return ranks.quantiles(long_form(df, [], cols), ["feature"], "value", {"median": 0.5})


def long_form(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    return df.select(*ids, *[c(x).cast("double").alias(x) for x in cols]).unpivot(ids, cols, "feature", "value")


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """P6, fitting: mean and population deviation per feature."""
    return long_form(df, [], cols).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def scale(long: DataFrame, scaler: DataFrame) -> DataFrame:
    """(value - mean) / std of a long frame; a constant feature is only centred."""
    out = long.join(scaler, "feature")
    by = F.when(c("std") > 0, c("std")).otherwise(1.0)
    return out.withColumn("scaled", (c("value") - c("mean")) / by).drop("mean", "std")


def resample(df: DataFrame, unit: str, outputs: dict[str, tuple[str, str]], keys=("symbol",), order="date") -> DataFrame:
    """Per calendar unit (week, month, quarter, year), ``outputs = {name: (last | first | mean | sum, column)}``."""
    pick = {"last": lambda x: F.max_by(x, order), "first": lambda x: F.min_by(x, order), "mean": F.avg, "sum": F.sum}
    bucket = F.to_date(F.date_trunc(unit, c(order)))
    return df.groupBy(*keys, bucket.alias("period")).agg(*[pick[how](x).alias(name) for name, (how, x) in outputs.items()])


def lags(df: DataFrame, cols: list[str], ks: list[int]) -> DataFrame:
    """P8."""
    return df.select("*", *[lagged(x, k).alias(f"{x}_lag_{k}") for x in cols for k in ks])


def period_returns(df: DataFrame, periods=(21, 63, 252), col="close", prefix="return") -> DataFrame:
    """P9."""
    return df.select("*", *[change(col, p).alias(f"{prefix}_{p}d") for p in periods])


def rolling_statistics(df: DataFrame, cols: list[str], n: int, stats=("mean", "std")) -> DataFrame:
    """P10."""
    how = {"mean": rolling_mean, "std": rolling_std, "min": rolling_min, "max": rolling_max}
    return df.select("*", *[how[s](x, n).alias(f"{x}_rolling_{s}_{n}") for x in cols for s in stats])


def rank_features(df: DataFrame, cols: list[str], windows=(20, 60, 252)) -> DataFrame:
    """P11."""
    return rolling_ranks(df, {f"{x}_rank_{n}d": (x, n, n) for x in cols for n in windows})


def drawdown(df: DataFrame, col="daily_return", keys=("strategy",), order="date") -> DataFrame:
    """cumulative_return, peak, drawdown."""
    w = running(keys, [order])
    out = df.withColumn("cumulative_return", compounded(col, w))
    out = out.withColumn("peak", F.max("cumulative_return").over(w))
    return out.withColumn("drawdown", ratio(c("cumulative_return") - c("peak"), "peak"))


def forward_return(df: DataFrame, n=21, col="close", name="target") -> DataFrame:
    """P13."""
    return df.withColumn(name, ratio(F.lead(col, n).over(ordered()), col) - 1)


def forward_compounded(df: DataFrame, n=21, col="r", name="forward_return") -> DataFrame:
    """Compounded return of the next n rows, null unless all n exist."""
    w = ordered().rowsBetween(1, n)
    return df.withColumn(name, F.when(F.count(col).over(w) == n, compounded(col, w) - 1))


def momentum_block(df: DataFrame) -> DataFrame:
    """P15."""
    out = df.withColumn("returns_1d", change("close"))
    out = out.select("*", *[rolling_mean("returns_1d", n).alias(f"returns_{n}d") for n in (5, 21, 63, 252)])
    return out.select(
        "*", F.abs("returns_21d").alias("momentum_strength_21d"), F.abs("returns_63d").alias("momentum_strength_63d"),
        (c("returns_21d") - c("returns_63d")).alias("momentum_acceleration"),
        *[change("close", n).alias(f"momentum_{n}d") for n in (21, 63, 252)],
    )


def volume_block(df: DataFrame) -> DataFrame:
    """P16."""
    out = df.select(
        "*", (change("close") * c("volume")).alias("_v"),
        F.coalesce(F.signum(c("close") - lagged("close")) * c("volume"), F.lit(0.0)).alias("_o"),
        rolling_mean("volume", 20).alias("_vm"), rolling_mean("close", 20).alias("_cm"),
    )
    out = out.withColumn("_vpt", F.when(c("_v").isNotNull(), F.sum("_v").over(running())))
    out = out.withColumn("_obv", F.sum("_o").over(running()))
    return out.select(
        *df.columns, change("_vpt", 21).alias("vpt_momentum"), change("_obv", 21).alias("obv_momentum"),
        F.coalesce((ratio("volume", "_vm") > 2.0).cast("int"), F.lit(0)).alias("volume_surge"),
        (change("_cm", 5) * change("_vm", 5)).alias("price_volume_divergence"),
    )


def balance(df: DataFrame, cols: list[str], method: str, symbols: DataFrame | None = None) -> DataFrame:
    """``intersection`` keeps dates on which every symbol has complete values, ``ffill`` fills a full grid,
    ``drop`` removes incomplete rows."""
    if method == "drop":
        return df.dropna(subset=cols)
    if method == "intersection":
        from factorframe.operators.align import common_dates

        return common_dates(df.dropna(subset=cols))
    if method == "ffill":
        from factorframe.operators.align import forward_fill_grid

        return forward_fill_grid(df, cols)
    raise ValueError(f"unknown method {method!r}")


def to_wide(df: DataFrame, value: str, columns: list[str], key="symbol", order="date") -> DataFrame:
    """One row per date; the wanted columns are named so that no extra pass looks for them."""
    return df.groupBy(order).pivot(key, columns).agg(F.first(value))


def to_long(df: DataFrame, columns: list[str], value: str, key="symbol", order="date") -> DataFrame:
    """P18, the way back."""
    return df.unpivot([order], columns, key, value).where(c(value).isNotNull())


def rebalance_bucket(frequency: str, d="date") -> Column:
    """Key of the rebalance period; weeks start on Monday and are split at New Year."""
    d = c(d)
    if frequency == "daily":
        return F.date_format(d, "yyyy-MM-dd")
    if frequency == "weekly":
        week = F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
        return F.concat_ws("-", F.year(d), F.lpad(week.cast("string"), 2, "0"))
    if frequency == "monthly":
        return F.date_format(d, "yyyy-MM")
    if frequency == "quarterly":
        return F.concat(F.year(d), F.lit("-Q"), F.quarter(d))
    raise ValueError(f"unknown frequency {frequency!r}")


def rebalance_dates(df: DataFrame, frequency: str, order="date") -> DataFrame:
    """Last available date of every period."""
    return df.groupBy(rebalance_bucket(frequency, order).alias("bucket")).agg(F.max(order).alias("rebalance_date"))


def correlation(df: DataFrame, value: str, method="pearson", key="symbol", order="date") -> DataFrame:
    """P20: (s1, s2, n, corr) for s1 <= s2, over the dates both names have."""
    if method == "pearson":
        return pairs.covariances(df, value, key, order).drop("cov")
    if method in ("spearman", "kendall"):
        return pairs.rank_correlations(df, value, method, key, order)
    raise ValueError(f"unknown method {method!r}")


def derived_bar_columns(bars: DataFrame, doji=0.1) -> DataFrame:
    """P21."""
    body, span = F.abs(c("close") - c("open")), c("high") - c("low")
    return bars.select(
        "*", ((c("high") + c("low") + c("close")) / 3).alias("typical_price"),
        ((c("high") + c("low")) / 2).alias("median_price"), span.alias("price_range"), body.alias("body_size"),
        (body < span * doji).alias("is_doji"),
    )
