"""Data quality (Q1-Q27): every check is one aggregate or one projection over the long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.functions import ranks
from factorframe.functions.pairs import covariances
from factorframe.functions.stats import count_if, safe_corr
from factorframe.functions.windows import c, change, lagged, ordered, ratio, running

PRICES = ("open", "high", "low", "close")


def _rule_counts(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule, n) with n > 0: all rules in one pass, then one row per broken rule."""
    wide = df.groupBy(*keys).agg(*[count_if(cond).alias(r) for r, cond in rules.items()])
    return wide.unpivot(keys, list(rules), "rule", "n").where("n > 0")


def missing_columns(df: DataFrame, required) -> list[str]:
    have = {x.lower() for x in df.columns}
    return [x for x in required if x.lower() not in have]


def validate_bars(bars: DataFrame) -> DataFrame:
    """Q1: violations per symbol and rule."""
    lost = missing_columns(bars, PRICES + ("volume",))
    if lost:
        raise ValueError(f"missing columns: {lost}")
    o, h, l, cl = (c(x) for x in PRICES)
    return _rule_counts(bars, ["symbol"], {
        "non_positive_price": (o <= 0) | (h <= 0) | (l <= 0) | (cl <= 0),
        "high_below_low": h < l,
        "open_close_outside_range": (h < o) | (h < cl) | (l > o) | (l > cl),
        "negative_volume": c("volume") < 0,
        "missing_price": o.isNull() | h.isNull() | l.isNull() | cl.isNull(),
    })


def validate_factors(factors: DataFrame, cols=("MKT", "SMB", "HML", "RMW", "CMA")) -> DataFrame:
    """Q2: |factor| above 1 and |RF| above 0.1, as (rule, n), zero counts included."""
    rules = {f"{x}_out_of_range": F.abs(x) > 1 for x in cols} | {"RF_out_of_range": F.abs("RF") > 0.1}
    wide = factors.agg(*[count_if(e).alias(r) for r, e in rules.items()])
    return wide.unpivot([], list(rules), "rule", "n")


def validate_signals(signals: DataFrame, symbols: DataFrame) -> DataFrame:
    """Q3: (symbol, rule, n): signals outside [0, 1] and wanted symbols without a signal."""
    outside = _rule_counts(signals, ["symbol"], {"outside_unit_range": (c("signal") < 0) | (c("signal") > 1)})
    absent = symbols.select("symbol").distinct().join(signals.select("symbol").distinct(), "symbol", "left_anti")
    return outside.unionByName(absent.select("symbol", F.lit("missing").alias("rule"), F.lit(1).cast("long").alias("n")))


def validate_weights(weights: DataFrame, tolerance=0.01) -> DataFrame:
    """Q4: per strategy and date: total, min, max, nulls and the verdict."""
    out = weights.groupBy("strategy", "date").agg(
        F.sum("weight").alias("total"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"),
        count_if(c("weight").isNull()).alias("nulls"),
    )
    ok = (F.abs(c("total") - 1) <= tolerance) & (c("min_weight") >= 0) & (c("max_weight") <= 1) & (c("nulls") == 0)
    return out.withColumn("valid", ok)


def repair_bars(bars: DataFrame) -> DataFrame:
    """Q5: negative prices become null, inverted high/low swap, the range covers open and close, incomplete rows go."""
    df = bars.select(*[F.when(c(x) >= 0, c(x)).alias(x) if x in PRICES else c(x) for x in bars.columns])
    flip = c("high") < c("low")
    df = df.withColumns({"high": F.when(flip, c("low")).otherwise(c("high")),
                         "low": F.when(flip, c("high")).otherwise(c("low"))})
    df = df.withColumns({"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")})
    return df.dropna(subset=list(PRICES))


def clean_bars(bars: DataFrame, cols=PRICES + ("volume",)) -> DataFrame:
    """Q6: forward then backward fill per symbol, rows still incomplete go."""
    back = running()
    ahead = Window.partitionBy("symbol").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    filled = bars.select(*[x for x in bars.columns if x not in cols],
                         *[F.coalesce(F.last(x, True).over(back), F.last(x, True).over(ahead)).alias(x) for x in cols])
    return filled.dropna(subset=list(cols))


def clean_factors(factors: DataFrame, cols=("MKT", "SMB", "HML", "RMW", "CMA"), limit=1.0, rf_limit=0.1) -> DataFrame:
    """Q7: rows with nulls or values out of range go."""
    df = factors.dropna(subset=list(cols) + ["RF"])
    for x in cols:
        df = df.where(F.abs(x) <= limit)
    return df.where(F.abs("RF") <= rf_limit)


def quality_report(bars: DataFrame) -> DataFrame:
    """Q8: one row per symbol."""
    steps = bars.select("*", F.datediff("date", lagged("date")).alias("_gap"), change("close").alias("_ret"))
    rep = steps.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_rows"), F.min("date").alias("start"), F.max("date").alias("end"),
        *[count_if(c(x).isNull()).alias(f"missing_{x}") for x in PRICES + ("volume",)],
        (F.count("date") - F.countDistinct("date")).alias("duplicate_dates"),
        F.percentile("_gap", F.lit(0.5)).alias("median_gap"), F.max(F.abs("_ret")).alias("max_daily_change"),
        (F.stddev_samp("_ret") * 252**0.5).alias("volatility"),
    )
    g = c("median_gap")
    kind = F.when(g.isNull(), "unknown").when(g <= 1.5, "daily").when(g <= 8, "weekly").when(g <= 35, "monthly")
    return rep.withColumn("frequency", kind.otherwise("low_frequency"))


def frame_statistics(bars: DataFrame) -> DataFrame:
    """Q9."""
    return bars.agg(
        F.countDistinct("symbol").alias("symbols"), F.min("date").alias("start"), F.max("date").alias("end"),
        F.count(F.lit(1)).alias("points"),
    ).withColumn("points_per_symbol", c("points") / c("symbols"))


def success_gate(wanted: DataFrame, have: DataFrame, min_share=0.8, min_count=10) -> DataFrame:
    """Q10: share of wanted symbols with data and whether both bounds hold."""
    found = have.select("symbol").distinct().withColumn("_found", F.lit(1))
    out = wanted.select("symbol").distinct().join(found, "symbol", "left").agg(
        F.count(F.lit(1)).alias("wanted"), F.count("_found").alias("found"))
    out = out.withColumn("share", c("found") / F.nullif(c("wanted"), F.lit(0)))
    return out.withColumn("passed", (c("share") >= min_share) & (c("found") >= min_count))


def usable(bars: DataFrame, min_rows=10) -> DataFrame:
    """Q11."""
    ok = bars.groupBy("symbol").agg(F.count("close").alias("_k"), F.count(F.lit(1)).alias("_n"))
    return bars.join(ok.where((c("_k") > 0) & (c("_n") >= min_rows)).select("symbol"), "symbol", "left_semi")


def check_returns(df: DataFrame, key="strategy", value="daily_return", extreme=0.5, gap_days=5, min_rows=20,
                  min_vol=1e-6, max_vol=0.1) -> DataFrame:
    """Q12 / Q22 / Q27: one row per series with its findings."""
    steps = df.withColumn("_gap", F.datediff("date", lagged("date", 1, key)))
    out = steps.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), count_if(F.abs(value) > extreme).alias("extreme"),
        count_if(c(value).isNull()).alias("missing"), F.countDistinct(value).alias("distinct_values"),
        F.stddev_samp(value).alias("volatility"), F.max("_gap").alias("max_gap"),
    )
    return out.select(
        "*", (c("distinct_values") <= 2).alias("near_constant"), (c("volatility") < min_vol).alias("flat"),
        (c("volatility") > max_vol).alias("wild"), (c("max_gap") > gap_days).alias("has_gaps"),
        (c("n") < min_rows).alias("too_short"),
    )


def missing_report(df: DataFrame, features: dict[str, int], tolerance=1.5) -> DataFrame:
    """Q13: per feature the null share against its warm-up rows per symbol, times the tolerance."""
    cols = list(features)
    names = df.select("symbol").distinct().count() if "symbol" in df.columns else 1
    wide = df.agg(F.count(F.lit(1)).alias("total"), *[count_if(c(x).isNull()).alias(x) for x in cols])
    long = wide.unpivot(["total"], cols, "feature", "missing")
    warm = F.element_at(F.create_map(*[F.lit(v) for kv in features.items() for v in kv]), c("feature"))
    long = long.withColumn("missing_share", c("missing") / c("total")).withColumn("expected", warm.cast("long") * names)
    return long.withColumn("exceeds", c("missing") > c("expected") * tolerance)


def panel_checks(df: DataFrame, cols: list[str], min_symbols=3, min_per_date=3, max_missing=0.5, max_empty=0.1) -> DataFrame:
    """Q14: one row of findings for a (date, symbol) panel."""
    nulls = sum((c(x).isNull().cast("int") for x in cols), F.lit(0))
    rows = df.agg(
        F.countDistinct("symbol").alias("symbols"), (F.sum(nulls) / (F.count(F.lit(1)) * len(cols))).alias("missing_share"),
        F.avg((nulls == len(cols)).cast("double")).alias("empty_rows_share"),
    )
    dates = df.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.avg((c("_n") >= min_per_date).cast("double")).alias("dates_covered"))
    out = rows.withColumn("_k", F.lit(0)).join(dates.withColumn("_k", F.lit(0)), "_k").drop("_k")
    ok = ((c("symbols") >= min_symbols) & (c("dates_covered") >= 0.5) & (c("missing_share") <= max_missing)
          & (c("empty_rows_share") <= max_empty))
    return out.withColumn("valid", ok)


def panel_summary(df: DataFrame) -> DataFrame:
    """Q15."""
    out = df.agg(F.countDistinct("date").alias("dates"), F.countDistinct("symbol").alias("symbols"),
                 F.count(F.lit(1)).alias("n_rows"))
    return out.select("*", (c("n_rows") / (c("dates") * c("symbols"))).alias("completeness"),
                      (c("n_rows") / c("dates")).alias("avg_per_date"))


def outliers(df: DataFrame, col: str, method="iqr", threshold=1.5, by=(), name="is_outlier", base: DataFrame | None = None) -> DataFrame:
    """Q16: iqr, zscore or modified_zscore; groups of any size (default: the whole column).

    ``base`` is the frame to take the bounds from (default df): when several flags are
    added one after the other, pass the first frame so that its plan is not nested.
    """
    from factorframe.operators.transforms import _attach, mad_table

    by, src = list(by), df if base is None else base
    if method == "iqr":
        q = ranks.quantiles(src, by, col, {"_q1": 0.25, "_q3": 0.75}, by in (["symbol"], ["strategy"]))
        out = _attach(df, q, by)
        width = (c("_q3") - c("_q1")) * threshold
        flag = (c(col) < c("_q1") - width) | (c(col) > c("_q3") + width)
        return out.withColumn(name, flag).drop("_q1", "_q3")
    if method == "zscore":
        out = _attach(df, src.groupBy(*by).agg(F.avg(col).alias("_a"), F.stddev_samp(col).alias("_s")), by)
        return out.withColumn(name, F.abs(ratio(c(col) - c("_a"), "_s")) > threshold).drop("_a", "_s")
    if method == "modified_zscore":
        out = _attach(df, mad_table(src, col, by), by)
        return out.withColumn(name, F.abs(ratio(0.6745 * (c(col) - c("_med")), "_mad")) > threshold).drop("_med", "_mad")
    raise ValueError(f"unknown method {method!r}")


def clean(df: DataFrame, cols: list[str], remove_duplicates=True, method: str | None = "iqr") -> DataFrame:
    """Q17: drop equal rows, then outliers column after column (later bounds see the rows that are left)."""
    out = df.dropDuplicates() if remove_duplicates else df
    limit = {"iqr": 1.5, "zscore": 3.0}
    for x in cols if method else []:
        flagged = outliers(out, x, method, limit[method], name="_out")
        keep = F.coalesce(~c("_out"), F.lit(False))
        out = flagged.where(keep).drop("_out")
    return out


def clip_to_bounds(df: DataFrame, col: str, k=3.0, by=(), name=None) -> DataFrame:
    """Q18: clip at mean +- k deviations."""
    out = ranks.with_group_stats(df, list(by), _a=F.avg(col), _s=F.stddev_samp(col))
    lo, hi = c("_a") - k * c("_s"), c("_a") + k * c("_s")
    return out.withColumn(name or col, F.greatest(F.least(col, hi), lo)).drop("_a", "_s")


def extreme_days(returns: DataFrame, threshold=0.05, n=10, key="strategy", value="daily_return") -> DataFrame:
    """Q19: the n largest moves beyond the threshold per series."""
    hits = returns.where(F.abs(value) > threshold)
    return ranks.top_n(hits, [key], [F.desc(F.abs(value)), F.asc("date")], n, "position")


def extreme_context(extremes: DataFrame, weights: DataFrame, trades: DataFrame, key="strategy") -> DataFrame:
    """Q19: names held and traded on the extreme days."""
    held = weights.where("weight > 0").groupBy(key, "date").agg(
        F.count(F.lit(1)).alias("names_held"), F.max("weight").alias("largest_weight"))
    traded = trades.groupBy("date").agg(F.count(F.lit(1)).alias("trades"), F.sum("quantity").alias("traded_quantity"))
    out = extremes.join(held, [key, "date"], "left").join(traded, "date", "left")
    return out.fillna(0, ["names_held", "trades"])


def extreme_runs(returns: DataFrame, threshold=0.05, max_gap=3, key="strategy", value="daily_return") -> DataFrame:
    """Q19: runs of extreme days at most max_gap calendar days apart."""
    hits = returns.where(F.abs(value) > threshold)
    fresh = F.coalesce((F.datediff("date", lagged("date", 1, key)) > max_gap).cast("int"), F.lit(1))
    runs = hits.withColumn("_new", fresh).withColumn("run", F.sum("_new").over(running(key)))
    return runs.groupBy(key, "run").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days"),
        F.sum(value).alias("total_return"))


def around_dates(returns: DataFrame, marks: DataFrame, rows=5, key="strategy") -> DataFrame:
    """Q19: the rows within +- ``rows`` positions of each marked date of a series, with their offset."""
    numbered = returns.withColumn("_i", F.row_number().over(ordered(key)))
    at = numbered.join(marks.select(key, "date").distinct(), [key, "date"], "left_semi").select(
        key, c("date").alias("mark"), c("_i").alias("_m"))
    near = at.withColumn("offset", F.explode(F.sequence(F.lit(-rows), F.lit(rows))))
    near = near.withColumn("_i", c("_m") + c("offset"))
    return near.join(numbered, [key, "_i"]).drop("_i", "_m")


def return_percentiles(returns: DataFrame, probs=(0.01, 0.05, 0.5, 0.95, 0.99), key="strategy", value="daily_return") -> DataFrame:
    """Q19: (key, p1, p5, ...)."""
    return ranks.quantiles(returns, [key], value, {f"p{round(q * 100)}": q for q in probs}, calendar_bound=True)


def beta_diagnosis(returns: DataFrame, benchmark: DataFrame, key="strategy", value="daily_return", bench="bench_return") -> DataFrame:
    """Q20: overlap, unit check, spread and regression of each series on the benchmark."""
    both = returns.join(benchmark, "date")
    agg = both.groupBy(key).agg(
        F.count(F.lit(1)).alias("overlap"), F.covar_samp(value, bench).alias("covariance"),
        F.var_samp(bench).alias("bench_variance"), safe_corr(value, bench).alias("correlation"),
        F.regr_slope(value, bench).alias("slope"), F.regr_intercept(value, bench).alias("intercept"),
        F.regr_r2(value, bench).alias("r2"), F.stddev_samp(value).alias("std"), F.stddev_samp(bench).alias("bench_std"),
        (F.max(F.abs(value)) > 1).alias("looks_like_percent"),
    )
    q = ranks.quantiles(both, [key], value, {"q01": 0.01, "q99": 0.99}, calendar_bound=True)
    return agg.join(q, key)


def value_kind(df: DataFrame, key="strategy", value="daily_return") -> DataFrame:
    """Q20: do the values look like prices, percent or simple returns?"""
    out = df.groupBy(key).agg(F.min(value).alias("lowest"), F.avg(F.abs(value)).alias("mean_abs"))
    kind = F.when((c("lowest") > 0) & (c("mean_abs") > 1), "prices").when(c("mean_abs") > 0.5, "percent")
    return out.withColumn("kind", kind.otherwise("returns"))


METRIC_RULES = {  # fixed values: metric -> (low, high, severity)
    "sharpe_ratio": (-5.0, 5.0, "warning"),
    "max_drawdown": (-1.0, 0.0, "error"),
    "volatility": (0.0, 1.0, "error"),
}


def validate_metrics(metrics: DataFrame) -> DataFrame:
    """Q21: metrics(strategy, metric, value) outside their range, plus a high implied return."""
    rules = F.create_map(*[x for m, (lo, hi, sev) in METRIC_RULES.items() for x in (
        F.lit(m), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(sev).alias("severity")))])
    r = metrics.withColumn("_r", F.element_at(rules, c("metric")))
    bad = r.where((c("value") < c("_r.lo")) | (c("value") > c("_r.hi"))).select(
        "strategy", "metric", "value", c("_r.severity").alias("severity"))
    wide = metrics.groupBy("strategy").agg(
        F.max(F.when(c("metric") == "sharpe_ratio", c("value"))).alias("s"),
        F.max(F.when(c("metric") == "volatility", c("value"))).alias("v"))
    implied = wide.where((c("v") > 0) & (F.abs(c("s") * c("v")) > 0.5)).select(
        "strategy", F.lit("implied_return").alias("metric"), (c("s") * c("v")).alias("value"), F.lit("warning").alias("severity"))
    return bad.unionByName(implied)


def signal_report(signals: DataFrame, keys=("strategy", "date"), extreme=10.0) -> DataFrame:
    """Q23."""
    s = c("signal")
    odd = s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))
    return signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("symbols"), count_if(s > 0).alias("positive"), count_if(s < 0).alias("negative"),
        count_if(s == 0).alias("zero"), F.min("signal").alias("lowest"), F.max("signal").alias("highest"),
        count_if(F.abs(s) > extreme).alias("extreme"), count_if(odd).alias("not_finite"))


def signal_diversity(signals: DataFrame) -> DataFrame:
    """Q24 for one strategy's signals(date, symbol, signal): one row of diversity figures."""
    by_symbol = signals.groupBy("symbol").agg(F.var_samp("signal").alias("v"), F.countDistinct("signal").alias("u"))
    a = by_symbol.agg(F.avg("v").alias("avg_time_variance"), F.avg("u").alias("avg_unique_values"))
    by_date = signals.groupBy("date").agg(F.var_samp("signal").alias("v"))
    b = by_date.agg(F.avg("v").alias("cross_variance_mean"), F.stddev_samp("v").alias("cross_variance_std"),
                    F.min("v").alias("cross_variance_min"), F.max("v").alias("cross_variance_max"))
    p = covariances(signals, "signal").where("s1 < s2").agg(
        F.avg("corr").alias("avg_pairwise_correlation"), F.max("corr").alias("max_correlation"))
    d = signals.agg((100 * F.avg((c("signal") > 0).cast("double"))).alias("long_percentage"),
                    (100 * F.avg((c("signal") < 0).cast("double"))).alias("short_percentage"))
    out = a.withColumn("_k", F.lit(0))
    for part in (b, p, d):  # one row each
        out = out.join(F.broadcast(part.withColumn("_k", F.lit(0))), "_k")
    return out.drop("_k").withColumn("diverse", c("avg_time_variance") > 1e-6)


def series_checks(bars: DataFrame, min_rows=252, col="close") -> DataFrame:
    """Q25."""
    out = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count(col).alias("values"),
                                     count_if(c(col) <= 0).alias("non_positive"))
    ok = (c("n") >= min_rows) & (c("values") > 0) & (c("non_positive") == 0)
    return out.withColumn("valid", ok)


def trace_signal_to_weight(signals: DataFrame, weights: DataFrame, recommended: DataFrame, keys=("date", "symbol"), by=("date",)) -> DataFrame:
    """Q26: per date (or other keys) how signals, weights and recommendations agree."""
    keys = list(keys)
    s = signals.select(*keys, "signal", F.lit(1).alias("_s"))
    w = weights.select(*keys, "weight", F.lit(1).alias("_w"))
    r = recommended.select(*keys, F.lit(1).alias("_r"))
    all_ = s.join(w, keys, "full_outer").join(r, keys, "full_outer")
    sig, wt = F.coalesce("signal", F.lit(0.0)), F.coalesce("weight", F.lit(0.0))
    return all_.groupBy(*by).agg(
        count_if(sig != 0).alias("non_zero_signals"), count_if(wt != 0).alias("non_zero_weights"),
        count_if((wt != 0) & (sig == 0)).alias("weight_without_signal"),
        count_if(c("_r").isNotNull()).alias("recommended"),
        count_if(c("_r").isNotNull() & (sig == 0)).alias("recommended_without_signal"))
