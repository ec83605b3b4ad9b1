"""Cross-sectional features (X1-X20): windows per symbol first, then work per date that holds for any number of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.functions import joins, ranks
from factorframe.functions.stats import safe_corr
from factorframe.functions.windows import (
    c, change, ordered, positive_log, ratio, rolling_max, rolling_mean, rolling_std, running, trailing,
)

# fixed values
LOOKBACK = {"momentum": 252, "volatility": 60, "ma_long": 200, "ma_short": 50}
RAW = ("market_cap", "size", "book_to_market", "value", "momentum", "volatility")
DECILES = [i / 10 for i in range(1, 10)]


def raw_features(bars: DataFrame, lookback=LOOKBACK) -> DataFrame:
    """market_cap, size, book_to_market, value, momentum, volatility; one exchange by symbol."""
    m, v, long = lookback["momentum"], lookback["volatility"], lookback["ma_long"]
    volume = F.when(F.count("volume").over(trailing(20)) >= 20, F.avg("volume").over(trailing(20))).otherwise(c("volume"))
    df = bars.select(
        "symbol", "date", "close", change("close").alias("_r"), (c("close") * volume).alias("market_cap"),
        F.avg("close").over(trailing(long)).alias("_ma"), F.max("high").over(trailing(252)).alias("_high"),
        change("close", m).alias("momentum"))
    df = df.withColumn("volatility", rolling_std("_r", v) * 252**0.5)
    return df.select(
        "symbol", "date", "market_cap", positive_log("market_cap").alias("size"),
        (ratio("_ma", "close") * (1 - F.coalesce("momentum", F.lit(0.0)))).alias("book_to_market"),
        (2.0 - (ratio("close", "_ma") + ratio("close", "_high")) / 2).alias("value"), "momentum", "volatility")


def _long(df: DataFrame, cols) -> DataFrame:
    return df.select("date", "symbol", *cols).unpivot(["date", "symbol"], list(cols), "feature", "value")


def ranks_and_zscores(df: DataFrame, cols=RAW) -> DataFrame:
    """X7 in long form: (date, symbol, feature, value, rank, zscore); z is 0 when the date has no spread."""
    long = _long(df, cols)
    out = ranks.percent_rank(long, ["date", "feature"], "value", "rank")
    out = ranks.with_group_stats(out, ["date", "feature"], _a=F.avg("value"), _s=F.stddev_samp("value"))
    z = F.when(c("_s") > 0, (c("value") - c("_a")) / c("_s")).when(c("value").isNotNull(), 0.0)
    return out.withColumn("zscore", z).drop("_a", "_s")


def winsorized(df: DataFrame, cols=RAW, p=0.01) -> DataFrame:
    """X8 in long form: values clipped at the date's p and 1 - p quantiles."""
    long = _long(df, cols)
    q = ranks.quantiles(long, ["date", "feature"], "value", {"_lo": p, "_hi": 1 - p})
    out = long.join(q, ["date", "feature"], "left")
    clipped = F.when(c("value").isNotNull(), F.greatest(F.least("value", "_hi"), "_lo"))
    return out.withColumn("value", clipped).drop("_lo", "_hi")


def widen(long: DataFrame, cols, values=("value", "rank", "zscore")) -> DataFrame:
    """(date, symbol) rows with {feature}, {feature}_rank, {feature}_zscore columns."""
    pick = [F.max(F.when(c("feature") == x, c(v))).alias(x if v == "value" else f"{x}_{v}") for x in cols for v in values
            if v in long.columns]
    return long.groupBy("date", "symbol").agg(*pick)


def panel(bars: DataFrame, lookback=LOOKBACK, p=0.01) -> DataFrame:
    """The whole cross-sectional panel, all dates at once (ranks and z-scores before winsorizing)."""
    raw = raw_features(bars, lookback)
    rz = ranks_and_zscores(raw).drop("value")
    return widen(winsorized(raw, p=p).join(rz, ["date", "symbol", "feature"]), RAW)


def fit_statistics(df: DataFrame, cols=RAW) -> DataFrame:
    """Per feature mean, std and the nine deciles of the training panel (a table of a few rows)."""
    long = _long(df, cols)
    q = ranks.quantiles(long, ["feature"], "value", {f"d{i + 1}": d for i, d in enumerate(DECILES)})
    s = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return s.join(q, "feature").select("feature", "mean", "std", F.array(*[f"d{i}" for i in range(1, 10)]).alias("deciles"))


def apply_statistics(df: DataFrame, fitted: DataFrame, cols=RAW) -> DataFrame:
    """X10 in long form: rank interpolated between learned deciles, learned z-score."""
    out = _long(df, cols).join(fitted, "feature")
    v, d = c("value"), lambda i: F.element_at("deciles", i)
    branch = F.when(v.isNull(), 0.5).when(v <= d(1), F.when(d(1) > 0, 0.1 * v / F.nullif(d(1), F.lit(0.0))).otherwise(0.0))
    for i in range(2, 10):
        lo = (i - 1) / 10
        width = d(i) - d(i - 1)
        branch = branch.when(v <= d(i), F.when(width > 0, lo + (v - d(i - 1)) / F.nullif(width, F.lit(0.0)) * 0.1).otherwise(lo))
    z = F.when(c("std") > 0, (v - c("mean")) / c("std")).otherwise(0.0)
    return out.select("date", "symbol", "feature", "value", branch.otherwise(1.0).alias("rank"), z.alias("zscore"))


def eligible(bars: DataFrame, dates: DataFrame, longest=252, back_days=30, ahead_days=14) -> DataFrame:
    """X11: (symbol, date, data_date, n_rows) with at least max(30, longest / 2) rows at the row found for the date."""
    from factorframe.operators.align import date_points

    counted = bars.select("symbol", "date", F.count(F.lit(1)).over(running()).alias("n_rows"))
    points = date_points(bars, dates.select(c("date").alias("as_of")))
    hit = joins.asof_within(points, counted, ["symbol"], ["n_rows"], back_days=back_days, ahead_days=ahead_days,
                            matched="data_date")
    return hit.where(c("n_rows") >= max(30, longest // 2))


def market_block(returns: DataFrame, bars: DataFrame) -> DataFrame:
    """X13 per date: mean percent rank and mean z-score of closes, mean percent rank of returns.

    The mean of average-method percent ranks of n values is (n + 1) / 2n, and the
    mean z-score is 0, whatever the values; neither needs a sort.
    """
    close = bars.groupBy("date").agg(F.count("close").alias("_n"), F.stddev_samp("close").alias("_s"))
    ret = returns.groupBy("date").agg(F.count("r").alias("_m"))
    half = lambda n: (c(n) + 1) / (2 * F.nullif(c(n), F.lit(0)))
    return close.join(ret, "date", "left").select(
        "date", half("_n").alias("cs_rank"), F.when(c("_s") > 0, 0.0).alias("cs_zscore"), half("_m").alias("cs_momentum"))


def rolling_beta(returns: DataFrame, n=60, value="r") -> DataFrame:
    """Beta of each symbol to the equal-weighted market over its trailing n rows."""
    market = returns.groupBy("date").agg(F.avg(value).alias("_mkt"))
    df = returns.join(market, "date")
    w = trailing(n)
    full = F.count(value).over(w) >= n
    beta = F.covar_samp(value, "_mkt").over(w) / F.nullif(F.var_samp("_mkt").over(w), F.lit(0.0))
    return df.withColumn("beta", F.when(full, beta)).drop("_mkt")


# fixed values
BOX_CATEGORIES = {
    "size": ("large", "mid", "small"), "style": ("growth", "neutral", "value"), "region": ("developed", "emerging"),
    "sector": ("Technology", "Financials", "Healthcare", "Consumer Discretionary", "Consumer Staples", "Industrials",
               "Energy", "Utilities", "Materials", "Real Estate", "Communication"),
}


def box_dummies(classes: DataFrame, categories=BOX_CATEGORIES) -> DataFrame:
    """One 0/1 column per class of each dimension."""
    flag = lambda d, v: F.coalesce((c(d) == v).cast("int"), F.lit(0)).alias(f"box_{d}_{v.lower().replace(' ', '_')}")
    return classes.select("symbol", *[flag(d, v) for d, vs in categories.items() for v in vs])


def with_box_dummies(bars: DataFrame, classes: DataFrame) -> DataFrame:
    """X16 on every symbol-date."""
    return bars.join(box_dummies(classes), "symbol")


def frozen_classes(bars: DataFrame, meta: DataFrame, end) -> DataFrame:
    """Classes from what was known at the training end date; write the result and reuse it unchanged.

    The cap is the last close times the mean volume of the last 20 rows up to that date.
    """
    from factorframe.operators import classify

    known = bars.where(c("date") <= F.lit(end).cast("date"))
    last = ranks.top_n(known, ["symbol"], [F.desc("date")], 20)
    caps = last.groupBy("symbol").agg((F.max_by("close", "date") * F.avg("volume")).alias("market_cap"))
    return classify.box_keys(classify.classify(meta.drop("market_cap").join(caps, "symbol")))


def information_coefficients(df: DataFrame, signal="signal", target="forward_return", by=("date",)) -> DataFrame:
    """Correlation of signal and forward return per date."""
    ok = df.where(c(signal).isNotNull() & c(target).isNotNull())
    return ok.groupBy(*by).agg(safe_corr(signal, target).alias("ic"), F.count(F.lit(1)).alias("n"))


def ic_summary(ics: DataFrame, by=()) -> DataFrame:
    """Mean, deviation, ratio and share of positive coefficients."""
    aggs = [F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"),
            (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("ic_sharpe"),
            F.avg((c("ic") > 0).cast("double")).alias("positive_ic_ratio"), F.count("ic").alias("n_dates")]
    return ics.groupBy(*by).agg(*aggs) if by else ics.agg(*aggs)


def feature_records(df: DataFrame, cols, target="forward_return", ic_threshold=0.03) -> DataFrame:
    """IC figures of every feature and whether it is accepted; all features in one job."""
    long = df.select("date", target, *cols).unpivot(["date", target], list(cols), "feature", "signal")
    out = ic_summary(information_coefficients(long, "signal", target, ("feature", "date")), ("feature",))
    verdict = F.when(F.abs("mean_ic") >= ic_threshold, "ACCEPT").when(F.abs("mean_ic") >= ic_threshold / 2, "MARGINAL")
    return out.withColumn("recommendation", verdict.otherwise("REJECT"))


# fixed values, tried in this order
FAMILIES = {
    "momentum": "momentum_|log_return_|exp_momentum|risk_adj_momentum",
    "volatility": "volatility_|vol_of_vol_|parkinson_vol|gk_vol|range_volatility",
    "technical": "sma_|ema_|macd_|bb_|rsi_|stochastic_|williams_r|adx|cci|mfi",
    "volume": "volume_|obv|vwap|ad_line",
    "cross_sectional": "market_cap|book_to_market|size_factor|value_factor|country_risk|equity_risk|default_spread",
    "box": "size_|style_|region_|sector_",
}


def feature_family(name="feature"):
    return F.coalesce(*[F.when(c(name).rlike(rx), fam) for fam, rx in FAMILIES.items()], F.lit("other"))


def importance_by_family(importance: DataFrame) -> DataFrame:
    """importance(feature, importance) -> share per family."""
    fam = importance.withColumn("feature_type", feature_family()).groupBy("feature_type").agg(
        F.sum("importance").alias("total_importance"), F.avg("importance").alias("avg_importance"),
        F.count(F.lit(1)).alias("n_features"))
    out = ranks.with_group_stats(fam, [], _t=F.sum("total_importance"))
    return out.withColumn("pct_importance", 100 * c("total_importance") / c("_t")).drop("_t")
