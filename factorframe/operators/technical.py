"""Technical indicators (T1-T26): windows per symbol, all over one exchange and one sort.

Every function adds columns to a bars frame (symbol, date, open, high, low,
close, volume).  Null means warm-up or an undefined quotient.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.functions.windows import (
    c, change, decayed_sums, ewm_means, lagged, log_change, ordered, positive_log, ratio, rolling, rolling_max, rolling_mean,
    rolling_min, rolling_ranks, rolling_std, rolling_sum, running, trailing, whole,
)

# fixed values
MOMENTUM_PERIODS = (21, 63, 126, 252)
VOLATILITY_WINDOWS = (20, 60)
SMA_PERIODS = (10, 20, 50, 200)
EMA_SPANS = (12, 26)
RANK_ROWS, RANK_MIN = 252, 126


def momentum(bars: DataFrame, periods=MOMENTUM_PERIODS) -> DataFrame:
    """T1."""
    return bars.select("*", *[change("close", p).alias(f"momentum_{p}d") for p in periods])


def log_returns(bars: DataFrame, periods=MOMENTUM_PERIODS) -> DataFrame:
    """T2."""
    return bars.select("*", *[log_change("close", p).alias(f"log_return_{p}d") for p in periods])


def exp_momentum(bars: DataFrame, periods=MOMENTUM_PERIODS) -> DataFrame:
    """Weighted mean of x / x0 - 1 over the last p rows, weights rising from e^-1 to 1."""
    decay = {p: math.exp(-1 / (p - 1)) if p > 1 else 1.0 for p in periods}
    df = decayed_sums(bars, "close", {f"_e{p}": (p, a) for p, a in decay.items()})

    def one(p):
        mean = c(f"_e{p}") / sum(decay[p] ** k for k in range(p))
        return F.when(F.count("close").over(trailing(p)) == p, ratio(mean, lagged("close", p - 1)) - 1).alias(f"exp_momentum_{p}d")

    return df.select("*", *[one(p) for p in periods]).drop(*[f"_e{p}" for p in periods])


def risk_adjusted_momentum(bars: DataFrame, periods=MOMENTUM_PERIODS) -> DataFrame:
    """T4."""
    df = bars.withColumn("_ret", change("close"))
    return df.select(
        "*", *[ratio(change("close", p), rolling_std("_ret", p)).alias(f"risk_adj_momentum_{p}d") for p in periods]
    ).drop("_ret")


def momentum_rank(bars: DataFrame, periods=MOMENTUM_PERIODS, rows=RANK_ROWS, min_rows=RANK_MIN) -> DataFrame:
    """T5."""
    df = bars.select("*", *[change("close", p).alias(f"_m{p}") for p in periods])
    df = rolling_ranks(df, {f"momentum_rank_{p}d": (f"_m{p}", rows, min_rows) for p in periods})
    return df.drop(*[f"_m{p}" for p in periods])


def volatility(bars: DataFrame, windows=VOLATILITY_WINDOWS) -> DataFrame:
    """T6."""
    df = bars.withColumn("_ret", change("close"))
    return df.select("*", *[rolling_std("_ret", w).alias(f"volatility_{w}d") for w in windows]).drop("_ret")


def vol_of_vol(bars: DataFrame, windows=VOLATILITY_WINDOWS) -> DataFrame:
    """T7; adds T6 as well."""
    df = volatility(bars, windows)
    return df.select("*", *[rolling_std(f"volatility_{w}d", w).alias(f"vol_of_vol_{w}d") for w in windows])


def _log_range():
    return positive_log(ratio("high", "low"))


def _gk_term():
    co = positive_log(ratio("close", "open"))
    return 0.5 * F.pow(_log_range(), 2.0) - (2 * math.log(2) - 1) * F.pow(co, 2.0)


def parkinson(bars: DataFrame, windows=VOLATILITY_WINDOWS) -> DataFrame:
    """T8."""
    df = bars.withColumn("_r2", F.pow(_log_range(), 2.0))
    return df.select(
        "*", *[F.sqrt(rolling_sum("_r2", w) / (4 * math.log(2))).alias(f"parkinson_vol_{w}d") for w in windows]
    ).drop("_r2")


def garman_klass(bars: DataFrame, windows=VOLATILITY_WINDOWS) -> DataFrame:
    """Mean of roots; a row with a negative term blanks the windows it is in."""
    df = bars.withColumn("_t", _gk_term()).withColumn("_g", F.when(F.col("_t") >= 0, F.sqrt("_t")))
    return df.select("*", *[rolling_mean("_g", w).alias(f"gk_vol_{w}d") for w in windows]).drop("_t", "_g")


def volatility_rank(bars: DataFrame, windows=VOLATILITY_WINDOWS, rows=RANK_ROWS, min_rows=RANK_MIN) -> DataFrame:
    """T10; adds T6 as well."""
    return rolling_ranks(volatility(bars, windows), {f"volatility_rank_{w}d": (f"volatility_{w}d", rows, min_rows) for w in windows})


def long_parkinson(bars: DataFrame) -> DataFrame:
    """T11.  Divides by the symbol's full row count, so it looks ahead; kept for parity, T8 is the sound measure."""
    df = bars.withColumn("_r2", F.pow(_log_range(), 2.0))
    n = F.count(F.lit(1)).over(whole())
    return df.withColumn("parkinson_volatility", F.sqrt(rolling_sum("_r2", 20) / (4 * n * math.log(2)))).drop("_r2")


def long_garman_klass(bars: DataFrame) -> DataFrame:
    """T12."""
    df = bars.withColumn("_t", _gk_term()).withColumn("_s", rolling_sum("_t", 20))
    return df.withColumn("garman_klass_volatility", F.when(F.col("_s") >= 0, F.sqrt("_s"))).drop("_t", "_s")


def range_volatility(bars: DataFrame) -> DataFrame:
    """T13."""
    return bars.withColumn("range_volatility", ratio(c("high") - c("low"), "close"))


def sma(bars: DataFrame, periods=SMA_PERIODS) -> DataFrame:
    """T14; the flag is 0 during warm-up."""
    df = bars.select("*", *[rolling_mean("close", p).alias(f"sma_{p}") for p in periods])
    return df.select(
        "*", *[F.coalesce((F.col("close") > F.col(f"sma_{p}")).cast("int"), F.lit(0)).alias(f"price_above_sma_{p}")
               for p in periods]
    )


def ema(bars: DataFrame, spans=EMA_SPANS) -> DataFrame:
    """T15."""
    return ewm_means(bars, {f"ema_{s}": ("close", s) for s in spans})


def macd(bars: DataFrame, fast=12, slow=26, signal=9) -> DataFrame:
    """T16."""
    df = ewm_means(bars, {"_fast": ("close", fast), "_slow": ("close", slow)})
    df = df.withColumn("macd_line", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = ewm_means(df, {"macd_signal": ("macd_line", signal)})
    return df.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))


def bollinger(bars: DataFrame, n=20, k=2.0) -> DataFrame:
    """T17."""
    df = bars.select("*", rolling_mean("close", n).alias("bb_middle"), (rolling_std("close", n) * k).alias("_h"))
    df = df.withColumn("bb_upper", F.col("bb_middle") + F.col("_h")).withColumn("bb_lower", F.col("bb_middle") - F.col("_h"))
    return (
        df.withColumn("bb_position", ratio(c("close") - c("bb_lower"), c("bb_upper") - c("bb_lower")))
        .withColumn("bb_width", ratio(c("bb_upper") - c("bb_lower"), "bb_middle")).drop("_h")
    )


def rsi(bars: DataFrame, n=14) -> DataFrame:
    """Simple means; the first difference counts as 0; no loss gives 100, no move at all null."""
    df = bars.withColumn("_d", F.coalesce(c("close") - lagged("close"), F.lit(0.0)))
    df = df.withColumn("_up", F.greatest("_d", F.lit(0.0))).withColumn("_down", F.greatest(-F.col("_d"), F.lit(0.0)))
    df = df.withColumn("_g", rolling_mean("_up", n)).withColumn("_l", rolling_mean("_down", n))
    value = F.when(F.col("_l") > 0, 100 - 100 / (1 + ratio("_g", "_l"))).when((F.col("_l") == 0) & (F.col("_g") > 0), 100.0)
    return df.withColumn(f"rsi_{n}", value).drop("_d", "_up", "_down", "_g", "_l")


def _extremes(bars, n):
    return bars.withColumn("_lo", rolling_min("low", n)).withColumn("_hi", rolling_max("high", n))


def stochastic(bars: DataFrame, n=14, d=3) -> DataFrame:
    """T19."""
    df = _extremes(bars, n)
    df = df.withColumn("stochastic_k", 100 * (c("close") - c("_lo")) / (c("_hi") - c("_lo") + 1e-8))
    return df.withColumn("stochastic_d", rolling_mean("stochastic_k", d)).drop("_lo", "_hi")


def williams_r(bars: DataFrame, n=14) -> DataFrame:
    """T20."""
    df = _extremes(bars, n)
    return df.withColumn("williams_r", -100 * (c("_hi") - c("close")) / (c("_hi") - c("_lo") + 1e-8)).drop("_lo", "_hi")


def mfi(bars: DataFrame, n=14) -> DataFrame:
    """Flow on rises against flow on falls of the typical price; no fall in the frame gives 100."""
    df = bars.withColumn("_tp", (c("high") + c("low") + c("close")) / 3)
    df = df.withColumn("_step", c("_tp") - lagged("_tp")).withColumn("_mf", c("_tp") * c("volume"))
    df = df.withColumn("_pos", F.when(c("_step") > 0, c("_mf")).otherwise(0.0))
    df = df.withColumn("_neg", F.when(c("_step") < 0, c("_mf")).otherwise(0.0))
    df = df.withColumn("_p", rolling_sum("_pos", n)).withColumn("_n", rolling_sum("_neg", n))
    value = F.when(c("_n") > 0, 100 - 100 / (1 + ratio("_p", "_n"))).when((c("_n") == 0) & (c("_p") > 0), 100.0)
    return df.withColumn("mfi", value).drop("_tp", "_step", "_mf", "_pos", "_neg", "_p", "_n")


def true_range(bars: DataFrame, name="true_range") -> DataFrame:
    """Largest of high - low and the two gaps from the previous close (the gaps are skipped on the first row)."""
    prev = lagged("close")
    return bars.withColumn(name, F.greatest(c("high") - c("low"), F.abs(c("high") - prev), F.abs(c("low") - prev)))


def adx(bars: DataFrame, n=14) -> DataFrame:
    """Simple means instead of smoothed ones."""
    df = bars.select("*", lagged("close").alias("_pc"), (c("high") - lagged("high")).alias("_up"),
                     (lagged("low") - c("low")).alias("_dn"))
    df = true_range(df, "_tr").withColumn("_tr", F.when(c("_pc").isNotNull(), c("_tr")))
    df = df.withColumn("_dp", F.when((c("_up") > c("_dn")) & (c("_up") > 0), c("_up")).otherwise(0.0))
    df = df.withColumn("_dm", F.when((c("_dn") > c("_up")) & (c("_dn") > 0), c("_dn")).otherwise(0.0))
    df = df.withColumn("_atr", rolling_mean("_tr", n))
    df = df.withColumn("_p", 100 * ratio(rolling_mean("_dp", n), "_atr"))
    df = df.withColumn("_m", 100 * ratio(rolling_mean("_dm", n), "_atr"))
    df = df.withColumn("_dx", 100 * ratio(F.abs(c("_p") - c("_m")), c("_p") + c("_m")))
    return df.withColumn("adx", rolling_mean("_dx", n)).drop("_pc", "_up", "_dn", "_tr", "_dp", "_dm", "_atr", "_p", "_m", "_dx")


def cci(bars: DataFrame, n=20) -> DataFrame:
    """T23."""
    df = bars.withColumn("_tp", (c("high") + c("low") + c("close")) / 3)
    df = df.withColumn("_m", rolling_mean("_tp", n)).withColumn("_f", F.collect_list("_tp").over(trailing(n)))
    dev = F.aggregate("_f", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_m"))) / n
    return df.withColumn("cci", ratio(c("_tp") - c("_m"), 0.015 * dev)).drop("_tp", "_m", "_f")


def volume_price_trend(bars: DataFrame, name="volume_price_trend") -> DataFrame:
    """T24."""
    df = bars.withColumn("_v", c("volume") * change("close"))
    return df.withColumn(name, F.when(c("_v").isNotNull(), F.sum("_v").over(running()))).drop("_v")


def basic_block(bars: DataFrame) -> DataFrame:
    """Second indicator block."""
    df = bars.select(
        "*", *[rolling_mean("close", p).alias(f"sma_{p}") for p in (20, 50, 200)],
        rolling_mean("volume", 20).alias("volume_sma_20"),
        F.coalesce(F.signum(c("close") - lagged("close")) * c("volume"), F.lit(0.0)).alias("_flow"),
    )
    df = true_range(df)
    df = df.select("*", rolling_mean("true_range", 14).alias("atr_14"), F.sum("_flow").over(running()).alias("obv"))
    df = df.withColumn("price_to_sma20", ratio("close", "sma_20")).withColumn("price_to_sma200", ratio("close", "sma_200"))
    return ema(volume_price_trend(df, "vpt")).drop("_flow")


def technical_panel(bars: DataFrame, periods=MOMENTUM_PERIODS, windows=VOLATILITY_WINDOWS) -> DataFrame:
    """All indicator columns of a symbol-date; one exchange by symbol.  Ranks come last, in one pass for all of them,
    since they leave the JVM and later windows would need another exchange."""
    df = risk_adjusted_momentum(exp_momentum(log_returns(momentum(bars, periods), periods), periods), periods)
    df = vol_of_vol(df, windows)
    for step in (parkinson, garman_klass):
        df = step(df, windows)
    for step in (long_parkinson, long_garman_klass, range_volatility, sma, ema, macd, bollinger, rsi, stochastic,
                 williams_r, mfi, adx, cci, volume_price_trend):
        df = step(df)
    ranked = {f"momentum_rank_{p}d": f"momentum_{p}d" for p in periods} | {f"volatility_rank_{w}d": f"volatility_{w}d" for w in windows}
    return rolling_ranks(df, {name: (x, RANK_ROWS, RANK_MIN) for name, x in ranked.items()})


def drop_empty_columns(df: DataFrame, keep=("symbol", "date")) -> DataFrame:
    """Columns without a single value go; the check is one aggregate whose single row sets the column list."""
    others = [x for x in df.columns if x not in keep]
    counts = df.agg(*[F.count(x).alias(x) for x in others]).first()
    return df.select(*keep, *[x for x in others if counts[x] > 0])
