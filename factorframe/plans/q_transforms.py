"""Queries P1-P21."""

from pyspark.sql import functions as F

from factorframe.operators import transforms as x
from factorframe.plans.catalog import query
from factorframe.plans.q_technical import RUN, chg, full, lag, win

KEYS = ["symbol", "date"]


@query("p01_returns", "bars", f"SELECT symbol, date, {chg('close')} AS simple, ln(close / {lag('close')}) AS log FROM bars",
       "simple:6 log:6")
def _(p):
    return x.returns(x.returns(p.bars, "simple", name="simple"), "log", name="log").select(*KEYS, "simple", "log")


@query("p02_scaled_volatility", "ret", f"SELECT symbol, date, {full('stddev_samp', 'r', 60)} * sqrt(60) AS volatility FROM ret", "volatility:9")
def _(p):
    return x.scaled_volatility(p.ret, 60, "r").select(*KEYS, "volatility")


@query("p03_normalize", "bars", """SELECT b.symbol, b.date, (close - a) / s AS zscore, (close - lo) / (hi - lo) AS minmax,
    (close - med) / mad AS robust FROM bars b
    JOIN (SELECT symbol, avg(close) AS a, stddev_samp(close) AS s, min(close) AS lo, max(close) AS hi, median(close) AS med,
          mad(close) AS mad FROM bars GROUP BY symbol) g ON b.symbol = g.symbol""", "zscore:6 minmax:6 robust:6")
def _(p):
    df = p.bars.select(*KEYS, "close")
    for m in ("zscore", "minmax", "robust"):
        df = x.normalize(df, "close", m, name=m)
    return df.drop("close")


GAPS = """(SELECT *, CASE WHEN CAST(volume AS BIGINT) % 3 > 0 THEN close END AS g,
           row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM bars)"""


@query("p04_fill", "bars", f"""SELECT symbol, date, last(g IGNORE NULLS) {RUN} AS ffill,
    first(g IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bfill,
    CASE WHEN g IS NOT NULL THEN g WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END AS linear
    FROM (SELECT *, last(g IGNORE NULLS) {RUN} AS pv, last(CASE WHEN g IS NOT NULL THEN i END IGNORE NULLS) {RUN} AS pi,
      first(g IGNORE NULLS) OVER w AS nv, first(CASE WHEN g IS NOT NULL THEN i END IGNORE NULLS) OVER w AS ni
      FROM {GAPS} WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
       "ffill:3 bfill:3 linear:3")
def _(p):
    df = p.bars.select(*KEYS, F.when(F.col("volume").cast("long") % 3 > 0, F.col("close")).alias("g"))
    df = x.fill(df, "g", "forward_fill", name="ffill")
    df = x.fill(df, "g", "backward_fill", name="bfill")
    return x.fill(df, "g", "interpolate", name="linear").drop("g")


@query("p05_null_policy", "bars", f"""SELECT symbol, date,
    least(greatest(coalesce(last(g IGNORE NULLS) {RUN}, first(g IGNORE NULLS) OVER w, (SELECT median(g) FROM {GAPS}), 0), -1e9), 1e9) AS g,
    coalesce(m, first(m IGNORE NULLS) OVER w, (SELECT median(m) FROM (SELECT {chg('close', 5)} AS m FROM bars)), 0) AS m
    FROM (SELECT *, {chg('close', 5)} AS m FROM {GAPS})
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""", "g:3 m:6")
def _(p):
    df = p.bars.select(*KEYS, F.when(F.col("volume").cast("long") % 3 > 0, F.col("close")).alias("g"),
                       x.change("close", 5).alias("m"), F.lit(None).cast("double").alias("empty"))
    return x.null_policy(df, ["g", "m", "empty"], x.fit_medians(df, ["g", "m"]))


@query("p06_standard_scaling", "bars", """SELECT symbol, date, feature, (value - avg(value) OVER (PARTITION BY feature))
    / stddev_pop(value) OVER (PARTITION BY feature) AS scaled
    FROM (UNPIVOT (SELECT symbol, date, close, volume FROM bars) ON close, volume INTO NAME feature VALUE value)""", "scaled:6")
def _(p):
    cols = ["close", "volume"]
    long = x.long_form(p.bars, KEYS, cols)
    return x.scale(long, x.fit_scaler(p.bars, cols)).drop("value")


for unit in ("week", "month", "quarter"):
    @query(f"p07_resample_{unit}", "bars", f"""SELECT symbol, CAST(date_trunc('{unit}', date) AS DATE) AS period,
        arg_max(close, date) AS last_close, arg_min(close, date) AS first_close, avg(close) AS mean_close, sum(volume) AS sum_volume
        FROM bars GROUP BY 1, 2""", "last_close:3 first_close:3 mean_close:3")
    def _(p, unit=unit):
        return x.resample(p.bars, unit, {"last_close": ("last", "close"), "first_close": ("first", "close"),
                                         "mean_close": ("mean", "close"), "sum_volume": ("sum", "volume")})


@query("p08_lags", "bars", f"SELECT symbol, date, {lag('close', 1)} AS close_lag_1, {lag('close', 5)} AS close_lag_5, "
       f"{lag('volume', 1)} AS volume_lag_1, {lag('volume', 5)} AS volume_lag_5 FROM bars", "close_lag_1:3 close_lag_5:3")
def _(p):
    return x.lags(p.bars, ["close", "volume"], [1, 5]).select(
        *KEYS, "close_lag_1", "close_lag_5", "volume_lag_1", "volume_lag_5")


@query("p09_period_returns", "bars", "SELECT symbol, date, " + ", ".join(f"{chg('close', n)} AS return_{n}d" for n in (21, 63, 252))
       + " FROM bars", "return_21d:6 return_63d:6 return_252d:6")
def _(p):
    return x.period_returns(p.bars.select(*KEYS, "close")).drop("close")


@query("p10_rolling_statistics", "bars", "SELECT symbol, date, " + ", ".join(
    f"{full(a, 'close', 20)} AS close_rolling_{s}_20" for s, a in
    (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM bars",
       " ".join(f"close_rolling_{s}_20:3" for s in ("mean", "std", "min", "max")))
def _(p):
    return x.rolling_statistics(p.bars.select(*KEYS, "close"), ["close"], 20, ("mean", "std", "min", "max")).drop("close")


def _rr(n):
    f = f"list(close) OVER {win(n)}"
    return (f"CASE WHEN len({f}) = {n} THEN (len(list_filter({f}, lambda v: v < close)) + (len(list_filter({f}, lambda v: v = close)) + 1) / 2.0)"
            f" / {n} END AS close_rank_{n}d")


@query("p11_rolling_rank", "bars", f"SELECT symbol, date, {_rr(20)}, {_rr(60)} FROM bars", "close_rank_20d:6 close_rank_60d:6")
def _(p):
    return x.rank_features(p.bars.select(*KEYS, "close"), ["close"], (20, 60)).drop("close")


SRUN = "OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING)"
DD = (f"(SELECT *, max(cumulative_return) {SRUN} AS peak FROM (SELECT *, exp(sum(ln(1 + daily_return)) {SRUN}) AS cumulative_return FROM strat))")


@query("p12_drawdown", "strat", f"SELECT strategy, date, cumulative_return, peak, (cumulative_return - peak) / peak AS drawdown FROM {DD}",
       "cumulative_return:8 peak:8 drawdown:8")
def _(p):
    return x.drawdown(p.strat).drop("daily_return")


@query("p13_forward_return", "bars", "SELECT symbol, date, lead(close, 21) OVER (PARTITION BY symbol ORDER BY date) / close - 1 AS target FROM bars", "target:6")
def _(p):
    return x.forward_return(p.bars).select(*KEYS, "target")


@query("p14_forward_compounded", "ret", """SELECT symbol, date, CASE WHEN count(r) OVER w = 21 THEN exp(sum(ln(1 + r)) OVER w) - 1 END AS forward_return
    FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING)""", "forward_return:8")
def _(p):
    return x.forward_compounded(p.ret).select(*KEYS, "forward_return")


MB = f"(SELECT *, {chg('close')} AS r1 FROM bars)"
MB = "(SELECT *, " + ", ".join(f"{full('avg', 'r1', n)} AS a{n}" for n in (5, 21, 63, 252)) + f" FROM {MB})"


@query("p15_momentum_block", "bars", f"""SELECT symbol, date, r1 AS returns_1d, a5 AS returns_5d, a21 AS returns_21d, a63 AS returns_63d,
    a252 AS returns_252d, abs(a21) AS momentum_strength_21d, abs(a63) AS momentum_strength_63d, a21 - a63 AS momentum_acceleration,
    {chg('close', 21)} AS momentum_21d, {chg('close', 63)} AS momentum_63d, {chg('close', 252)} AS momentum_252d FROM {MB}""",
       "returns_1d:6 returns_5d:6 returns_21d:6 returns_63d:6 returns_252d:6 momentum_strength_21d:6 momentum_strength_63d:6 "
       "momentum_acceleration:6 momentum_21d:6 momentum_63d:6 momentum_252d:6")
def _(p):
    return x.momentum_block(p.bars.select(*KEYS, "close")).drop("close")


VB = (f"(SELECT *, {chg('close')} * volume AS v, coalesce(sign(close - {lag('close')}) * volume, 0) AS o, "
      f"{full('avg', 'volume', 20)} AS vm, {full('avg', 'close', 20)} AS cm FROM bars)")
VB = f"(SELECT *, CASE WHEN v IS NOT NULL THEN sum(v) {RUN} END AS vpt, sum(o) {RUN} AS obv FROM {VB})"


@query("p16_volume_block", "bars", f"""SELECT symbol, date, {chg('vpt', 21)} AS vpt_momentum, {chg('obv', 21)} AS obv_momentum,
    CASE WHEN volume / vm > 2.0 THEN 1 ELSE 0 END AS volume_surge, {chg('cm', 5)} * {chg('vm', 5)} AS price_volume_divergence FROM {VB}""",
       "vpt_momentum:5 obv_momentum:5 price_volume_divergence:6")
def _(p):
    return x.volume_block(p.bars).select(*KEYS, "vpt_momentum", "obv_momentum", "volume_surge", "price_volume_divergence")


@query("p17_balance_panel", "strat", """SELECT strategy, date, daily_return FROM strat WHERE date IN
    (SELECT date FROM strat GROUP BY date HAVING count(*) = (SELECT count(DISTINCT strategy) FROM strat))""", "daily_return:8")
def _(p):
    s = p.strat.withColumnRenamed("strategy", "symbol")
    return x.balance(s, ["daily_return"], "intersection").withColumnRenamed("symbol", "strategy").select(
        "strategy", "date", "daily_return")


@query("p17_balance_ffill", "strat", """SELECT g.strategy, g.date, s.daily_return FROM
    (SELECT strategy, d.date FROM (SELECT strategy, min(date) AS first FROM strat GROUP BY 1) f JOIN (SELECT DISTINCT date FROM strat) d ON d.date >= f.first) g
    ASOF JOIN strat s ON g.strategy = s.strategy AND g.date >= s.date""", "daily_return:8")
def _(p):
    s = p.strat.withColumnRenamed("strategy", "symbol")
    return x.balance(s, ["daily_return"], "ffill").withColumnRenamed("symbol", "strategy").select("strategy", "date", "daily_return")


@query("p17_balance_drop", "bars", """SELECT symbol, date, change FROM (SELECT symbol, date, tanh(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) - 1) AS change FROM bars)
    WHERE change IS NOT NULL""", "change:8")
def _(p):
    from factorframe.functions.windows import change

    return x.balance(p.bars.select("symbol", "date", F.tanh(change("close", 5)).alias("change")), ["change"], "drop")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("p18_reshape_wide", "strat", "SELECT date, " + ", ".join(
    f"round(max(daily_return) FILTER (strategy = '{s}'), 8) AS \"{s[0]}\"" for s in PRIORITIES) + " FROM strat GROUP BY date")
def _(p):
    w = x.to_wide(p.strat.withColumn("daily_return", F.round("daily_return", 8)), "daily_return", PRIORITIES, key="strategy")
    return w.select("date", *[F.col(f"`{s}`").alias(s[0]) for s in PRIORITIES])


@query("p18_reshape_round_trip", "strat", "SELECT date, strategy, daily_return FROM strat", "daily_return:8")
def _(p):
    w = x.to_wide(p.strat, "daily_return", PRIORITIES, key="strategy")
    return x.to_long(w, PRIORITIES, "daily_return", key="strategy")


for freq, key in (("weekly", "strftime(date, '%Y-%W')"), ("monthly", "strftime(date, '%Y-%m')"),
                  ("quarterly", "year(date) || '-Q' || quarter(date)")):
    @query(f"p19_rebalance_{freq}", "bars", f"SELECT {key} AS bucket, max(date) AS rebalance_date FROM bars GROUP BY 1")
    def _(p, freq=freq):
        return x.rebalance_dates(p.bars, freq)


@query("p20_correlation_pearson", "ret", """SELECT a.symbol AS s1, b.symbol AS s2, count(*) AS n, corr(a.r, b.r) AS corr
    FROM ret a JOIN ret b ON a.date = b.date AND a.symbol <= b.symbol GROUP BY 1, 2""", "corr:6")
def _(p):
    return x.correlation(p.ret, "r")


@query("p20_correlation_spearman", "strat", """SELECT s1, s2, count(*) AS n, corr(rx, ry) AS corr FROM (
    SELECT s1, s2, rank() OVER (PARTITION BY s1, s2 ORDER BY x) + (count(*) OVER (PARTITION BY s1, s2, x) - 1) / 2.0 AS rx,
           rank() OVER (PARTITION BY s1, s2 ORDER BY y) + (count(*) OVER (PARTITION BY s1, s2, y) - 1) / 2.0 AS ry
    FROM (SELECT a.strategy AS s1, b.strategy AS s2, a.daily_return AS x, b.daily_return AS y
          FROM strat a JOIN strat b ON a.date = b.date AND a.strategy <= b.strategy)) GROUP BY 1, 2""", "corr:6")
def _(p):
    return x.correlation(p.strat, "daily_return", "spearman", key="strategy")


@query("p20_correlation_kendall", "strat", """SELECT s1, s2, max(n) AS n, sum(sign(x2 - x) * sign(y2 - y)) / sqrt(sum(abs(sign(x2 - x))) * sum(abs(sign(y2 - y)))) AS corr
    FROM (SELECT a.*, b.x AS x2, b.y AS y2, count(*) OVER (PARTITION BY a.s1, a.s2) / a.m * 0 + a.m AS n FROM
      (SELECT *, row_number() OVER (PARTITION BY s1, s2 ORDER BY d) AS i, count(*) OVER (PARTITION BY s1, s2) AS m FROM q) a
      JOIN (SELECT *, row_number() OVER (PARTITION BY s1, s2 ORDER BY d) AS i FROM q) b ON a.s1 = b.s1 AND a.s2 = b.s2 AND a.i < b.i)
    GROUP BY 1, 2""".replace("count(*) OVER (PARTITION BY a.s1, a.s2) / a.m * 0 + a.m AS n", "a.m AS n")
       .replace("FROM q)", """FROM (SELECT a.strategy AS s1, b.strategy AS s2, a.v AS x, b.v AS y, a.m AS d FROM mo a JOIN mo b ON a.m = b.m AND a.strategy <= b.strategy))""")
       .replace("FROM mo a JOIN mo b", """FROM (SELECT strategy, date_trunc('month', date) AS m, round(avg(daily_return), 12) AS v FROM strat GROUP BY 1, 2) a
          JOIN (SELECT strategy, date_trunc('month', date) AS m, round(avg(daily_return), 12) AS v FROM strat GROUP BY 1, 2) b"""), "corr:6")
def _(p):
    monthly = x.resample(p.strat, "month", {"daily_return": ("mean", "daily_return")}, keys=["strategy"])
    monthly = monthly.withColumn("daily_return", F.round("daily_return", 12))
    return x.correlation(monthly, "daily_return", "kendall", key="strategy", order="period")


@query("p21_derived_bar_columns", "bars", """SELECT symbol, date, (high + low + close) / 3 AS typical_price, (high + low) / 2 AS median_price,
    high - low AS price_range, abs(close - open) AS body_size, abs(close - open) < 0.1 * (high - low) AS is_doji FROM bars""",
       "typical_price:3 median_price:3 price_range:3 body_size:3")
def _(p):
    return x.derived_bar_columns(p.bars).drop("open", "high", "low", "close", "volume")
