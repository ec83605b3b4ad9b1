"""Queries Q1-Q27."""

from pyspark.sql import functions as F

from factorframe.operators import quality as q
from factorframe.plans.catalog import query
from factorframe.plans.q_technical import RUN, chg, lag
from factorframe.functions.windows import change

PX = ["open", "high", "low", "close"]
BAD = {
    "non_positive_price": "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0",
    "high_below_low": "high < low",
    "open_close_outside_range": "high < open OR high < close OR low > open OR low > close",
    "negative_volume": "volume < 0",
    "missing_price": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL",
}


@query("q01_validate_bars", "dirty", " UNION ALL ".join(
    f"SELECT symbol, '{r}' AS rule, count(*) AS n FROM dirty WHERE {e} GROUP BY symbol" for r, e in BAD.items()))
def _(p):
    return q.validate_bars(p.dirty)


@query("q02_validate_factors", "factors", " UNION ALL ".join(
    f"SELECT '{x}_out_of_range' AS rule, count(*) FILTER (abs({x}) > {lim}) AS n FROM factors"
    for x, lim in (("MKT", 1), ("SMB", 1), ("HML", 1), ("RMW", 1), ("CMA", 1), ("RF", 0.1))))
def _(p):
    return q.validate_factors(p.factors)


@query("q03_validate_signals", "signals meta", """SELECT symbol, 'outside_unit_range' AS rule, count(*) AS n FROM signals
    WHERE signal < 0 OR signal > 1 GROUP BY 1 UNION ALL SELECT symbol, 'missing', 1 FROM
    (SELECT symbol FROM meta UNION SELECT n_name FROM nation) WHERE symbol NOT IN (SELECT symbol FROM signals)""")
def _(p):
    wanted = p.meta.select("symbol").union(p.table("nation").select("n_name"))
    return q.validate_signals(p.signals, wanted)


@query("q04_validate_weights", "weights", """SELECT *, abs(total - 1) <= 0.01 AND min_weight >= 0 AND max_weight <= 1 AND nulls = 0 AS valid
    FROM (SELECT strategy, date, sum(weight) AS total, min(weight) AS min_weight, max(weight) AS max_weight,
          count(*) FILTER (weight IS NULL) AS nulls FROM weights GROUP BY 1, 2)""", "total:8 min_weight:8 max_weight:8")
def _(p):
    return q.validate_weights(p.weights)


@query("q05_repair_bars", "dirty", """SELECT symbol, date, o AS open, greatest(h2, o, c) AS high, least(l2, o, c) AS low, c AS close, volume FROM
    (SELECT *, CASE WHEN h < l THEN l ELSE h END AS h2, CASE WHEN h < l THEN h ELSE l END AS l2 FROM
     (SELECT *, CASE WHEN open >= 0 THEN open END AS o, CASE WHEN high >= 0 THEN high END AS h, CASE WHEN low >= 0 THEN low END AS l,
      CASE WHEN close >= 0 THEN close END AS c FROM dirty)) WHERE o IS NOT NULL AND c IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL""",
       "open:3 high:3 low:3 close:3")
def _(p):
    return q.repair_bars(p.dirty)


AHEAD = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("q06_clean_bars", "dirty", f"""SELECT symbol, date, open, high, low, volume,
    coalesce(last(close IGNORE NULLS) {RUN}, first(close IGNORE NULLS) {AHEAD}) AS close FROM dirty""",
       "open:3 high:3 low:3 close:3")
def _(p):
    return q.clean_bars(p.dirty)


@query("q07_clean_factors", "factors", """SELECT * FROM factors WHERE abs(MKT) <= 0.004 AND abs(SMB) <= 0.004 AND abs(HML) <= 0.004
    AND abs(RMW) <= 0.004 AND abs(CMA) <= 0.004 AND abs(RF) <= 0.1""", "MKT:9 SMB:9 HML:9 RMW:9 CMA:9 RF:9")
def _(p):
    return q.clean_factors(p.factors, limit=0.004)


@query("q08_quality_report", "dirty", f"""SELECT *, CASE WHEN median_gap IS NULL THEN 'unknown' WHEN median_gap <= 1.5 THEN 'daily'
      WHEN median_gap <= 8 THEN 'weekly' WHEN median_gap <= 35 THEN 'monthly' ELSE 'low_frequency' END AS frequency FROM
    (SELECT symbol, count(*) AS total_rows, min(date) AS start, max(date) AS "end",
     {", ".join(f"count(*) FILTER ({x} IS NULL) AS missing_{x}" for x in PX + ["volume"])},
     count(date) - count(DISTINCT date) AS duplicate_dates, CAST(median(gap) AS DOUBLE) AS median_gap,
     max(abs(ret)) AS max_daily_change, stddev_samp(ret) * sqrt(252) AS volatility
     FROM (SELECT *, date - {lag('date')} AS gap, {chg('close')} AS ret FROM dirty) GROUP BY symbol)""",
       "max_daily_change:4 volatility:4")
def _(p):
    return q.quality_report(p.dirty)


@query("q09_frame_statistics", "bars", """SELECT count(DISTINCT symbol) AS symbols, min(date) AS start, max(date) AS "end", count(*) AS points,
    count(*) / count(DISTINCT symbol) AS points_per_symbol FROM bars""", "points_per_symbol:6")
def _(p):
    return q.frame_statistics(p.bars)


@query("q10_success_gate", "bars meta", """SELECT wanted, found, found / wanted AS share, found / wanted >= 0.8 AND found >= 10 AS passed FROM
    (SELECT count(*) AS wanted, count(*) FILTER (symbol IN (SELECT symbol FROM bars)) AS found FROM
     (SELECT symbol FROM meta UNION SELECT n_name FROM nation))""", "share:6")
def _(p):
    return q.success_gate(p.meta.select("symbol").union(p.table("nation").select("n_name")), p.bars)


@query("q11_usable_symbols", "bars", """SELECT symbol, date, close FROM bars WHERE symbol IN
    (SELECT symbol FROM bars GROUP BY 1 HAVING count(close) > 0 AND count(*) >= 1500)""", "close:3")
def _(p):
    return q.usable(p.bars, 1500).select("symbol", "date", "close")


def returns_sql(table, key, value, extreme, gap):
    return f"""SELECT *, distinct_values <= 2 AS near_constant, volatility < 1e-6 AS flat, volatility > 0.1 AS wild,
    max_gap > {gap} AS has_gaps, n < 20 AS too_short FROM (SELECT {key}, count(*) AS n, count(*) FILTER (abs({value}) > {extreme}) AS extreme,
     count(*) FILTER ({value} IS NULL) AS missing, count(DISTINCT {value}) AS distinct_values, stddev_samp({value}) AS volatility,
     CAST(max(date - lag) AS INTEGER) AS max_gap FROM (SELECT *, lag(date) OVER (PARTITION BY {key} ORDER BY date) AS lag FROM {table}) GROUP BY 1)"""


@query("q12_check_returns", "ret", returns_sql("(SELECT symbol, date, round(r, 10) AS r FROM ret)", "symbol", "r", 0.0076, 5), "volatility:8")
def _(p):
    return q.check_returns(p.ret.withColumn("r", F.round("r", 10)), "symbol", "r", extreme=0.0076)


FEATURES = {"momentum_5d": 5, "momentum_252d": 252}


@query("q13_missing_report", "bars", f"""SELECT feature, missing, total, missing / total AS missing_share, expected, missing > expected * 1.5 AS exceeds FROM
    (SELECT *, (CASE feature WHEN 'momentum_5d' THEN 5 ELSE 252 END) * (SELECT count(DISTINCT symbol) FROM bars) AS expected FROM
     (SELECT 'momentum_5d' AS feature, count(*) AS total, count(*) FILTER (a IS NULL) AS missing FROM (SELECT {chg('close', 5)} AS a FROM bars)
      UNION ALL SELECT 'momentum_252d', count(*), count(*) FILTER (a IS NULL) FROM (SELECT {chg('close', 252)} AS a FROM bars)))""", "missing_share:6")
def _(p):
    df = p.bars.select("symbol", *[change("close", n).alias(f) for f, n in FEATURES.items()])
    return q.missing_report(df, FEATURES)


@query("q14_panel_checks", "dirty", """SELECT symbols, missing_share, empty_rows_share, dates_covered,
    symbols >= 3 AND dates_covered >= 0.5 AND missing_share <= 0.5 AND empty_rows_share <= 0.1 AS valid FROM
    (SELECT count(DISTINCT symbol) AS symbols, sum((close IS NULL)::INT + (v IS NULL)::INT) / (count(*) * 2) AS missing_share,
     avg((close IS NULL AND v IS NULL)::INT) AS empty_rows_share FROM (SELECT *, CASE WHEN close > 0 THEN volume END AS v FROM dirty)),
    (SELECT avg((n >= 3)::INT) AS dates_covered FROM (SELECT count(*) AS n FROM dirty GROUP BY date))""",
       "missing_share:8 empty_rows_share:8 dates_covered:8")
def _(p):
    df = p.dirty.select("symbol", "date", "close", F.when(F.col("close") > 0, F.col("volume")).alias("v"))
    return q.panel_checks(df, ["close", "v"])


@query("q15_panel_summary", "bars", """SELECT *, n_rows / (dates * symbols) AS completeness, n_rows / dates AS avg_per_date FROM
    (SELECT count(DISTINCT date) AS dates, count(DISTINCT symbol) AS symbols, count(*) AS n_rows FROM bars)""",
       "completeness:8 avg_per_date:6")
def _(p):
    return q.panel_summary(p.bars)


@query("q16_outliers", "bars", """SELECT symbol, date, close < q1 - 1.5 * (q3 - q1) OR close > q3 + 1.5 * (q3 - q1) AS iqr,
    abs((close - a) / s) > 3 AS zscore, abs(0.6745 * (close - med) / md) > 3.5 AS modified FROM bars,
    (SELECT quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3, avg(close) AS a, stddev_samp(close) AS s,
     median(close) AS med, mad(close) AS md FROM bars)""")
def _(p):
    df = p.bars.select("symbol", "date", "close")
    out = q.outliers(df, "close", "iqr", 1.5, name="iqr", base=df)
    out = q.outliers(out, "close", "zscore", 3.0, name="zscore", base=df)
    return q.outliers(out, "close", "modified_zscore", 3.5, name="modified", base=df).drop("close")


@query("q17_clean", "bars", """, a AS (SELECT quantile_cont(close, 0.25) AS q1, quantile_cont(close, 0.75) AS q3 FROM bars),
    b AS (SELECT symbol, date, close, volume FROM bars, a WHERE close BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
    d AS (SELECT quantile_cont(volume, 0.25) AS q1, quantile_cont(volume, 0.75) AS q3 FROM b)
    SELECT symbol, date, close, volume FROM b, d WHERE volume BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""".replace(", a AS", "WITH a AS", 1),
       "close:3")
def _(p):
    return q.clean(p.bars.select("symbol", "date", "close", "volume"), ["close", "volume"])


@query("q18_clip_to_bounds", "bars", """SELECT symbol, date, greatest(least(close, a + 3 * s), a - 3 * s) AS close FROM bars
    JOIN (SELECT symbol AS k, avg(close) AS a, stddev_samp(close) AS s FROM bars GROUP BY 1) ON symbol = k""", "close:3")
def _(p):
    return q.clip_to_bounds(p.bars.select("symbol", "date", "close"), "close", 3.0, ["symbol"])


EXT = "(SELECT strategy, date, round(daily_return, 9) AS daily_return FROM strat WHERE abs(daily_return) > 0.005)"
TOP = f"(SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY abs(daily_return) DESC, date) AS position FROM {EXT})"


def _rounded(p):
    return p.strat.withColumn("daily_return", F.round("daily_return", 9))


@query("q19_extreme_days", "strat", f"SELECT strategy, date, daily_return, CAST(position AS INTEGER) AS position FROM {TOP} WHERE position <= 10")
def _(p):
    return q.extreme_days(_rounded(p), 0.005).select("strategy", "date", "daily_return", "position")


@query("q19_extreme_context", "strat weights trades", f"""SELECT e.strategy, e.date, coalesce(h.names_held, 0) AS names_held, h.largest_weight,
    coalesce(t.trades, 0) AS trades, t.traded_quantity
    FROM (SELECT 'momentum' AS strategy, date FROM {TOP} WHERE position <= 10) e
    LEFT JOIN (SELECT strategy, date, count(*) AS names_held, max(weight) AS largest_weight FROM weights WHERE weight > 0 GROUP BY 1, 2) h
      ON e.strategy = h.strategy AND e.date = h.date
    LEFT JOIN (SELECT date, count(*) AS trades, sum(quantity) AS traded_quantity FROM trades GROUP BY 1) t ON e.date = t.date""",
       "largest_weight:8")
def _(p):
    days = q.extreme_days(_rounded(p), 0.005).select(F.lit("momentum").alias("strategy"), "date")
    return q.extreme_context(days, p.weights, p.trades)


@query("q19_extreme_runs", "strat", f"""SELECT strategy, run, min(date) AS start, max(date) AS "end", count(*) AS days, sum(daily_return) AS total_return FROM
    (SELECT *, CAST(sum(fresh) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM
     (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY strategy ORDER BY date) <= 3 THEN 0 ELSE 1 END AS fresh FROM {EXT}))
    GROUP BY 1, 2""", "total_return:8")
def _(p):
    return q.extreme_runs(_rounded(p), 0.005)


@query("q19_around_dates", "strat", f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY date) AS i FROM strat),
    m AS (SELECT n.strategy, n.date AS mark, n.i FROM n JOIN {TOP} t ON n.strategy = t.strategy AND n.date = t.date WHERE t.position <= 3)
    SELECT n.strategy, mark, CAST(n.i - m.i AS INTEGER) AS "offset", n.date, daily_return FROM n JOIN m ON n.strategy = m.strategy
    AND n.i BETWEEN m.i - 5 AND m.i + 5""", "daily_return:8")
def _(p):
    marks = q.extreme_days(_rounded(p), 0.005, n=3)
    return q.around_dates(p.strat, marks)


@query("q19_return_percentiles", "strat", "SELECT strategy, " + ", ".join(
    f"quantile_cont(daily_return, {v}) AS p{round(v * 100)}" for v in (0.01, 0.05, 0.5, 0.95, 0.99)) + " FROM strat GROUP BY 1",
       "p1:8 p5:8 p50:8 p95:8 p99:8")
def _(p):
    return q.return_percentiles(p.strat)


@query("q20_beta_diagnosis", "strat benchmark_returns", """SELECT strategy, count(*) AS overlap, covar_samp(daily_return, bench_return) * 1e4 AS covariance,
    var_samp(bench_return) * 1e4 AS bench_variance, corr(daily_return, bench_return) AS correlation, regr_slope(daily_return, bench_return) AS slope,
    regr_intercept(daily_return, bench_return) AS intercept, regr_r2(daily_return, bench_return) AS r2,
    stddev_samp(daily_return) AS std, stddev_samp(bench_return) AS bench_std, max(abs(daily_return)) > 1 AS looks_like_percent,
    quantile_cont(daily_return, 0.01) AS q01, quantile_cont(daily_return, 0.99) AS q99
    FROM strat JOIN benchmark_returns USING (date) GROUP BY 1""",
       "covariance:8 bench_variance:8 correlation:7 slope:7 intercept:8 r2:7 std:8 bench_std:8 q01:8 q99:8")
def _(p):
    out = q.beta_diagnosis(p.strat, p.benchmark)
    return out.withColumn("covariance", F.col("covariance") * 1e4).withColumn("bench_variance", F.col("bench_variance") * 1e4)


@query("q20_value_kind", "bars", """SELECT symbol, lowest, mean_abs, CASE WHEN lowest > 0 AND mean_abs > 1 THEN 'prices'
    WHEN mean_abs > 0.5 THEN 'percent' ELSE 'returns' END AS kind FROM
    (SELECT symbol, min(close) AS lowest, avg(abs(close)) AS mean_abs FROM bars GROUP BY 1)""", "lowest:3 mean_abs:3")
def _(p):
    return q.value_kind(p.bars, "symbol", "close")


@query("q21_validate_metrics", "bars", """WITH m AS (SELECT symbol, (avg(r) - (pow(1.02, 1.0 / 252) - 1)) / stddev_samp(r) * sqrt(252) AS s,
      stddev_samp(r) * sqrt(252) AS v FROM (SELECT symbol, tanh(close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1) AS r FROM bars) GROUP BY 1)
    SELECT symbol AS strategy, 'sharpe_ratio' AS metric, s AS value, 'warning' AS severity FROM m WHERE s < -5 OR s > 5
    UNION ALL SELECT symbol, 'volatility', v, 'error' FROM m WHERE v < 0 OR v > 1
    UNION ALL SELECT symbol, 'implied_return', s * v, 'warning' FROM m WHERE v > 0 AND abs(s * v) > 0.5""", "value:6")
def _(p):
    from factorframe.functions.stats import sharpe

    r = p.bars.select("symbol", F.tanh(change("close")).alias("r"))
    wide = r.groupBy(F.col("symbol").alias("strategy")).agg(
        sharpe("r").alias("sharpe_ratio"), (F.stddev_samp("r") * 252**0.5).alias("volatility"))
    return q.validate_metrics(wide.unpivot(["strategy"], ["sharpe_ratio", "volatility"], "metric", "value"))


@query("q22_validate_returns_matrix", "strat", returns_sql("(SELECT strategy, date, round(daily_return, 10) AS daily_return FROM strat)",
                                                            "strategy", "daily_return", 0.5, 5), "volatility:8")
def _(p):
    return q.check_returns(p.strat.withColumn("daily_return", F.round("daily_return", 10)))


@query("q23_signal_report", "signals", """SELECT strategy, date, count(*) AS symbols, count(*) FILTER (signal > 0) AS positive,
    count(*) FILTER (signal < 0) AS negative, count(*) FILTER (signal = 0) AS zero, min(signal) AS lowest, max(signal) AS highest,
    count(*) FILTER (abs(signal) > 10) AS extreme, CAST(0 AS BIGINT) AS not_finite FROM signals GROUP BY 1, 2""", "lowest:8 highest:8")
def _(p):
    return q.signal_report(p.signals)


@query("q24_signal_diversity", "signals", """WITH s AS (SELECT symbol, date, round(avg(signal), 8) AS signal FROM signals GROUP BY symbol, date),
    a AS (SELECT avg(v) AS avg_time_variance, avg(u) AS avg_unique_values FROM (SELECT var_samp(signal) AS v, count(DISTINCT signal) AS u FROM s GROUP BY symbol)),
    b AS (SELECT avg(v) AS cross_variance_mean, stddev_samp(v) AS cross_variance_std, min(v) AS cross_variance_min, max(v) AS cross_variance_max
          FROM (SELECT var_samp(signal) AS v FROM s GROUP BY date)),
    p AS (SELECT avg(r) AS avg_pairwise_correlation, max(r) AS max_correlation FROM (SELECT corr(x.signal, y.signal) AS r
          FROM s x JOIN s y ON x.date = y.date AND x.symbol < y.symbol GROUP BY x.symbol, y.symbol)),
    d AS (SELECT 100 * avg((signal > 0)::INT) AS long_percentage, 100 * avg((signal < 0)::INT) AS short_percentage FROM s)
    SELECT *, avg_time_variance > 1e-6 AS diverse FROM a, b, p, d""",
       "avg_time_variance:7 avg_unique_values:6 cross_variance_mean:7 cross_variance_std:7 cross_variance_min:7 cross_variance_max:7 "
       "avg_pairwise_correlation:7 max_correlation:7 long_percentage:6 short_percentage:6")
def _(p):
    blend = p.signals.groupBy("symbol", "date").agg(F.round(F.avg("signal"), 8).alias("signal"))  # of all strategies
    return q.signal_diversity(blend)


@query("q25_series_checks", "dirty", """SELECT *, n >= 252 AND values > 0 AND non_positive = 0 AS valid FROM
    (SELECT symbol, count(*) AS n, count(close) AS values, count(*) FILTER (close <= 0) AS non_positive FROM dirty GROUP BY 1)""")
def _(p):
    return q.series_checks(p.dirty)


@query("q26_trace_signal_to_weight", "signals weights", """SELECT strategy, date, count(*) FILTER (coalesce(signal, 0) <> 0) AS non_zero_signals,
    count(*) FILTER (coalesce(weight, 0) <> 0) AS non_zero_weights,
    count(*) FILTER (coalesce(weight, 0) <> 0 AND coalesce(signal, 0) = 0) AS weight_without_signal,
    count(*) FILTER (r IS NOT NULL) AS recommended, count(*) FILTER (r IS NOT NULL AND coalesce(signal, 0) = 0) AS recommended_without_signal
    FROM (SELECT strategy, date, symbol, CASE WHEN abs(signal) > 0.2 THEN signal END AS signal FROM signals) s
    FULL JOIN (SELECT strategy, date, symbol, weight FROM weights) w USING (strategy, date, symbol)
    FULL JOIN (SELECT strategy, date, symbol, 1 AS r FROM weights WHERE weight > 0.1) x USING (strategy, date, symbol) GROUP BY 1, 2""")
def _(p):  # small signals count as none, so weights without a signal occur
    s = p.signals.withColumn("signal", F.when(F.abs("signal") > 0.2, F.col("signal")))
    return q.trace_signal_to_weight(s, p.weights, p.weights.where("weight > 0.1"), ("strategy", "date", "symbol"), ("strategy", "date"))


@query("q27_validate_experiments", "signals", returns_sql(
    "(SELECT strategy || ' ' || symbol AS strategy, date, round(0.01 * signal, 10) AS signal FROM signals)", "strategy", "signal", 0.002, 7), "volatility:8")
def _(p):
    s = p.signals.select(F.concat_ws(" ", "strategy", "symbol").alias("strategy"), "date",
                         F.round(0.01 * F.col("signal"), 10).alias("signal"))
    return q.check_returns(s, "strategy", "signal", extreme=0.002, gap_days=7)
