"""Queries G1-G17."""

from pyspark.sql import functions as F

from factorframe.operators import estimate as m, signals as g
from factorframe.plans.catalog import query
from factorframe.plans.ols_sql import ols_sql
from factorframe.plans.q_estimate import FRAME, FIT3, frame

# a third regression with two factors gives the statistics to filter by; names with few rows have none
STATS = f"(SELECT symbol, t_alpha AS t_stat FROM {FIT3} WHERE n >= 1500)"


def _fit(p):
    return m.fit(frame(p, m.FF3), m.FF3)


def _stats(p, fit):
    return fit.where("n >= 1500").select("symbol", F.col("t_alpha").alias("t_stat"))


FACTOR = {"hard_threshold": "CASE WHEN abs(t_stat) >= 0.5 THEN 1 ELSE 0 END", "linear_shrinkage": "least(1, abs(t_stat) / 0.5)",
          "sigmoid_shrinkage": "1 / (1 + exp(-2 * (abs(t_stat) - 0.5)))"}


@query("g01_alpha_filter", "ret factors", f"SELECT e.symbol, CASE WHEN s.symbol IS NULL THEN alpha ELSE alpha * {FACTOR['hard_threshold']} END AS alpha FROM {FIT3} e LEFT JOIN {STATS} s ON e.symbol = s.symbol", "alpha:8")
def _(p):
    fit = _fit(p)
    return g.filter_alphas(fit.select("symbol", "alpha"), _stats(p, fit), threshold=0.5)


@query("g02_shrinkage", "ret factors", f"SELECT symbol, {', '.join(f'CAST(coalesce({e}, 0) AS DOUBLE) AS {k}' for k, e in FACTOR.items())} FROM (SELECT symbol, t_alpha AS t_stat FROM {FIT3})",
       " ".join(f"{k}:6" for k in FACTOR))
def _(p):
    return _fit(p).select("symbol", *[g.shrinkage("t_alpha", 0.5, k).alias(k) for k in FACTOR])


ROLL = f"""(SELECT symbol, date, t_alpha AS t_stat FROM ({ols_sql(f'''(SELECT a.symbol, a.date, b.y, b.MKT, b.SMB FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {FRAME}) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {FRAME}) b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 59 AND a.i)''', ["symbol", "date"], ["MKT", "SMB"], "y", min_rows=30)}))"""


@query("g03_rolling_alpha_filter", "signals ret factors", f"""SELECT strategy, s.date, s.symbol, CASE WHEN r.symbol IS NULL THEN signal ELSE signal * CASE WHEN abs(t_stat) >= 1.0 THEN 1 ELSE 0 END END AS signal
    FROM signals s LEFT JOIN {ROLL} r ON s.symbol = r.symbol AND s.date = r.date""", "signal:7")
def _(p):
    t = m.rolling_alpha_tstats(frame(p, ["MKT", "SMB"]), ["MKT", "SMB"], n=60)
    s = p.signals.select("strategy", "date", "symbol", "signal")
    return g.filter_alphas(s, t, ["symbol", "date"], threshold=1.0, value="signal")


SR = "(SELECT strategy, date, symbol, round(signal + 1.7e-11, 8) AS signal FROM signals)"


def _signals(p):
    return p.signals.withColumn("signal", F.round(F.col("signal") + 1.7e-11, 8))


@query("g04_rank_transform", "signals", f"""SELECT strategy, date, symbol, CASE WHEN count(*) OVER w > 1 THEN (rank() OVER (PARTITION BY strategy, date ORDER BY signal)
    + (count(*) OVER (PARTITION BY strategy, date, signal) - 1) / 2.0 - 1) / (count(*) OVER w - 1) ELSE 1 END AS signal FROM {SR} WINDOW w AS (PARTITION BY strategy, date)""", "signal:7")
def _(p):
    s = _signals(p).withColumnRenamed("signal", "alpha")
    return g.transform(s, "rank", ["strategy", "date"]).drop("alpha")


@query("g04_zscore_transform", "signals", f"""SELECT strategy, date, symbol, CASE WHEN stddev_pop(signal) OVER w > 0 THEN (tanh((signal - avg(signal) OVER w) / stddev_pop(signal) OVER w) + 1) / 2 ELSE 0 END AS signal
    FROM {SR} WINDOW w AS (PARTITION BY strategy, date)""", "signal:6")
def _(p):
    s = _signals(p).withColumnRenamed("signal", "alpha")
    return g.transform(s, "zscore", ["strategy", "date"]).drop("alpha")


@query("g05_alpha_signals", "ret factors", f"""WITH a AS (SELECT e.symbol, round(CASE WHEN s.symbol IS NULL THEN alpha ELSE alpha * {FACTOR['linear_shrinkage']} END, 10) AS alpha FROM {FIT3} e LEFT JOIN {STATS} s ON e.symbol = s.symbol),
    r AS (SELECT symbol, (rank() OVER (ORDER BY alpha) + (count(*) OVER (PARTITION BY alpha) - 1) / 2.0 - 1) / (count(*) OVER () - 1) AS signal FROM a)
    SELECT date, symbol, signal FROM r, (SELECT DISTINCT date FROM ret)""", "signal:7")
def _(p):
    fit = _fit(p)
    return g.alpha_signals(fit, p.ret, _stats(p, fit), threshold=0.5, shrink="linear_shrinkage")


@query("g05_expected_return_signals", "ret factors", f"""WITH x AS (SELECT r.date, r.symbol, alpha + b_MKT * MKT + b_SMB * SMB + b_HML * HML AS e FROM ret r JOIN factors f ON r.date = f.date JOIN {FIT3} e ON e.symbol = r.symbol)
    SELECT date, symbol, CASE WHEN stddev_pop(e) OVER w > 0 THEN (tanh((e - avg(e) OVER w) / stddev_pop(e) OVER w) + 1) / 2 ELSE 0 END AS signal FROM x WINDOW w AS (PARTITION BY date)""", "signal:5")
def _(p):
    pts = p.ret.select("symbol", "date").join(p.factors.select("date", *m.FF3), "date")
    return g.expected_return_signals(pts, _fit(p), m.FF3, method="zscore")


@query("g06_calendar_predictions", "signals", """WITH s AS (SELECT strategy, symbol, date, signal AS prediction FROM signals),
    d AS (SELECT strategy, symbol, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM s GROUP BY strategy, symbol)
    SELECT d.strategy, d.symbol, d.date, prediction FROM d ASOF LEFT JOIN s ON d.strategy = s.strategy AND d.symbol = s.symbol AND d.date >= s.date""", "prediction:7")
def _(p):
    return g.calendar_predictions(p.signals.select("strategy", "symbol", "date", F.col("signal").alias("prediction")), keys=("strategy", "symbol"))


@query("g07_long_only", "weights", "SELECT strategy, date, symbol, weight FROM weights", "weight:8")
def _(p):
    return p.weights


GAP = f"(SELECT strategy, date, symbol, CASE WHEN abs(signal) > 0.05 THEN signal END AS signal FROM {SR})"


def _gappy(p):
    return _signals(p).withColumn("signal", F.when(F.abs("signal") > 0.05, F.col("signal")))


@query("g08_clipped_zscore", "signals", f"""SELECT strategy, date, symbol, CASE WHEN signal IS NOT NULL AND stddev_samp(signal) OVER w > 0
    THEN greatest(least((signal - avg(signal) OVER w) / stddev_samp(signal) OVER w, 3), -3) ELSE 0 END AS signal FROM {GAP} WINDOW w AS (PARTITION BY strategy, date)""", "signal:6")
def _(p):
    return g.clipped_zscore(_gappy(p))


@query("g08_min_max", "signals", f"""SELECT strategy, date, symbol, coalesce((signal - min(signal) OVER w) / CASE WHEN max(signal) OVER w > min(signal) OVER w THEN max(signal) OVER w - min(signal) OVER w ELSE 1 END, 0.5) AS signal
    FROM {GAP} WINDOW w AS (PARTITION BY strategy, date)""", "signal:7")
def _(p):
    return g.min_max(_gappy(p))


@query("g09_drop_weak", "signals", "SELECT strategy, date, symbol, CASE WHEN abs(signal) < 0.1 THEN 0 ELSE signal END AS signal FROM signals", "signal:7")
def _(p):
    return g.drop_weak(p.signals)


@query("g10_unit_range", "signals", """SELECT strategy, date, symbol, CASE WHEN max(signal) OVER w > min(signal) OVER w THEN 2 * (signal - min(signal) OVER w) / (max(signal) OVER w - min(signal) OVER w) - 1 ELSE 0 END AS signal
    FROM signals WINDOW w AS (PARTITION BY strategy, date)""", "signal:7")
def _(p):
    return g.to_unit_range(p.signals)


def _pair(p, a, b):
    n = p.table("region").where("r_regionkey < 2")
    return n.select(F.when(F.col("r_regionkey") == 0, "momentum").otherwise("reversal").alias("strategy"), F.when(F.col("r_regionkey") == 0, a).otherwise(b))


@query("g11_combine", "signals", "SELECT date, symbol, sum(signal * CASE strategy WHEN 'momentum' THEN 0.75 ELSE 0.25 END) AS signal FROM signals GROUP BY 1, 2", "signal:7")
def _(p):
    return g.combine(p.signals, _pair(p, 3.0, 1.0).toDF("strategy", "weight"))


@query("g12_last_wins", "signals", "SELECT date, symbol, arg_max(signal, CASE strategy WHEN 'momentum' THEN 1 ELSE 2 END) AS signal FROM signals GROUP BY 1, 2", "signal:7")
def _(p):
    return g.last_wins(p.signals, _pair(p, 1, 2).toDF("strategy", "priority"))


@query("g13_equal_weights", "strat", "SELECT strategy, 1.0 / (SELECT count(DISTINCT strategy) FROM strat) AS weight FROM strat GROUP BY 1", "weight:8")
def _(p):
    return g.fit_weights(p.strat, p.benchmark, "equal")


def _descent(rest, den, steps=3000):
    """Coordinate descent over the covariances of common dates, one coordinate a step; ``x`` is the old weight."""
    return f"""WITH RECURSIVE c AS (SELECT date FROM strat JOIN benchmark_returns USING (date) GROUP BY date HAVING count(*) = (SELECT count(DISTINCT strategy) FROM strat)),
        f AS (SELECT strategy, date, daily_return AS r, bench_return AS b FROM strat JOIN benchmark_returns USING (date) JOIN c USING (date)),
        v AS (SELECT x.strategy, y.strategy AS other, covar_pop(x.r, y.r) AS s FROM f x JOIN f y USING (date) GROUP BY 1, 2),
        t AS (SELECT strategy, covar_pop(r, b) AS y, count(*) AS n FROM f GROUP BY 1),
        m AS (SELECT list(strategy ORDER BY strategy) AS names, list(s ORDER BY strategy) AS s, list(y ORDER BY strategy) AS y, max(n) AS n
            FROM t JOIN (SELECT strategy, list(s ORDER BY other) AS s FROM v GROUP BY 1) USING (strategy)),
        d AS (SELECT 0 AS step, list_transform(names, lambda x: CAST(0 AS DOUBLE)) AS w FROM m
            UNION ALL SELECT step + 1, list_transform(w, lambda x, i: CASE WHEN i = step % len(w) + 1
                THEN greatest(y[i] - list_inner_product(s[i], w) + s[i][i] * x - {rest}, 0) / (s[i][i] + {den}) ELSE x END) FROM d, m WHERE step < {steps})
        SELECT unnest(names) AS strategy, unnest(list_transform(w, lambda x: x / list_sum(w))) AS weight FROM d, m WHERE step = {steps}"""


@query("g13_lasso_weights", "strat benchmark_returns", _descent("1e-7", "0"), "weight:6")
def _(p):
    return g.fit_weights(p.strat, p.benchmark, "lasso", 1e-7)


@query("g13_ridge_weights", "strat benchmark_returns", _descent("0", "0.001 / n"), "weight:6")
def _(p):
    return g.fit_weights(p.strat, p.benchmark, "ridge", 0.001)


@query("g14_combined_return", "strat", "SELECT date, sum(daily_return) / 5 AS combined_return FROM strat GROUP BY 1", "combined_return:8")
def _(p):
    return g.combined_return(p.strat, g.fit_weights(p.strat, p.benchmark, "equal"))


@query("g15_signal_records", "signals bars", """SELECT s.strategy, s.date, s.symbol, CASE WHEN signal > 0 THEN 'BUY' ELSE 'SELL' END AS signal_type, least(abs(signal), 1) AS strength, b.close AS price
    FROM (SELECT * FROM signals WHERE signal <> 0) s ASOF LEFT JOIN bars b ON s.symbol = b.symbol AND s.date >= b.date""", "strength:7 price:3")
def _(p):
    return g.signal_records(p.signals, p.bars)


@query("g16_signal_quality", "signals", """WITH d AS (SELECT strategy, date, lead(date) OVER (PARTITION BY strategy ORDER BY date) AS nxt FROM (SELECT DISTINCT strategy, date FROM signals)),
    pr AS (SELECT d.strategy, y.symbol, d.date, d.nxt FROM d JOIN (SELECT DISTINCT strategy, symbol FROM signals) y ON d.strategy = y.strategy WHERE nxt IS NOT NULL),
    f AS (SELECT pr.strategy, count(*) AS k FROM pr LEFT JOIN signals a ON a.strategy = pr.strategy AND a.symbol = pr.symbol AND a.date = pr.date
      LEFT JOIN signals b ON b.strategy = pr.strategy AND b.symbol = pr.symbol AND b.date = pr.nxt WHERE coalesce(a.signal > 0, false) <> coalesce(b.signal > 0, false) GROUP BY 1),
    i AS (SELECT strategy, avg(v) AS avg_signal_intensity, max(v) AS max_signal_intensity, sum(n) AS n FROM (SELECT strategy, symbol, avg(abs(signal)) AS v, count(*) AS n FROM signals GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT strategy, count(DISTINCT date) AS nd, count(DISTINCT symbol) AS ns FROM signals GROUP BY 1)
    SELECT strategy, avg_signal_intensity, max_signal_intensity, n / (nd * ns) AS avg_signal_consistency, k / (nd - 1) / ns AS signal_frequency, k AS total_signal_changes
    FROM i JOIN s USING (strategy) JOIN f USING (strategy)""", "avg_signal_intensity:7 max_signal_intensity:7 avg_signal_consistency:7 signal_frequency:7")
def _(p):
    return g.signal_quality(p.signals)


@query("g17_equal_target", "strat", "SELECT date, avg(daily_return) AS target_return FROM strat GROUP BY 1", "target_return:8")
def _(p):
    return g.equal_target(p.strat)
