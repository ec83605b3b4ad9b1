"""Queries A1-A40."""

from pyspark.sql import functions as F

from factorframe.operators import analytics as a, estimate as m
from factorframe.plans.catalog import query
from factorframe.plans.q_estimate import FIT3, FRAME, frame
from factorframe.plans.q_technical import full, win
from factorframe.plans.q_transforms import DD, SRUN

NEXT = "(SELECT strategy, date, lead(date) OVER (PARTITION BY strategy ORDER BY date) AS nxt FROM (SELECT DISTINCT strategy, date FROM weights))"
PR = f"""(SELECT w.strategy, r.date, sum(weight * r) AS daily_return FROM weights w JOIN {NEXT} n ON w.strategy = n.strategy AND w.date = n.date
    JOIN ret r ON r.symbol = w.symbol AND r.date = n.nxt WHERE weight > 0 GROUP BY 1, 2)"""


@query("a01_portfolio_returns", "weights ret", f"SELECT * FROM {PR}", "daily_return:8")
def _(p):
    return a.portfolio_returns(p.weights, p.ret)


VAL = f"(SELECT *, 1e6 * exp(sum(ln(1 + daily_return)) {SRUN}) AS portfolio_value FROM strat)"


@query("a02_equity", "strat", f"""SELECT strategy, date, daily_return, portfolio_value, portfolio_value / 1e6 - 1 AS cumulative_return,
    {full('stddev_samp', 'daily_return', 20, 'strategy')} * sqrt(252) AS rolling_20d_vol, {full('avg', 'daily_return', 20, 'strategy')} * 252 AS rolling_20d_return FROM {VAL}""",
       "daily_return:8 portfolio_value:2 cumulative_return:7 rolling_20d_vol:7 rolling_20d_return:7")
def _(p):
    return a.equity(p.strat)


TOSQL = f"""(SELECT strategy, date, sum(abs(v)) / 2 AS turnover FROM (SELECT strategy, date, symbol, sum(v) AS v FROM
    (SELECT strategy, date, symbol, weight AS v FROM weights UNION ALL SELECT w.strategy, nxt, symbol, -weight FROM weights w JOIN {NEXT} n ON w.strategy = n.strategy AND w.date = n.date WHERE nxt IS NOT NULL)
    GROUP BY 1, 2, 3) t WHERE date > (SELECT min(date) FROM weights x WHERE x.strategy = t.strategy) GROUP BY 1, 2)"""


@query("a03_turnover", "weights", f"SELECT * FROM {TOSQL}", "turnover:7")
def _(p):
    return a.turnover(p.weights)


@query("a03_mean_turnover", "weights", f"SELECT strategy, avg(turnover) AS turnover FROM {TOSQL} GROUP BY 1", "turnover:7")
def _(p):
    return a.mean_turnover(p.weights)


CON = "(SELECT strategy, date, sum(weight * weight) FILTER (weight > 0) / pow(sum(weight) FILTER (weight > 0), 2) AS hhi, max(abs(weight)) AS max_weight FROM weights GROUP BY 1, 2)"


@query("a04_concentration", "weights", f"SELECT * FROM {CON}", "hhi:7 max_weight:7")
def _(p):
    return a.concentration(p.weights)


@query("a05_position_metrics", "weights", """SELECT strategy, avg(n) AS avg_positions, max(n) AS max_positions, min(n) AS min_positions, avg(a) AS avg_position_weight, max(m) AS max_position_weight, avg(m) AS avg_concentration FROM
    (SELECT strategy, date, count(*) FILTER (weight > 0) AS n, coalesce(avg(weight) FILTER (weight > 0), 0) AS a, coalesce(max(weight) FILTER (weight > 0), 0) AS m FROM weights GROUP BY 1, 2) GROUP BY 1""",
       "avg_positions:6 avg_position_weight:7 max_position_weight:7 avg_concentration:7")
def _(p):
    return a.position_metrics(p.weights)


@query("a06_rolling_performance", "strat", f"""SELECT strategy, date, s * sqrt(252) AS rolling_volatility, m / nullif(s, 0) * sqrt(252) AS rolling_sharpe FROM
    (SELECT *, {full('stddev_samp', 'daily_return', 252, 'strategy')} AS s, {full('avg', 'daily_return', 252, 'strategy')} AS m FROM strat)""", "rolling_volatility:7 rolling_sharpe:6")
def _(p):
    return a.rolling_performance(p.strat)


CONTR = "(SELECT strategy, w.symbol, sum(weight * r) AS contribution FROM weights w JOIN ret r ON w.symbol = r.symbol AND w.date = r.date GROUP BY 1, 2)"


@query("a06_contributions", "weights ret", f"SELECT * FROM {CONTR}", "contribution:7")
def _(p):
    return a.contributions(p.weights, p.ret)


@query("a06_extreme_contributors", "weights ret", f"""SELECT strategy, symbol, contribution, kind, CAST(position AS INTEGER) AS position FROM
    (SELECT *, 'top' AS kind, row_number() OVER (PARTITION BY strategy ORDER BY contribution DESC, symbol) AS position FROM {CONTR}
     UNION ALL SELECT *, 'worst', row_number() OVER (PARTITION BY strategy ORDER BY contribution, symbol) FROM {CONTR}) WHERE position <= 5""", "contribution:7")
def _(p):
    return a.extreme_contributors(a.contributions(p.weights, p.ret))


@query("a07_portfolio_summary", "weights ret", f"""WITH pr AS (SELECT * FROM {PR}), cu AS (SELECT *, exp(sum(ln(1 + daily_return)) {SRUN}) AS c FROM pr),
    dd AS (SELECT *, (c - max(c) {SRUN}) / max(c) {SRUN} AS d FROM cu)
    SELECT strategy, exp(sum(ln(1 + daily_return))) - 1 AS total_return, pow(1 + avg(daily_return), 252) - 1 AS annualized_return, stddev_samp(daily_return) * sqrt(252) AS volatility,
    count(*) AS number_of_periods, min(d) AS max_drawdown, (SELECT avg(turnover) FROM {TOSQL} t WHERE t.strategy = dd.strategy) AS turnover,
    (SELECT avg(hhi) FROM {CON} c WHERE c.strategy = dd.strategy) AS concentration_risk FROM dd GROUP BY strategy""",
       "total_return:4 annualized_return:6 volatility:7 max_drawdown:6 turnover:7 concentration_risk:7")
def _(p):
    return a.portfolio_summary(p.weights, p.ret)


@query("a08_strategy_specific", "weights", f"""WITH h AS (SELECT strategy, date, count(*) FILTER (weight > 0) AS n, sum(CASE WHEN symbol = 'Brand#1' THEN weight ELSE 0 END) AS cash FROM weights GROUP BY 1, 2)
    SELECT strategy, avg(n) AS avg_positions_held, max(n) AS max_positions_held, min(n) AS min_positions_held, avg(cash) AS avg_cash_allocation, max(cash) AS max_cash_allocation,
    (SELECT 2 * sum(turnover) FROM {TOSQL} t WHERE t.strategy = h.strategy) / (SELECT sum(abs(weight)) FROM weights w WHERE w.strategy = h.strategy) AS signal_turnover_ratio FROM h GROUP BY strategy""",
       "avg_positions_held:6 avg_cash_allocation:7 max_cash_allocation:7 signal_turnover_ratio:6")
def _(p):
    return a.strategy_specific(p.weights, "Brand#1")


FLAT = "(SELECT DISTINCT strategy, date, CAST(1e6 AS DOUBLE) AS portfolio_value FROM weights)"


def _flat(p):
    return p.weights.select("strategy", "date").distinct().withColumn("portfolio_value", F.lit(1e6))


@query("a09_target_trades", "weights ret bars", f"""WITH d AS (SELECT strategy, date, symbol, sum(v) AS value_change FROM (SELECT strategy, date, symbol, weight * 1e6 AS v FROM weights
      UNION ALL SELECT w.strategy, nxt, w.symbol, -weight * 1e6 * (1 + coalesce(r, 0)) FROM weights w JOIN {NEXT} n ON w.strategy = n.strategy AND w.date = n.date AND nxt IS NOT NULL
      LEFT JOIN ret r ON r.symbol = w.symbol AND r.date = nxt) GROUP BY 1, 2, 3)
    SELECT d.strategy, d.date, d.symbol, CASE WHEN value_change > 0 THEN 'BUY' ELSE 'SELL' END AS side, abs(value_change / close) AS quantity, close AS price, value_change
    FROM d ASOF JOIN bars b ON d.symbol = b.symbol AND d.date >= b.date WHERE abs(value_change) >= 10000""", "quantity:4 price:3 value_change:3")
def _(p):
    return a.target_trades(p.weights, _flat(p), p.ret, p.bars)


VM = "greatest(least(1 + (volatility - 0.2) * 2, 3), 0.5)"
TRV = "(SELECT *, day_volume / 400.0 AS volatility FROM trades)"


def _trades(p):
    return p.trades.withColumn("volatility", F.col("day_volume") / 400.0).withColumn("side", F.when(F.col("side") == "SELL", "SHORT").otherwise("BUY"))


@query("a10_cost_breakdown", "trades", f"""SELECT symbol, date, v AS trade_value, v * 0.001 AS commission_cost, v * 0.0005 * k AS spread_cost, v * 0.0002 * k AS slippage_cost, s AS short_cost,
    v * 0.001 + v * 0.0007 * k + s + imp AS total_cost, (v * 0.001 + v * 0.0007 * k + s + imp) / v AS cost_share FROM (SELECT *, quantity * price AS v, {VM} AS k,
    CASE WHEN side = 'SELL' THEN quantity * price * 0.02 / 365.25 ELSE 0 END AS s, 11e-6 * quantity / day_volume * price * quantity * {VM} AS imp FROM {TRV})""",
       "trade_value:2 commission_cost:4 spread_cost:4 slippage_cost:4 short_cost:4 total_cost:4 cost_share:8")
def _(p):
    return a.cost_breakdown(_trades(p)).select("symbol", "date", "trade_value", "commission_cost", "spread_cost", "slippage_cost", "short_cost", "total_cost", "cost_share")


@query("a11_market_impact", "trades", f"""SELECT symbol, date, 1e-6 * f AS permanent_impact, 1e-5 * f AS temporary_impact, 11e-6 * f AS total_impact, 11e-6 * f / (price * quantity) * 10000 AS impact_bps,
    11e-6 * f * {VM} AS adjusted_impact FROM (SELECT *, quantity / day_volume * price * quantity AS f FROM {TRV})""",
       "permanent_impact:6 temporary_impact:6 total_impact:6 impact_bps:6 adjusted_impact:6")
def _(p):
    return a.market_impact(_trades(p)).select("symbol", "date", "permanent_impact", "temporary_impact", "total_impact", "impact_bps", "adjusted_impact")


@query("a12_execution_schedule", "trades", """SELECT symbol, date, CAST(d AS INTEGER) AS day, quantity * CASE WHEN quantity / (day_volume * 5) > 0.1 THEN (1.5 - (d - 1) * 0.25) / 5 ELSE 0.2 END AS shares
    FROM trades, (SELECT unnest([1, 2, 3, 4, 5]) AS d)""", "shares:5")
def _(p):
    return a.execution_schedule(p.trades).select("symbol", "date", "day", "shares")


LEDGER = """n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM trades),
    led AS (SELECT symbol, date, side, price, i, CASE WHEN side = 'BUY' THEN quantity ELSE CAST(0 AS DOUBLE) END AS quantity, CASE WHEN side = 'BUY' THEN price ELSE CAST(0 AS DOUBLE) END AS average_cost FROM n WHERE i = 1
     UNION ALL SELECT n.symbol, n.date, n.side, n.price, n.i, CASE WHEN n.side = 'BUY' THEN led.quantity + n.quantity ELSE greatest(led.quantity - n.quantity, 0) END,
      CASE WHEN n.side = 'BUY' THEN (led.quantity * led.average_cost + n.quantity * n.price) / (led.quantity + n.quantity) WHEN led.quantity - n.quantity < 0 THEN 0 ELSE led.average_cost END
      FROM led JOIN n ON n.symbol = led.symbol AND n.i = led.i + 1)"""


@query("a13_position_ledger", "trades", "WITH RECURSIVE " + LEDGER + " SELECT symbol, date, side, price, quantity, average_cost, quantity * price AS market_value, quantity * (price - average_cost) AS unrealized_pnl FROM led",
       "price:3 quantity:4 average_cost:3 market_value:1 unrealized_pnl:1")
def _(p):
    return a.position_ledger(p.trades)


@query("a14_daily_valuation", "trades bars", "WITH RECURSIVE " + LEDGER + """, g AS (SELECT s.symbol, d.date FROM (SELECT symbol, min(date) AS f FROM bars GROUP BY 1) s JOIN (SELECT DISTINCT date FROM bars) d ON d.date >= s.f),
    h AS (SELECT g.symbol, g.date, quantity, average_cost FROM g ASOF JOIN led ON g.symbol = led.symbol AND g.date >= led.date),
    v AS (SELECT h.date, sum(quantity * close) AS position_value, count(*) AS positions, sum(quantity * (close - average_cost)) AS unrealized_pnl FROM h ASOF JOIN bars b ON h.symbol = b.symbol AND h.date >= b.date WHERE quantity > 0 GROUP BY 1)
    SELECT *, position_value - lag(position_value) OVER (ORDER BY date) AS value_change FROM v""", "position_value:0 unrealized_pnl:0 value_change:0")
def _(p):
    return a.daily_valuation(a.position_ledger(p.trades), p.bars)


@query("a15_turnover_rate", "trades strat", f"""SELECT strategy, coalesce(t / v * (252 / n), 0) AS turnover_rate FROM (SELECT strategy, avg(portfolio_value) AS v, count(*) AS n FROM {VAL} GROUP BY 1)
    LEFT JOIN (SELECT '1-URGENT' AS strategy, sum(quantity * price) AS t FROM trades) USING (strategy)""", "turnover_rate:4")
def _(p):
    return a.turnover_rate(p.trades.withColumn("strategy", F.lit("1-URGENT")), a.equity(p.strat))


RM = "(SELECT strategy, exp(sum(ln(1 + daily_return))) - 1 AS total_return, pow(exp(sum(ln(1 + daily_return))), 252.0 / count(*)) - 1 AS annualized_return, stddev_samp(daily_return) * sqrt(252) AS volatility FROM strat GROUP BY 1)"


@query("a16_return_metrics", "strat", f"SELECT * FROM {RM}", "total_return:5 annualized_return:7 volatility:7")
def _(p):
    return a.return_metrics(p.strat)


RFD = "(pow(1.02, 1.0 / 252) - 1)"
MDD = f"(SELECT strategy, min((cumulative_return - peak) / peak) AS max_drawdown FROM {DD} GROUP BY 1)"
RATIO = f"""(SELECT strategy, (m - {RFD}) / s * sqrt(252) AS sharpe_ratio, (m - {RFD}) / d * sqrt(252) AS sortino_ratio, annualized_return / abs(max_drawdown) AS calmar_ratio FROM
    (SELECT strategy, avg(daily_return) AS m, stddev_samp(daily_return) AS s, stddev_samp(CASE WHEN daily_return < {RFD} THEN daily_return END) AS d FROM strat GROUP BY 1) JOIN {RM} USING (strategy) JOIN {MDD} USING (strategy))"""


@query("a17_ratios", "strat", f"SELECT *, false AS no_losses, false AS no_drawdown FROM {RATIO}", "sharpe_ratio:6 sortino_ratio:6 calmar_ratio:6")
def _(p):
    return a.ratios(p.strat)


@query("a18_max_drawdown", "strat", f"SELECT * FROM {MDD}", "max_drawdown:7")
def _(p):
    return a.max_drawdown(p.strat)


TAIL = """(SELECT strategy, any_value(v95) AS var_95, any_value(v99) AS var_99, avg(daily_return) FILTER (daily_return <= v95) AS expected_shortfall_95, avg(daily_return) FILTER (daily_return <= v99) AS expected_shortfall_99
    FROM strat JOIN (SELECT strategy, quantile_cont(daily_return, 0.05) AS v95, quantile_cont(daily_return, 0.01) AS v99 FROM strat GROUP BY 1) USING (strategy) GROUP BY 1)"""


@query("a19_tail_risk", "strat", f"SELECT * FROM {TAIL}", "var_95:7 var_99:7 expected_shortfall_95:7 expected_shortfall_99:7")
def _(p):
    return a.tail_risk(p.strat)


TM = "(SELECT strategy, avg((daily_return > 0)::INT) AS win_rate, sum(daily_return) FILTER (daily_return > 0) / -sum(daily_return) FILTER (daily_return < 0) AS profit_factor FROM strat GROUP BY 1)"


@query("a20_trading_metrics", "strat", f"SELECT *, false AS no_losses FROM {TM}", "win_rate:7 profit_factor:6")
def _(p):
    return a.trading_metrics(p.strat)


REL = """(SELECT strategy, p - (0.02 + beta * (b - 0.02)) AS alpha, beta, x / t AS information_ratio, t AS tracking_error FROM (SELECT strategy, covar_samp(daily_return, bench_return) / var_pop(bench_return) AS beta,
    avg(daily_return) * 252 AS p, avg(bench_return) * 252 AS b, avg(daily_return - bench_return) * 252 AS x, stddev_samp(daily_return - bench_return) * sqrt(252) AS t FROM strat JOIN benchmark_returns USING (date) GROUP BY 1))"""


@query("a21_relative_metrics", "strat benchmark_returns", f"SELECT * FROM {REL}", "alpha:6 beta:6 information_ratio:6 tracking_error:7")
def _(p):
    return a.relative_metrics(p.strat, p.benchmark)


CAP = """(SELECT strategy, avg(daily_return) FILTER (bench_return > 0) / avg(bench_return) FILTER (bench_return > 0) AS up_capture,
    avg(daily_return) FILTER (bench_return < 0) / avg(bench_return) FILTER (bench_return < 0) AS down_capture FROM strat JOIN benchmark_returns USING (date) GROUP BY 1)"""


@query("a22_capture", "strat benchmark_returns", f"SELECT * FROM {CAP}", "up_capture:6 down_capture:6")
def _(p):
    return a.capture(p.strat, p.benchmark)


@query("a23_all_metrics", "strat benchmark_returns", f"SELECT * FROM {RM} JOIN {RATIO} USING (strategy) JOIN {MDD} USING (strategy) JOIN {TAIL} USING (strategy) JOIN {TM} USING (strategy) JOIN {REL} USING (strategy) JOIN {CAP} USING (strategy)",
       "total_return:5 annualized_return:6 volatility:6 sharpe_ratio:6 sortino_ratio:6 calmar_ratio:6 max_drawdown:6 var_95:6 var_99:6 expected_shortfall_95:6 expected_shortfall_99:6 win_rate:6 profit_factor:6 alpha:6 beta:6 information_ratio:6 tracking_error:6 up_capture:6 down_capture:6")
def _(p):
    return a.all_metrics(p.strat, p.benchmark)


RES = f"""(SELECT strategy, i AS initial_capital, f AS final_value, v AS volatility, w AS win_rate, f / i - 1 AS total_return, pow(f / i, 252.0 / n) - 1 AS annualized_return, (pow(f / i, 252.0 / n) - 1) / v AS return_over_volatility FROM
    (SELECT strategy, arg_min(portfolio_value, date) AS i, arg_max(portfolio_value, date) AS f, count(x) AS n, stddev_samp(x) * sqrt(252) AS v, avg((x > 0)::INT) AS w FROM
     (SELECT *, portfolio_value / lag(portfolio_value) OVER (PARTITION BY strategy ORDER BY date) - 1 AS x FROM {VAL}) GROUP BY 1))"""


@query("a24_result_metrics", "strat", f"SELECT * FROM {RES}", "initial_capital:2 final_value:2 volatility:6 win_rate:6 total_return:5 annualized_return:6 return_over_volatility:6")
def _(p):
    return a.result_metrics(a.equity(p.strat))


@query("a24_formatted_summary", "strat", f"""SELECT strategy, 'volatility' AS metric, printf('%.2f%%', round(volatility * 100, 2)) AS text FROM {RES}
    UNION ALL SELECT strategy, 'win_rate', printf('%.2f%%', round(win_rate * 100, 2)) FROM {RES}""")
def _(p):
    return a.formatted_summary(a.result_metrics(a.equity(p.strat)).select("strategy", "volatility", "win_rate"))


@query("a25_against_benchmark", "strat benchmark_returns", f"""SELECT strategy, t AS total_outperformance, CASE WHEN 1 + t > 0 THEN pow(1 + t, 252.0 / n) - 1 END AS annualized_outperformance, v AS outperformance_volatility, e AS tracking_error FROM
    (SELECT strategy, arg_max(o, date) AS t, count(*) AS n, stddev_samp(o) * sqrt(252) AS v, stddev_samp(daily_return - bench_return) * sqrt(252) AS e FROM
     (SELECT *, exp(sum(ln(1 + daily_return)) {SRUN}) - exp(sum(ln(1 + bench_return)) {SRUN}) AS o FROM strat JOIN benchmark_returns USING (date)) GROUP BY 1)""",
       "total_outperformance:5 annualized_outperformance:6 outperformance_volatility:5 tracking_error:7")
def _(p):
    return a.against_benchmark(p.strat, p.benchmark)


@query("a26_downside_deviation", "strat", "SELECT strategy, stddev_samp(daily_return) FILTER (daily_return < 0) * sqrt(252) AS downside_deviation FROM strat GROUP BY 1", "downside_deviation:7")
def _(p):
    return a.downside_deviation(p.strat)


@query("a27_shape", "strat", "SELECT strategy, skewness(daily_return) AS skewness, kurtosis(daily_return) AS kurtosis FROM strat GROUP BY 1", "skewness:6 kurtosis:6")
def _(p):
    return a.shape(p.strat)


@query("a28_drawdown_risk", "strat", f"""WITH d AS (SELECT strategy, date, (cumulative_return - peak) / peak AS dd FROM {DD}), u AS (SELECT *, (dd < 0)::INT AS under FROM d),
    r AS (SELECT *, sum(1 - under) {SRUN} AS run FROM u)
    SELECT strategy, min(dd) AS max_drawdown, coalesce(avg(dd) FILTER (dd < 0), 0) AS avg_drawdown, avg(under) AS drawdown_frequency,
    (SELECT CAST(max(l) AS BIGINT) FROM (SELECT sum(under) AS l FROM r x WHERE x.strategy = r.strategy GROUP BY run)) AS max_duration FROM r GROUP BY strategy""", "max_drawdown:6 avg_drawdown:6 drawdown_frequency:7")
def _(p):
    return a.drawdown_risk(p.strat)


PAIRS = "(SELECT a.symbol AS s1, b.symbol AS s2, corr(a.r, b.r) AS c, covar_samp(a.r, b.r) AS v FROM ret a JOIN ret b ON a.date = b.date AND a.symbol <= b.symbol GROUP BY 1, 2)"


@query("a29_correlation_risk", "ret", f"SELECT avg(abs(c)) AS correlation_risk, count(c) AS pairs FROM {PAIRS} WHERE s1 < s2", "correlation_risk:7")
def _(p):
    return a.correlation_risk(p.ret)


@query("a30_liquidity_risk", "weights bars", """WITH v AS (SELECT symbol, avg(volume) AS av FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM bars) WHERE i <= 20 GROUP BY 1),
    x AS (SELECT w.strategy, weight * 1e6 / av AS x FROM weights w JOIN (SELECT strategy, max(date) AS d FROM weights GROUP BY 1) l ON w.strategy = l.strategy AND w.date = l.d JOIN v ON v.symbol = w.symbol WHERE weight <> 0)
    SELECT strategy, avg(x) AS avg_liquidity_ratio, max(x) AS max_liquidity_ratio, count(*) FILTER (x > 0.1) AS illiquid_positions, stddev_pop(x) AS liquidity_concentration FROM x GROUP BY 1""",
       "avg_liquidity_ratio:4 max_liquidity_ratio:4 liquidity_concentration:4")
def _(p):
    return a.liquidity_risk(p.weights, p.bars)


@query("a31_risk_record", "weights ret", f"""WITH strat AS (SELECT * FROM {PR}), benchmark_returns AS (SELECT date, avg(r) AS bench_return FROM ret GROUP BY 1)
    SELECT var_95, var_99, expected_shortfall_95, volatility, max_drawdown, t.strategy, beta, overall_risk_score FROM (SELECT *,
      least(1, 0.25 * least(abs(var_99) / 0.05, 1) + 0.25 * least(abs(max_drawdown) / 0.2, 1) + 0.2 * least(coalesce(hhi, 0), 1) + 0.15 * least(corr, 1) + 0.15 * least(volatility / 0.3, 1)) AS overall_risk_score
      FROM {TAIL} JOIN {RM} USING (strategy) JOIN {MDD} USING (strategy) JOIN {REL} USING (strategy)
      JOIN (SELECT strategy, arg_max(hhi, date) AS hhi FROM {CON} GROUP BY 1) USING (strategy), (SELECT avg(abs(c)) AS corr FROM {PAIRS} WHERE s1 < s2)) t""",
       "var_95:7 var_99:7 expected_shortfall_95:7 volatility:7 max_drawdown:6 beta:6 overall_risk_score:6")
def _(p):
    bench = p.ret.groupBy("date").agg(F.avg("r").alias("bench_return"))
    rec = a.risk_record(a.portfolio_returns(p.weights, p.ret), bench, p.weights, p.ret)
    return rec.select("strategy", "var_95", "var_99", "expected_shortfall_95", "volatility", "max_drawdown", "beta", "overall_risk_score")


@query("a31_check_limits", "strat", f"""SELECT strategy, metric, value, cap, abs(value) <= cap AS within FROM (SELECT strategy, 'volatility' AS metric, volatility AS value, 0.12 AS cap FROM {RM}
    UNION ALL SELECT strategy, 'max_drawdown', max_drawdown, 0.1 FROM {MDD})""", "value:6 cap:3")
def _(p):
    rec = a.return_metrics(p.strat).join(a.max_drawdown(p.strat), "strategy")
    first = F.col("r_regionkey") == 0
    limits = p.table("region").where("r_regionkey < 2").select(F.when(first, "volatility").otherwise("max_drawdown").alias("metric"), F.when(first, 0.12).otherwise(0.1).alias("cap"))
    return a.check_limits(rec, limits, ["volatility", "max_drawdown"])


@query("a32_sample_covariance", "ret", f"SELECT s1, s2, v * 252 AS cov FROM {PAIRS} WHERE v IS NOT NULL", "cov:7")
def _(p):
    return a.sample_covariance(p.ret)


COMMON = "(SELECT * FROM strat WHERE date IN (SELECT date FROM strat GROUP BY 1 HAVING count(*) = 5))"
LW = f"""(WITH x AS (SELECT strategy, date, daily_return - avg(daily_return) OVER (PARTITION BY strategy) AS v FROM {COMMON}),
    m AS (SELECT a.strategy AS s1, b.strategy AS s2, sum(a.v * b.v) / count(*) AS s, sum(a.v * a.v * b.v * b.v) AS q, count(*) AS t FROM x a JOIN x b ON a.date = b.date GROUP BY 1, 2),
    k AS (SELECT 5.0 AS p, max(t) AS t, sum(s) FILTER (s1 = s2) AS tr, sum(s * s) AS ss, sum(q) AS q FROM m),
    f AS (SELECT tr / p AS mu, least((q / t - ss) / (p * t), (ss - 2 * tr / p * tr + p * pow(tr / p, 2)) / p) / ((ss - 2 * tr / p * tr + p * pow(tr / p, 2)) / p) AS h FROM k)
    SELECT s1, s2, ((1 - h) * s + CASE WHEN s1 = s2 THEN h * mu ELSE 0 END) * 252 AS cov, h AS shrinkage FROM m, f WHERE s1 <= s2)"""


@query("a33_shrunk_covariance", "strat", f"SELECT * FROM {LW}", "cov:7 shrinkage:6")
def _(p):
    return a.shrunk_covariance(p.strat, "daily_return", "strategy")


FLONG = "(UNPIVOT (SELECT date, MKT, SMB, HML FROM factors) ON MKT, SMB, HML INTO NAME strategy VALUE daily_return)"
LWF = LW.replace(COMMON, FLONG).replace("5.0 AS p", "3.0 AS p")


@query("a34_factor_covariance", "ret factors", f"""WITH f AS (SELECT s1, s2, cov FROM {LWF} UNION ALL SELECT s2, s1, cov FROM {LWF} WHERE s1 <> s2),
    e AS (SELECT * FROM {FIT3}), b AS (UNPIVOT (SELECT symbol, b_MKT AS "MKT", b_SMB AS "SMB", b_HML AS "HML" FROM e) ON "MKT", "SMB", "HML" INTO NAME factor VALUE v)
    SELECT x.symbol AS s1, y.symbol AS s2, sum(x.v * f.cov * y.v) + any_value(CASE WHEN x.symbol = y.symbol THEN e.rss / (e.n - 4) * 252 ELSE 0 END) AS cov
    FROM b x JOIN f ON x.factor = f.s1 JOIN b y ON y.factor = f.s2 JOIN e ON e.symbol = x.symbol WHERE x.symbol <= y.symbol GROUP BY 1, 2""", "cov:7")
def _(p):
    return a.factor_covariance(m.fit(frame(p, m.FF3), m.FF3, t_stats=False), p.factors, m.FF3)


# figures of resampled returns r and the benchmark's b, one group a strategy and draw
RATIO = "CASE WHEN {sd} > 0 THEN {top} / {sd} * sqrt(252) ELSE 0 END"
A35 = {
    "sharpe": RATIO.format(top="avg(r - 0.02 / 252)", sd="stddev_samp(r - 0.02 / 252)"),
    "sortino": RATIO.format(top="avg(r - 0.02 / 252)", sd="stddev_samp(r - 0.02 / 252) FILTER (r < 0.02 / 252)"),
    "total_return": "exp(sum(ln(1 + r))) - 1",
    "alpha": "exp(sum(ln(1 + r))) - exp(sum(ln(1 + b)))",
    "information_ratio": RATIO.format(top="avg(r - b)", sd="stddev_samp(r - b)"),
}


def _significance(metric, draws, digits):
    against = metric in ("alpha", "information_ratio")
    key = a.draw_keys_sql("d", "i", 42)
    if metric == "information_ratio":  # a permutation: positions in the order of their keys
        place = f"(SELECT strategy, d, i, n, row_number() OVER (PARTITION BY strategy, d ORDER BY {key}, i) - 1 AS j FROM g)"
        drawn = f"SELECT p.strategy, p.d, y.r, x.b FROM {place} p JOIN s y ON y.strategy = p.strategy AND y.i = p.i JOIN s x ON x.strategy = p.strategy AND x.i = p.j"
    else:
        centre = {"alpha": "y.mb", "total_return": "0"}.get(metric, "0.02 / 252")
        drawn = f"""SELECT p.strategy, p.d, y.r - y.m + {centre} AS r, x.b FROM (SELECT *, {key} % n AS j FROM g) p
            JOIN s y ON y.strategy = p.strategy AND y.i = p.j JOIN s x ON x.strategy = p.strategy AND x.i = p.i"""
    bench = "JOIN benchmark_returns USING (date)" if against else ""
    sql = f"""WITH s AS (SELECT strategy, daily_return AS r, {"bench_return" if against else "0.0"} AS b, row_number() OVER (PARTITION BY strategy ORDER BY date) - 1 AS i,
        count(*) OVER (PARTITION BY strategy) AS n, avg(daily_return) OVER (PARTITION BY strategy) AS m, avg({"bench_return" if against else "0.0"}) OVER (PARTITION BY strategy) AS mb FROM strat {bench}),
        g AS (SELECT strategy, i, n, d FROM s, (SELECT unnest(range({draws})) AS d)),
        o AS (SELECT strategy, {A35[metric]} AS observed FROM s GROUP BY 1),
        z AS (SELECT strategy, d, {A35[metric]} AS x FROM ({drawn}) GROUP BY 1, 2)
        SELECT strategy, any_value(observed) AS observed, avg(x) AS null_mean, stddev_samp(x) AS null_std, quantile_cont(x, 0.95) AS critical_value,
        avg((x >= observed)::INT) AS p_value FROM z JOIN o USING (strategy) GROUP BY 1"""

    @query(f"a35_significance_{metric}", "strat benchmark_returns", sql, " ".join(f"{x}:{digits}" for x in ("observed", "null_mean", "null_std", "critical_value")) + " p_value:6")
    def _(p):
        return a.significance(p.strat, p.benchmark if against else None, metric, draws=draws)


for _metric, _draws in {"sharpe": 1000, "sortino": 200, "total_return": 200, "alpha": 200, "information_ratio": 200}.items():
    _significance(_metric, _draws, 7)


@query("a36_strategy_statistics", "strat", f"""SELECT strategy, avg(daily_return) * 252 AS annual_return, stddev_samp(daily_return) * sqrt(252) AS annual_volatility, count(*) AS total_observations, min(date) AS start_date, max(date) AS end_date,
    avg(daily_return) / stddev_samp(daily_return) * sqrt(252) AS sharpe_ratio, any_value(max_drawdown) AS max_drawdown FROM strat JOIN {MDD} USING (strategy) GROUP BY 1""",
       "annual_return:6 annual_volatility:7 sharpe_ratio:6 max_drawdown:6")
def _(p):
    return a.strategy_statistics(p.strat)


@query("a37_alpha_distribution", "ret factors", f"WITH e AS (SELECT * FROM {FIT3}) " + " UNION ALL ".join(
    f"SELECT '{k}' AS measure, count(*) FILTER ({c}) AS n FROM e" for k, c in {"positive": "alpha > 0", "negative": "alpha < 0", "zero": "alpha = 0"}.items() | {f"t_above_{x}": f"abs(t_alpha) >= {x}" for x in (1.0, 1.5, 2.0, 2.5, 3.0)}.items()))
def _(p):
    return a.alpha_distribution(m.fit(frame(p, m.FF3), m.FF3))


@query("a37_extreme_alphas", "ret factors", f"""WITH e AS (SELECT * FROM {FIT3}) SELECT symbol, alpha, 'top' AS kind FROM (SELECT * FROM e ORDER BY alpha DESC, symbol LIMIT 10)
    UNION ALL SELECT symbol, alpha, 'bottom' FROM (SELECT * FROM e ORDER BY alpha, symbol LIMIT 10)""", "alpha:8")
def _(p):
    return a.extreme_alphas(m.fit(frame(p, m.FF3), m.FF3, t_stats=False))


@query("a38_monthly_table", "strat", f"""SELECT strategy, CAST(year(mo) AS INTEGER) AS year, {", ".join(f"max(r) FILTER (month(mo) = {i}) AS m{i}" for i in range(1, 13))} FROM
    (SELECT strategy, mo, 100 * (v / lag(v) OVER (PARTITION BY strategy ORDER BY mo) - 1) AS r FROM (SELECT strategy, date_trunc('month', date) AS mo, arg_max(portfolio_value, date) AS v FROM {VAL} GROUP BY 1, 2)) WHERE r IS NOT NULL GROUP BY 1, 2""",
       " ".join(f"m{i}:6" for i in range(1, 13)))
def _(p):
    return a.monthly_table(a.equity(p.strat))


@query("a39_position_properties", "trades", "WITH RECURSIVE " + LEDGER + """ SELECT symbol, date, quantity > 0 AS is_long, quantity < 0 AS is_short, abs(quantity) < 1e-6 AS is_empty,
    coalesce((price - average_cost) / nullif(average_cost, 0), 0) AS return_pct FROM led""", "return_pct:6")
def _(p):
    return a.position_properties(a.position_ledger(p.trades)).select("symbol", "date", "is_long", "is_short", "is_empty", "return_pct")


@query("a39_trade_properties", "trades", "SELECT symbol, date, quantity * price + CASE WHEN side = 'BUY' THEN commission ELSE -commission END AS total_cost, side = 'BUY' AS is_buy, side <> 'BUY' AS is_sell FROM trades", "total_cost:2")
def _(p):
    return a.trade_properties(p.trades).select("symbol", "date", "total_cost", "is_buy", "is_sell")


@query("a39_snapshot_properties", "weights", """SELECT strategy, date, sum(weight * 1000) AS equity_value, 0.25 AS cash_ratio, sum(weight * 1000) / 2000 AS equity_ratio, CAST(count(*) FILTER (abs(weight) >= 1e-6) AS INTEGER) AS positions_count
    FROM weights GROUP BY 1, 2""", "equity_value:4 cash_ratio:4 equity_ratio:6")
def _(p):
    pos = F.collect_list(F.struct("symbol", F.col("weight").alias("quantity"), (F.col("weight") * 1000).alias("market_value"))).alias("positions")
    snap = p.weights.groupBy("strategy", "date").agg(pos).withColumn("total_value", F.lit(2000.0)).withColumn("cash", F.lit(500.0))
    return a.snapshot_properties(snap).select("strategy", "date", "equity_value", "cash_ratio", "equity_ratio", "positions_count")


@query("a40_limit_breaches", "weights ret", f"""WITH strat AS (SELECT * FROM {PR}), v AS (SELECT strategy, date, portfolio_value < first(portfolio_value) OVER (PARTITION BY strategy ORDER BY date) * 1.5 AS below FROM {VAL}),
    o AS (SELECT strategy, date, count(*) FILTER (abs(weight) > 0.3) AS n FROM weights GROUP BY 1, 2)
    SELECT strategy, date, coalesce(n, 0) AS positions_over_limit, coalesce(below, false) AS below_drawdown_limit FROM o FULL JOIN v USING (strategy, date)""")
def _(p):
    return a.limit_breaches(p.weights, a.equity(a.portfolio_returns(p.weights, p.ret)), 0.3, -0.5)
