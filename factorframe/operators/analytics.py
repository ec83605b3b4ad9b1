"""Returns, costs, risk and tests of portfolios.

Everything takes a ``strategy`` key.  A strategy has at most one return per
day, so a group of returns is one calendar; weights are grouped and joined, never collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorframe.functions import joins, ranks
from factorframe.functions.pairs import _dealt, covariances, pair_moments
from factorframe.functions.stats import count_if, sample_kurtosis, sample_skew, sharpe
from factorframe.functions.windows import (
    c, change, compounded, lagged, ordered, ratio, rolling_mean, rolling_std, running,
)
from factorframe.operators.transforms import drawdown

DAY = ("strategy", "date")
YEAR = 252


def next_dates(df: DataFrame) -> DataFrame:
    """(strategy, date, next_date) over the dates a strategy has rows on."""
    days = df.select("strategy", "date").distinct()
    return days.select("strategy", "date", F.lead("date").over(ordered("strategy")).alias("next_date"))


def portfolio_returns(weights: DataFrame, returns: DataFrame, value="r") -> DataFrame:
    """A1: sum of the previous date's long weights times the return of the date."""
    held = weights.where("weight > 0").join(next_dates(weights), ["strategy", "date"])
    held = held.select("strategy", "symbol", "weight", c("next_date").alias("date")).where("date is not null")
    hit = held.join(returns.select("symbol", "date", value), ["symbol", "date"])
    return hit.groupBy("strategy", "date").agg(F.sum(c("weight") * c(value)).alias("daily_return"))


def equity(returns: DataFrame, capital=1_000_000.0, value="daily_return") -> DataFrame:
    """A2."""
    w = running("strategy")
    out = returns.withColumn("portfolio_value", capital * compounded(value, w))
    return out.select(
        "strategy", "date", c(value).alias("daily_return"), "portfolio_value", (c("portfolio_value") / capital - 1).alias("cumulative_return"),
        (rolling_std(value, 20, keys="strategy") * YEAR**0.5).alias("rolling_20d_vol"),
        (rolling_mean(value, 20, keys="strategy") * YEAR).alias("rolling_20d_return"))


def turnover(weights: DataFrame) -> DataFrame:
    """A3: half the sum of weight changes per date after the first (a missing name counts as 0)."""
    after = weights.join(next_dates(weights), ["strategy", "date"]).where("next_date is not null")
    moves = weights.select("strategy", "date", "symbol", c("weight").alias("v")).unionByName(
        after.select("strategy", c("next_date").alias("date"), "symbol", (-c("weight")).alias("v")))
    per = moves.groupBy("strategy", "date", "symbol").agg(F.sum("v").alias("v"))
    out = per.groupBy("strategy", "date").agg((F.sum(F.abs("v")) / 2).alias("turnover"))
    first = weights.groupBy("strategy").agg(F.min("date").alias("_first"))
    return out.join(first, "strategy").where(c("date") > c("_first")).drop("_first")


def mean_turnover(weights: DataFrame) -> DataFrame:
    return turnover(weights).groupBy("strategy").agg(F.avg("turnover").alias("turnover"))


def concentration(weights: DataFrame) -> DataFrame:
    """A4: Herfindahl index of the normalised long weights and the largest absolute weight, per date."""
    pos = F.when(c("weight") > 0, c("weight"))
    return weights.groupBy("strategy", "date").agg(
        (F.sum(pos * pos) / F.nullif(F.pow(F.sum(pos), 2.0), F.lit(0.0))).alias("hhi"), F.max(F.abs("weight")).alias("max_weight"))


def position_metrics(weights: DataFrame) -> DataFrame:
    """A5."""
    pos = F.when(c("weight") > 0, c("weight"))
    day = weights.groupBy("strategy", "date").agg(F.count(pos).alias("n"), F.coalesce(F.avg(pos), F.lit(0.0)).alias("a"), F.coalesce(F.max(pos), F.lit(0.0)).alias("m"))
    return day.groupBy("strategy").agg(
        F.avg("n").alias("avg_positions"), F.max("n").alias("max_positions"), F.min("n").alias("min_positions"),
        F.avg("a").alias("avg_position_weight"), F.max("m").alias("max_position_weight"), F.avg("m").alias("avg_concentration"))


def rolling_performance(returns: DataFrame, n=252, value="daily_return") -> DataFrame:
    """Rolling volatility and Sharpe ratio."""
    sd = rolling_std(value, n, keys="strategy")
    out = returns.select("strategy", "date", sd.alias("_s"), rolling_mean(value, n, keys="strategy").alias("_m"))
    return out.select("strategy", "date", (c("_s") * YEAR**0.5).alias("rolling_volatility"), (ratio("_m", "_s") * YEAR**0.5).alias("rolling_sharpe"))


def contributions(weights: DataFrame, returns: DataFrame, value="r") -> DataFrame:
    """Sum of weight times same-day return per name."""
    hit = weights.join(returns.select("symbol", "date", value), ["symbol", "date"])
    return hit.groupBy("strategy", "symbol").agg(F.sum(c("weight") * c(value)).alias("contribution"))


def extreme_contributors(contrib: DataFrame, n=5) -> DataFrame:
    """The n best and worst names per strategy."""
    top = ranks.top_n(contrib, ["strategy"], [F.desc("contribution"), F.asc("symbol")], n, "position").withColumn("kind", F.lit("top"))
    low = ranks.top_n(contrib, ["strategy"], [F.asc("contribution"), F.asc("symbol")], n, "position").withColumn("kind", F.lit("worst"))
    return top.unionByName(low)


def portfolio_summary(weights: DataFrame, returns: DataFrame, value="r") -> DataFrame:
    """A7."""
    r = portfolio_returns(weights, returns, value)
    dd = drawdown(r).groupBy("strategy").agg(F.min("drawdown").alias("max_drawdown"))
    s = r.groupBy("strategy").agg(
        (compounded("daily_return", None) - 1).alias("total_return"), (F.pow(1 + F.avg("daily_return"), F.lit(float(YEAR))) - 1).alias("annualized_return"),
        (F.stddev_samp("daily_return") * YEAR**0.5).alias("volatility"), F.count(F.lit(1)).alias("number_of_periods"))
    hhi = concentration(weights).groupBy("strategy").agg(F.avg("hhi").alias("concentration_risk"))
    return s.join(dd, "strategy").join(mean_turnover(weights), "strategy", "left").join(hhi, "strategy", "left")


def strategy_specific(weights: DataFrame, cash_symbol="SHY") -> DataFrame:
    """Held positions, signal turnover ratio and cash share."""
    held = weights.groupBy("strategy", "date").agg(count_if(c("weight") > 0).alias("n"), F.sum(F.when(c("symbol") == cash_symbol, c("weight")).otherwise(0.0)).alias("cash"))
    a = held.groupBy("strategy").agg(F.avg("n").alias("avg_positions_held"), F.max("n").alias("max_positions_held"), F.min("n").alias("min_positions_held"),
                                     F.avg("cash").alias("avg_cash_allocation"), F.max("cash").alias("max_cash_allocation"))
    moved = turnover(weights).groupBy("strategy").agg((2 * F.sum("turnover")).alias("_moved"))
    total = weights.groupBy("strategy").agg(F.sum(F.abs("weight")).alias("_total"))
    out = a.join(moved, "strategy", "left").join(total, "strategy")
    return out.withColumn("signal_turnover_ratio", ratio("_moved", "_total")).drop("_moved", "_total")


def target_trades(weights: DataFrame, values: DataFrame, returns: DataFrame, bars: DataFrame, threshold=0.01, value="r") -> DataFrame:
    """Trades that move the drifted holdings of the previous date to the targets; small ones are left out.

    values(strategy, date, portfolio_value); a name without a return on the date has not moved.
    """
    v = values.select("strategy", "date", "portfolio_value")
    want = weights.join(v, ["strategy", "date"]).select("strategy", "date", "symbol", (c("weight") * c("portfolio_value")).alias("target"))
    prev = want.join(next_dates(weights), ["strategy", "date"]).where("next_date is not null")
    prev = prev.select("strategy", c("next_date").alias("date"), "symbol", "target").join(returns.select("symbol", "date", value), ["symbol", "date"], "left")
    held = prev.select("strategy", "date", "symbol", (-c("target") * (1 + F.coalesce(value, F.lit(0.0)))).alias("v"))
    delta = want.select("strategy", "date", "symbol", c("target").alias("v")).unionByName(held).groupBy("strategy", "date", "symbol").agg(F.sum("v").alias("value_change"))
    big = delta.join(v, ["strategy", "date"]).where(F.abs("value_change") >= threshold * c("portfolio_value"))
    priced = joins.asof(big.drop("portfolio_value"), bars.select("symbol", "date", "close"), ["symbol"], ["close"])
    return priced.where("close > 0").select("strategy", "date", "symbol", F.when(c("value_change") > 0, "BUY").otherwise("SELL").alias("side"),
                                            F.abs(c("value_change") / c("close")).alias("quantity"), c("close").alias("price"), "value_change")


# fixed values
COMMISSION, SPREAD, SLIPPAGE, BORROW = 0.001, 0.0005, 0.0002, 0.02
GAMMA, ETA, TRADING_RATE = 1e-6, 1e-6, 0.1


def volatility_multiplier(vol) -> Column:
    v = c(vol)
    return F.when(v <= 0, 1.0).otherwise(F.greatest(F.least(1 + (v - 0.2) * 2, F.lit(3.0)), F.lit(0.5)))


def market_impact(trades: DataFrame, gamma=GAMMA, eta=ETA, rate=TRADING_RATE) -> DataFrame:
    """Permanent and temporary impact of trades(quantity, price, day_volume, volatility), bps, volatility adjusted."""
    frac = c("quantity") / F.nullif(c("day_volume"), F.lit(0.0))
    size = frac * c("price") * c("quantity")
    out = trades.withColumn("volume_fraction", frac).withColumn("permanent_impact", gamma * size).withColumn("temporary_impact", eta / rate * size)
    out = out.withColumn("total_impact", c("permanent_impact") + c("temporary_impact"))
    out = out.withColumn("impact_bps", F.coalesce(ratio("total_impact", c("price") * c("quantity")) * 10000, F.lit(0.0)))
    return out.withColumn("adjusted_impact", c("total_impact") * volatility_multiplier("volatility"))


def cost_breakdown(trades: DataFrame, holding_days=1) -> DataFrame:
    """A10: commission, spread, slippage, short_cost, impact, total and share of the trade value."""
    out = market_impact(trades)
    v, k = c("quantity") * c("price"), volatility_multiplier("volatility")
    out = out.withColumn("trade_value", v).withColumn("commission_cost", v * COMMISSION).withColumn("spread_cost", v * SPREAD * k)
    out = out.withColumn("slippage_cost", v * SLIPPAGE * k)
    out = out.withColumn("short_cost", F.when(c("side") == "SHORT", v * BORROW / 365.25 * holding_days).otherwise(0.0))
    out = out.withColumn("total_cost", c("commission_cost") + c("spread_cost") + c("slippage_cost") + c("short_cost") + c("adjusted_impact"))
    return out.withColumn("cost_share", F.coalesce(ratio("total_cost", "trade_value"), F.lit(0.0)))


def execution_schedule(orders: DataFrame, days=5) -> DataFrame:
    """orders(…, quantity, day_volume) spread over days; falling weights above 10% of the volume."""
    heavy = c("quantity") / F.nullif(c("day_volume") * days, F.lit(0.0)) > 0.1
    out = orders.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    step = 1.0 / (days - 1) if days > 1 else 0.0
    falling = (1.5 - (c("day") - 1) * step) / float(days)  # weights 1.5 .. 0.5 have mean 1
    return out.withColumn("shares", c("quantity") * F.when(heavy, falling).otherwise(1.0 / days))


def position_ledger(trades: DataFrame, keys=("symbol",)) -> DataFrame:
    """Quantity, average_cost, market_value and unrealized_pnl after every trade, all by windows.

    trades has one row per key and day (intraday fills are summed first).  Selling
    more than is held floors the quantity at 0 and clears the average cost, so the quantity is the running sum
    less its running minimum below 0.  Sales leave the average cost alone and a
    purchase moves it by w = bought / held, an exponential mean with changing
    weight: per episode between empty positions it is a weighted sum with the decay
    L = sum(-ln(1 - w)).  Blocks of 37 in L keep the factors in range (e^-37 is
    below double precision), as in ``ewm_means``.
    """
    keys = list(keys)
    w = running(keys)
    from pyspark.sql import Window

    d = F.when(c("side") == "BUY", c("quantity")).otherwise(-c("quantity"))
    df = trades.withColumn("_d", d).withColumn("_s", F.sum("_d").over(w))
    raw = c("_s") - F.least(F.lit(0.0), F.min("_s").over(w))
    df = df.withColumn("_q", F.when(raw > 1e-9, raw).otherwise(0.0))
    df = df.withColumn("_before", F.coalesce(lagged("_q", 1, keys), F.lit(0.0)))
    buy = c("_d") > 0
    df = df.withColumn("_ep", F.sum((buy & (c("_before") == 0)).cast("int")).over(w))
    step = F.when(buy & (c("_before") > 0), -F.ln(c("_before") / c("_q"))).otherwise(0.0)
    ep = Window.partitionBy(*keys, "_ep").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_L", F.sum(step).over(ep)).withColumn("_b", F.floor(c("_L") / 37))
    term = F.when(buy, c("_d") / c("_q") * c("price") * F.exp(c("_L") - c("_b") * 37)).otherwise(0.0)
    df = df.withColumn("_t", term)
    here = Window.partitionBy(*keys, "_ep", "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    prev = Window.partitionBy(*keys, "_ep").orderBy("_b").rangeBetween(-1, -1)
    total = F.sum("_t").over(here) + F.coalesce(F.sum("_t").over(prev), F.lit(0.0)) * F.exp(F.lit(-37.0))
    oversold = (c("_before") + c("_d") < -1e-9) | (c("_ep") == 0)
    df = df.withColumn("average_cost", F.when(oversold, 0.0).otherwise(total * F.exp(c("_b") * 37 - c("_L"))))
    return df.select(*keys, "date", "side", "price", c("_q").alias("quantity"), "average_cost", (c("_q") * c("price")).alias("market_value"),
                     (c("_q") * (c("price") - c("average_cost"))).alias("unrealized_pnl"))


def daily_valuation(ledger: DataFrame, bars: DataFrame) -> DataFrame:
    """Value and profit of the held positions on every date, positions and prices as last known."""
    from factorframe.operators.align import date_grid

    grid = date_grid(bars.select("symbol", "date"))
    held = joins.asof(grid, ledger, ["symbol"], ["quantity", "average_cost"])
    priced = joins.asof(held.where("quantity > 0"), bars.select("symbol", "date", "close"), ["symbol"], ["close"])
    day = priced.groupBy("date").agg(F.sum(c("quantity") * c("close")).alias("position_value"), F.count(F.lit(1)).alias("positions"),
                                     F.sum(c("quantity") * (c("close") - c("average_cost"))).alias("unrealized_pnl"))
    one = day.withColumn("_k", F.lit(0))  # one row per day: the single ordered group is one calendar
    return one.withColumn("value_change", c("position_value") - lagged("position_value", 1, "_k")).drop("_k")


def turnover_rate(trades: DataFrame, values: DataFrame) -> DataFrame:
    """A15 per strategy: traded value over mean value, annualised by the days of the value series."""
    t = trades.groupBy("strategy").agg(F.sum(c("quantity") * c("price")).alias("_t"))
    v = values.groupBy("strategy").agg(F.avg("portfolio_value").alias("_v"), F.count(F.lit(1)).alias("_n"))
    out = v.join(t, "strategy", "left")
    return out.select("strategy", F.coalesce(ratio("_t", "_v") * (YEAR / c("_n")), F.lit(0.0)).alias("turnover_rate"))


def _annualized(total, n):
    return F.pow(total, YEAR / n) - 1


def return_metrics(returns: DataFrame, value="daily_return") -> DataFrame:
    """A16."""
    g = compounded(value, None)
    out = returns.groupBy("strategy").agg((g - 1).alias("total_return"), F.count(value).alias("_n"), (F.stddev_samp(value) * YEAR**0.5).alias("volatility"))
    return out.select("strategy", "total_return", _annualized(1 + c("total_return"), c("_n")).alias("annualized_return"), "volatility")


def ratios(returns: DataFrame, rf=0.02, value="daily_return") -> DataFrame:
    """Sharpe, Sortino and Calmar; an unbounded Sortino or Calmar is null with its flag set."""
    daily = (1 + rf) ** (1 / YEAR) - 1
    dd = drawdown(returns, value)
    low = F.when(c(value) < daily, c(value) - daily)
    out = dd.groupBy("strategy").agg(
        sharpe(value, rf).alias("sharpe_ratio"), F.avg(c(value) - daily).alias("_m"), F.stddev_samp(low).alias("_d"), F.count(low).alias("_k"),
        F.min("drawdown").alias("_dd"), (compounded(value, None)).alias("_g"), F.count(value).alias("_n"))
    sortino = F.when(c("_d") > 0, c("_m") / c("_d") * YEAR**0.5).when(c("_k") == 0, F.lit(None)).otherwise(0.0)
    return out.select("strategy", "sharpe_ratio", sortino.alias("sortino_ratio"), ratio(_annualized(c("_g"), c("_n")), F.abs("_dd")).alias("calmar_ratio"),
                      (c("_k") == 0).alias("no_losses"), (c("_dd") == 0).alias("no_drawdown"))


def max_drawdown(returns: DataFrame, value="daily_return") -> DataFrame:
    """A18."""
    return drawdown(returns, value).groupBy("strategy").agg(F.min("drawdown").alias("max_drawdown"))


def tail_risk(returns: DataFrame, value="daily_return", levels=(0.95, 0.99)) -> DataFrame:
    """Value at risk (exact, interpolated) and the mean of the returns at or below it."""
    q = ranks.quantiles(returns, ["strategy"], value, {f"var_{round(100 * x)}": 1 - x for x in levels}, calendar_bound=True)
    tail = lambda x: F.avg(F.when(c(value) <= c(f"var_{round(100 * x)}"), c(value))).alias(f"expected_shortfall_{round(100 * x)}")
    es = returns.join(q, "strategy").groupBy("strategy").agg(*[tail(x) for x in levels])
    return q.join(es, "strategy")


def trading_metrics(returns: DataFrame, value="daily_return") -> DataFrame:
    """Win rate and profit factor (null and flagged without losses)."""
    gain, loss = F.sum(F.when(c(value) > 0, c(value)).otherwise(0.0)), F.sum(F.when(c(value) < 0, -c(value)).otherwise(0.0))
    return returns.groupBy("strategy").agg(F.avg((c(value) > 0).cast("double")).alias("win_rate"),
                                           (gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"), (loss == 0).alias("no_losses"))


def relative_metrics(returns: DataFrame, benchmark: DataFrame, rf=0.02, value="daily_return", bench="bench_return", ddof=0) -> DataFrame:
    """Beta mixes sample covariance with population variance (ddof 0), as the source does; ddof 1 is consistent."""
    both = returns.join(benchmark, "date")
    var = F.var_pop(bench) if ddof == 0 else F.var_samp(bench)
    active = c(value) - c(bench)
    out = both.groupBy("strategy").agg(
        F.when(var > 0, F.covar_samp(value, bench) / var).otherwise(1.0).alias("beta"), (F.avg(value) * YEAR).alias("_p"), (F.avg(bench) * YEAR).alias("_b"),
        (F.stddev_samp(active) * YEAR**0.5).alias("tracking_error"), (F.avg(active) * YEAR).alias("_a"))
    return out.select("strategy", (c("_p") - (rf + c("beta") * (c("_b") - rf))).alias("alpha"), "beta",
                      F.coalesce(ratio("_a", "tracking_error"), F.lit(0.0)).alias("information_ratio"), "tracking_error")


def capture(returns: DataFrame, benchmark: DataFrame, value="daily_return", bench="bench_return") -> DataFrame:
    """A22."""
    side = lambda cond: F.coalesce(F.avg(F.when(cond, c(value))) / F.nullif(F.avg(F.when(cond, c(bench))), F.lit(0.0)), F.lit(0.0))
    return returns.join(benchmark, "date").groupBy("strategy").agg(side(c(bench) > 0).alias("up_capture"), side(c(bench) < 0).alias("down_capture"))


def all_metrics(returns: DataFrame, benchmark: DataFrame | None = None, rf=0.02, value="daily_return") -> DataFrame:
    """One row per strategy with every metric."""
    parts = [return_metrics(returns, value), ratios(returns, rf, value).drop("no_losses", "no_drawdown"), max_drawdown(returns, value), tail_risk(returns, value),
             trading_metrics(returns, value).drop("no_losses")]
    if benchmark is not None:
        parts += [relative_metrics(returns, benchmark, rf, value), capture(returns, benchmark, value)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "strategy", "left")
    return out


def result_metrics(values: DataFrame) -> DataFrame:
    """From the first and last value; this Sharpe ratio has no risk-free rate.  values(strategy, date, portfolio_value)."""
    steps = values.select("strategy", "date", "portfolio_value", change("portfolio_value", 1, "strategy").alias("daily_return"))
    out = steps.groupBy("strategy").agg(
        F.min_by("portfolio_value", "date").alias("initial_capital"), F.max_by("portfolio_value", "date").alias("final_value"), F.count("daily_return").alias("_n"),
        (F.stddev_samp("daily_return") * YEAR**0.5).alias("volatility"), F.avg((c("daily_return") > 0).cast("double")).alias("win_rate"))
    out = out.withColumn("total_return", c("final_value") / c("initial_capital") - 1)
    out = out.withColumn("annualized_return", _annualized(1 + c("total_return"), c("_n")))
    return out.withColumn("return_over_volatility", F.coalesce(ratio("annualized_return", "volatility"), F.lit(0.0))).drop("_n")


def formatted_summary(metrics: DataFrame, percent=("total_return", "annualized_return", "volatility", "win_rate"),
                      money=("initial_capital", "final_value")) -> DataFrame:
    """Metric values as text, one row per strategy and metric."""
    text = {x: F.concat(F.format_number(c(x) * 100, 2), F.lit("%")) for x in percent} | {x: F.concat(F.lit("$"), F.format_number(x, 0)) for x in money}
    cols = [x for x in metrics.columns if x in text]
    return metrics.select("strategy", *[text[x].alias(x) for x in cols]).unpivot(["strategy"], cols, "metric", "text")


def against_benchmark(returns: DataFrame, benchmark: DataFrame, value="daily_return", bench="bench_return") -> DataFrame:
    """Outperformance of the compounded series on common dates."""
    w = running("strategy")
    both = returns.join(benchmark, "date").select("strategy", "date", value, bench, (compounded(value, w) - compounded(bench, w)).alias("_o"))
    out = both.groupBy("strategy").agg(F.max_by("_o", "date").alias("total_outperformance"), F.count(F.lit(1)).alias("_n"),
                                       (F.stddev_samp("_o") * YEAR**0.5).alias("outperformance_volatility"),
                                       (F.stddev_samp(c(value) - c(bench)) * YEAR**0.5).alias("tracking_error"))
    g = 1 + c("total_outperformance")
    annual = F.when(g > 0, F.pow(g, YEAR / c("_n")) - 1)
    return out.select("strategy", "total_outperformance", annual.alias("annualized_outperformance"), "outperformance_volatility", "tracking_error")


def downside_deviation(returns: DataFrame, target=0.0, value="daily_return") -> DataFrame:
    """A26."""
    low = F.when(c(value) < target, c(value) - target)
    return returns.groupBy("strategy").agg(F.coalesce(F.stddev_samp(low) * YEAR**0.5, F.lit(0.0)).alias("downside_deviation"))


def shape(returns: DataFrame, value="daily_return") -> DataFrame:
    """A27."""
    return returns.groupBy("strategy").agg(sample_skew(value).alias("skewness"), sample_kurtosis(value).alias("kurtosis"))


def drawdown_risk(returns: DataFrame, value="daily_return") -> DataFrame:
    """Deepest and mean drawdown, longest run under water, share of days under water."""
    dd = drawdown(returns, value).withColumn("_under", (c("drawdown") < 0).cast("int"))
    dd = dd.withColumn("_run", F.sum(1 - c("_under")).over(running("strategy")))
    runs = dd.groupBy("strategy", "_run").agg(F.sum("_under").alias("_len")).groupBy("strategy").agg(F.max("_len").alias("max_duration"))
    out = dd.groupBy("strategy").agg(F.min("drawdown").alias("max_drawdown"), F.coalesce(F.avg(F.when(c("_under") == 1, c("drawdown"))), F.lit(0.0)).alias("avg_drawdown"),
                                     F.avg(c("_under").cast("double")).alias("drawdown_frequency"))
    return out.join(runs, "strategy")


def correlation_risk(returns: DataFrame, key="symbol", value="r") -> DataFrame:
    """Mean absolute pairwise correlation."""
    pairs = covariances(returns, value, key).where("s1 < s2")
    return pairs.agg(F.coalesce(F.avg(F.abs("corr")), F.lit(0.0)).alias("correlation_risk"), F.count("corr").alias("pairs"))


def liquidity_risk(weights: DataFrame, bars: DataFrame, rows=20) -> DataFrame:
    """A30 per strategy at its last date: position (in millions) over the mean volume of the last rows."""
    from factorframe.operators.universe import recent_volume

    last = weights.groupBy("strategy").agg(F.max("date").alias("date"))
    pos = weights.join(last, ["strategy", "date"]).where("weight <> 0").join(recent_volume(bars, rows), "symbol").where("avg_volume > 0")
    x = c("weight") * 1e6 / c("avg_volume")
    return pos.groupBy("strategy").agg(F.avg(x).alias("avg_liquidity_ratio"), F.max(x).alias("max_liquidity_ratio"),
                                       count_if(x > 0.1).alias("illiquid_positions"), F.stddev_pop(x).alias("liquidity_concentration"))


def risk_score(var_99, dd, conc, corr, vol) -> Column:
    part = lambda x, top: F.least(F.abs(c(x)) / top, F.lit(1.0))
    return F.least(0.25 * part(var_99, 0.05) + 0.25 * part(dd, 0.20) + 0.2 * part(conc, 1.0) + 0.15 * part(corr, 1.0) + 0.15 * part(vol, 0.30), F.lit(1.0))


def risk_record(returns: DataFrame, benchmark: DataFrame, weights: DataFrame, assets: DataFrame) -> DataFrame:
    """All risk figures and the overall score of each strategy; assets(symbol, date, r) gives the correlation part."""
    last = concentration(weights).groupBy("strategy").agg(F.max_by("hhi", "date").alias("concentration_risk"))
    corr = correlation_risk(assets).select("correlation_risk", F.lit(0).alias("_k"))
    out = tail_risk(returns)
    for p in (return_metrics(returns).select("strategy", "volatility"), max_drawdown(returns), downside_deviation(returns), shape(returns),
              relative_metrics(returns, benchmark).select("strategy", "beta", "tracking_error"), last):
        out = out.join(p, "strategy", "left")
    out = out.withColumn("_k", F.lit(0)).join(F.broadcast(corr), "_k").drop("_k")
    return out.withColumn("overall_risk_score", risk_score("var_99", "max_drawdown", F.coalesce("concentration_risk", F.lit(0.0)), "correlation_risk", "volatility"))


def check_limits(records: DataFrame, limits: DataFrame, metrics: list[str]) -> DataFrame:
    """limits(metric, cap) against the records, one row per strategy and limit; sizes are compared."""
    long = records.select("strategy", *[c(x).cast("double").alias(x) for x in metrics]).unpivot(["strategy"], metrics, "metric", "value")
    return long.join(limits, "metric").withColumn("within", F.abs("value") <= c("cap"))


def sample_covariance(returns: DataFrame, value="r", key="symbol") -> DataFrame:
    """Pairwise complete, annualised."""
    return covariances(returns, value, key).select("s1", "s2", (c("cov") * YEAR).alias("cov"))


def shrunk_covariance(returns: DataFrame, value="r", key="symbol") -> DataFrame:
    """Ledoit-Wolf (2004) shrinkage to a scaled identity, on dates all names have, annualised."""
    from factorframe.operators.align import common_dates

    full = common_dates(returns.where(c(value).isNotNull()), key)
    centre = full.groupBy(key).agg(F.avg(value).alias("_m"))
    x = full.join(centre, key).select(key, "date", (c(value) - c("_m")).alias("_v"))
    m = pair_moments(x, "_v", key).withColumn("_s", c("sxy") / c("n"))
    twice = F.when(c("s1") == c("s2"), 1.0).otherwise(2.0)
    tot = m.agg(F.sum(F.when(c("s1") == c("s2"), 1.0)).alias("p"), F.max("n").alias("t"), F.sum(F.when(c("s1") == c("s2"), c("_s"))).alias("trace"),
                F.sum(twice * c("_s") * c("_s")).alias("ss"), F.sum(twice * c("sxxyy")).alias("q"))
    mu = c("trace") / c("p")
    delta = (c("ss") - 2 * mu * c("trace") + c("p") * mu * mu) / c("p")
    beta = F.least((c("q") / c("t") - c("ss")) / (c("p") * c("t")), delta)
    fit = tot.select(mu.alias("_mu"), F.coalesce(beta / F.nullif(delta, F.lit(0.0)), F.lit(0.0)).alias("shrinkage"), F.lit(0).alias("_k"))
    out = m.withColumn("_k", F.lit(0)).join(F.broadcast(fit), "_k")
    value_ = (1 - c("shrinkage")) * c("_s") + F.when(c("s1") == c("s2"), c("shrinkage") * c("_mu")).otherwise(0.0)
    return out.select("s1", "s2", (value_ * YEAR).alias("cov"), "shrinkage")


def factor_covariance(exposures: DataFrame, factors: DataFrame, xs: list[str], n_obs="n", rss="rss", default_specific=0.04, per_block=512) -> DataFrame:
    """B F B' + D per pair; F is the shrunk annual covariance of a few factors, D the annual residual variance.

    Blocks of names meet in tasks as dense matrices, like in ``pair_moments``.
    """
    long = factors.select("date", *xs).unpivot(["date"], xs, "symbol", "r")
    rows = {(r["s1"], r["s2"]): r["cov"] for r in shrunk_covariance(long).collect()}  # len(xs)^2 numbers
    f = np.array([[rows.get((a, b), rows.get((b, a), 0.0)) for b in xs] for a in xs])
    k = len(xs)
    specific = F.coalesce(c(rss) / F.nullif(c(n_obs) - (k + 1), F.lit(0)) * YEAR, F.lit(default_specific))
    packed = exposures.select("symbol", F.explode(F.array(*[F.struct(F.lit(i).alias("date"), c(f"b_{x}").alias("v")) for i, x in enumerate(xs)],
                                                          F.struct(F.lit(k).alias("date"), specific.alias("v")))).alias("e")).select("symbol", "e.*")
    dealt = _dealt(packed, "v", "symbol", "date", per_block, [])

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        side = lambda o: pdf[pdf["_own"] == o].pivot(index="s", columns="d", values="v").reindex(columns=range(k + 1))
        a = side(i)
        b = a if i == j else side(j)
        cov = a.to_numpy()[:, :k] @ f @ b.to_numpy()[:, :k].T
        na, nb = a.index.to_numpy(dtype=object), b.index.to_numpy(dtype=object)
        if i == j:
            cov[np.diag_indices_from(cov)] += a[k].to_numpy()
        r, s = np.meshgrid(np.arange(len(na)), np.arange(len(nb)), indexing="ij")
        r, s = r.ravel(), s.ravel()
        keep = na[r] <= nb[s] if i == j else np.ones(len(r), bool)
        x, y = na[r[keep]], nb[s[keep]]
        swap = x > y
        return pd.DataFrame({"s1": np.where(swap, y, x), "s2": np.where(swap, x, y), "cov": cov[r[keep], s[keep]]})

    return dealt.groupBy("_i", "_j").applyInPandas(multiply, "s1 string, s2 string, cov double")


#: Draws of positions: multipliers and shifts of three rounds modulo a prime, small enough for 64-bit products anywhere.
DRAW_PRIME, DRAW_STEPS, DRAW_ROUNDS = 2**31 - 1, (15_485_863, 1_000_003, 7_368_787), ((48_271, 15), (69_621, 13), (40_692, 16))


def draw_keys(draw: np.ndarray, n: int, seed: int) -> np.ndarray:
    """One pseudo-random key for each draw (row) and position (column), from integers alone, so SQL can repeat them."""
    a, b, k = DRAW_STEPS
    x = (seed * a + draw[:, None].astype(np.int64) * b + np.arange(n, dtype=np.int64) * k + 1) % DRAW_PRIME
    for m, shift in DRAW_ROUNDS:
        x = x * m % DRAW_PRIME
        x ^= x >> shift
    return x


def draw_keys_sql(draw: str, position: str, seed: int) -> str:
    """The key of one draw and position as SQL over 64-bit integers."""
    a, b, k = DRAW_STEPS
    x = f"(({seed * a + 1} + {draw} * {b} + {position} * {k}) % {DRAW_PRIME})"
    for m, shift in DRAW_ROUNDS:
        x = f"list_transform([{x} * {m} % {DRAW_PRIME}], lambda x{shift}: xor(x{shift}, x{shift} >> {shift}))[1]"
    return x


def _deviation(x: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """Sample deviation along the last axis, of the elements in ``use``; 0 for fewer than two."""
    use = np.ones(x.shape, bool) if use is None else use
    n = use.sum(-1)
    mean = np.where(use, x, 0).sum(-1) / np.maximum(n, 1)
    return np.sqrt(np.where(use, (x - mean[..., None]) ** 2, 0).sum(-1) / np.maximum(n - 1, 1)) * (n > 1)


def _statistic(metric: str, r: np.ndarray, b: np.ndarray, rf: float) -> np.ndarray:
    """A figure of returns ``r`` (the last axis is time) against ``b``; ratios without a deviation are 0."""
    per = lambda top, sd: np.where(sd > 0, top / np.where(sd > 0, sd, 1) * YEAR**0.5, 0.0)
    grown = lambda x: np.exp(np.log1p(np.maximum(x, -1 + 1e-12)).sum(axis=-1))
    ex = r - rf / YEAR
    if metric == "sharpe":
        return per(ex.mean(axis=-1), _deviation(ex))
    if metric == "sortino":
        return per(ex.mean(axis=-1), _deviation(ex, ex < 0))
    if metric == "total_return":
        return grown(r) - 1
    if metric == "alpha":  # with a beta of 1 the risk-free rate drops out
        return grown(r) - grown(b)
    if metric == "information_ratio":
        return per((r - b).mean(axis=-1), _deviation(r - b))
    raise ValueError(metric)


def significance(returns: DataFrame, benchmark: DataFrame | None = None, metric="sharpe", draws=1000, seed=42, rf=0.02, value="daily_return",
                 per_task=100) -> DataFrame:
    """(strategy, observed, null_mean, null_std, critical_value, p_value) by resampling.

    Sharpe, Sortino and total return: bootstrap of the centred returns (a permutation cannot change them), around the
    risk-free rate or 0.  Alpha (compounded return less the benchmark's): bootstrap of returns centred on the benchmark's
    mean.  Information ratio: permutation against the benchmark.  Days without either return take no part.  A strategy's
    series is one calendar, so it travels as an array; draws are split into tasks and worked off as matrices of about
    four million positions; positions follow from (seed, draw, place) by ``draw_keys``, so reruns agree.
    """
    if benchmark is not None:
        df = returns.join(benchmark.select("date", c("bench_return").alias("_b")), "date")
    elif metric in ("information_ratio", "alpha"):
        raise ValueError(f"{metric} needs a benchmark")
    else:
        df = returns.withColumn("_b", F.lit(0.0))
    df = df.where(c(value).isNotNull() & c("_b").isNotNull())
    series = df.groupBy("strategy").agg(F.array_sort(F.collect_list(F.struct("date", c(value).alias("r"), c("_b").alias("b")))).alias("_x"))
    tasks = series.select("strategy", c("_x.r").alias("r"), c("_x.b").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(per_task))).alias("first"))

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                r, b = np.asarray(row.r, float), np.asarray(row.b, float)
                n, last = len(r), min(row.first + per_task, draws)
                seen = float(_statistic(metric, r, b, rf))
                shift = b.mean() if metric == "alpha" else rf / YEAR if metric in ("sharpe", "sortino") else 0.0
                block = max(1, 4_000_000 // n)
                for low in range(row.first, last, block):
                    keys = draw_keys(np.arange(low, min(low + block, last)), n, seed)
                    if metric == "information_ratio":
                        x = r[np.argsort(keys, axis=1, kind="stable")]
                    else:
                        x = (r - r.mean() + shift)[keys % n]
                    yield pd.DataFrame({"strategy": row.strategy, "observed": seen, "null": _statistic(metric, x, b, rf)})

    null = tasks.repartition("strategy", "first").mapInPandas(run, "strategy string, observed double, null double")
    return null.groupBy("strategy").agg(
        F.max("observed").alias("observed"), F.avg("null").alias("null_mean"), F.stddev_samp("null").alias("null_std"),
        F.percentile("null", F.lit(0.95)).alias("critical_value"), F.avg((c("null") >= c("observed")).cast("double")).alias("p_value"))


def strategy_statistics(returns: DataFrame, value="daily_return") -> DataFrame:
    """This Sharpe ratio has no risk-free rate."""
    out = returns.groupBy("strategy").agg(
        (F.avg(value) * YEAR).alias("annual_return"), (F.stddev_samp(value) * YEAR**0.5).alias("annual_volatility"), F.count(value).alias("total_observations"),
        F.min("date").alias("start_date"), F.max("date").alias("end_date"))
    out = out.withColumn("sharpe_ratio", F.coalesce(ratio("annual_return", "annual_volatility"), F.lit(0.0)))
    return out.join(max_drawdown(returns, value), "strategy")


def alpha_distribution(exposures: DataFrame, thresholds=(1.0, 1.5, 2.0, 2.5, 3.0)) -> DataFrame:
    """Names by sign of alpha and names significant at each threshold, as (measure, n)."""
    aggs = {"positive": c("alpha") > 0, "negative": c("alpha") < 0, "zero": c("alpha") == 0} | {f"t_above_{x}": F.abs("t_alpha") >= x for x in thresholds}
    return exposures.agg(*[count_if(e).alias(k) for k, e in aggs.items()]).unpivot([], [c(f"`{k}`") for k in aggs], "measure", "n")


def extreme_alphas(exposures: DataFrame, n=10) -> DataFrame:
    """A37."""
    top = ranks.top_n(exposures.select("symbol", "alpha"), [], [F.desc("alpha"), F.asc("symbol")], n).withColumn("kind", F.lit("top"))
    return top.unionByName(ranks.top_n(exposures.select("symbol", "alpha"), [], [F.asc("alpha"), F.asc("symbol")], n).withColumn("kind", F.lit("bottom")))


def monthly_table(values: DataFrame) -> DataFrame:
    """(strategy, year, m1..m12) percent change of the month's last value."""
    m = values.groupBy("strategy", F.trunc("date", "month").alias("date")).agg(F.max_by("portfolio_value", "date").alias("v"))
    r = m.select("strategy", F.year("date").alias("year"), F.month("date").alias("month"), (100 * change("v", 1, "strategy")).alias("r")).where("r is not null")
    wide = r.groupBy("strategy", "year").pivot("month", list(range(1, 13))).agg(F.first("r"))
    return wide.select("strategy", "year", *[c(str(i)).alias(f"m{i}") for i in range(1, 13)])


def position_properties(positions: DataFrame) -> DataFrame:
    """A39."""
    q = c("quantity")
    return positions.select("*", (q > 0).alias("is_long"), (q < 0).alias("is_short"), (F.abs(q) < 1e-6).alias("is_empty"),
                            F.coalesce((c("price") - c("average_cost")) / F.nullif(c("average_cost"), F.lit(0.0)), F.lit(0.0)).alias("return_pct"))


def trade_properties(trades: DataFrame) -> DataFrame:
    """A39."""
    base, buy = c("quantity") * c("price"), c("side") == "BUY"
    return trades.select("*", F.when(buy, base + c("commission")).otherwise(base - c("commission")).alias("total_cost"), buy.alias("is_buy"), (~buy).alias("is_sell"))


def snapshot_properties(snapshots: DataFrame) -> DataFrame:
    """snapshots(…, total_value, cash, positions array)."""
    eq = F.aggregate("positions", F.lit(0.0), lambda acc, x: acc + x["market_value"])
    share = lambda x: F.coalesce(x / F.nullif(c("total_value"), F.lit(0.0)), F.lit(0.0))
    return snapshots.select("*", eq.alias("equity_value"), share(c("cash")).alias("cash_ratio"), share(eq).alias("equity_ratio"),
                            F.size(F.filter("positions", lambda x: F.abs(x["quantity"]) >= 1e-6)).alias("positions_count"))


def limit_breaches(weights: DataFrame, values: DataFrame, position_limit=0.1, drawdown_limit=0.2) -> DataFrame:
    """A40 per strategy and date: weights over the limit, and value under start x (1 - drawdown limit)."""
    over = weights.groupBy("strategy", "date").agg(count_if(F.abs("weight") > position_limit).alias("positions_over_limit"))
    start = values.groupBy("strategy").agg(F.min_by("portfolio_value", "date").alias("_start"))
    v = values.join(start, "strategy").select("strategy", "date", (c("portfolio_value") < c("_start") * (1 - drawdown_limit)).alias("below_drawdown_limit"))
    return over.join(v, ["strategy", "date"], "full_outer").select(
        "strategy", "date", F.coalesce("positions_over_limit", F.lit(0)).alias("positions_over_limit"), F.coalesce("below_drawdown_limit", F.lit(False)).alias("below_drawdown_limit"))
