"""Flagship query: does buying the five strongest names each day pay?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.functions import ranks
from factorframe.functions.windows import change, rolling_mean, ratio
from factorframe.operators import analytics, portfolio
from factorframe.sources.panel import damped


def daily_strength(bars: DataFrame, n=5, average=10) -> DataFrame:
    """Strength = close over its moving average; equal weights of the top n; next day's damped return; performance row."""
    df = bars.select("symbol", "date", damped(change("close")).alias("r"), (ratio("close", rolling_mean("close", average)) - 1).alias("signal"))
    chosen = ranks.percent_rank(df.where("signal is not null"), ["date"], "signal", "strength")
    chosen = chosen.select(F.lit("strongest").alias("strategy"), "date", "symbol", F.col("strength").alias("signal"))
    weights = portfolio.top_n_weight(chosen, n)
    returns = analytics.portfolio_returns(weights, df.where("r is not null"))
    return analytics.return_metrics(returns).join(analytics.ratios(returns), "strategy").join(analytics.max_drawdown(returns), "strategy")
