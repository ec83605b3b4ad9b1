"""Alignment of panels on time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.functions import joins
from factorframe.functions.windows import c


def common_dates(df: DataFrame, key="symbol", order="date") -> DataFrame:
    """Rows on the dates that every name has."""
    names = df.agg(F.countDistinct(key).alias("_names"))
    per_date = df.groupBy(order).agg(F.countDistinct(key).alias("_here"))
    full = per_date.join(F.broadcast(names), c("_here") == c("_names")).select(order)
    return df.join(full, order, "left_semi")


def date_grid(df: DataFrame, key="symbol", order="date") -> DataFrame:
    """Every name on every date from its own first one: the dates are exploded from one array of the calendar."""
    days = df.select(order).distinct().agg(F.sort_array(F.collect_set(order)).alias("_days"))  # bounded by the calendar
    first = df.groupBy(key).agg(F.min(order).alias("_from"))
    grid = first.withColumn("_all", F.lit(0)).join(F.broadcast(days.withColumn("_all", F.lit(0))), "_all")
    return grid.select(key, "_from", F.explode("_days").alias(order)).where(c(order) >= c("_from")).select(key, order)


def forward_fill_grid(df: DataFrame, cols: list[str], key="symbol", order="date") -> DataFrame:
    """P17 ffill: names on all dates since their first, last known values."""
    return joins.asof(date_grid(df, key, order), df, [key], cols, on=order)


def factors_on_days(days: DataFrame, factors: DataFrame, cols: list[str], order="date") -> DataFrame:
    """Last known factor row on each distinct day of ``days``.

    Both sides are one row per day, so the single ordered group holds one calendar.
    """
    d = days.select(order).distinct().withColumn("_all", F.lit(0))
    return joins.asof(d, factors.withColumn("_all", F.lit(0)), ["_all"], cols, on=order).drop("_all")


def with_factors(bars: DataFrame, factors: DataFrame, cols: list[str], order="date") -> DataFrame:
    """Factor columns, filled forward, on every symbol-date."""
    return bars.join(factors_on_days(bars, factors, cols, order), order)


def known_symbols(df: DataFrame, symbols: DataFrame, key="symbol") -> DataFrame:
    """J9."""
    return df.join(symbols.select(key).distinct(), key, "left_semi")


def missing_symbols(wanted: DataFrame, df: DataFrame, key="symbol") -> DataFrame:
    """J10."""
    return wanted.select(key).distinct().join(df.select(key).distinct(), key, "left_anti")


def history_upto(bars: DataFrame, dates: DataFrame, key="symbol", order="date", as_of="as_of") -> DataFrame:
    """Rows of history and last date of every name at or before each date of ``dates``.

    A running count per name joined as-of replaces the non-equi join on date <= as_of.
    """
    from factorframe.functions.windows import running

    counted = bars.select(key, order, F.count(F.lit(1)).over(running(key, order)).alias("n_rows"))
    wanted = date_points(bars, dates, key, as_of, order)
    return joins.asof(wanted, counted, [key], ["n_rows"], on=order, matched="last_date").withColumnRenamed(order, as_of)


def date_points(bars: DataFrame, dates: DataFrame, key="symbol", as_of="as_of", order="date") -> DataFrame:
    """Every name on every listed date (a rebalance calendar, so one bounded array)."""
    days = dates.agg(F.collect_set(as_of).alias("_days")).withColumn("_all", F.lit(0))
    names = bars.select(key).distinct().withColumn("_all", F.lit(0))
    return names.join(F.broadcast(days), "_all").select(key, F.explode("_days").alias(order))


def factor_windows(bars: DataFrame, factors: DataFrame, cols: list[str], n: int) -> DataFrame:
    """Mean of each factor over every symbol's trailing n rows (a range join in the form of a window)."""
    from factorframe.functions.windows import rolling_mean

    df = bars.join(factors, "date")
    return df.select(*bars.columns, *[rolling_mean(x, n).alias(f"{x}_mean_{n}") for x in cols])


def outer_blocks(blocks: list[DataFrame], keys=("date", "symbol")) -> DataFrame:
    """Feature blocks side by side on the keys; of equally named columns the first stays."""
    out = blocks[0]
    for b in blocks[1:]:
        new = [x for x in b.columns if x not in out.columns]
        out = out.join(b.select(*keys, *new), list(keys), "full_outer")
    return out


def country_risk(df: DataFrame, symbol_country: DataFrame, risk: DataFrame, cols: list[str], key="symbol") -> DataFrame:
    """Symbol -> country -> risk columns, zeros where either look-up misses."""
    place = symbol_country.select(key, "country").dropDuplicates([key])
    table = risk.select("country", *cols).dropDuplicates(["country"])
    out = df.join(place, key, "left").join(table, "country", "left")
    return out.select(*df.columns, "country", *[F.coalesce(c(x), F.lit(0.0)).alias(x) for x in cols])


def aligned_series(df: DataFrame, method: str, key="strategy", order="date", value="daily_return") -> DataFrame:
    """``inner`` keeps dates all series have, ``outer`` fills the full grid with 0, ``left`` fills forward, then 0."""
    if method == "inner":
        return common_dates(df, key, order)
    days = df.select(order).distinct().agg(F.collect_set(order).alias("_days")).withColumn("_all", F.lit(0))
    names = df.select(key).distinct().withColumn("_all", F.lit(0))
    grid = names.join(F.broadcast(days), "_all").select(key, F.explode("_days").alias(order))
    if method == "outer":
        out = grid.join(df, [key, order], "left")
    elif method == "left":
        out = joins.asof(grid, df, [key], [value], on=order)
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.withColumn(value, F.coalesce(c(value), F.lit(0.0)))
