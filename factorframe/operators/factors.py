"""Factor construction and factor statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.functions import pairs, ranks
from factorframe.functions.stats import sample_kurtosis, sample_skew
from factorframe.functions.windows import c, compounded, ratio, running

PORTFOLIOS = ("SH", "SM", "SL", "BH", "BM", "BL")
FACTORS = ("MKT", "SMB", "HML", "RMW", "CMA")


def double_sorts(panel: DataFrame, min_names=10) -> DataFrame:
    """panel(date, symbol, r, market_cap, bm) -> port in SH..BL per date; thin dates are skipped."""
    ok = panel.where((c("market_cap") > 0) & (c("bm") > 0) & c("r").isNotNull())
    size = ranks.quantiles(ok, ["date"], "market_cap", {"_med": 0.5})
    value = ranks.quantiles(ok, ["date"], "bm", {"_b30": 0.3, "_b70": 0.7})
    n = ok.groupBy("date").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= min_names)
    cuts = n.join(size, "date").join(value, "date")
    s = F.when(c("market_cap") < c("_med"), "S").otherwise("B")
    b = F.when(c("bm") < c("_b30"), "L").when(c("bm") >= c("_b70"), "H").otherwise("M")
    return ok.join(cuts, "date").withColumn("port", F.concat(s, b)).drop("_n", "_med", "_b30", "_b70")


def portfolio_returns(sorted_panel: DataFrame) -> DataFrame:
    """cap-weighted return of each of the six."""
    return sorted_panel.groupBy("date", "port").agg(
        (F.sum(c("r") * c("market_cap")) / F.sum("market_cap")).alias("port_return"))


def three_factors(sorted_panel: DataFrame, rf: DataFrame) -> DataFrame:
    """MKT (cap-weighted market less RF), SMB, HML; means over the portfolios that exist."""
    ports = portfolio_returns(sorted_panel).groupBy("date").pivot("port", list(PORTFOLIOS)).agg(F.first("port_return"))

    def mean(*names):
        there = [c(x) for x in names]
        n = sum((x.isNotNull().cast("int") for x in there), F.lit(0))
        total = sum((F.coalesce(x, F.lit(0.0)) for x in there), F.lit(0.0))
        return total / F.nullif(n, F.lit(0))

    market = sorted_panel.groupBy("date").agg((F.sum(c("r") * c("market_cap")) / F.sum("market_cap")).alias("_m"))
    out = ports.join(market, "date").join(rf.select("date", "RF"), "date", "left")
    return out.select(
        "date", (c("_m") - F.coalesce("RF", F.lit(0.0))).alias("MKT"), (mean("SH", "SM", "SL") - mean("BH", "BM", "BL")).alias("SMB"),
        (mean("SH", "BH") - mean("SL", "BL")).alias("HML"), F.coalesce("RF", F.lit(0.0)).alias("RF"))


def extend_history(history: DataFrame, update: DataFrame) -> DataFrame:
    """only dates after the stored ones are added."""
    last = history.agg(F.max("date").alias("_last"))
    fresh = update.join(F.broadcast(last), F.col("_last").isNull() | (c("date") > c("_last"))).drop("_last")
    return history.unionByName(fresh.groupBy("date").agg(*[F.first(x).alias(x) for x in history.columns if x != "date"]))


def daily_risk_free(yields: DataFrame, dates: DataFrame, rate="annual_yield", days=252, tail=30) -> DataFrame:
    """(1 + y)^(1/252) - 1 per date; dates without a yield get the mean of the last 30 known daily rates."""
    known = yields.where(c(rate).isNotNull()).select("date", (F.pow(1 + c(rate), F.lit(1 / days)) - 1).alias("_rf"))
    fallback = ranks.top_n(known, [], [F.desc("date")], tail).agg(F.avg("_rf").alias("_fb"))
    out = dates.select("date").distinct().join(known, "date", "left").withColumn("_k", F.lit(0))
    out = out.join(F.broadcast(fallback.withColumn("_k", F.lit(0))), "_k")
    return out.select("date", F.coalesce("_rf", "_fb").alias("RF"))


def factor_statistics(factors: DataFrame, cols=FACTORS) -> DataFrame:
    """F6."""
    long = factors.select("date", *cols).unpivot(["date"], list(cols), "factor", "v")
    sd = F.stddev_samp("v")
    return long.groupBy("factor").agg(
        F.avg("v").alias("mean"), sd.alias("std"), F.min("v").alias("lowest"), F.max("v").alias("highest"),
        (F.avg("v") * 252).alias("annual_mean"), (sd * 252**0.5).alias("annual_std"),
        (F.avg("v") / F.nullif(sd, F.lit(0.0)) * 252**0.5).alias("sharpe"),
        sample_skew("v").alias("skew"), sample_kurtosis("v").alias("kurtosis"))


def factor_correlations(factors: DataFrame, cols=FACTORS) -> DataFrame:
    """pairs f1 <= f2."""
    cols = sorted(cols)
    both = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = factors.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in both])
    long = wide.unpivot([], [f"{a}|{b}" for a, b in both], "pair", "corr")
    return long.select(F.split("pair", r"\|")[0].alias("f1"), F.split("pair", r"\|")[1].alias("f2"), "corr")


def cumulative_factor_returns(factors: DataFrame, cols=FACTORS) -> DataFrame:
    """running compounded return; one row per day, so the single ordered group is one calendar."""
    long = factors.select("date", *cols).unpivot(["date"], list(cols), "factor", "v")
    return long.withColumn("cumulative", compounded("v", running("factor")) - 1).drop("v")
