"""Factor regressions and their statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorframe.functions import ranks
from factorframe.functions.gram import gram, solve, student_p
from factorframe.functions.windows import c, ordered, rolling_sums, running

# fixed values
FF5 = ["MKT", "SMB", "HML", "RMW", "CMA"]
FF3 = ["MKT", "SMB", "HML"]
MIN_ROWS = 50


def regression_frame(returns: DataFrame, factors: DataFrame, xs: list[str], value="r", excess=True) -> DataFrame:
    """Returns with the factors of their date, less the risk-free rate when the table has one."""
    rf = ["RF"] if excess and "RF" in factors.columns else []
    df = returns.join(factors.select("date", *xs, *rf), "date")
    return df.withColumn("y", c(value) - c("RF") if rf else c(value))


def fit(frame: DataFrame, xs: list[str], keys=("symbol",), y="y", ridge=0.0, standardize=False, min_rows=MIN_ROWS,
        t_stats=True) -> DataFrame:
    """M1/M2: one regression per key; only the moments of a key leave the aggregation."""
    m = gram(frame, list(keys), xs, y).where(c("_n") >= min_rows)
    return solve(m, list(keys), xs, ridge=ridge, standardize=standardize, t_stats=t_stats)


def predict(points: DataFrame, exposures: DataFrame, xs: list[str], keys=("symbol",), name="prediction") -> DataFrame:
    """M3: alpha + beta . factors; unknown keys get 0."""
    cols = ["alpha"] + [f"b_{x}" for x in xs]
    out = points.join(exposures.select(*keys, *cols), list(keys), "left")
    value = c("alpha") + sum((c(f"b_{x}") * c(x) for x in xs), F.lit(0.0))
    return out.withColumn(name, F.coalesce(value, F.lit(0.0))).drop(*cols)


def split_return(points: DataFrame, exposures: DataFrame, xs: list[str], keys=("symbol",)) -> DataFrame:
    """Expected return split into alpha and factor part, with the share of alpha."""
    cols = ["alpha"] + [f"b_{x}" for x in xs]
    out = points.join(exposures.select(*keys, *cols), list(keys))
    part = sum((c(f"b_{x}") * c(x) for x in xs), F.lit(0.0))
    out = out.withColumn("factor_part", part).withColumn("expected_return", c("alpha") + c("factor_part"))
    share = F.abs("alpha") / F.nullif(F.abs("alpha") + F.abs("factor_part"), F.lit(0.0))
    return out.withColumn("alpha_share", share).drop(*cols[1:])


def exposure_summary(exposures: DataFrame, xs: list[str]) -> DataFrame:
    """M4: (coefficient, mean, std, mean_abs) over symbols; std is of the population."""
    cols = ["alpha"] + [f"b_{x}" for x in xs]
    long = exposures.select(*cols).unpivot([], cols, "coefficient", "v")
    return long.groupBy("coefficient").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg(F.abs("v")).alias("mean_abs"))


def alpha_tstats(frame: DataFrame, xs: list[str], keys=("symbol",), y="y", min_rows=30) -> DataFrame:
    """M5: alpha, t_stat, p_value, r2, n; too few rows or no variance give 0, 1, 0."""
    m = gram(frame, list(keys), xs, y)
    good = solve(m.where((c("_n") >= min_rows) & (c("_syy") > 0)), list(keys), xs)
    out = m.select(*keys, c("_n").cast("long").alias("n")).join(good.drop("n"), list(keys), "left")
    default = lambda x, v: F.coalesce(c(x), F.lit(v))
    return out.select(*keys, "n", default("alpha", 0.0).alias("alpha"), default("t_alpha", 0.0).alias("t_stat"),
                      default("p_alpha", 1.0).alias("p_value"), default("r2", 0.0).alias("r2"))


def rolling_moments(frame: DataFrame, xs: list[str], y="y", n=252, keys=("symbol",), order=("date",)) -> DataFrame:
    """Moments of the trailing n rows at every row, in one linear pass (see ``rolling_sums``).

    Values should be centred near zero (returns are), since covariances come from sums of products.
    """
    vs = xs + [y]
    df = frame.dropna(subset=vs)
    prods = {f"_{a}_{b}": c(a) * c(b) for i, a in enumerate(vs) for b in vs[i:]}
    df = df.select(*keys, *order, *vs, *[e.alias(k) for k, e in prods.items()])
    df = rolling_sums(df, vs + list(prods), n, list(keys), list(order))
    m = lambda v: c(f"{v}_sum") / c("_rows")
    cov = lambda a, b: c(f"_{a}_{b}_sum" if f"_{a}_{b}" in prods else f"_{b}_{a}_sum") / c("_rows") - m(a) * m(b)
    out = [c("_rows").cast("double").alias("_n"), m(y).alias("_my"), cov(y, y).alias("_syy")]
    out += [m(x).alias(f"_m{i}") for i, x in enumerate(xs)] + [cov(x, y).alias(f"_y{i}") for i, x in enumerate(xs)]
    out += [cov(xs[i], xs[j]).alias(f"_x{i}_{j}") for i in range(len(xs)) for j in range(i + 1)]
    return df.select(*keys, *order, *out)


def rolling_alpha_tstats(frame: DataFrame, xs: list[str], y="y", n=252, min_rows=30, keys=("symbol",)) -> DataFrame:
    """M6: alpha and its t-statistic over the trailing n rows (at least min_rows) of every symbol and date."""
    m = rolling_moments(frame, xs, y, n, keys).where(c("_n") >= min_rows)
    out = solve(m, list(keys) + ["date"], xs)
    return out.select(*keys, "date", "n", "alpha", c("t_alpha").alias("t_stat"), c("p_alpha").alias("p_value"), "r2")


def gammas(panel: DataFrame, features: list[str], y="y", by="date", min_names=3, ridge=0.0) -> DataFrame:
    """M7: one cross-sectional regression per date -> (date, feature, coef, n_obs, r2), intercept included."""
    need = max(min_names, len(features) + 1)
    m = gram(panel, [by], features, y).where(c("_n") >= need)
    wide = solve(m, [by], features, ridge=ridge, t_stats=False)
    wide = wide.select(by, "n", "r2", c("alpha").alias("intercept"), *[c(f"b_{x}").alias(x) for x in features])
    cols = ["intercept"] + features
    return wide.unpivot([by, "n", "r2"], cols, "feature", "coef").select(
        by, "feature", "coef", c("n").alias("n_obs"), "r2")


def with_p_value(df: DataFrame, t: str, dof: str, name="p_value") -> DataFrame:
    """Two-sided Student p-values, a batch at a time."""

    @F.pandas_udf("double")
    def p(t_: pd.Series, d_: pd.Series) -> pd.Series:
        return pd.Series(student_p(t_.to_numpy(dtype=float, na_value=np.nan), d_.to_numpy(dtype=float, na_value=np.nan)))

    return df.withColumn(name, F.nanvl(p(c(t).cast("double"), c(dof).cast("double")), F.lit(None).cast("double")))


def gamma_statistics(gamma: DataFrame) -> DataFrame:
    """M7: mean, std, t and p of every coefficient's series."""
    s = gamma.groupBy("feature").agg(F.count("coef").alias("n_dates"), F.avg("coef").alias("mean"), F.stddev_samp("coef").alias("std"))
    s = s.withColumn("t_stat", c("mean") / F.nullif(c("std") / F.sqrt("n_dates"), F.lit(0.0))).withColumn("_d", c("n_dates") - 1)
    return with_p_value(s, "t_stat", "_d").drop("_d")


def fdr(tests: DataFrame, level=0.05, monotone=False, p="p_value", name="feature") -> DataFrame:
    """M9: Benjamini-Hochberg over any number of tests: p_adjusted, significant.

    Null p-values are no tests: they are kept but not counted.  ``monotone`` adds the running minimum from above.
    """
    known = ranks.row_numbers(tests.where(c(p).isNotNull()), [], p, [name], "_rank")
    m = known.agg(F.count(F.lit(1)).alias("_m"))
    out = known.withColumn("_all", F.lit(0)).join(F.broadcast(m.withColumn("_all", F.lit(0))), "_all")
    last = out.agg(F.max(F.when(c(p) <= c("_rank") / c("_m") * level, c("_rank"))).alias("_k")).withColumn("_all", F.lit(0))
    out = out.join(F.broadcast(last), "_all").withColumn("p_adjusted", F.least(c(p) * c("_m") / c("_rank"), F.lit(1.0)))
    out = out.withColumn("significant", F.coalesce(c("_rank") <= c("_k"), F.lit(False)))
    if monotone:
        out = _running_min_from_above(out)
    res = out.drop("_all", "_m", "_k", "_rank")
    rest = tests.where(c(p).isNull()).withColumn("p_adjusted", F.lit(None).cast("double")).withColumn("significant", F.lit(False))
    return res.unionByName(rest)


def _running_min_from_above(df: DataFrame, size=4096) -> DataFrame:
    """min of p_adjusted over ranks >= own: per block of ranks, then the minimum of the blocks above."""
    from pyspark.sql import Window

    df = df.withColumn("_b", F.floor(c("_rank") / size))
    tops = df.groupBy("_b").agg(F.min("p_adjusted").alias("_min"))
    above = Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    tops = tops.select("_b", F.min("_min").over(above).alias("_above"))
    here = Window.partitionBy("_b").orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_here", F.min("p_adjusted").over(here)).join(tops, "_b")
    return out.withColumn("p_adjusted", F.least("_here", "_above")).drop("_b", "_here", "_above")


def predict_cross_section(panel: DataFrame, statistics: DataFrame, features: list[str], name="prediction") -> DataFrame:
    """Mean gammas applied to features; a missing feature counts as 0, without gammas there is no prediction.

    The coefficient table is one row.
    """
    cols = ["intercept"] + features
    wide = statistics.agg(*[F.max(F.when(c("feature") == x, c("mean"))).alias(f"_g_{x}") for x in cols]).withColumn("_k", F.lit(0))
    out = panel.withColumn("_k", F.lit(0)).join(F.broadcast(wide), "_k")
    value = c("_g_intercept") + sum((c(f"_g_{x}") * F.coalesce(c(x), F.lit(0.0)) for x in features), F.lit(0.0))
    return out.withColumn(name, value).drop("_k", *[f"_g_{x}" for x in cols])


def residuals(frame: DataFrame, exposures: DataFrame, xs: list[str], keys=("symbol",), y="y") -> DataFrame:
    out = predict(frame.dropna(subset=xs + [y]).join(exposures.select(*keys), list(keys), "left_semi"), exposures, xs, keys, "_fit")
    return out.withColumn("residual", c(y) - c("_fit")).drop("_fit")


def residual_momentum(frame: DataFrame, xs: list[str], formation=252, skip=21, y="y", min_rows=MIN_ROWS) -> DataFrame:
    """Sum over std of the residuals of the formation rows that end ``skip`` rows ago; 0 before there are enough."""
    res = residuals(frame, fit(frame, xs, y=y, min_rows=min_rows, t_stats=False), xs, y=y)
    w = ordered().rowsBetween(-(formation + skip - 1), -skip)
    n = F.count(F.lit(1)).over(running())
    sd = F.stddev_samp("residual").over(w)
    value = F.when((n >= formation + skip) & (sd > 0), F.sum("residual").over(w) / sd).otherwise(0.0)
    return res.select("symbol", "date", "residual", value.alias("residual_momentum"))
