"""Queries M1-M7, M9-M10, M18-M19."""

from pyspark.sql import functions as F

from factorframe.functions.windows import change
from factorframe.operators import estimate as m
from factorframe.plans.catalog import query
from factorframe.plans.ols_sql import ols_sql, student_sql
from factorframe.plans.q_technical import RUN, chg

FRAME = "(SELECT symbol, r.date, r - RF AS y, MKT, SMB, HML, RMW, CMA FROM ret r JOIN factors f ON r.date = f.date)"


def frame(p, xs=tuple(m.FF5)):
    return m.regression_frame(p.ret.select("symbol", "date", "r"), p.factors, list(xs))


B5 = " ".join(f"b_{x}:6" for x in m.FF5)
COLS5 = ", ".join(f"b_{x}" for x in m.FF5)


@query("m01_five_factor_ols", "ret factors", f"SELECT symbol, n, alpha, {COLS5}, r2, t_alpha FROM ({ols_sql(FRAME, ['symbol'], m.FF5, 'y', min_rows=50)})",
       f"alpha:8 {B5} r2:6 t_alpha:5")
def _(p):
    return m.fit(frame(p), m.FF5).select("symbol", "n", "alpha", *[f"b_{x}" for x in m.FF5], "r2", "t_alpha")


@query("m01_five_factor_ridge", "ret factors", f"SELECT symbol, alpha, {COLS5} FROM ({ols_sql(FRAME, ['symbol'], m.FF5, 'y', ridge=0.01, min_rows=50)})",
       f"alpha:8 {B5}")
def _(p):
    return m.fit(frame(p), m.FF5, ridge=0.01, t_stats=False).select("symbol", "alpha", *[f"b_{x}" for x in m.FF5])


@query("m02_three_factor_ols", "ret factors", f"SELECT symbol, n, alpha, b_MKT, b_SMB, b_HML, r2 FROM ({ols_sql(FRAME, ['symbol'], m.FF3, 'y', min_rows=50)})",
       "alpha:8 b_MKT:6 b_SMB:6 b_HML:6 r2:6")
def _(p):
    return m.fit(frame(p, m.FF3), m.FF3, t_stats=False).select("symbol", "n", "alpha", "b_MKT", "b_SMB", "b_HML", "r2")


FIT3 = f"({ols_sql(FRAME, ['symbol'], m.FF3, 'y', min_rows=50)})"


@query("m03_predict", "ret factors bars", f"""SELECT b.symbol, b.date, coalesce(alpha + b_MKT * MKT + b_SMB * SMB + b_HML * HML, 0) AS prediction
    FROM bars b JOIN factors f ON b.date = f.date LEFT JOIN (SELECT * FROM {FIT3} WHERE n >= 1500) e ON b.symbol = e.symbol""", "prediction:8")
def _(p):
    exp = m.fit(frame(p, m.FF3), m.FF3, t_stats=False, min_rows=1500)
    pts = p.bars.select("symbol", "date").join(p.factors.select("date", *m.FF3), "date")
    return m.predict(pts, exp, m.FF3).select("symbol", "date", "prediction")


@query("m04_exposure_summary", "ret factors", f"""SELECT coefficient, avg(v) AS mean, stddev_pop(v) AS std, avg(abs(v)) AS mean_abs FROM
    (UNPIVOT (SELECT alpha, b_MKT, b_SMB, b_HML FROM {FIT3}) ON alpha, b_MKT, b_SMB, b_HML INTO NAME coefficient VALUE v) GROUP BY 1""", "mean:7 std:7 mean_abs:7")
def _(p):
    return m.exposure_summary(m.fit(frame(p, m.FF3), m.FF3, t_stats=False), m.FF3)


@query("m05_alpha_tstats", "ret factors", f"SELECT symbol, n, alpha, t_alpha AS t_stat, r2 FROM ({ols_sql(FRAME, ['symbol'], m.FF5, 'y', min_rows=30)})",
       "alpha:8 t_stat:5 r2:6")
def _(p):
    return m.alpha_tstats(frame(p), m.FF5).drop("p_value")


@query("m05_alpha_p_values", "ret factors", f"""SELECT symbol, n, alpha, t_alpha AS t_stat, {student_sql("t_alpha", "n - 6")} AS p_value, r2
    FROM ({ols_sql(FRAME, ['symbol'], m.FF5, 'y', min_rows=30)})""", "alpha:8 t_stat:5 p_value:5 r2:6")
def _(p):
    return m.alpha_tstats(frame(p), m.FF5)


ROLLSQL = ols_sql(f"""(SELECT a.symbol, a.date, b.y, b.MKT, b.SMB FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {FRAME}) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {FRAME}) b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 59 AND a.i)""",
                  ["symbol", "date"], ["MKT", "SMB"], "y", min_rows=30)


@query("m06_rolling_alpha_tstats", "ret factors", f"SELECT symbol, date, n, alpha, t_alpha AS t_stat, r2 FROM ({ROLLSQL})", "alpha:7 t_stat:4 r2:5")
def _(p):
    out = m.rolling_alpha_tstats(frame(p, ["MKT", "SMB"]), ["MKT", "SMB"], n=60)
    return out.drop("p_value")


ROLL5 = ols_sql(f"""(SELECT a.symbol, a.date, b.y, {", ".join("b." + x for x in m.FF5)} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {FRAME}) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM {FRAME}) b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 251 AND a.i)""",
                ["symbol", "date"], m.FF5, "y", min_rows=30)


@query("m06_rolling_five_factor", "ret factors", f"SELECT symbol, date, n, alpha, t_alpha AS t_stat, {student_sql('t_alpha', 'n - 6')} AS p_value, r2 FROM ({ROLL5})",
       "alpha:7 t_stat:4 p_value:4 r2:5")
def _(p):
    return m.rolling_alpha_tstats(frame(p), m.FF5, n=252)


PANEL = f"""(SELECT symbol, date, lead(r) OVER (PARTITION BY symbol ORDER BY date) AS y, tanh({chg('close', 5)}) AS mom, volume / 100 AS vol FROM ret)"""


def _panel(p):
    return p.ret.select("symbol", "date", F.lead("r").over(m.ordered()).alias("y"), F.tanh(change("close", 5)).alias("mom"),
                        (F.col("volume") / 100).alias("vol"))


GAM = ols_sql(PANEL, ["date"], ["mom", "vol"], "y", min_rows=10)
GLONG = f"(UNPIVOT (SELECT date, n, r2, alpha AS intercept, b_mom AS mom, b_vol AS vol FROM ({GAM})) ON intercept, mom, vol INTO NAME feature VALUE coef)"


@query("m07_gammas", "ret", f"SELECT date, feature, coef, n AS n_obs, r2 FROM {GLONG}", "coef:7 r2:6")
def _(p):
    return m.gammas(_panel(p), ["mom", "vol"], min_names=10)


GSTAT = f"(SELECT feature, count(coef) AS n_dates, avg(coef) AS mean, stddev_samp(coef) AS std, avg(coef) / (stddev_samp(coef) / sqrt(count(coef))) AS t_stat FROM {GLONG} GROUP BY 1)"


@query("m07_gamma_statistics", "ret", f"SELECT * FROM {GSTAT}", "mean:8 std:7 t_stat:5")
def _(p):
    return m.gamma_statistics(m.gammas(_panel(p), ["mom", "vol"], min_names=10)).drop("p_value")


GP = f"(SELECT *, {student_sql('t_stat', 'n_dates - 1')} AS p_value FROM {GSTAT})"
GBH = f"(SELECT *, row_number() OVER (ORDER BY p_value, feature) AS rk, count(*) OVER () AS tests FROM {GP})"


@query("m07_gamma_p_values", "ret", f"""SELECT feature, n_dates, mean, std, t_stat, p_value, least(p_value * tests / rk, 1.0) AS p_adjusted,
    coalesce(rk <= (SELECT max(rk) FROM {GBH} WHERE p_value <= rk / tests * 0.05), false) AS significant FROM {GBH}""",
       "mean:8 std:7 t_stat:5 p_value:5 p_adjusted:5")
def _(p):
    return m.fdr(m.gamma_statistics(m.gammas(_panel(p), ["mom", "vol"], min_names=10)))


PV = "(SELECT p_partkey AS feature, CASE WHEN p_partkey % 97 > 0 THEN round(pow(p_size / 50.0, 6) * (1 + p_partkey % 13) / 13, 12) END AS p_value FROM part)"


def _pvalues(p):
    v = F.round(F.pow(F.col("p_size") / 50.0, 6) * (1 + F.col("p_partkey") % 13) / 13, 12)
    return p.table("part").select(F.col("p_partkey").alias("feature"), F.when(F.col("p_partkey") % 97 > 0, v).alias("p_value"))


BH = f"""(SELECT *, row_number() OVER (ORDER BY p_value, feature) AS rk, count(*) OVER () AS m FROM {PV} WHERE p_value IS NOT NULL)"""


@query("m09_fdr", "", f"""SELECT feature, p_value, least(p_value * m / rk, 1.0) AS p_adjusted, coalesce(rk <= (SELECT max(rk) FROM {BH} WHERE p_value <= rk / m * 0.05), false) AS significant
    FROM {BH} UNION ALL SELECT feature, p_value, NULL, false FROM {PV} WHERE p_value IS NULL""", "p_adjusted:10")
def _(p):
    return m.fdr(_pvalues(p))


@query("m09_fdr_monotone", "", f"""SELECT feature, p_value, min(least(p_value * m / rk, 1.0)) OVER (ORDER BY rk DESC) AS p_adjusted,
    coalesce(rk <= (SELECT max(rk) FROM {BH} WHERE p_value <= rk / m * 0.05), false) AS significant
    FROM {BH} UNION ALL SELECT feature, p_value, NULL, false FROM {PV} WHERE p_value IS NULL""", "p_adjusted:10")
def _(p):
    return m.fdr(_pvalues(p), monotone=True)


@query("m10_cross_section_prediction", "ret", f"""SELECT symbol, date, g.i + g.m * coalesce(mom, 0) + g.v * coalesce(vol, 0) AS prediction FROM {PANEL},
    (SELECT max(mean) FILTER (feature = 'intercept') AS i, max(mean) FILTER (feature = 'mom') AS m, max(mean) FILTER (feature = 'vol') AS v FROM {GSTAT}) g""", "prediction:8")
def _(p):
    panel = _panel(p)
    stats = m.gamma_statistics(m.gammas(panel, ["mom", "vol"], min_names=10))
    return m.predict_cross_section(panel, stats, ["mom", "vol"]).select("symbol", "date", "prediction")


W = "(PARTITION BY symbol ORDER BY date ROWS BETWEEN 272 PRECEDING AND 21 PRECEDING)"


@query("m18_residual_momentum", "ret factors", f"""SELECT symbol, date, residual, CASE WHEN i >= 273 AND stddev_samp(residual) OVER {W} > 0
    THEN sum(residual) OVER {W} / stddev_samp(residual) OVER {W} ELSE 0 END AS residual_momentum FROM
    (SELECT x.symbol, x.date, y - (alpha + b_MKT * MKT + b_SMB * SMB + b_HML * HML) AS residual, row_number() OVER (PARTITION BY x.symbol ORDER BY x.date) AS i
     FROM {FRAME} x JOIN {FIT3} e ON x.symbol = e.symbol)""", "residual:8 residual_momentum:5")
def _(p):
    return m.residual_momentum(frame(p, m.FF3), m.FF3)


@query("m19_split_expected_return", "ret factors", f"""SELECT *, abs(alpha) / nullif(abs(alpha) + abs(factor_part), 0) AS alpha_share, alpha + factor_part AS expected_return FROM
    (SELECT e.symbol, f.date, alpha, b_MKT * MKT + b_SMB * SMB + b_HML * HML AS factor_part FROM {FIT3} e JOIN ret r ON r.symbol = e.symbol JOIN factors f ON f.date = r.date)""",
       "alpha:8 factor_part:8 alpha_share:6 expected_return:8")
def _(p):
    exp = m.fit(frame(p, m.FF3), m.FF3, t_stats=False)
    pts = p.ret.select("symbol", "date").join(p.factors.select("date", *m.FF3), "date")
    return m.split_return(pts, exp, m.FF3).drop(*m.FF3)
