"""Queries X1-X20."""

from pyspark.sql import functions as F

from factorframe.functions.windows import change
from factorframe.operators import align, crosssection as x, signals as g, transforms
from factorframe.plans.catalog import query
from factorframe.plans.q_technical import chg, full, lag, win

RAWSQL = f"""(SELECT symbol, date, mc AS market_cap, CASE WHEN mc > 0 THEN ln(mc) END AS size,
    ma / close * (1 - coalesce(mom, 0)) AS book_to_market, 2.0 - (close / ma + close / hi) / 2 AS value, mom AS momentum, vol AS volatility FROM
    (SELECT *, close * CASE WHEN count(volume) OVER {win(20)} >= 20 THEN avg(volume) OVER {win(20)} ELSE volume END AS mc,
      avg(close) OVER {win(200)} AS ma, max(high) OVER {win(252)} AS hi, {chg('close', 252)} AS mom,
      {full('stddev_samp', 'ret', 60)} * sqrt(252) AS vol FROM (SELECT *, {chg('close')} AS ret FROM bars)))"""
DG = "market_cap:2 size:6 book_to_market:5 value:6 momentum:6 volatility:5"
LONG = f"(UNPIVOT {RAWSQL} ON market_cap, size, book_to_market, value, momentum, volatility INTO NAME feature VALUE v)"
# UNPIVOT in SQL leaves nulls out
STABLE = {"size": 6, "value": 6, "momentum": 6}


def _one(name, cols, dg):
    query(name, "bars", f"SELECT symbol, date, {', '.join(cols)} FROM {RAWSQL}", dg)(
        lambda p: x.raw_features(p.bars).select("symbol", "date", *cols))


_one("x01_market_cap_proxy", ["market_cap"], "market_cap:2")
_one("x02_size", ["size"], "size:6")
_one("x03_book_to_market", ["book_to_market"], "book_to_market:5")
_one("x04_value", ["value"], "value:6")
_one("x05_momentum", ["momentum"], "momentum:6")
_one("x06_volatility", ["volatility"], "volatility:5")

# rank inputs are rounded so that equal values tie in both engines
RND = "(SELECT symbol, date, feature, round(v + 1.7e-9, 6) + 0.0 AS value FROM " + LONG + " WHERE feature <> 'market_cap')"
FIVE = ["size", "book_to_market", "value", "momentum", "volatility"]


def _rounded(p):
    df = x.raw_features(p.bars)
    return df.select("date", "symbol", *[(F.round(F.col(n) + 1.7e-9, 6) + 0.0).alias(n) for n in FIVE])


@query("x07_rank_zscore", "bars", f"""SELECT date, symbol, feature, value,
    (rank() OVER (PARTITION BY date, feature ORDER BY value) + (count(*) OVER (PARTITION BY date, feature, value) - 1) / 2.0)
      / count(*) OVER (PARTITION BY date, feature) AS rank,
    CASE WHEN stddev_samp(value) OVER (PARTITION BY date, feature) > 0 THEN (value - avg(value) OVER (PARTITION BY date, feature))
      / stddev_samp(value) OVER (PARTITION BY date, feature) ELSE 0 END AS zscore FROM {RND}""", "rank:6 zscore:5")
def _(p):
    return x.ranks_and_zscores(_rounded(p), FIVE).where("value is not null")


@query("x08_winsorize", "bars", f"""SELECT date, symbol, feature, greatest(least(value, quantile_cont(value, 0.9) OVER (PARTITION BY date, feature)),
    quantile_cont(value, 0.1) OVER (PARTITION BY date, feature)) AS value FROM {RND}""", "value:5")
def _(p):
    return x.winsorized(_rounded(p), FIVE, 0.1).where("value is not null")


Q9 = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
FITSQL = f"(SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, quantile_cont(value, {Q9}) AS d FROM {RND} WHERE date <= DATE '1998-12-31' GROUP BY 1)"


@query("x09_fit_statistics", "bars", f"SELECT feature, mean, std, d[1] AS d1, d[5] AS d5, d[9] AS d9 FROM {FITSQL}", "mean:4 std:3 d1:5 d5:5 d9:5")
def _(p):
    fit = x.fit_statistics(_rounded(p).where("date <= '1998-12-31'"), FIVE)
    return fit.select("feature", "mean", "std", *[F.element_at("deciles", i).alias(f"d{i}") for i in (1, 5, 9)])


BR = "CASE WHEN value IS NULL THEN 0.5 WHEN value <= d[1] THEN CASE WHEN d[1] > 0 THEN 0.1 * value / d[1] ELSE 0 END " + " ".join(
    f"WHEN value <= d[{i}] THEN CASE WHEN d[{i}] > d[{i - 1}] THEN {(i - 1) / 10} + (value - d[{i - 1}]) / (d[{i}] - d[{i - 1}]) * 0.1 ELSE {(i - 1) / 10} END"
    for i in range(2, 10)) + " ELSE 1.0 END"


@query("x10_learned_rank", "bars", f"""SELECT date, symbol, feature, value, {BR} AS rank, CASE WHEN std > 0 THEN (value - mean) / std ELSE 0 END AS zscore
    FROM {RND} JOIN {FITSQL} USING (feature) WHERE date > DATE '1998-12-31'""", "rank:5 zscore:4")
def _(p):
    df = _rounded(p)
    fit = x.fit_statistics(df.where("date <= '1998-12-31'"), FIVE)
    return x.apply_statistics(df.where("date > '1998-12-31'"), fit, FIVE).where("value is not null")


@query("x11_eligible", "bars", """WITH cnt AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n_rows FROM bars),
    pts AS (SELECT symbol, d AS date FROM (SELECT DISTINCT symbol FROM bars), (SELECT max(date) AS d FROM bars GROUP BY strftime(date, '%Y-%m')))
    SELECT * FROM (SELECT p.symbol, p.date,
      CASE WHEN p.date - b.date <= 30 THEN b.date WHEN a.date - p.date <= 14 THEN a.date ELSE l.date END AS data_date,
      CASE WHEN p.date - b.date <= 30 THEN b.n_rows WHEN a.date - p.date <= 14 THEN a.n_rows ELSE l.n_rows END AS n_rows
      FROM pts p ASOF LEFT JOIN cnt b ON p.symbol = b.symbol AND p.date >= b.date ASOF LEFT JOIN cnt a ON p.symbol = a.symbol AND p.date <= a.date
      LEFT JOIN (SELECT symbol, max(date) AS date, max(n_rows) AS n_rows FROM cnt GROUP BY 1) l ON p.symbol = l.symbol) WHERE n_rows >= 126""")
def _(p):
    ends = transforms.rebalance_dates(p.bars, "monthly").select(F.col("rebalance_date").alias("date"))
    return x.eligible(p.bars, ends)


@query("x12_panel", "bars", f"""SELECT date, symbol, least(greatest(size, quantile_cont(size, 0.01) OVER w), quantile_cont(size, 0.99) OVER w) AS size,
    (rank() OVER (PARTITION BY date ORDER BY size) + (count(*) OVER (PARTITION BY date, size) - 1) / 2.0) / count(*) OVER w AS size_rank,
    CASE WHEN stddev_samp(size) OVER w > 0 THEN (size - avg(size) OVER w) / stddev_samp(size) OVER w ELSE 0 END AS size_zscore
    FROM {RAWSQL} WINDOW w AS (PARTITION BY date)""", "size:6 size_rank:6 size_zscore:5")
def _(p):
    return x.panel(p.bars).select("date", "symbol", "size", "size_rank", "size_zscore")


@query("x13_market_block", "bars ret", """SELECT a.date, (n + 1) / (2.0 * n) AS cs_rank, CASE WHEN s > 0 THEN 0.0 END AS cs_zscore, (m + 1) / (2.0 * m) AS cs_momentum
    FROM (SELECT date, count(close) AS n, stddev_samp(close) AS s FROM bars GROUP BY 1) a LEFT JOIN (SELECT date, count(r) AS m FROM ret GROUP BY 1) b
    ON a.date = b.date""", "cs_rank:8 cs_zscore:8 cs_momentum:8")
def _(p):
    return x.market_block(p.ret, p.bars)


@query("x13_rolling_beta", "ret", f"""SELECT symbol, date, CASE WHEN count(r) OVER {win(60)} >= 60 THEN covar_samp(r, m) OVER {win(60)} / nullif(var_samp(m) OVER {win(60)}, 0) END AS beta
    FROM (SELECT r.*, avg(r) OVER (PARTITION BY date) AS m FROM ret r)""", "beta:6")
def _(p):
    return x.rolling_beta(p.ret).select("symbol", "date", "beta")


@query("x14_country_risk_panel", "bars meta", """SELECT b.symbol, b.date, m.country, coalesce(premium, 0) AS premium FROM bars b JOIN meta m ON b.symbol = m.symbol
    LEFT JOIN (SELECT n_name AS country, n_regionkey / 100 AS premium FROM nation WHERE n_nationkey % 4 <> 0) r ON m.country = r.country""", "premium:6")
def _(p):
    risk = p.table("nation").where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("country"), (F.col("n_regionkey") / 100).alias("premium"))
    return align.country_risk(p.bars.select("symbol", "date"), p.meta, risk, ["premium"])


@query("x15_factor_columns", "bars factors", "SELECT b.symbol, b.date, MKT, HML, RF FROM bars b ASOF LEFT JOIN factors f ON b.date >= f.date", "MKT:9 HML:9 RF:9")
def _(p):
    return align.with_factors(p.bars.select("symbol", "date"), p.factors, ["MKT", "HML", "RF"])


DUM = ", ".join(f"CASE WHEN {d} = '{v}' THEN 1 ELSE 0 END AS box_{d}_{v.lower().replace(' ', '_')}" for d, vs in x.BOX_CATEGORIES.items() for v in vs)


@query("x16_box_dummies", "bars boxes", f"SELECT b.symbol, date, {DUM} FROM bars b JOIN boxes x ON b.symbol = x.symbol")
def _(p):
    return x.with_box_dummies(p.bars.select("symbol", "date"), p.boxes)


@query("x17_frozen_classes", "bars meta", """WITH k AS (SELECT symbol, arg_max(close, date) * avg(volume) AS cap FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i
      FROM bars WHERE date <= DATE '1998-12-31') WHERE i <= 20 GROUP BY 1),
    m AS (SELECT * FROM meta JOIN k USING (symbol)), q AS (SELECT quantile_cont(cap, 0.2) AS c20, quantile_cont(cap, 0.8) AS c80,
      quantile_cont(pb_ratio, 0.3) AS p30, quantile_cont(pb_ratio, 0.7) AS p70 FROM m)
    SELECT symbol, CASE WHEN cap >= c80 THEN 'large' WHEN cap >= c20 THEN 'mid' ELSE 'small' END AS size,
      CASE WHEN pb_ratio >= p70 THEN 'growth' WHEN pb_ratio >= p30 THEN 'neutral' ELSE 'value' END AS style, region, sector FROM m, q""")
def _(p):
    return x.frozen_classes(p.bars, p.meta, "1998-12-31")


FWD = """(SELECT symbol, date, CASE WHEN count(r) OVER w = 5 THEN exp(sum(ln(1 + r)) OVER w) - 1 END AS fwd FROM ret
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""
def corr_sql(x, y):
    """``stats.safe_corr``: null where a side is constant but for rounding noise."""
    flat = " AND ".join(f"stddev_samp({v}) > 1e-6 * avg(abs({v}))" for v in (x, y))
    return f"CASE WHEN {flat} THEN greatest(least(covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})), 1.0), -1.0) END"


ICSQL = f"""(SELECT strategy, s.date AS date, {corr_sql("signal", "fwd")} AS ic, count(*) AS n
    FROM signals s JOIN {FWD} f ON s.symbol = f.symbol AND s.date = f.date WHERE fwd IS NOT NULL GROUP BY strategy, s.date)"""


def _with_forward(p):
    fwd = transforms.forward_compounded(p.ret, 5).select("symbol", "date", "forward_return")
    return p.signals.join(fwd, ["symbol", "date"])


@query("x18_information_coefficient", "signals ret", "SELECT strategy, date, ic, n FROM " + ICSQL, "ic:6")
def _(p):
    return x.information_coefficients(_with_forward(p), by=("strategy", "date"))


@query("x18_ic_summary", "signals ret", """SELECT strategy, avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS ic_sharpe,
    avg((ic > 0)::INT) AS positive_ic_ratio, count(ic) AS n_dates FROM """ + ICSQL + " GROUP BY strategy", "mean_ic:6 ic_std:6 ic_sharpe:6 positive_ic_ratio:6")
def _(p):
    return x.ic_summary(x.information_coefficients(_with_forward(p), by=("strategy", "date")), ("strategy",))


@query("x19_feature_records", "bars ret", f"""SELECT *, CASE WHEN abs(mean_ic) >= 0.03 THEN 'ACCEPT' WHEN abs(mean_ic) >= 0.015 THEN 'MARGINAL' ELSE 'REJECT' END AS recommendation FROM
    (SELECT feature, avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS ic_sharpe, avg((ic > 0)::INT) AS positive_ic_ratio, count(ic) AS n_dates FROM
     (SELECT feature, f.date, {corr_sql("value", "fwd")} AS ic FROM {RND} v JOIN {FWD} f ON v.symbol = f.symbol AND v.date = f.date
      WHERE fwd IS NOT NULL GROUP BY feature, f.date) GROUP BY feature)""", "mean_ic:6 ic_std:6 ic_sharpe:6 positive_ic_ratio:6")
def _(p):
    fwd = transforms.forward_compounded(p.ret, 5).select("symbol", "date", "forward_return")
    return x.feature_records(_rounded(p).join(fwd, ["date", "symbol"]), FIVE)


@query("x20_importance_by_family", "", """SELECT feature_type, sum(importance) AS total_importance, avg(importance) AS avg_importance, count(*) AS n_features,
    100 * sum(importance) / (SELECT sum(p_retailprice) FROM part) AS pct_importance FROM
    (SELECT p_retailprice AS importance, CASE p_size % 7 WHEN 0 THEN 'momentum' WHEN 1 THEN 'volatility' WHEN 2 THEN 'technical' WHEN 3 THEN 'volume'
      WHEN 4 THEN 'cross_sectional' WHEN 5 THEN 'box' ELSE 'other' END AS feature_type FROM part) GROUP BY 1""",
       "total_importance:2 avg_importance:4 pct_importance:6")
def _(p):
    names = F.array(*[F.lit(n) for n in ("momentum_21d", "vol_of_vol_20d", "rsi_14", "obv_x", "default_spread", "box_size_large", "zzz")])
    t = p.table("part").select(F.element_at(names, F.col("p_size") % 7 + 1).alias("feature"), F.col("p_retailprice").alias("importance"))
    return x.importance_by_family(t)
