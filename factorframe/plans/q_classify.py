"""Queries C1-C11 and F1-F7."""

from pyspark.sql import functions as F

from factorframe.operators import classify as k, factors as f
from factorframe.plans.catalog import query
from factorframe.plans.q_technical import chg, full

BOX = "size || '_' || style || '_' || region || '_' || sector"


@query("c01_size_class", "boxes", "SELECT symbol, size FROM boxes")
def _(p):
    return k.size_class(p.meta).select("symbol", "size")


SCORE = f"""(SELECT symbol, CASE WHEN n < 20 THEN 0.5 ELSE (greatest(0, least(1, -m * 50 + 0.5)) + greatest(0, least(1, v / 0.4))
      + greatest(0, least(1, coalesce((s - c) / s + 0.5, 1)))) / 3 END AS technical_score FROM
    (SELECT symbol, count(r) AS n, avg(r) FILTER (i <= 21) AS m, stddev_samp(r) * sqrt(252) AS v, arg_max(close, date) AS c, max(sma) FILTER (i = 1) AS s FROM
     (SELECT *, {chg('close')} AS r, {full('avg', 'close', 200)} AS sma, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM bars) GROUP BY 1))"""


@query("c02_style_class", "bars meta", f"""SELECT symbol, CASE WHEN pb IS NULL THEN CASE WHEN technical_score > 0.65 THEN 'growth' WHEN technical_score < 0.35 THEN 'value' ELSE 'neutral' END
    WHEN pb >= p70 THEN 'growth' WHEN pb >= p30 THEN 'neutral' ELSE 'value' END AS style FROM
    (SELECT *, CASE WHEN sector <> 'Energy' THEN pb_ratio END AS pb FROM meta) JOIN {SCORE} USING (symbol),
    (SELECT quantile_cont(pb_ratio, 0.3) AS p30, quantile_cont(pb_ratio, 0.7) AS p70 FROM meta WHERE sector <> 'Energy')""")
def _(p):
    m = p.meta.withColumn("pb_ratio", F.when(F.col("sector") != "Energy", F.col("pb_ratio")))
    return k.style_class(m.join(k.technical_style_score(p.bars), "symbol"), technical="technical_score").select("symbol", "style")


@query("c03_technical_style_score", "bars", f"SELECT symbol, technical_score FROM {SCORE}", "technical_score:6")
def _(p):
    return k.technical_style_score(p.bars)


@query("c04_fundamental_style_score", "", """SELECT p_partkey, CASE WHEN a > 0 AND b > 0 THEN (a + b) / 2 WHEN a > 0 THEN a WHEN b > 0 THEN b END AS score FROM
    (SELECT p_partkey, coalesce(greatest(0, least(1, (pe - 15) / 10.0)), 0) AS a, coalesce(greatest(0, least(1, (p_size / 10.0 - 1.5) / 2)), 0) AS b FROM
     (SELECT *, CASE WHEN p_partkey % 5 > 0 THEN p_size END AS pe FROM part))""", "score:6")
def _(p):
    t = p.table("part").withColumn("pe", F.when(F.col("p_partkey") % 5 > 0, F.col("p_size")))
    return t.select("p_partkey", k.fundamental_style_score("pe", F.col("p_size") / 10).alias("score"))


@query("c05_region_class", "", "SELECT n_name, CASE WHEN n_name IN ('NATION_1', 'NATION_5', 'NATION_9') OR n_nationkey % 6 = 0 THEN 'developed' ELSE 'emerging' END AS region FROM nation")
def _(p):
    t = p.table("nation").withColumn("c", F.when(F.col("n_nationkey") % 6 > 0, F.col("n_name")))
    return t.select("n_name", k.region_class("c", ["NATION_1", "NATION_5", "NATION_9"]).alias("region"))


@query("c06_sector_class", "", """SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'Mapped' WHEN p_size > 40 THEN p_type WHEN upper(name) LIKE '%BANK%' THEN 'Financials'
    WHEN upper(name) LIKE '%OIL%' THEN 'Energy' END AS sector FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'first bank ' WHEN 1 THEN 'oil ' ELSE '' END || p_name || p_partkey AS name FROM part)""")
def _(p):
    pre = F.element_at(F.array(F.lit("first bank "), F.lit("oil "), F.lit("")), (F.col("p_partkey") % 3 + 1).cast("int"))
    t = p.table("part").select("p_partkey", F.concat(pre, "p_name", F.col("p_partkey").cast("string")).alias("symbol"),
                               F.when(F.col("p_size") > 40, F.col("p_type")).alias("listed"))
    m = t.where("p_partkey % 50 = 0").select("symbol", F.lit("Mapped").alias("sector"))
    return k.sector_class(t, m, "listed").select("p_partkey", "sector")


STATS = f"""(SELECT symbol, stddev_samp(r) * sqrt(252) / 1000 AS vol, avg(volume) AS avg_volume FROM (SELECT *, {chg('close')} AS r FROM bars) GROUP BY 1)"""
SC = """greatest(0, least(1, 0.3 * least(1, log10(market_cap / 1e4 + 1) / 3) + 0.4 * pb_ratio / 5 + 0.2 * coalesce(greatest(0, least(1, 1 - abs(vol - 0.25) / 0.25)), 0.5)
    + 0.1 * coalesce(least(1, avg_volume / 1e6), 0.5)))"""
SCORED = f"(SELECT symbol, {SC} AS score FROM meta JOIN {STATS} USING (symbol))"


def _scored(p):
    from factorframe.functions.windows import change

    st = p.bars.select("symbol", "volume", change("close").alias("r")).groupBy("symbol").agg(
        (F.stddev_samp("r") * 252**0.5 / 1000).alias("vol"), F.avg("volume").alias("avg_volume"))
    score = k.classification_score(F.col("market_cap") / 1e4, F.col("pb_ratio") / 5, "vol", "avg_volume")
    return p.meta.join(st, "symbol").select("symbol", score.alias("score"))


@query("c07_classification_score", "bars meta", f"SELECT symbol, score FROM {SCORED}", "score:8")
def _(p):
    return _scored(p)


@query("c08_box_members", "bars meta boxes", f"""SELECT symbol, box, score, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY score DESC, symbol) AS position FROM
    (SELECT b.symbol, {BOX} AS box, score FROM boxes b JOIN {SCORED} s ON b.symbol = s.symbol)) WHERE position <= 2""", "score:8")
def _(p):
    return k.box_members(p.boxes.join(_scored(p), "symbol"), 2).select("symbol", "box", "score", "position")


@query("c09_box_summary", "boxes", """WITH x AS (SELECT size, style, region, sector, count(*) AS stocks FROM boxes GROUP BY 1, 2, 3, 4)
    SELECT 'size' AS dimension, size AS value, count(*) AS boxes, CAST(sum(stocks) AS BIGINT) AS stocks FROM x GROUP BY 2
    UNION ALL SELECT 'style', style, count(*), CAST(sum(stocks) AS BIGINT) FROM x GROUP BY 2 UNION ALL SELECT 'region', region, count(*), CAST(sum(stocks) AS BIGINT) FROM x GROUP BY 2
    UNION ALL SELECT 'all', 'all', count(*), CAST(sum(stocks) AS BIGINT) FROM x""")
def _(p):
    return k.box_summary(p.boxes)


@query("c09_extreme_boxes", "boxes", f"""WITH x AS (SELECT {BOX} AS box, count(*) AS stocks FROM boxes GROUP BY 1)
    SELECT * FROM (SELECT box, stocks, 'largest' AS kind FROM x ORDER BY stocks DESC, box LIMIT 5)
    UNION ALL SELECT * FROM (SELECT box, stocks, 'smallest' FROM x ORDER BY stocks, box LIMIT 5)""")
def _(p):
    return k.extreme_boxes(p.boxes)


@query("c10_merge_small_boxes", "boxes", f"""WITH x AS (SELECT size, style, region, sector, {BOX} AS box, count(*) AS stocks FROM boxes GROUP BY ALL),
    kept AS (SELECT * FROM x WHERE stocks >= 2 ORDER BY stocks DESC, box LIMIT 30), small AS (SELECT * FROM x WHERE box NOT IN (SELECT box FROM kept)),
    sim AS (SELECT s.box, k.box AS target, (s.size = k.size)::INT * 3 + (s.style = k.style)::INT * 2 + (s.region = k.region)::INT AS like_ FROM small s, kept k),
    best AS (SELECT box, target FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY like_ DESC, target) AS i FROM sim WHERE like_ > 0) WHERE i = 1)
    SELECT box, box AS target FROM kept UNION ALL SELECT s.box, coalesce(target, s.box) FROM small s LEFT JOIN best b ON s.box = b.box""")
def _(p):
    return k.merge_small_boxes(p.boxes)


@query("c11_box_coverage", "boxes meta", f"""SELECT box, count(*) AS symbols, count(*) / sum(count(*)) OVER () AS share FROM
    (SELECT u.symbol, coalesce({BOX}, 'unclassified') AS box FROM (SELECT symbol FROM meta UNION SELECT n_name FROM nation) u LEFT JOIN boxes b ON u.symbol = b.symbol) GROUP BY 1""", "share:6")
def _(p):
    return k.box_coverage(p.meta.select("symbol").union(p.table("nation").select("n_name")), p.boxes)


SORTED = """(SELECT r.*, (CASE WHEN market_cap < med THEN 'S' ELSE 'B' END) || (CASE WHEN bm < b30 THEN 'L' WHEN bm >= b70 THEN 'H' ELSE 'M' END) AS port FROM
    (SELECT date, r.symbol, r, market_cap, 1 / pb_ratio AS bm FROM ret r JOIN meta m ON r.symbol = m.symbol) r JOIN
    (SELECT date, quantile_cont(market_cap, 0.5) AS med, quantile_cont(1 / pb_ratio, 0.3) AS b30, quantile_cont(1 / pb_ratio, 0.7) AS b70
     FROM ret r JOIN meta m ON r.symbol = m.symbol GROUP BY 1 HAVING count(*) >= 10) q ON r.date = q.date)"""


def _sorted(p):
    panel = p.ret.select("date", "symbol", "r").join(p.meta.select("symbol", "market_cap", (1 / F.col("pb_ratio")).alias("bm")), "symbol")
    return f.double_sorts(panel)


@query("f01_double_sorts", "ret meta", f"SELECT date, symbol, port FROM {SORTED}")
def _(p):
    return _sorted(p).select("date", "symbol", "port")


@query("f02_portfolio_returns", "ret meta", f"SELECT date, port, sum(r * market_cap) / sum(market_cap) AS port_return FROM {SORTED} GROUP BY 1, 2", "port_return:9")
def _(p):
    return f.portfolio_returns(_sorted(p))


THREE = f"""(SELECT date, m - RF AS MKT, list_avg(list_filter([SH, SM, SL], lambda x: x IS NOT NULL)) - list_avg(list_filter([BH, BM, BL], lambda x: x IS NOT NULL)) AS SMB,
    list_avg(list_filter([SH, BH], lambda x: x IS NOT NULL)) - list_avg(list_filter([SL, BL], lambda x: x IS NOT NULL)) AS HML, RF FROM
    (SELECT date, {", ".join(f"sum(r * market_cap) FILTER (port = '{x}') / sum(market_cap) FILTER (port = '{x}') AS {x}" for x in f.PORTFOLIOS)},
     sum(r * market_cap) / sum(market_cap) AS m, CAST(0.0001 AS DOUBLE) AS RF FROM {SORTED} GROUP BY 1))"""


@query("f03_three_factors", "ret meta", f"SELECT * FROM {THREE}", "MKT:9 SMB:9 HML:9 RF:9")
def _(p):
    return f.three_factors(_sorted(p), p.factors)


@query("f04_extend_history", "factors", """SELECT date, MKT, 'old' AS origin FROM factors WHERE date <= DATE '1999-06-30' UNION ALL
    SELECT date, 2 * MKT, 'new' FROM factors WHERE date > DATE '1999-06-30'""", "MKT:9")
def _(p):
    old = p.factors.where("date <= '1999-06-30'").select("date", "MKT", F.lit("old").alias("origin"))
    return f.extend_history(old, p.factors.select("date", (2 * F.col("MKT")).alias("MKT"), F.lit("new").alias("origin")))


@query("f05_daily_risk_free", "", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 1e7 AS y, count(*) AS n FROM orders GROUP BY 1),
    k AS (SELECT date, pow(1 + y, 1.0 / 252) - 1 AS rf FROM d WHERE n > 4)
    SELECT d.date, coalesce(rf, (SELECT avg(rf) FROM (SELECT rf FROM k ORDER BY date DESC LIMIT 30))) AS RF FROM d LEFT JOIN k ON d.date = k.date""", "RF:9")
def _(p):
    d = p.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 1e7).alias("annual_yield"), F.count(F.lit(1)).alias("n"))
    return f.daily_risk_free(d.where("n > 4"), d)


@query("f06_factor_statistics", "factors", """SELECT factor, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lowest, max(v) AS highest, avg(v) * 252 AS annual_mean,
    stddev_samp(v) * sqrt(252) AS annual_std, avg(v) / stddev_samp(v) * sqrt(252) AS sharpe, skewness(v) AS skew, kurtosis(v) AS kurtosis
    FROM (UNPIVOT (SELECT date, MKT, SMB, HML, RMW, CMA FROM factors) ON MKT, SMB, HML, RMW, CMA INTO NAME factor VALUE v) GROUP BY 1""",
       "mean:8 std:8 lowest:8 highest:8 annual_mean:6 annual_std:6 sharpe:5 skew:5 kurtosis:5")
def _(p):
    return f.factor_statistics(p.factors)


NAMES = sorted(f.FACTORS)


@query("f07_factor_correlations", "factors", " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a}, {b}) AS corr FROM factors" for i, a in enumerate(NAMES) for b in NAMES[i:]), "corr:6")
def _(p):
    return f.factor_correlations(p.factors)


@query("f07_cumulative_returns", "factors", """SELECT date, factor, exp(sum(ln(1 + v)) OVER (PARTITION BY factor ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS cumulative
    FROM (UNPIVOT (SELECT date, MKT, SMB, HML, RMW, CMA FROM factors) ON MKT, SMB, HML, RMW, CMA INTO NAME factor VALUE v)""", "cumulative:6")
def _(p):
    return f.cumulative_factor_returns(p.factors)
