"""Queries W1-W16."""

from pyspark.sql import functions as F

from factorframe.functions.pairs import covariances
from factorframe.operators import classify, portfolio as w, transforms, universe
from factorframe.plans import builders
from factorframe.plans.catalog import query

SR = "(SELECT strategy, date, symbol, round(signal + 1.7e-11, 8) AS signal FROM signals)"
BX = "(SELECT symbol, size || '_' || style AS box FROM boxes)"
SIZES, STYLES = ["large", "mid", "small"], ["growth", "neutral", "value"]
SELSQL = f"""(SELECT * FROM (SELECT s.*, box, row_number() OVER (PARTITION BY strategy, date, box ORDER BY signal DESC NULLS LAST, s.symbol) AS i
    FROM {SR} s JOIN {BX} b ON s.symbol = b.symbol) WHERE i <= 2)"""


def _signals(p):
    return p.signals.withColumn("signal", F.round(F.col("signal") + 1.7e-11, 8))


def _boxes(p):
    return p.boxes.select("symbol", F.concat_ws("_", "size", "style").alias("box"))


def _targets(p):
    t = w.equal_box_targets(p.spark, {"size": SIZES, "style": STYLES})
    return t.where("box <> 'mid_neutral'")


TSQL = "CASE WHEN box = 'mid_neutral' THEN 0.5 ELSE 1.0 / 9 END"


def _selected(p):
    return w.with_targets(w.select_in_boxes(_signals(p), _boxes(p), 2), _targets(p), unknown=0.5)


@query("w01_top_per_box", "signals boxes", f"SELECT strategy, date, box, symbol, signal FROM {SELSQL}")
def _(p):
    return w.select_in_boxes(_signals(p), _boxes(p), 2)


@query("w01_minimum_per_box", "signals boxes", f"SELECT strategy, date, box, symbol, signal FROM (SELECT *, count(*) OVER (PARTITION BY strategy, date, box) AS n FROM {SELSQL}) WHERE n >= 2")
def _(p):
    return w.select_in_boxes(_signals(p), _boxes(p), 2, minimum=2)


@query("w02_box_targets", "boxes", f"SELECT symbol, box, {TSQL} AS target FROM {BX}", "target:8")
def _(p):
    return w.with_targets(_boxes(p), _targets(p), unknown=0.5).select("symbol", "box", "target")


@query("w03_box_coverage", "boxes", f"""SELECT coalesce(h.box, t.box) AS box, CASE WHEN h.box IS NULL THEN 'no_stocks' WHEN t.box IS NULL THEN 'no_target' ELSE 'covered' END AS status,
    coalesce(stocks, 0) AS stocks, coalesce(target, 0) AS target FROM (SELECT box, count(*) AS stocks FROM {BX} GROUP BY 1) h
    FULL JOIN (SELECT s || '_' || y AS box, 1.0 / 9 AS target FROM (SELECT unnest(['large', 'mid', 'small']) AS s), (SELECT unnest(['growth', 'neutral', 'value']) AS y) WHERE s || '_' || y <> 'mid_neutral') t ON h.box = t.box""", "target:8")
def _(p):
    return w.coverage(_boxes(p), _targets(p))


EQ = f"(SELECT strategy, date, box, symbol, {TSQL} / count(*) OVER (PARTITION BY strategy, date, box) AS weight FROM {SELSQL})"


@query("w04_equal_in_box", "signals boxes", f"SELECT * FROM {EQ}", "weight:8")
def _(p):
    return w.equal_in_box(_selected(p))


@query("w05_proportional_in_box", "signals boxes", f"""SELECT strategy, date, box, symbol, CASE WHEN t IS NULL THEN {TSQL} / n WHEN signal > 1e-6 THEN {TSQL} * signal / t ELSE 0 END AS weight FROM
    (SELECT *, count(*) OVER w AS n, sum(CASE WHEN signal > 1e-6 THEN signal END) OVER w AS t FROM {SELSQL} WINDOW w AS (PARTITION BY strategy, date, box))""", "weight:7")
def _(p):
    return w.proportional_in_box(_selected(p))


def _cov(p):
    return covariances(p.ret, "r").select("s1", "s2", (F.col("cov") * 252).alias("cov"))


def _audit(weights, keys, cap, *more):
    """Names, sum, worst breach of [0, cap] and status of each optimised group."""
    return weights.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("names"), F.sum("weight").alias("total"), F.greatest(F.max("weight") - cap, -F.min("weight"), F.lit(0.0)).alias("breach"),
        F.max("status").alias("status"), *more)


def _audit_sql(chosen, keys, cap):
    """What an optimiser that keeps its limits must report: 1 and 0 where the names can carry the weight, else nothing."""
    fits = f"count(*) * {cap} >= 1 - 1e-9"
    return f"""SELECT {keys}, count(*) AS names, CASE WHEN {fits} THEN CAST(1 AS DOUBLE) END AS total, CAST(0 AS DOUBLE) AS breach,
        CASE WHEN {fits} THEN 'optimal' ELSE 'infeasible' END AS status FROM ({chosen}) GROUP BY {keys}"""


def _strongest_sql(n):
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, date ORDER BY abs(signal) DESC NULLS LAST, symbol) AS i FROM {SR}) WHERE i <= {n}"


@query("w06_mean_variance", "signals", _audit_sql(_strongest_sql(5), "strategy, date", 0.3), "total:6 breach:6")
def _(p):
    return _audit(w.mean_variance(w.strongest(_signals(p), 5), _cov(p), cap=0.3), ["strategy", "date"], 0.3)


@query("w06_mean_variance_per_box", "signals boxes", f"""SELECT strategy, date, box, count(*) AS names, sum({TSQL}) / count(*) AS total, CAST(0 AS DOUBLE) AS breach, 'optimal' AS status
    FROM {SELSQL} GROUP BY strategy, date, box""", "total:6 breach:6")
def _(p):
    return _audit(w.mean_variance(_selected(p), _cov(p), group="box"), ["strategy", "date", "box"], 1.0)


@query("w07_equal_weight", "signals", "SELECT strategy, date, symbol, 1.0 / count(*) OVER (PARTITION BY strategy, date) AS weight FROM signals", "weight:8")
def _(p):
    return w.equal_weight(p.signals)


@query("w07_top_n_weight", "signals", f"""SELECT strategy, date, symbol, 1.0 / count(*) OVER (PARTITION BY strategy, date) AS weight FROM
    (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, date ORDER BY signal DESC NULLS LAST, symbol) AS i FROM {SR}) WHERE i <= 10)""", "weight:8")
def _(p):
    return w.top_n_weight(_signals(p), 10)


@query("w08_exposure_check", "weights boxes", """SELECT dimension, value, strategy, date, exposure, cap, exposure <= cap + 1e-9 AS within FROM
    (SELECT strategy, date, 'size' AS dimension, size AS value, sum(weight) AS exposure, 0.7 AS cap FROM weights JOIN boxes USING (symbol) WHERE size = 'large' GROUP BY ALL
     UNION ALL SELECT strategy, date, 'region', region, sum(weight), 0.4 FROM weights JOIN boxes USING (symbol) WHERE region = 'emerging' GROUP BY ALL)""", "exposure:7 cap:3")
def _(p):
    k = p.table("region").where("r_regionkey < 2")
    first = F.col("r_regionkey") == 0
    limits = k.select(F.when(first, "size").otherwise("region").alias("dimension"), F.when(first, "large").otherwise("emerging").alias("value"),
                      F.when(first, 0.7).otherwise(0.4).alias("cap"))
    return w.exposure_check(p.weights, p.boxes, limits)


@query("w08_capped_optimization", "signals boxes", f"""SELECT strategy, date, names, CASE WHEN fits THEN CAST(1 AS DOUBLE) END AS total, CAST(0 AS DOUBLE) AS breach,
    CASE WHEN fits THEN 'optimal' ELSE 'infeasible' END AS status, CAST(CASE WHEN fits THEN 0 END AS DOUBLE) AS over FROM
    (SELECT strategy, date, count(*) AS names, sum(CASE WHEN region = 'emerging' THEN 0 ELSE 0.6 END) + least(0.4, 0.6 * count(CASE WHEN region = 'emerging' THEN 1 END)) >= 1 - 1e-9 AS fits
     FROM ({_strongest_sql(6)}) JOIN boxes USING (symbol) GROUP BY strategy, date)""", "total:6 breach:6 over:6")
def _(p):
    chosen = w.strongest(_signals(p), 6).join(p.boxes.select("symbol", "region"), "symbol")
    got = w.mean_variance(chosen, _cov(p), cap=0.6, limits=[("region", "emerging", 0.4)]).join(p.boxes.select("symbol", "region"), "symbol")
    held = F.coalesce(F.sum(F.when(F.col("region") == "emerging", F.col("weight"))), F.sum(F.col("weight") * 0))
    return _audit(got, ["strategy", "date"], 0.6, F.greatest(held - 0.4, F.sum(F.col("weight") * 0)).alias("over"))


@query("w09_strongest", "signals", f"""SELECT strategy, date, symbol, signal FROM (SELECT *, row_number() OVER (PARTITION BY strategy, date ORDER BY abs(signal) DESC, symbol) AS i FROM {SR}) WHERE i <= 5""")
def _(p):
    return w.strongest(_signals(p), 5)


@query("w10_box_sampling", "bars meta boxes signals", f"""WITH liq AS (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 1300),
    last AS (SELECT symbol, sum(signal) AS signal FROM (SELECT strategy, symbol, arg_max(signal, date) AS signal FROM {SR} GROUP BY 1, 2) GROUP BY 1)
    SELECT box, symbol, signal FROM (SELECT box, b.symbol, signal, row_number() OVER (PARTITION BY box ORDER BY signal DESC NULLS LAST, b.symbol) AS i
      FROM {BX} b JOIN liq ON b.symbol = liq.symbol LEFT JOIN last ON b.symbol = last.symbol) WHERE i <= 2""")
def _(p):
    liquid = universe.liquid(p.bars, min_rows=1300)
    last = _signals(p).groupBy("strategy", "symbol").agg(F.max_by("signal", "date").alias("signal"))
    last = last.groupBy("symbol").agg(F.sum("signal").alias("signal"))  # of all strategies
    return w.sample_boxes(_boxes(p).join(liquid.select("symbol"), "symbol", "left_semi"), last, 2)


@query("w10_random_sampling", "meta boxes", f"""SELECT box, symbol, CAST(NULL AS DOUBLE) AS signal FROM
    (SELECT box, symbol, row_number() OVER (PARTITION BY box ORDER BY md5(symbol || '|42'), symbol) AS i FROM {BX} b) WHERE i <= 2""")
def _(p):
    return w.sample_boxes(_boxes(p), None, 2)


@query("w11_constrained", "weights", """WITH a AS (SELECT *, sum(weight) OVER (PARTITION BY strategy, date) AS t FROM weights WHERE weight >= 0.02),
    b AS (SELECT *, least(CASE WHEN t < 1e-6 THEN 0 ELSE weight / t END, 0.3) AS v FROM (SELECT strategy, date, symbol, CASE WHEN t > 1 THEN weight / t ELSE weight END AS weight, least(t, 1) AS t FROM a))
    SELECT strategy, date, symbol, v / sum(v) OVER (PARTITION BY strategy, date) AS weight FROM b""", "weight:7")
def _(p):
    return w.constrained(p.weights, 0.02, 1.0, 0.3)


@query("w12_normalized", "weights", """SELECT strategy, date, symbol, CASE WHEN abs(t) < 1e-6 THEN 0 ELSE v / t END AS weight FROM
    (SELECT *, sum(v) OVER (PARTITION BY strategy, date) AS t FROM (SELECT strategy, date, symbol, weight * weight AS v FROM weights))""", "weight:7")
def _(p):
    return w.normalized(p.weights.withColumn("weight", F.col("weight") * F.col("weight")))


@query("w12_weight_totals", "weights", """SELECT *, gross <= 1 + 1e-6 AS gross_ok, abs(net - 1) <= 1e-6 AS net_ok FROM
    (SELECT strategy, date, sum(abs(weight)) AS gross, sum(weight) AS net FROM weights GROUP BY 1, 2)""", "gross:7 net:7")
def _(p):
    return w.weight_totals(p.weights)


@query("w13_carried", "weights bars", """WITH r AS (SELECT strategy, max(date) AS rb FROM weights GROUP BY strategy, strftime(date, '%Y-%m')),
    g AS (SELECT strategy, date FROM (SELECT DISTINCT strategy FROM weights), (SELECT DISTINCT date FROM bars)),
    a AS (SELECT g.strategy, g.date, coalesce(r.rb, (SELECT min(rb) FROM r x WHERE x.strategy = g.strategy)) AS rb FROM g ASOF LEFT JOIN r ON g.strategy = r.strategy AND g.date >= r.rb)
    SELECT a.strategy, a.date, symbol, CASE WHEN abs(sum(weight) OVER (PARTITION BY a.strategy, a.date)) < 1e-6 THEN 0 ELSE weight / sum(weight) OVER (PARTITION BY a.strategy, a.date) END AS weight
    FROM a JOIN weights w ON a.strategy = w.strategy AND a.rb = w.date""", "weight:7")
def _(p):
    ends = p.weights.groupBy("strategy", transforms.rebalance_bucket("monthly").alias("b")).agg(F.max("date").alias("date")).drop("b")
    return w.carried(p.weights.join(ends, ["strategy", "date"], "left_semi"), p.bars)


@query("w14_box_based_builder", "signals boxes", f"SELECT strategy, date, symbol, weight / sum(weight) OVER (PARTITION BY strategy, date) AS weight FROM {EQ.replace('THEN 0.5', 'THEN 1.0')}", "weight:7")
def _(p):
    return builders.box_based(_signals(p), _boxes(p), _targets(p), 2)


@query("w14_quantitative_builder", "bars signals", _audit_sql(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, date ORDER BY abs(signal) DESC NULLS LAST, symbol) AS i
    FROM {SR} WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 1400)) WHERE i <= 5""", "strategy, date", 0.4), "total:6 breach:6")
def _(p):
    got = builders.quantitative(_signals(p), universe.liquid(p.bars, min_rows=1400), _cov(p), n=5, cap=0.4)
    return _audit(got, ["strategy", "date"], 0.4)


@query("w15_recommendations", "weights signals boxes", f"""SELECT w.strategy, w.date, w.symbol, weight, coalesce(signal, 0) AS signal_strength, 0.5 * abs(coalesce(signal, 0)) AS risk_score, box
    FROM weights w LEFT JOIN signals s ON w.strategy = s.strategy AND w.date = s.date AND w.symbol = s.symbol LEFT JOIN {BX} b ON w.symbol = b.symbol WHERE weight > 0""",
       "weight:7 signal_strength:7 risk_score:7")
def _(p):
    return w.recommendations(p.weights, p.signals, _boxes(p))


@query("w16_outlook", "weights signals", """SELECT w.strategy, w.date, sum(weight * coalesce(signal, 0)) * 252 AS expected_return, sqrt(sum(weight * weight)) * 0.2 AS expected_risk,
    least(count(*) / 10, 1) AS diversification, count(*) AS positions FROM weights w LEFT JOIN signals s ON w.strategy = s.strategy AND w.date = s.date AND w.symbol = s.symbol
    WHERE weight > 0 GROUP BY 1, 2""", "expected_return:5 expected_risk:7 diversification:7")
def _(p):
    return w.outlook(p.weights, p.signals)
