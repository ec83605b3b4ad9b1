"""Queries M8, M11-M17, M20-M21."""

from pyspark.sql import functions as F

from factorframe.functions.stats import sharpe
from factorframe.functions.windows import change, compounded
from factorframe.operators import estimate, ml, search
from factorframe.plans.catalog import query
from factorframe.plans.ols_sql import ols_sql
from factorframe.plans.q_estimate import FRAME, PANEL, _panel, frame


@query("m08_sequences", "ret", """SELECT symbol, date, sequence, target FROM (SELECT symbol, date, list([a, b]) OVER (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING) AS sequence,
    lead(a) OVER (PARTITION BY symbol ORDER BY date) AS target FROM (SELECT symbol, date, round(r + 1.7e-11, 8) AS a, volume AS b FROM ret)) WHERE len(sequence) = 5 AND target IS NOT NULL""")
def _(p):
    a = p.ret.select("symbol", "date", F.round(F.col("r") + 1.7e-11, 8).alias("a"), F.col("volume").alias("b"))
    a = a.withColumn("next", F.lead("a").over(estimate.ordered()))
    return ml.sequences(a, ["a", "b"], "next", 5)


def _train(p):
    return _panel(p).where("y is not null").withColumnRenamed("y", "target").withColumn("target", F.col("target") * 100)


@query("m11_boosted_trees", "ret", f"SELECT count(*) AS n, count(*) AS predicted, true AS learns FROM {PANEL} WHERE y IS NOT NULL")
def _(p):
    """Every row gets a prediction, and on the rows it was fitted on the error is not above that of their mean."""
    feats = ["mom", "vol"]
    df = _train(p)
    model = ml.boosted_trees(df.where("date < '2000-01-01'"), feats, trees=5)
    fitted = lambda x: F.when(F.col("date") < "2000-01-01", x)
    error = F.avg(fitted((F.col("target") - F.col("prediction")) ** 2))
    return ml.score_trees(model, df, feats).agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("predicted"),
                                                (error <= F.var_pop(fitted(F.col("target")))).alias("learns"))


@query("m11_tree_importance", "", "SELECT CAST(2 AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total, true AS shares", "total:6")
def _(p):
    feats = ["mom", "vol"]
    got = ml.tree_importance(p.spark, ml.boosted_trees(_train(p), feats, trees=5), feats)
    return got.agg(F.count(F.lit(1)).alias("features"), F.sum("importance").alias("total"), F.min(F.col("importance").between(0, 1)).alias("shares"))


@query("m12_training_frame", "bars ret", """SELECT b.date, b.symbol, mom, r FROM (SELECT symbol, date, tanh(close / lag(close, 21) OVER (PARTITION BY symbol ORDER BY date) - 1) AS mom FROM bars) b
    JOIN ret r ON b.symbol = r.symbol AND b.date = r.date WHERE mom IS NOT NULL AND b.date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""", "mom:7 r:8")
def _(p):
    feats = p.bars.select("date", "symbol", F.tanh(change("close", 21)).alias("mom"))
    return ml.training_frame(feats, p.ret.select("date", "symbol", "r"), ["mom"], "1996-01-01", "1999-12-31")


IDX = "(SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"


def split_sql(folds, a, b, s, e):
    return f"""SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN idx >= {a} AND idx < {b} THEN 'train' ELSE 'test' END AS role, date
    FROM {IDX}, (SELECT unnest(range({folds})) AS fold) WHERE {b} - {a} >= 10 AND ((idx >= {a} AND idx < {b}) OR (idx >= {s} AND idx < {e}))"""


PURGED = split_sql(5, "0", "(fold + 1) * (n // 6) - 7", "(fold + 1) * (n // 6)", "least((fold + 2) * (n // 6), n)")


@query("m13_purged_split", "bars", PURGED)
def _(p):
    return ml.purged_split(ml.date_index(p.bars))


@query("m14_expanding_split", "bars", "SELECT * FROM (" + split_sql(
    5, "0", "CAST(floor(n * 0.5) AS BIGINT) + fold * CAST(floor(n * 0.2) AS BIGINT)", "CAST(floor(n * 0.5) AS BIGINT) + fold * CAST(floor(n * 0.2) AS BIGINT) + 5",
    "least(CAST(floor(n * 0.5) AS BIGINT) + (fold + 1) * CAST(floor(n * 0.2) AS BIGINT) + 5, n)")
    + ") WHERE fold IN (SELECT fold FROM (SELECT unnest(range(5)) AS fold), (SELECT count(DISTINCT date) AS n FROM bars) WHERE floor(n * 0.5) + fold * floor(n * 0.2) + 5 < n)")
def _(p):
    return ml.expanding_split(ml.date_index(p.bars))


@query("m14_walk_forward_split", "bars", f"""SELECT CAST(fold AS INTEGER) AS fold, role, min(date) AS start, max(date) AS "end", count(*) AS n_dates FROM
    (SELECT fold, date, CASE WHEN idx < fold * 21 + 252 THEN 'train' ELSE 'test' END AS role FROM {IDX} JOIN (SELECT unnest(range(1000)) AS fold) f
     ON (idx BETWEEN fold * 21 AND fold * 21 + 251 OR idx BETWEEN fold * 21 + 257 AND fold * 21 + 277)
     AND fold < (n - 257) // 21 AND fold * 21 + 278 <= n) GROUP BY 1, 2""")
def _(p):
    return ml.fold_ranges(ml.walk_forward_split(ml.date_index(p.bars)))


@query("m14_business_day_split", "bars", """WITH r AS (SELECT min(date) AS a, max(date) AS b FROM bars), d AS (SELECT CAST(x AS DATE) AS date FROM
    (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS x FROM r) WHERE isodow(x) < 6)
    SELECT fold, role, min(date) AS start, max(date) AS "end", count(*) AS n_dates FROM (""" + PURGED.replace("SELECT DISTINCT date FROM bars", "SELECT date FROM d") + ") GROUP BY 1, 2")
def _(p):
    span = p.bars.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("date")).where(F.weekday("date") < 5)
    return ml.fold_ranges(ml.purged_split(ml.date_index(days)))


XS = ["MKT", "SMB"]
CVFIT = ols_sql(f"(SELECT f.fold, x.* FROM {FRAME} x JOIN ({PURGED}) f ON x.date = f.date WHERE role = 'train')", ["fold", "symbol"], XS, "y", ridge=0.001, min_rows=50)
CV = f"""(SELECT fold, count(*) AS n, 1 - avg(e * e) / var_pop(y) AS r2, avg(e * e) AS mse, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM
    (SELECT f.fold, y, y - (alpha + b_MKT * MKT + b_SMB * SMB) AS e FROM {FRAME} x JOIN ({PURGED}) f ON x.date = f.date AND role = 'test'
     JOIN ({CVFIT}) m ON m.fold = f.fold AND m.symbol = x.symbol) GROUP BY 1)"""


def _cv(p, ridges):
    return ml.cross_validate(frame(p, XS), ml.purged_split(ml.date_index(p.bars)), XS, ridges=ridges)


@query("m15_cross_validate", "bars ret factors", f"SELECT CAST(0.001 AS DOUBLE) AS ridge, fold, n, r2, mse * 1e4 AS mse, mae, rmse FROM {CV}", "r2:6 mse:6 mae:8 rmse:8")
def _(p):
    return _cv(p, [0.001]).withColumn("mse", F.col("mse") * 1e4).drop("mape")


@query("m15_validation_summary", "bars ret factors", f"SELECT CAST(0.001 AS DOUBLE) AS ridge, avg(r2) AS mean_score, stddev_samp(r2) AS std_score, count(*) AS folds FROM {CV}", "mean_score:6 std_score:6")
def _(p):
    return ml.validation_summary(_cv(p, [0.001]))


@query("m16_regression_metrics", "preds", """SELECT model_id, count(*) AS n, 1 - avg(e * e) / var_pop(actual) AS r2, avg(e * e) AS mse, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
    CASE WHEN min(abs(actual)) > 0 THEN avg(abs(e / nullif(actual, 0))) END AS mape FROM (SELECT *, actual - prediction AS e FROM preds WHERE actual IS NOT NULL) GROUP BY 1""",
       "r2:6 mse:4 mae:5 rmse:5 mape:4")
def _(p):
    return ml.regression_metrics(p.preds, ["model_id"], "actual")


@query("m16_classification_metrics", "", """WITH x AS (SELECT source, quality AS y, 1 - toxic AS p FROM labels JOIN documents USING (doc_id)),
    k AS (SELECT source, c, count(*) FILTER (y = c) AS sup, count(*) FILTER (p = c) AS pred, count(*) FILTER (y = c AND p = c) AS hit FROM x, (SELECT unnest([0, 1]) AS c) GROUP BY 1, 2)
    SELECT source, sum(hit) / sum(sup) AS accuracy, sum(coalesce(hit / nullif(pred, 0), 0) * sup) / sum(sup) AS precision, sum(coalesce(hit / nullif(sup, 0), 0) * sup) / sum(sup) AS recall,
    sum(coalesce(2 * hit / nullif(pred + sup, 0), 0) * sup) / sum(sup) AS f1 FROM k GROUP BY 1""", "accuracy:8 precision:8 recall:8 f1:8")
def _(p):
    x = p.table("labels").join(p.table("documents").select("doc_id", "source"), "doc_id")
    return ml.classification_metrics(x.select("source", F.col("quality").alias("y"), (1 - F.col("toxic")).alias("prediction")), ["source"])


@query("m17_parameter_search", "bars ret factors", f"SELECT ridge, avg(r2) AS mean_score, stddev_samp(r2) AS std_score, count(*) AS folds FROM (" + " UNION ALL ".join(
    f"SELECT CAST({lam} AS DOUBLE) AS ridge, r2 FROM {CV.replace('0.001 / n', f'{lam} / n')}" for lam in (0.001, 0.1, 10.0)) + ") GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2", "mean_score:6 std_score:6")
def _(p):
    return ml.best_parameters(_cv(p, [0.001, 0.1, 10.0]), n=2)

TRIALS, FOLDS, SEED = 16, 5, 11


def _space_sql(space, trials):
    """Points of ``search.points`` in SQL."""
    u = lambda n: f"(CAST(('0x' || substr(md5('{SEED}:' || trial || ':{n}'), 1, 13)) AS BIGINT) / pow(16, 13))"
    kinds = {"log": lambda n, a, b: f"exp(ln({a!r}) + {u(n)} * (ln({b!r}) - ln({a!r})))", "int": lambda n, a, b: f"CAST({a} + floor({u(n)} * {b - a + 1}) AS INTEGER)",
             "choice": lambda n, v: f"({[str(x).lower() for x in v]})[CAST(floor({u(n)} * {len(v)}) AS INTEGER) + 1] = 'true'"}
    return f"SELECT CAST(trial AS INTEGER) AS trial, {', '.join(f'{kinds[s[0]](n, *s[1:])} AS {n}' for n, s in space.items())} FROM range({trials}) t(trial)"


def _halving_sql(n, folds):
    """Rungs over s(trial, fold, r2) and pts."""
    out, alive = [], "SELECT trial FROM pts"
    for rung, upto in enumerate(search.budgets(folds)):
        keep = 1 if upto == folds else -(-n // 2)
        out.append(f"""g{rung} AS (SELECT {rung} AS rung, {upto} AS folds, trial, m AS mean_score, row_number() OVER (ORDER BY m DESC NULLS LAST, trial) AS place FROM
          (SELECT trial, CASE WHEN count(r2) = {upto} THEN avg(r2) END AS m FROM ({alive}) LEFT JOIN (SELECT * FROM s WHERE fold < {upto}) USING (trial) GROUP BY 1))""")
        alive, n = f"SELECT trial FROM g{rung} WHERE place <= {keep}", keep
    keeps, n = [], TRIALS
    for rung, upto in enumerate(search.budgets(folds)):
        n = 1 if upto == folds else -(-n // 2)
        keeps.append(f"SELECT *, place <= {n} AS kept FROM g{rung}")
    return ", ".join(out), " UNION ALL ".join(keeps)


RUNGS, ALL_RUNGS = _halving_sql(TRIALS, FOLDS)
SEARCH = f"""WITH f AS (SELECT p.fold, p.role, x.* FROM {FRAME} x JOIN ({PURGED}) p ON x.date = p.date WHERE y IS NOT NULL AND MKT IS NOT NULL AND SMB IS NOT NULL),
    pts AS ({_space_sql(search.LINEAR, TRIALS)}),
    m AS (SELECT fold, symbol, count(*) AS n, avg(y) AS my, avg(MKT) AS m1, avg(SMB) AS m2, var_pop(MKT) AS s11, var_pop(SMB) AS s22, covar_pop(MKT, SMB) AS s12,
      covar_pop(MKT, y) AS y1, covar_pop(SMB, y) AS y2 FROM f WHERE role = 'train' GROUP BY 1, 2 HAVING count(*) >= 50),
    a AS (SELECT *, s11 + ridge / n * CASE WHEN scaled THEN s11 ELSE 1 END AS a1, s22 + ridge / n * CASE WHEN scaled THEN s22 ELSE 1 END AS a2, CASE WHEN factors = 2 THEN s12 ELSE 0 END AS a12 FROM m, pts),
    b AS (SELECT fold, symbol, trial, my, m1, m2, CASE WHEN factors = 2 THEN (y1 * a2 - a12 * y2) / (a1 * a2 - a12 * a12) ELSE y1 / a1 END AS b1,
      CASE WHEN factors = 2 THEN (a1 * y2 - a12 * y1) / (a1 * a2 - a12 * a12) ELSE 0 END AS b2 FROM a),
    s AS (SELECT trial, fold, 1 - avg(pow(y - (my + b1 * (MKT - m1) + b2 * (SMB - m2)), 2)) / var_pop(y) AS r2 FROM f JOIN b USING (fold, symbol) WHERE role = 'test' GROUP BY 1, 2), {RUNGS}
    SELECT CAST(rung AS INTEGER) AS rung, CAST(folds AS INTEGER) AS folds, trial, ridge, scaled, factors, mean_score, CAST(place AS INTEGER) AS place, kept FROM ({ALL_RUNGS}) JOIN pts USING (trial)"""


@query("m17_halving_search", "bars ret factors", SEARCH, "ridge:6 mean_score:6")
def _(p):
    pts = search.points(p.spark, search.LINEAR, TRIALS, SEED)
    return search.linear_search(frame(p, XS), ml.purged_split(ml.date_index(p.bars)), XS, pts, FOLDS)


@query("m17_tree_search")
def _(p):
    """Two rungs over four points of a small space; trees are fitted again only for the better two."""
    space = {"trees": ("int", 2, 5), "depth": ("int", 1, 3), "rate": ("log", 0.05, 0.5)}
    return search.tree_search(_train(p), ml.purged_split(ml.date_index(p.bars), folds=2), ["mom", "vol"], search.points(p.spark, space, 4, SEED), 2)


RES = """(SELECT symbol AS model, (avg(r) - (pow(1.02, 1.0 / 252) - 1)) / stddev_samp(r) * sqrt(252) AS sharpe_ratio, exp(sum(ln(1 + r))) - 1 AS total_return FROM ret GROUP BY 1)"""


def _results(p):
    return p.ret.groupBy(F.col("symbol").alias("model")).agg(sharpe("r").alias("sharpe_ratio"), (compounded("r", None) - 1).alias("total_return"))


@query("m20_compare", "ret", f"SELECT model, sharpe_ratio, sharpe_ratio - (SELECT max(sharpe_ratio) FROM {RES}) AS gap_to_best FROM {RES} ORDER BY 2 DESC, 1 LIMIT 10", "sharpe_ratio:6 gap_to_best:6")
def _(p):
    return ml.compare(_results(p), "sharpe_ratio").drop("total_return")


@query("m21_model_summary", "ret", f"""SELECT count(*) AS total_models, arg_max(model, sharpe_ratio) AS best_model, avg(sharpe_ratio) AS avg_sharpe_ratio, max(sharpe_ratio) AS best_sharpe_ratio,
    avg(total_return) AS avg_total_return, max(total_return) AS best_total_return FROM {RES}""", "avg_sharpe_ratio:6 best_sharpe_ratio:6 avg_total_return:4 best_total_return:4")
def _(p):
    return ml.model_summary(_results(p))


META = "(SELECT (avg(m) - (pow(1.02, 1.0 / 252) - 1)) / stddev_samp(m) * sqrt(252) AS meta_sharpe FROM (SELECT avg(r) AS m FROM ret GROUP BY date))"


@query("m21_meta_against_base", "ret", f"SELECT model, sharpe_ratio, meta_sharpe, meta_sharpe - sharpe_ratio AS improvement FROM {RES}, {META}", "sharpe_ratio:6 meta_sharpe:6 improvement:6")
def _(p):
    meta = p.ret.groupBy("date").agg(F.avg("r").alias("r")).agg(sharpe("r").alias("sharpe_ratio"))
    return ml.meta_against_base(meta, _results(p))


@query("m21_system_verdict", "ret", f"""SELECT model, sharpe_ratio, max_drawdown, sharpe_ratio >= 0.5 AS meets_sharpe, max_drawdown >= -0.3 AS meets_drawdown,
    sharpe_ratio >= 0.5 AND max_drawdown >= -0.3 AS valid FROM (SELECT model, sharpe_ratio, least(0, total_return) AS max_drawdown FROM {RES})""", "sharpe_ratio:6 max_drawdown:4")
def _(p):
    worst = _results(p).withColumn("max_drawdown", F.least(F.lit(0.0), F.col("total_return")))
    return ml.system_verdict(worst)
