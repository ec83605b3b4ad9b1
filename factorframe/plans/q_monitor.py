"""Queries L1-L9; those named stream run the same operator as a Structured Streaming job over what is there."""

from pyspark.sql import functions as F

from factorframe.plans.catalog import query
from factorframe.sources import store
from factorframe.streaming import ingest, monitor as l
from factorframe.streaming.replay import replay
from factorframe.streaming.storage import work_path


def _features(df, value="value"):
    return df.withColumn("features", F.create_map(F.lit("value"), F.col(value), F.lit("hour"), F.hour("ts").cast("double"),
                                                  F.lit("gap"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 10 + 0.0)))


def _events(p):
    return p.table("events").select("event_id", "ts", F.col("event_type").alias("model_id"), "value")


LATE = 20  # days a row may be late: slices of the test month are 15 days long, and one row in 20 comes a slice after its own


def _event_stream(p):
    """Events as a stream in two slices, some late."""
    return replay(_events(p), "ts", {"event_id": -1, "model_id": "", "value": 0.0}, F.col("event_id") % 20 == 0, LATE)


LOG = "SELECT event_id, model_id, prediction FROM (SELECT event_id, event_type AS model_id, value AS prediction FROM events)"


KEPT = f"{LOG} WHERE event_id IN (SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY)"


def _log(df, days=10):
    return l.prediction_log(df.withColumnRenamed("event_id", "prediction_id"), days).select(
        F.col("prediction_id").alias("event_id"), "model_id", F.col("value").alias("prediction"))


@query("l01_prediction_log", "", KEPT)
def _(p):
    return _log(_events(p))


# Every tenth row comes twice, every twentieth two slices late.  A batch drops what is older than the watermark of the batch before the last.
@query("l01_stream_prediction_log", "", f"""WITH x AS (SELECT event_id, epoch_us(ts) AS us, CASE WHEN event_id % 20 = 0 THEN 2 ELSE 0 END AS late FROM events),
    b AS (SELECT min(us) AS a, (max(us) - min(us)) // 6 + 1 AS width FROM x), t AS (SELECT x.*, least((us - a) // width + late, 5) AS turn FROM x, b),
    m AS (SELECT turn + 2 AS turn, max(max(us) // 1000 * 1000 - 259200000000) OVER (ORDER BY turn) AS mark FROM t GROUP BY t.turn)
    {LOG} WHERE event_id IN (SELECT event_id FROM t LEFT JOIN m USING (turn) WHERE mark IS NULL OR us > mark)""")
def _(p):
    twice = _events(p).unionByName(_events(p).where("event_id % 10 = 3"))
    stream = replay(twice, "ts", {"event_id": -1, "model_id": "", "value": 0.0}, F.when(F.col("event_id") % 20 == 0, 2), 3, slices=6)
    return l.run_available(_log(stream, 3)).where("event_id >= 0")


MATCH = "SELECT prediction_id, model_id, prediction, CASE WHEN actual_ts <= ts + INTERVAL 5 DAY THEN actual END AS actual FROM preds"


@query("l02_with_actuals", "preds", MATCH)
def _(p):
    left = p.preds.select("prediction_id", "model_id", "ts", "prediction")
    right = p.preds.where("actual is not null").select("prediction_id", "actual", "actual_ts")
    return l.with_actuals(left, right, 5).select("prediction_id", "model_id", "prediction", "actual")


@query("l02_stream_with_actuals", "preds", MATCH)
def _(p):
    left = replay(p.preds.select("prediction_id", "model_id", "ts", "prediction"), "ts", {"prediction_id": -1}, F.col("prediction_id") % 20 == 0, LATE + 5)
    right = replay(p.preds.where("actual is not null").select("prediction_id", "actual", "actual_ts"), "actual_ts", {"prediction_id": -2, "actual": 0.0},
                   F.col("prediction_id") % 20 == 1, LATE + 5)
    return l.run_available(l.with_actuals(left, right, 5, late_days=LATE).select("prediction_id", "model_id", "prediction", "actual")).where("prediction_id >= 0")


PERF = """(SELECT CAST(d AS DATE) AS start_day, model_id, count(*) AS predictions, count(actual) AS with_actual, avg(abs(p - actual)) AS mae, sqrt(avg(pow(p - actual, 2))) AS rmse, corr(p, actual) AS correlation,
    avg(((p > 0) = (actual > 0))::INT) AS directional_accuracy, count(actual) / count(*) AS feedback_rate FROM
    (SELECT *, CASE WHEN actual IS NOT NULL THEN prediction END AS p, unnest(generate_series(date_trunc('day', ts) - INTERVAL 29 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS d FROM preds) GROUP BY 1, 2)"""
PDG = "mae:5 rmse:5 correlation:6 directional_accuracy:6 feedback_rate:6"


def _perf(df):
    out = l.window_performance(df, late_days=LATE)
    return out.select(F.to_date("window_start").alias("start_day"), *[x for x in out.columns if not x.startswith("window_")])


@query("l03_sliding_performance", "preds", f"SELECT * FROM {PERF}", PDG)
def _(p):
    return _perf(p.preds)


def _pred_stream(p, beyond=0):
    return replay(p.preds, "ts", {"prediction_id": -1, "model_id": ""}, F.col("prediction_id") % 20 == 0, LATE + beyond)


@query("l03_stream_sliding_performance", "preds", f"SELECT * FROM {PERF}", PDG)
def _(p):
    return l.run_available(_perf(_pred_stream(p, 29)))  # the last window ends 29 days after the last row


DAILY = "SELECT CAST(ts AS DATE) AS day, event_type AS model_id, count(*) AS predictions FROM events GROUP BY 1, 2"


@query("l04_daily_counts", "", DAILY)
def _(p):
    return l.daily_counts(_events(p))


@query("l04_stream_daily_counts", "", DAILY)
def _(p):
    return l.run_available(l.daily_counts(_event_stream(p), LATE))


FST = """WITH x AS (SELECT event_type AS model_id, CAST(epoch_us(ts) // 2592000000000 AS BIGINT) AS w, unnest(['value', 'hour', 'gap']) AS feature,
      unnest([value, hour(ts), CASE WHEN event_id % 7 > 0 THEN event_id % 10 END]) AS v FROM events)
    SELECT w, model_id, feature, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lowest, max(v) AS highest, avg((v IS NULL)::INT) AS missing_rate FROM x GROUP BY 1, 2, 3"""
FDG = "mean:6 std:6 lowest:4 highest:4 missing_rate:6"


def _fstats(df):
    out = l.feature_statistics(_features(df), late_days=LATE)
    w = F.floor(F.unix_timestamp(F.col("window_start").cast("timestamp")) / 2592000).alias("w")
    return out.select(w, *[x for x in out.columns if x != "window_start"])


@query("l05_feature_statistics", "", FST, FDG)
def _(p):
    return _fstats(_events(p))


@query("l05_stream_feature_statistics", "", FST, FDG)
def _(p):
    stream = replay(_events(p), "ts", {"event_id": -1, "model_id": "", "value": 0.0}, F.col("event_id") % 20 == 0, LATE + 30)  # to the end of a window of 30 days
    return l.run_available(_fstats(stream))


BASE = "(SELECT model_id, avg(abs(prediction - actual)) AS mae, corr(prediction, actual) AS correlation FROM preds WHERE actual IS NOT NULL AND ts < TIMESTAMP '2024-01-08' GROUP BY 1)"
DEG = f"""SELECT start_day, model_id, metric, cur AS current, base AS baseline, change AS relative_change, change > 0.2 AS degraded FROM
    (SELECT p.start_day, p.model_id, 'mae' AS metric, p.mae AS cur, b.mae AS base, (p.mae - b.mae) / b.mae AS change FROM {PERF} p JOIN {BASE} b ON p.model_id = b.model_id
     UNION ALL SELECT p.start_day, p.model_id, 'correlation', p.correlation, b.correlation, abs(p.correlation - b.correlation) / abs(b.correlation) FROM {PERF} p JOIN {BASE} b ON p.model_id = b.model_id)"""


def _baseline(p):
    ok = p.preds.where("actual is not null and ts < timestamp_ntz '2024-01-08'")
    wide = ok.groupBy("model_id").agg(F.avg(F.abs(F.col("prediction") - F.col("actual"))).alias("mae"), F.corr("prediction", "actual").alias("correlation"))
    return wide.unpivot(["model_id"], ["mae", "correlation"], "metric", "baseline")


@query("l06_degradation", "preds", DEG, "current:5 baseline:5 relative_change:5")
def _(p):
    out = l.degradation(l.window_performance(p.preds), _baseline(p), ["mae", "correlation"])
    return out.select(F.to_date("window_start").alias("start_day"), "model_id", "metric", "current", "baseline", "relative_change", "degraded")


REFCUR = "(SELECT event_type AS feature, value, CAST(ts AS DATE) <= DATE '2024-01-15' AS ref FROM events)"


DRIFT = f"""WITH x AS (SELECT * FROM {REFCUR}), v AS (SELECT feature, value, sum(ref::INT) AS a, sum((NOT ref)::INT) AS b FROM x GROUP BY 1, 2),
    k AS (SELECT feature, max(abs(ca / na - cb / nb)) AS ks_statistic, CAST(max(na) AS BIGINT) AS n_reference, CAST(max(nb) AS BIGINT) AS n_current FROM
      (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb FROM v WINDOW w AS (PARTITION BY feature ORDER BY value)) GROUP BY 1),
    s AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM x WHERE ref GROUP BY 1),
    g AS (SELECT s.feature, i AS bin, count(*) FILTER (ref) AS a, count(*) FILTER (NOT ref) AS b FROM s CROSS JOIN (SELECT unnest(range(10)) AS i)
      LEFT JOIN x ON x.feature = s.feature AND value BETWEEN lo AND hi AND greatest(ceil(round((value - lo) / ((hi - lo) / 10), 9)) - 1, 0) = i GROUP BY 1, 2),
    h AS (SELECT feature, CASE WHEN a > 0 THEN a / sum(a) OVER (PARTITION BY feature) ELSE 0.0001 END AS ra, CASE WHEN b > 0 THEN b / sum(b) OVER (PARTITION BY feature) ELSE 0.0001 END AS rb, a FROM
      (SELECT feature, bin, CASE WHEN a + b = 0 THEN 0 ELSE a END AS a, CASE WHEN a + b = 0 THEN 0 ELSE b END AS b FROM
        (SELECT s.feature, r.i AS bin, (SELECT count(*) FROM x WHERE x.feature = s.feature AND ref AND greatest(ceil(round((value - lo) / ((hi - lo) / 10), 9)) - 1, 0) = r.i AND value BETWEEN lo AND hi) AS a,
          (SELECT count(*) FROM x WHERE x.feature = s.feature AND NOT ref AND greatest(ceil(round((value - lo) / ((hi - lo) / 10), 9)) - 1, 0) = r.i AND value BETWEEN lo AND hi) AS b FROM s, (SELECT unnest(range(10)) AS i) r)))
    SELECT feature, ks_statistic, n_reference, n_current, psi FROM k JOIN (SELECT feature, sum((rb - ra) * ln(rb / ra)) AS psi FROM h GROUP BY 1) USING (feature)"""


@query("l07_drift", "", DRIFT,
       "ks_statistic:7 psi:6")
def _(p):
    e = p.table("events").select(F.col("event_type").alias("feature"), "value", (F.to_date("ts") <= F.lit("2024-01-15").cast("date")).alias("ref"))
    return l.drift(e.where("ref"), e.where("not ref")).drop("ks_pvalue", "drift_detected")


def p_sql(d, n, m):
    """p-value of the two-sample statistic in SQL: 40 terms of Kolmogorov's series."""
    lam2 = f"(pow({d}, 2) * {n} * {m} / ({n} + {m}))"
    terms = " + ".join(f"{2.0 if k % 2 else -2.0} * exp({-2.0 * k * k} * {lam2})" for k in range(1, 41))
    return f"CASE WHEN {lam2} < 0.04 THEN 1.0 ELSE greatest(least({terms}, 1.0), 0.0) END"


P_DRIFT = p_sql("ks_statistic", "n_reference", "n_current")


@query("l07_drift_verdict", "", f"SELECT *, ks_pvalue < 0.05 OR psi > 0.1 AS drift_detected FROM (SELECT *, {P_DRIFT} AS ks_pvalue FROM ({DRIFT}))",
       "ks_statistic:7 psi:6 ks_pvalue:6")
def _(p):
    e = p.table("events").select(F.col("event_type").alias("feature"), "value", F.to_date("ts").alias("d"))
    return l.drift(e.where("d <= '2024-01-15'"), e.where("d > '2024-01-15'"))


CELL = "CASE WHEN value < lo THEN -1 WHEN value > hi THEN 320 ELSE greatest(ceil(round((value - lo) / ((hi - lo) / 10), 9) * 32) - 1, 0) END"
RUN = f"""WITH e AS (SELECT event_type AS feature, value, ts, CAST(epoch_us(ts) // 432000000000 AS BIGINT) AS w FROM events),
    s AS (SELECT feature, min(value) AS lo, max(value) AS hi, count(*) AS n_reference FROM e WHERE CAST(ts AS DATE) <= DATE '2024-01-15' GROUP BY 1),
    x AS (SELECT w, feature, n_reference, {CELL} AS cell, CAST(ts AS DATE) <= DATE '2024-01-15' AS ref FROM e JOIN s USING (feature)),
    a AS (SELECT feature, cell, count(*) AS n FROM x WHERE ref GROUP BY 1, 2), b AS (SELECT w, feature, cell, count(*) AS n FROM x GROUP BY 1, 2, 3),
    t AS (SELECT w, feature, CAST(sum(n) AS BIGINT) AS n_current FROM b GROUP BY 1, 2), g AS (SELECT t.*, s.n_reference, c.cell FROM t JOIN s USING (feature), (SELECT unnest(range(-1, 321)) AS cell) c),
    h AS (SELECT g.*, coalesce(a.n, 0) / n_reference AS pa, coalesce(b.n, 0) / n_current AS pb FROM g LEFT JOIN a ON a.feature = g.feature AND a.cell = g.cell
      LEFT JOIN b ON b.w = g.w AND b.feature = g.feature AND b.cell = g.cell),
    k AS (SELECT w, feature, n_reference, n_current, max(abs(d)) AS ks_statistic, max(greatest(pa, pb)) AS ks_bound FROM
      (SELECT *, sum(pa - pb) OVER (PARTITION BY w, feature ORDER BY cell) AS d FROM h) GROUP BY 1, 2, 3, 4),
    q AS (SELECT w, feature, cell // 32 AS bin, sum(pa) AS pa, sum(pb) AS pb FROM h WHERE cell BETWEEN 0 AND 319 GROUP BY 1, 2, 3),
    p AS (SELECT w, feature, sum((rb - ra) * ln(rb / ra)) AS psi FROM (SELECT w, feature, CASE WHEN pa > 0 THEN pa / sum(pa) OVER v ELSE 0.0001 END AS ra,
      CASE WHEN pb > 0 THEN pb / sum(pb) OVER v ELSE 0.0001 END AS rb FROM q WINDOW v AS (PARTITION BY w, feature)) GROUP BY 1, 2)
    SELECT *, ks_pvalue < 0.05 OR psi > 0.1 AS drift_detected FROM (SELECT *, {P_DRIFT} AS ks_pvalue FROM k JOIN p USING (w, feature))"""
RUN_DIGITS = "ks_statistic:7 ks_bound:7 psi:6 ks_pvalue:6"


def _running_drift(p, stream):
    e = p.table("events").select(F.col("event_type").alias("feature"), "value", F.to_date("ts").alias("d"))
    current = stream.select("ts", F.col("model_id").alias("feature"), "value")
    out = l.windowed_drift(current, l.drift_reference(e.where("d <= '2024-01-15'")), "5 days", LATE)
    return out


def _by_window(out):
    w = F.floor(F.unix_timestamp(F.col("window_start").cast("timestamp")) / 432000).alias("w")
    return out.select(w, *[x for x in out.columns if x != "window_start"])


@query("l07_windowed_drift", "", RUN, RUN_DIGITS)
def _(p):
    return _by_window(_running_drift(p, _events(p)))


@query("l07_stream_drift", "", RUN, RUN_DIGITS)
def _(p):
    stream = replay(_events(p), "ts", {"event_id": -1, "model_id": "", "value": 0.0}, F.col("event_id") % 20 == 0, LATE + 5)
    return _by_window(l.run_available(_running_drift(p, stream)))


HEALTH = """SELECT model_id, day, issues, status, coalesce(status <> lag(status) OVER (PARTITION BY model_id ORDER BY day), false) AS changed FROM
    (SELECT model_id, day, issues, CASE WHEN issues = 0 THEN 'healthy' WHEN issues <= 3 THEN 'warning' ELSE 'critical' END AS status FROM
     (SELECT g.model_id, g.day, CAST((n IS NULL)::INT + coalesce((k / n < 0.1)::INT, 0) AS INTEGER) AS issues FROM
      (SELECT model_id, day FROM (SELECT DISTINCT user_id AS model_id FROM e), (SELECT DISTINCT CAST(ts AS DATE) AS day FROM e)) g
      LEFT JOIN (SELECT user_id AS model_id, CAST(ts AS DATE) AS day, count(*) AS n, count(CASE WHEN value > 20 THEN value END) AS k FROM e GROUP BY 1, 2) d ON g.model_id = d.model_id AND g.day = d.day))"""


def _user_log(p):
    return p.table("events").select(F.col("user_id").alias("model_id"), "ts", F.when(F.col("value") > 20, F.col("value")).alias("actual"))


@query("l08_daily_health", "", HEALTH.replace(" FROM e", " FROM events"))
def _(p):
    return l.daily_health(_user_log(p))


# from a model's first day on, every day of the calendar
RUNNING = """WITH d AS (SELECT user_id AS model_id, CAST(ts AS DATE) AS day, count(*) AS n, count(CASE WHEN value > 20 THEN value END) AS k FROM events GROUP BY 1, 2),
    g AS (SELECT model_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), (SELECT CAST(max(day) AS TIMESTAMP) FROM d), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1),
    i AS (SELECT g.model_id, g.day, CASE WHEN n IS NULL THEN 1 WHEN k / n < 0.1 THEN 1 ELSE 0 END AS issues FROM g LEFT JOIN d ON d.model_id = g.model_id AND d.day = g.day),
    h AS (SELECT model_id, day, issues, CASE WHEN issues = 0 THEN 'healthy' WHEN issues <= 3 THEN 'warning' ELSE 'critical' END AS status FROM i)
    SELECT *, coalesce(status <> lag(status) OVER (PARTITION BY model_id ORDER BY day), false) AS changed FROM h"""


def _running_health(p):
    log = _user_log(p).withColumn("event_id", F.xxhash64("model_id", "ts")).withColumn("model_id", F.col("model_id").cast("string"))
    stream = replay(log, "ts", {"model_id": ""}, F.col("event_id") % 20 == 0, LATE)
    return l.run_available(l.running_health(stream, LATE)).withColumn("model_id", F.col("model_id").cast("long"))


@query("l08_stream_health", "", RUNNING)
def _(p):
    return _running_health(p)


@query("l08_stream_status_changes", "", f"SELECT model_id, day, status FROM ({RUNNING}) WHERE changed")
def _(p):
    return _running_health(p).where("changed").select("model_id", "day", "status")


INGESTED = "SELECT symbol, date, close * CASE WHEN volume > 50 THEN 2 ELSE 1 END AS close, volume FROM bars"


def _ingested(p):
    """A store that a stream has filled: every bar once, those of large volume again with another price."""
    source, path = work_path(p.spark, "incoming"), work_path(p.spark, "store")
    stamp = lambda n: F.lit(n).cast("long").alias("load_ts")
    a = p.bars.select("symbol", "date", "close", "volume", stamp(1))
    b = p.bars.where("volume > 50").select("symbol", "date", (2 * F.col("close")).alias("close"), "volume", stamp(2))
    a.unionByName(b).write.parquet(source)
    s = p.spark.readStream.schema(p.spark.read.parquet(source).schema).option("maxFilesPerTrigger", "16").parquet(source)
    ingest.ingest(s, path).awaitTermination()
    return path


@query("l09_stream_ingest", "bars", INGESTED, "close:3")
def _(p):
    return store.read(p.spark, _ingested(p)).select("symbol", "date", "close", "volume")


@query("l09_compacted_store", "bars", INGESTED + " WHERE date BETWEEN DATE '1995-03-10' AND DATE '1997-02-20'", "close:3")
def _(p):
    path = _ingested(p)
    store.compact(p.spark, path)
    store.vacuum(p.spark, path)
    return store.read(p.spark, path, "1995-03-10", "1997-02-20").select("symbol", "date", "close", "volume")
