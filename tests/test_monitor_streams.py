"""Streams of the prediction monitor: late rows, silence, unmatched rows, bounded state."""

import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorframe.streaming import monitor
from factorframe.streaming.replay import replay

DAY0 = dt.datetime(2024, 1, 1)
PREDICTIONS = "prediction_id long, model_id string, ts timestamp, prediction double, actual double"


def at(day):
    return DAY0 + dt.timedelta(day)


def log(n=600, days=40, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = float(rng.normal(1000, 1))
        rows.append((i, f"m{i % 3}", at(float(rng.uniform(0, days))), x, None if rng.random() < 0.3 else x + float(rng.normal(0, 1))))
    return rows


def collected(stream, **options):
    """Rows that a stream appends, and the progress of its query."""
    rows, writer = [], stream.writeStream.outputMode("append").trigger(availableNow=True)
    q = writer.foreachBatch(lambda df, _: rows.extend(df.collect())).start()
    q.awaitTermination()
    return rows, [json.loads(p.json) for p in q.recentProgress]


def test_sliding_windows_against_pandas(spark):
    rows = log()
    pdf = pd.DataFrame(rows, columns=["prediction_id", "model_id", "ts", "prediction", "actual"])
    got = {(r.window_start, r.model_id): r for r in monitor.window_performance(spark.createDataFrame(rows, PREDICTIONS), "10 days", "1 day").collect()}
    for start in range(-9, 40):
        for m in ("m0", "m1", "m2"):
            own = pdf[(pdf.model_id == m) & (pdf.ts >= at(start)) & (pdf.ts < at(start + 10))]
            if not len(own):
                assert (at(start), m) not in got
                continue
            r, known = got[at(start), m], own.dropna()
            assert (r.predictions, r.with_actual) == (len(own), len(known))
            if len(known) > 2:
                e = known.prediction - known.actual
                assert r.mae == pytest.approx(e.abs().mean()) and r.rmse == pytest.approx((e ** 2).mean() ** 0.5)
                assert r.correlation == pytest.approx(known.prediction.corr(known.actual), abs=1e-6)


def test_correlation_of_constants_is_null(spark):
    rows = [(i, "m", at(i % 5), 0.1, float(i)) for i in range(30)] + [(99, "n", at(0), 1.0, 2.0)]
    for r in monitor.window_performance(spark.createDataFrame(rows, PREDICTIONS), "10 days").collect():
        assert r.correlation is None


def test_window_stream_appends_what_the_batch_gives_and_forgets(spark):
    """A long stream holds the panes and windows of its lateness, not its history."""
    df = spark.createDataFrame(log(900, 90), PREDICTIONS)
    figures = lambda x: monitor.window_performance(x, "5 days", "1 day", late_days=8)
    stream = figures(replay(df, "ts", {"prediction_id": -1, "model_id": ""}, F.col("prediction_id") % 9 == 0, 8 + 4, slices=18, files=1))
    rows, progress = collected(stream)
    close = lambda rs: {(r.window_start, r.model_id): (r.predictions, round(r.mae or 0, 6)) for r in rs}
    assert close(rows) == close(figures(df).collect())
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress if p["stateOperators"]]
    assert max(held) <= 3 * ((5 + 5 + 8 + 2) + (5 + 5 + 8 + 5 + 2)) + 12  # models x (open days + open windows); all 90 days are 270 panes


def test_unmatched_predictions_come_when_their_time_is_over(spark):
    left = spark.createDataFrame([(1, at(0.5), 1.0), (2, at(1), 2.0), (3, at(8), 3.0), (4, at(9), 4.0)], "prediction_id long, ts timestamp, prediction double")
    right = spark.createDataFrame([(1, 10.0, at(2)), (1, 11.0, at(2.5)), (2, 20.0, at(7)), (4, 40.0, at(9.5)), (7, 70.0, at(9))], "prediction_id long, actual double, actual_ts timestamp")
    late = F.col("prediction_id") == 1
    stream = monitor.with_actuals(replay(left, "ts", {"prediction_id": -1}, late, 25), replay(right, "actual_ts", {"prediction_id": -2}, late, 25), 5, late_days=10)
    rows, _ = collected(stream)
    want = {(1, 10.0), (2, None), (3, None), (4, 40.0)}  # the update of 2 came after its five days
    assert {(r.prediction_id, r.actual) for r in rows} == want and len(rows) == 4
    assert {(r.prediction_id, r.actual) for r in monitor.with_actuals(left, right, 5).collect()} == want


def test_histogram_drift_bounds_the_exact_one(spark):
    rng = np.random.default_rng(3)
    rows = []
    for name, shift in (("same", 0.0), ("moved", 0.4), ("tied", 0.0), ("constant", 0.0), ("empty", 0.0)):
        for part, n in (("ref", 500), ("cur", 300)):
            x = rng.normal(shift if part == "cur" else 0.0, 1.0, n)
            x = np.round(x) if name == "tied" else x * 0 + 5 if name == "constant" else x
            rows += [(part, name, at(i % 3), None if name == "empty" or i % 50 == 7 else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "part string, feature string, ts timestamp, value double")
    ref, cur = df.where("part = 'ref'"), df.where("part = 'cur'")
    exact = {r.feature: r for r in monitor.drift(ref, cur).collect()}
    held = monitor.drift_reference(ref)
    batch = {r.feature: r for r in monitor.windowed_drift(cur, held, "30 days").collect()}
    assert set(batch) == set(exact) == {"same", "moved", "tied", "constant"}
    for f, r in batch.items():
        e = exact[f]
        assert r.ks_statistic - 1e-9 <= e.ks_statistic <= r.ks_statistic + r.ks_bound + 1e-9
        assert (r.n_reference, r.n_current) == (e.n_reference, e.n_current) and r.psi == pytest.approx(e.psi, abs=1e-9)
    assert batch["moved"].drift_detected and batch["constant"].ks_statistic == 0
    stream = replay(cur.select("ts", "feature", "value"), "ts", {"feature": "", "value": 0.0}, F.col("value") > 1, 60)
    rows, _ = collected(monitor.windowed_drift(stream, held, "30 days", late_days=3))
    assert {r.feature: tuple(r) for r in rows} == {f: tuple(r) for f, r in batch.items()}


def test_silence_is_reported_by_timer(spark):
    rows = [("a", at(d + h / 24), 1.0 if d != 2 else None) for d in (0, 1, 2, 6) for h in range(3)] + [("b", at(3.5), 1.0)]
    rows += [("a", at(1.2), None)] * 30  # arrive late: day 1 has 3 answers of 33, under a tenth
    df = spark.createDataFrame(rows, "model_id string, ts timestamp, actual double")
    late = F.col("actual").isNull() & (F.to_date("ts") == F.lit("2024-01-02").cast("date"))
    out, _ = collected(monitor.running_health(replay(df, "ts", {"model_id": ""}, late, 5, slices=2), late_days=5))
    got = {(r.model_id, (r.day - DAY0.date()).days): (r.status, r.changed) for r in out}
    healthy, warning = "healthy", "warning"
    assert got == {("a", 0): (healthy, False), ("a", 1): (warning, True), ("a", 2): (warning, False), ("a", 3): (warning, False), ("a", 4): (warning, False),
                   ("a", 5): (warning, False), ("a", 6): (healthy, True), ("b", 3): (healthy, False), ("b", 4): (warning, True), ("b", 5): (warning, False),
                   ("b", 6): (warning, False)}


def test_health_of_many_models_is_kept_by_bucket(spark):
    """Against the batch from each model's first day on: one state row a bucket, not a model; models change buckets' clocks apart."""
    rng = np.random.default_rng(4)
    rows = [(f"m{i % 400}", at(float(rng.uniform(i % 9, 12))), None if rng.random() < 0.6 else 1.0) for i in range(1500)]
    df = spark.createDataFrame(rows, "model_id string, ts timestamp, actual double")
    late = F.col("model_id").endswith("7")
    for buckets in (1, 7):
        out, progress = collected(monitor.running_health(replay(df, "ts", {"model_id": ""}, late, 13, slices=3), late_days=13, buckets=buckets))
        assert max(o["numRowsTotal"] for p in progress for o in p["stateOperators"]) <= buckets
        first = {}
        for m, t, _ in rows:
            first[m] = min(first.get(m, t.date()), t.date())
        want, before = {}, {}
        for r in sorted(monitor.daily_health(df).collect(), key=lambda r: (r.model_id, r.day)):
            if r.day >= first[r.model_id]:
                want[r.model_id, r.day] = (r.issues, r.status, before.get(r.model_id, r.status) != r.status)
                before[r.model_id] = r.status
        assert len(out) == len(want) and {(r.model_id, r.day): (r.issues, r.status, r.changed) for r in out} == want


def test_replay_of_an_empty_table(spark):
    df = spark.createDataFrame([], "model_id string, ts timestamp, actual double")
    assert collected(monitor.running_health(replay(df, "ts", {"model_id": ""}, F.lit(False), 5), 5))[0] == []
