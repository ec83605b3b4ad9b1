"""Prediction monitoring (L1-L8).  Every function takes a batch or a streaming frame alike unless it says otherwise.

predictions(prediction_id, model_id, ts, prediction, actual[, features map])
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorframe.functions import ranks
from factorframe.functions.windows import c
from factorframe.streaming.storage import work_path

# fixed values
WINDOW_DAYS, DEGRADATION, DRIFT, MIN_SAMPLES, ALERTS, MIN_FEEDBACK = 30, 0.2, 0.1, 100, 3, 0.1


def prediction_log(predictions: DataFrame, days=2 * WINDOW_DAYS) -> DataFrame:
    """L1: the log of the last ``days`` before its newest row, one row an id.

    On a stream the state keeps ids for that long, and rows older than the watermark are dropped; a watermark
    alone would drop nothing.
    """
    if predictions.isStreaming:
        return predictions.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["prediction_id"])
    newest = predictions.agg(F.max("ts").alias("_newest"))  # one row
    kept = predictions.join(F.broadcast(newest), c("ts") >= c("_newest") - F.expr(f"interval {days} days")).drop("_newest")
    return kept.dropDuplicates(["prediction_id"])


def with_actuals(predictions: DataFrame, actuals: DataFrame, days=WINDOW_DAYS, how="left_outer", late_days=WINDOW_DAYS) -> DataFrame:
    """L2: actuals(prediction_id, actual, actual_ts) attached by id, the first update of an id counts.

    On streams this is a stream-stream join with a time bound; unmatched
    predictions appear once the watermark has passed.  ``late_days``: how late rows of either side may come.
    """
    left = predictions.withWatermark("ts", f"{late_days} days")
    right = actuals.select(c("prediction_id").alias("_id"), "actual", "actual_ts").withWatermark("actual_ts", f"{late_days} days")
    right = right.dropDuplicatesWithinWatermark(["_id"]) if actuals.isStreaming else right.groupBy("_id").agg(
        F.min_by("actual", "actual_ts").alias("actual"), F.min("actual_ts").alias("actual_ts"))
    bound = (c("prediction_id") == c("_id")) & (c("actual_ts") >= c("ts")) & (c("actual_ts") <= c("ts") + F.expr(f"interval {days} days"))
    return left.join(right, bound, how).drop("_id")


def _watermarked(df: DataFrame, late_days: int) -> DataFrame:
    return df.withWatermark("ts", f"{late_days} days") if df.isStreaming else df


def _paned(df: DataFrame, keys: list[str], slide: str, moments: list[Column], length: str, merged: list[Column]) -> DataFrame:
    """``merged`` moments per sliding window: rows are reduced to one pane a slide first, and only panes are copied to the
    windows that hold them.  On a stream both steps keep open panes and windows only and append what the watermark closes."""
    panes = df.groupBy(F.window("ts", slide).alias("pane"), *keys).agg(*moments)
    return panes.groupBy(F.window("pane", length, slide).alias("w"), *keys).agg(*merged)


def window_performance(predictions: DataFrame, length="30 days", slide="1 day", late_days=2 * WINDOW_DAYS) -> DataFrame:
    """L3: figures per model and sliding window."""
    p, a = F.when(c("actual").isNotNull(), c("prediction")), F.when(c("prediction").isNotNull(), c("actual"))
    e = p - a
    moments = [F.count(F.lit(1)).alias("_n"), F.count("actual").alias("_known"), F.count(e).alias("_k"), F.sum(F.abs(e)).alias("_abs"), F.sum(e * e).alias("_sq"),
               F.avg(p).alias("_p"), F.avg(a).alias("_a"), (F.var_pop(p) * F.count(e)).alias("_pp"), (F.var_pop(a) * F.count(e)).alias("_aa"),
               (F.covar_pop(p, a) * F.count(e)).alias("_pa"), F.sum(((p > 0) == (a > 0)).cast("long")).alias("_hits")]
    k = F.nullif(F.sum("_k"), F.lit(0))
    both = lambda m, x, y: F.sum(c(m) + c("_k") * c(x) * c(y)) - F.sum(c("_k") * c(x)) * F.sum(c("_k") * c(y)) / k  # pooled about the window's means
    spread = lambda m, x: F.when(both(m, x, x) > 1e-12 * F.sum(c(m) + c("_k") * c(x) * c(x)), both(m, x, x))
    merged = [F.sum("_n").alias("predictions"), F.sum("_known").alias("with_actual"), (F.sum("_abs") / k).alias("mae"), F.sqrt(F.sum("_sq") / k).alias("rmse"),
              (both("_pa", "_p", "_a") / F.sqrt(spread("_pp", "_p") * spread("_aa", "_a"))).alias("correlation"),
              (F.sum("_hits") / k).alias("directional_accuracy"), (F.sum("_known") / F.sum("_n")).alias("feedback_rate")]
    out = _paned(_watermarked(predictions, late_days), ["model_id"], slide, moments, length, merged)
    return out.select(c("w.start").alias("window_start"), c("w.end").alias("window_end"), *[x for x in out.columns if x != "w"])


def daily_counts(predictions: DataFrame, late_days=2 * WINDOW_DAYS) -> DataFrame:
    """L4: predictions per model and day (tumbling window)."""
    out = _watermarked(predictions, late_days).groupBy(F.window("ts", "1 day").alias("w"), "model_id").agg(F.count(F.lit(1)).alias("predictions"))
    return out.select(F.to_date("w.start").alias("day"), "model_id", "predictions")


def feature_statistics(predictions: DataFrame, length="30 days", late_days=2 * WINDOW_DAYS, slide: str | None = None) -> DataFrame:
    """Mean, std, min, max and missing rate of every feature per model and window (sliding if ``slide`` says so)."""
    long = _watermarked(predictions, late_days).select("ts", "model_id", F.explode("features").alias("feature", "v"))
    moments = [F.count(F.lit(1)).alias("_n"), F.count("v").alias("_k"), F.avg("v").alias("_m"), (F.var_pop("v") * F.count("v")).alias("_mm"),
               F.min("v").alias("_lo"), F.max("v").alias("_hi")]
    k = F.nullif(F.sum("_k"), F.lit(0))
    squares = F.sum(c("_mm") + c("_k") * c("_m") * c("_m")) - F.pow(F.sum(c("_k") * c("_m")), F.lit(2.0)) / k
    merged = [(F.sum(c("_k") * c("_m")) / k).alias("mean"), F.sqrt(F.greatest(squares, F.lit(0.0)) / F.nullif(k - 1, F.lit(0))).alias("std"),
              F.min("_lo").alias("lowest"), F.max("_hi").alias("highest"), (1 - F.sum("_k") / F.sum("_n")).alias("missing_rate")]
    if slide is None:
        panes = long.groupBy(F.window("ts", "1 day").alias("pane"), "model_id", "feature").agg(*moments)
        out = panes.groupBy(F.window("pane", length).alias("w"), "model_id", "feature").agg(*merged)
    else:
        out = _paned(long, ["model_id", "feature"], slide, moments, length, merged)
    return out.select(c("w.start").alias("window_start"), *[x for x in out.columns if x != "w"])


HIGHER_IS_BETTER = ("r2", "correlation", "directional_accuracy", "information_coefficient")  # fixed values
LOWER_IS_BETTER = ("mse", "rmse", "mae", "mape")


def degradation(current: DataFrame, baseline: DataFrame, metrics: list[str], threshold=DEGRADATION, keys=("model_id",)) -> DataFrame:
    """Relative change of every metric against baseline(model_id, metric, baseline); stream-static on a stream."""
    keep = [x for x in ("window_start", "window_end") if x in current.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), c(x).cast("double").alias("current")) for x in metrics])).alias("m")
    long = current.select(*keys, *keep, pairs).select(*keys, *keep, "m.*")
    out = long.join(baseline, [*keys, "metric"])
    zero = c("baseline") == 0
    size = F.when(zero, F.abs("current")).otherwise(F.abs(c("current") - c("baseline")) / F.nullif(F.abs("baseline"), F.lit(0.0)))
    rise = F.when(zero, c("current")).otherwise((c("current") - c("baseline")) / F.nullif(c("baseline"), F.lit(0.0)))
    out = out.withColumn("relative_change", F.when(c("metric").isin(*LOWER_IS_BETTER), rise).otherwise(size))
    return out.withColumn("degraded", c("relative_change") > threshold)


def _ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value of the two-sample statistic (Kolmogorov's series)."""
    lam2 = F.pow(d, F.lit(2.0)) * n * m / (n + m)
    terms = [(2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam2) for k in range(1, 41)]
    return F.when(lam2 < 0.04, 1.0).otherwise(F.greatest(F.least(sum(terms[1:], terms[0]), F.lit(1.0)), F.lit(0.0)))


def drift(reference: DataFrame, current: DataFrame, bins=10, psi_limit=DRIFT, by=("feature",)) -> DataFrame:
    """L7 (batch or inside foreachBatch): two-sample KS statistic with its asymptotic p-value, and PSI over equal bins
    of the reference range.  Both frames are (feature, value); groups may be of any size."""
    keys = list(by)
    both = reference.select(*keys, "value", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        current.select(*keys, "value", F.lit(0).alias("a"), F.lit(1).alias("b"))).where("value is not null")
    counts = both.groupBy(*keys, "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    tagged = ranks._tag_buckets(counts, keys, "value", False)
    sizes = tagged.groupBy(*keys, "_bucket").agg(F.sum("a").alias("_sa"), F.sum("b").alias("_sb"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sizes = sizes.select(*keys, "_bucket", *[F.coalesce(F.sum(f"_s{x}").over(upto), F.lit(0)).alias(f"_o{x}") for x in "ab"],
                         *[F.sum(f"_s{x}").over(whole).alias(f"n_{x}") for x in "ab"])
    inside = Window.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cum = tagged.select(*keys, "_bucket", *[F.sum(x).over(inside).alias(f"_c{x}") for x in "ab"]).join(sizes, [*keys, "_bucket"])
    share = lambda x: (c(f"_c{x}") + c(f"_o{x}")) / F.nullif(c(f"n_{x}"), F.lit(0))
    ks = cum.groupBy(*keys).agg(F.max(F.abs(share("a") - share("b"))).alias("ks_statistic"), F.max("n_a").alias("n_reference"), F.max("n_b").alias("n_current"))
    ks = ks.withColumn("ks_pvalue", _ks_pvalue(c("ks_statistic"), c("n_reference"), c("n_current")))

    span = reference.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    width = F.nullif((c("_hi") - c("_lo")) / bins, F.lit(0.0))
    at = F.greatest(F.ceil(F.round((c("value") - c("_lo")) / width, 9)) - 1, F.lit(0))
    binned = counts.join(span, keys).where((c("value") >= c("_lo")) & (c("value") <= c("_hi")))
    binned = binned.groupBy(*keys, F.coalesce(at, F.lit(0)).alias("bin")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    grid = span.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    binned = grid.join(binned, [*keys, "bin"], "left").fillna(0, ["a", "b"])
    binned = ranks.with_group_stats(binned, keys, _ta=F.sum("a"), _tb=F.sum("b"))
    pct = lambda x: F.when(c(x) > 0, c(x) / c(f"_t{x}")).otherwise(0.0001)
    psi = binned.groupBy(*keys).agg(F.sum((pct("b") - pct("a")) * F.ln(pct("b") / pct("a"))).alias("psi"))
    out = ks.join(psi, keys)
    return out.withColumn("drift_detected", (c("ks_pvalue") < 0.05) | (c("psi") > psi_limit))


def _cell(fine: int, bins: int) -> Column:
    """Cell of ``value`` in the reference range (_lo, _hi): ``fine`` cells a bin from 0; -1 below the range, bins * fine above."""
    width = F.nullif((c("_hi") - c("_lo")) / bins, F.lit(0.0))
    at = F.greatest(F.ceil(F.round((c("value") - c("_lo")) / width, 9) * fine) - 1, F.lit(0))
    return F.when(c("value") < c("_lo"), -1).when(c("value") > c("_hi"), bins * fine).otherwise(F.coalesce(at, F.lit(0))).cast("int")


def drift_reference(reference: DataFrame, bins=10, fine=32, by=("feature",)) -> DataFrame:
    """The stored side of a running comparison, one row a feature: range, rows, and rows per cell of a histogram."""
    keys, rows = list(by), reference.where("value is not null")
    span = rows.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"), F.count(F.lit(1)).alias("n_reference"))
    cells = rows.join(span, keys).groupBy(*keys, _cell(fine, bins).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    held = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("_reference"))
    return span.join(held, keys)


def windowed_drift(current: DataFrame, reference: DataFrame, length="30 days", late_days=2 * WINDOW_DAYS, bins=10, fine=32, psi_limit=DRIFT, by=("feature",)) -> DataFrame:
    """current(ts, feature, value), batch or stream, against ``drift_reference`` per tumbling window.

    Rows become counts per window, feature and cell, at most ``bins * fine + 2`` of them, which is all the state there is.
    PSI is exact, since cells make up its bins.  The KS statistic is taken at cell borders: the exact one lies between
    ``ks_statistic`` and ``ks_statistic + ks_bound``, the largest share that one cell holds on either side.
    """
    keys, top = list(by), bins * fine
    rows = _watermarked(current, late_days).join(reference.select(*keys, "_lo", "_hi"), keys).where("value is not null")
    counts = rows.groupBy(F.window("ts", length).alias("w"), *keys, _cell(fine, bins).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("w", *keys).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("_current"), F.sum("n").alias("n_current"))
    out = held.join(reference.select(*keys, "n_reference", "_reference"), keys)
    cells = F.sequence(F.lit(-1), F.lit(top))
    share = lambda m, n: (lambda i: F.coalesce(F.try_element_at(c(m), i), F.lit(0)) / c(n))
    a, b = share("_reference", "n_reference"), share("_current", "n_current")
    start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("d"), F.lit(0.0).alias("most"))

    def step(s, x):
        up, down = s["a"] + x["a"], s["b"] + x["b"]
        return F.struct(up.alias("a"), down.alias("b"), F.greatest(s["d"], F.abs(up - down)).alias("d"), F.greatest(s["most"], x["a"], x["b"]).alias("most"))

    out = out.withColumn("_cells", F.transform(cells, lambda i: F.struct(a(i).alias("a"), b(i).alias("b"))))
    out = out.withColumn("_ks", F.aggregate("_cells", start, step))
    inside = lambda side: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.aggregate(
        F.slice("_cells", k * fine + 2, fine), F.lit(0.0), lambda t, x: t + x[side]))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda t, y: t + y)
    out = out.withColumn("_a", inside("a")).withColumn("_b", inside("b")).withColumn("_ta", total(c("_a"))).withColumn("_tb", total(c("_b")))
    pct = lambda x, t: F.when(x > 0, x / c(t)).otherwise(0.0001)
    psi = total(F.zip_with("_a", "_b", lambda x, y: (pct(y, "_tb") - pct(x, "_ta")) * F.ln(pct(y, "_tb") / pct(x, "_ta"))))
    out = out.select(c("w.start").alias("window_start"), *keys, "n_reference", "n_current", c("_ks.d").alias("ks_statistic"), c("_ks.most").alias("ks_bound"), psi.alias("psi"))
    out = out.withColumn("ks_pvalue", _ks_pvalue(c("ks_statistic"), c("n_reference"), c("n_current")))
    return out.withColumn("drift_detected", (c("ks_pvalue") < 0.05) | (c("psi") > psi_limit))


def daily_health(predictions: DataFrame, flags: DataFrame | None = None, alerts=ALERTS) -> DataFrame:
    """L8 (batch): (model_id, day, issues, status, changed).

    Issues: no predictions on a day of the log, feedback under 10%, and what
    flags(model_id, day, degraded, drifted) adds.
    """
    day = predictions.groupBy("model_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count("actual").alias("k"))
    days = day.agg(F.sort_array(F.collect_set("day")).alias("_days")).withColumn("_k", F.lit(0))  # one calendar
    grid = day.select("model_id").distinct().withColumn("_k", F.lit(0)).join(F.broadcast(days), "_k").select("model_id", F.explode("_days").alias("day"))
    out = grid.join(day, ["model_id", "day"], "left")
    if flags is not None:
        out = out.join(flags, ["model_id", "day"], "left")
    no = lambda x: F.coalesce(c(x).cast("int"), F.lit(0)) if flags is not None else F.lit(0)
    issues = c("n").isNull().cast("int") + F.coalesce((c("k") / c("n") < MIN_FEEDBACK).cast("int"), F.lit(0)) + no("degraded") + no("drifted")
    out = out.withColumn("issues", issues).withColumn("status", health_status("issues", alerts))
    before = F.lag("status").over(Window.partitionBy("model_id").orderBy("day"))
    return out.select("model_id", "day", "issues", "status", F.coalesce(c("status") != before, F.lit(False)).alias("changed"))


def health_status(issues, alerts=ALERTS) -> Column:
    return F.when(c(issues) == 0, "healthy").when(c(issues) <= alerts, "warning").otherwise("critical")


DAY_MS = 86_400_000
#: Keys of the state of ``running_health``: models are dealt to these by hash.
BUCKETS = 1024


def running_health(predictions: DataFrame, late_days=2, alerts=ALERTS, buckets=BUCKETS) -> DataFrame:
    """L8 on a stream of predictions(model_id string, ts, actual): (model_id, day, issues, status, changed) for every day of a
    model from its first one, once the watermark has closed it.

    The state of a model is a pair of counts for each open day; the models of a bucket share one state of arrays, so that a
    micro-batch costs one Python turn a bucket however many models there are.  A timer at the end of the next day fires without
    any prediction, so silence is reported too; rows older than the watermark are dropped.  The empty model_id is a heartbeat.
    """
    names = np.array([None, "healthy", "warning", "critical"], dtype=object)
    kinds = {"at": np.int64, "last": np.int8, "own": np.int64, "days": np.int64, "sizes": np.int64, "known": np.int64}

    def per_day(f: pd.DataFrame) -> pd.DataFrame:
        f = f[f["model_id"].notna() & (f["model_id"] != "")]
        day = f["ts"].astype("int64") // {"s": 86_400, "ms": DAY_MS, "us": DAY_MS * 1000, "ns": DAY_MS * 1_000_000}[f["ts"].dt.unit]
        return pd.DataFrame({"model": f["model_id"], "day": day, "n": 1, "k": f["actual"].notna().astype("int64")}).groupby(["model", "day"], as_index=False).sum()

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        models, held = (list(state.get[0]), state.get[1:]) if state.exists else ([], [b""] * len(kinds))
        at, last, own, days, sizes, known = (np.frombuffer(bytes(x), k) for x, k in zip(held, kinds.values()))
        fresh = [per_day(f) for f in frames] if not state.hasTimedOut else []
        if sum(map(len, fresh)):
            new = pd.concat(fresh)
            place = {m: i for i, m in enumerate(models)}
            for m in new["model"].unique():
                place.setdefault(m, len(place))
            models, more = list(place), len(place) - len(at)
            at, last = np.append(at, np.zeros(more, np.int64)), np.append(last, np.zeros(more, np.int8))
            all_ = pd.DataFrame({"own": np.append(own, new["model"].map(place)), "day": np.append(days, new["day"]),
                                 "n": np.append(sizes, new["n"]), "k": np.append(known, new["k"])}).groupby(["own", "day"], as_index=False).sum()
            own, days, sizes, known = (all_[x].to_numpy(np.int64) for x in ("own", "day", "n", "k"))
            first = np.unique(own, return_index=True)  # days ascend within a model
            open_ = last[first[0]] == 0  # nothing reported yet: the first day may still move back
            at[first[0][open_]] = days[first[1][open_]]
        if not models:
            return
        closed = state.getCurrentWatermarkMs() // DAY_MS
        counts = np.maximum(closed - at, 0)
        ends = np.cumsum(counts)
        who = np.repeat(np.arange(len(models)), counts)
        day = np.arange(len(who)) - np.repeat(ends - counts, counts) + at[who]
        code = lambda m, d: (m << 32) + d + (1 << 31)
        seen = np.searchsorted(code(own, days), code(who, day))
        n, k = np.zeros((2, len(who)), np.int64)
        hit = seen < len(own)
        hit[hit] = code(own, days)[seen[hit]] == code(who, day)[hit]
        n[hit], k[hit] = sizes[seen[hit]], known[seen[hit]]
        issues = ((n == 0) | (k / np.maximum(n, 1) < MIN_FEEDBACK)).astype(np.int64)
        status = np.where(issues == 0, 1, np.where(issues <= alerts, 2, 3)).astype(np.int8)
        before = np.append(np.zeros(1, np.int8), status)[:-1]
        heads = counts > 0
        before[(ends - counts)[heads]] = last[heads]
        last = last.copy()
        last[heads] = status[ends[heads] - 1]
        at, keep = np.maximum(at, closed), days >= closed
        held = (at, last, own[keep], days[keep], sizes[keep], known[keep])
        state.update((models, *[x.astype(t).tobytes() for x, t in zip(held, kinds.values())]))
        state.setTimeoutTimestamp((int(at.min()) + 1) * DAY_MS)
        yield pd.DataFrame({"model_id": np.array(models, dtype=object)[who], "day": day, "issues": issues, "status": names[status],
                            "changed": (before > 0) & (before != status)})

    bucket = F.pmod(F.xxhash64("model_id"), F.lit(buckets)).alias("_bucket")
    rows = predictions.select(bucket, "model_id", "ts", c("actual").cast("double").alias("actual")).withWatermark("ts", f"{late_days} days")
    out = rows.groupBy("_bucket").applyInPandasWithState(
        step, "model_id string, day int, issues int, status string, changed boolean",
        "models array<string>, " + ", ".join(f"{x} binary" for x in kinds), "append", "EventTimeTimeout")
    return out.withColumn("day", F.date_from_unix_date("day"))


def run_available(stream: DataFrame, mode="append") -> DataFrame:
    """Process what is there and return the written result; complete mode keeps the last full result."""
    spark = stream.sparkSession
    path, marks = work_path(spark, "stream-result"), work_path(spark, "stream-state")

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={batch}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(path)
    return out.select(*stream.columns)
