"""Training frames, splits, validation, search and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorframe.functions import ranks
from factorframe.functions.gram import gram, solve
from factorframe.functions.windows import c, trailing
from factorframe.operators import estimate


def sequences(df: DataFrame, features: list[str], target: str, length: int) -> DataFrame:
    """M8: the last ``length`` feature rows of a symbol with the target of the newest row; never across symbols."""
    rows = F.collect_list(F.array(*[c(x).cast("double") for x in features])).over(trailing(length))
    out = df.dropna(subset=features).withColumn("sequence", rows).where((F.size("sequence") == length) & c(target).isNotNull())
    return out.select("symbol", "date", "sequence", c(target).alias("target"))


def training_frame(features: DataFrame, targets: DataFrame, cols: list[str], start=None, end=None) -> DataFrame:
    """Complete rows that have a target, in the date range."""
    from factorframe.operators.universe import between

    out = between(features, start, end).join(targets, ["date", "symbol"])
    return out.dropna(subset=cols + [x for x in targets.columns if x not in ("date", "symbol")])


def boosted_trees(train: DataFrame, features: list[str], label="target", trees=20, depth=3, rate=0.1, seed=42):
    """Fitted pipeline of Spark's gradient-boosted trees; missing features count as 0."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [VectorAssembler(inputCols=features, outputCol="_features"),
              GBTRegressor(featuresCol="_features", labelCol=label, predictionCol="prediction", maxIter=trees,
                           maxDepth=depth, stepSize=rate, seed=seed)]
    return Pipeline(stages=stages).fit(train.fillna(0.0, features))


def score_trees(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Prediction per row."""
    return model.transform(df.fillna(0.0, features)).drop("_features")


def tree_importance(spark: SparkSession, model, features: list[str]) -> DataFrame:
    """(feature, importance); one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


# ---- splits: tables (fold, role, date) over the distinct dates ----


def date_index(df: DataFrame, order="date") -> DataFrame:
    """(date, idx, n_dates): position of every distinct date.  The calendar is one bounded array."""
    days = df.select(order).distinct().agg(F.sort_array(F.collect_set(order)).alias("_days"))
    return days.select(F.posexplode("_days").alias("idx", "date"), F.size("_days").alias("n_dates"))


def business_days(spark: SparkSession, start, end) -> DataFrame:
    days = F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return spark.range(1).select(days.alias("date")).where(F.weekday("date") < 5)


def _roles(index: DataFrame, folds: Column, bounds) -> DataFrame:
    """``bounds(fold, n)`` -> (train_start, train_end, test_start, test_end) as half-open index ranges."""
    df = index.withColumn("fold", F.explode(folds))
    a, b, s, e = bounds(c("fold"), c("n_dates"))
    i = c("idx")
    role = F.when((i >= a) & (i < b), "train").when((i >= s) & (i < e), "test")
    ok = (b - a >= 10) & (e > s) & (s < c("n_dates"))
    return df.where(ok).withColumn("role", role).where(c("role").isNotNull()).select("fold", "role", "date")


def purged_split(index: DataFrame, folds=5, purge=5, embargo=2) -> DataFrame:
    """M13."""
    size = lambda n: F.floor(n / (folds + 1))
    return _roles(index, F.sequence(F.lit(0), F.lit(folds - 1)), lambda f, n: (
        F.lit(0), (f + 1) * size(n) - purge - embargo, (f + 1) * size(n), F.least((f + 2) * size(n), n)))


def expanding_split(index: DataFrame, folds=5, initial=0.5, test=0.2, purge=5) -> DataFrame:
    """M14."""

    def bounds(f, n):
        size = F.floor(n * test)
        start = F.floor(n * initial) + f * size + purge
        return F.lit(0), start - purge, start, F.least(start + size, n)

    return _roles(index, F.sequence(F.lit(0), F.lit(folds - 1)), bounds)


def walk_forward_split(index: DataFrame, train=252, test=21, step=21, purge=5) -> DataFrame:
    """Only windows that fit as a whole."""
    n = F.floor((c("n_dates") - train - purge) / step)
    folds = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))

    def bounds(f, n_):
        start = f * step
        end = start + train + purge + test
        return start, start + train, start + train + purge, F.when(end <= n_, end).otherwise(start)

    return _roles(index, folds, bounds)


def fold_ranges(split: DataFrame) -> DataFrame:
    """(fold, role, start, end, n_dates) of a split."""
    return split.groupBy("fold", "role").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("n_dates"))


# ---- metrics ----


def regression_metrics(df: DataFrame, by: list[str], actual="y", predicted="prediction") -> DataFrame:
    """r2, mse, mae, rmse and mape (null when an actual is 0)."""
    ok = df.where(c(actual).isNotNull() & c(predicted).isNotNull())
    e = c(actual) - c(predicted)
    out = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(actual).alias("_v"),
        F.when(F.min(F.abs(actual)) > 0, F.avg(F.abs(e / F.nullif(c(actual), F.lit(0.0))))).alias("mape"))
    return out.select(*by, "n", (1 - c("mse") / F.nullif(c("_v"), F.lit(0.0))).alias("r2"), "mse", "mae", F.sqrt("mse").alias("rmse"), "mape")


def classification_metrics(df: DataFrame, by: list[str], actual="y", predicted="prediction") -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, from counts per (actual, predicted)."""
    cells = df.groupBy(*by, c(actual).alias("_a"), c(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = cells.select(*by, F.explode(F.array(
        F.struct(c("_a").alias("k"), c("_n").alias("sup"), F.lit(0).cast("long").alias("pred"), F.when(c("_a") == c("_p"), c("_n")).otherwise(0).alias("hit")),
        F.struct(c("_p").alias("k"), F.lit(0).cast("long").alias("sup"), c("_n").alias("pred"), F.lit(0).cast("long").alias("hit")))).alias("s"))
    per = sides.groupBy(*by, "s.k").agg(F.sum("s.sup").alias("sup"), F.sum("s.pred").alias("pred"), F.sum("s.hit").alias("hit"))
    prec = F.coalesce(c("hit") / F.nullif(c("pred"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(c("hit") / F.nullif(c("sup"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * c("hit") / F.nullif(c("pred") + c("sup"), F.lit(0)), F.lit(0.0))
    w = lambda x: F.sum(x * c("sup")) / F.sum("sup")
    return per.groupBy(*by).agg((F.sum("hit") / F.sum("sup")).alias("accuracy"), w(prec).alias("precision"), w(rec).alias("recall"), w(f1).alias("f1"))


# ---- validation and search: folds and penalties are grouping keys of one job ----


def cross_validate(frame: DataFrame, split: DataFrame, xs: list[str], y="y", keys=("symbol",), ridges=(0.0,), min_rows=estimate.MIN_ROWS) -> DataFrame:
    """Metrics per (ridge, fold).

    A training row counts for every fold it belongs to; the copies are combined on
    the map side, so only moments are shuffled.  All penalties share the moments.
    """
    rows = frame.dropna(subset=xs + [y]).join(split, "date")
    m = gram(rows.where("role = 'train'"), ["fold", *keys], xs, y).where(c("_n") >= min_rows)
    m = m.withColumn("ridge", F.explode(F.lit([float(r) for r in ridges])))
    fitted = solve(m, ["ridge", "fold", *keys], xs, ridge="ridge", t_stats=False)
    test = rows.where("role = 'test'").join(fitted.select("ridge", "fold", *keys, "alpha", *[f"b_{x}" for x in xs]), ["fold", *keys])
    pred = c("alpha") + sum((c(f"b_{x}") * c(x) for x in xs), F.lit(0.0))
    return regression_metrics(test.withColumn("prediction", pred), ["ridge", "fold"], y)


def validation_summary(scores: DataFrame, metric="r2", by=("ridge",)) -> DataFrame:
    """Mean and deviation over the folds."""
    return scores.groupBy(*by).agg(F.avg(metric).alias("mean_score"), F.stddev_samp(metric).alias("std_score"), F.count(metric).alias("folds"))


def best_parameters(scores: DataFrame, metric="r2", by="ridge", n=1) -> DataFrame:
    """Parameter with the best mean score; the smaller one on a tie."""
    return ranks.top_n(validation_summary(scores, metric, (by,)), [], [F.desc_nulls_last("mean_score"), F.asc(by)], n)


def compare(results: DataFrame, metric: str, name="model", n=10, higher_is_better=True) -> DataFrame:
    """Models in order of the primary metric with their distance from the best."""
    order = F.desc_nulls_last(metric) if higher_is_better else F.asc_nulls_last(metric)
    top = ranks.top_n(results, [], [order, F.asc(name)], n)
    best = results.agg((F.max if higher_is_better else F.min)(metric).alias("_best")).withColumn("_k", F.lit(0))
    out = top.withColumn("_k", F.lit(0)).join(F.broadcast(best), "_k")
    return out.withColumn("gap_to_best", c(metric) - c("_best")).drop("_k", "_best")


def model_summary(results: DataFrame) -> DataFrame:
    """results(model, sharpe_ratio, total_return) -> one row."""
    return results.agg(
        F.count(F.lit(1)).alias("total_models"), F.max_by("model", F.struct("sharpe_ratio", "model")).alias("best_model"),
        F.avg("sharpe_ratio").alias("avg_sharpe_ratio"), F.max("sharpe_ratio").alias("best_sharpe_ratio"),
        F.avg("total_return").alias("avg_total_return"), F.max("total_return").alias("best_total_return"))


def meta_against_base(meta: DataFrame, base: DataFrame) -> DataFrame:
    """Sharpe of every base model, of the combination and the difference."""
    m = meta.agg(F.max("sharpe_ratio").alias("meta_sharpe")).withColumn("_k", F.lit(0))
    out = base.withColumn("_k", F.lit(0)).join(F.broadcast(m), "_k")
    return out.select("model", "sharpe_ratio", "meta_sharpe", (c("meta_sharpe") - c("sharpe_ratio")).alias("improvement"))


def system_verdict(meta: DataFrame, min_sharpe=0.5, max_drawdown=-0.3) -> DataFrame:
    """Does the combination meet the requirements?"""
    s, d = c("sharpe_ratio") >= min_sharpe, c("max_drawdown") >= max_drawdown
    return meta.select("model", "sharpe_ratio", "max_drawdown", s.alias("meets_sharpe"), d.alias("meets_drawdown"), (s & d).alias("valid"))
