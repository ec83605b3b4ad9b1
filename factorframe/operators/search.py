"""Search over a declared parameter space by successive halving.

A space names each parameter's kind: ``("float", low, high)``, ``("log", low, high)``, ``("int", low, high)`` or
``("choice", values)``.  Points are drawn by hash of (seed, trial, name), so that the same search can be repeated anywhere.

Halving: every point is scored on the first fold, the better part on ``eta`` folds, and so on until one point has been
scored on all folds.  What a rung has to look at is at most ``trials`` x ``folds`` scores; these, and nothing else, come to
the driver.

* Linear models: one pass over the rows gives the moments of every (fold, role, group).  Fits and scores of all points
  are algebra on these moments, so the search costs the same pass however many points it tries.
* Trees: Spark's boosted trees, fitted again for the points that are still in the race, over rows written once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorframe.functions.gram import _inverse, _unpack, gram
from factorframe.functions.windows import c
from factorframe.operators import estimate, ml
from factorframe.streaming.storage import work_path

#: What a linear model may be searched over.
LINEAR = {"ridge": ("log", 1e-4, 100.0), "scaled": ("choice", [False, True]), "factors": ("int", 1, 2)}
#: What boosted trees may be searched over.
TREES = {"trees": ("int", 20, 200), "depth": ("int", 3, 8), "rate": ("log", 0.01, 0.3)}


class Rung(NamedTuple):
    rung: int
    folds: int
    trial: int
    mean_score: float | None
    place: int
    kept: bool


def points(spark: SparkSession, space: dict, trials: int, seed: int = 0) -> DataFrame:
    """trial from 0 and one column per parameter of ``space``."""

    def drawn(name: str, spec: tuple):
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), c("trial").cast("string"), F.lit(name)).cast("binary"))
        u = F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / float(16**13)
        kind, *rest = spec
        if kind == "choice":
            values = F.array(*[F.lit(v) for v in rest[0]])
            return F.element_at(values, (F.floor(u * len(rest[0])) + 1).cast("int"))
        low, high = rest
        if kind == "int":
            return (F.lit(low) + F.floor(u * (high - low + 1))).cast("int")
        if kind == "float":
            return F.lit(float(low)) + u * float(high - low)
        if kind == "log":
            return F.exp(F.lit(float(np.log(low))) + u * float(np.log(high) - np.log(low)))
        raise ValueError(f"unknown kind {kind!r} of parameter {name!r}")

    if not space:
        raise ValueError("no search space")
    return spark.range(trials).select(c("id").cast("int").alias("trial")).select("trial", *[drawn(n, s).alias(n) for n, s in space.items()])


def budgets(folds: int, eta: int = 2) -> list[int]:
    """Folds that the points of each rung are scored on."""
    out = [1]
    while out[-1] < folds:
        out.append(min(folds, out[-1] * eta))
    return out


def halving(trials: list[int], folds: int, score: Callable[[list[int], range], list[tuple[int, int, float | None]]], eta: int = 2, maximize: bool = True) -> list[Rung]:
    """The history of a search.  ``score(trials, folds)`` gives (trial, fold, score); a score that is missing or null is
    the worst.  Ties go to the smaller trial."""
    held: dict[int, dict[int, float | None]] = {t: {} for t in trials}
    alive, done, out = list(trials), 0, []
    for rung, upto in enumerate(budgets(folds, eta)):
        for trial, fold, value in score(alive, range(done, upto)):
            held[trial][fold] = value
        done = upto

        def mean(t):
            own = [held[t].get(f) for f in range(upto)]
            return None if any(x is None or x != x for x in own) else float(np.mean(own))

        order = sorted(alive, key=lambda t: (mean(t) is None, 0.0 if mean(t) is None else -mean(t) if maximize else mean(t), t))
        keep = 1 if upto == folds else -(-len(alive) // eta)
        out += [Rung(rung, upto, t, mean(t), i + 1, i < keep) for i, t in enumerate(order)]
        alive = order[:keep]
    return out


def history(points: DataFrame, rungs: list[Rung]) -> DataFrame:
    """The history as a table: rung, folds, trial, parameters, mean_score, place, kept."""
    table = points.sparkSession.createDataFrame(rungs, "rung int, folds int, trial int, mean_score double, place int, kept boolean")
    return table.join(points, "trial").select("rung", "folds", "trial", *[x for x in points.columns if x != "trial"], "mean_score", "place", "kept")


# ---- linear models: fits and scores from moments -------------------------------------------------------------------


def fold_moments(frame: DataFrame, split: DataFrame, xs: list[str], y: str = "y", keys=("symbol",), min_rows=estimate.MIN_ROWS) -> DataFrame:
    """Moments of the training and the test rows of every (fold, group) side by side, from one pass."""
    both = gram(frame.join(split, "date"), ["fold", "role", *keys], xs, y)
    names = [x for x in both.columns if x not in ("fold", "role", *keys)]
    # one row a (fold, group): maximum of what is there for a role
    wide = both.groupBy("fold", *keys).agg(*[F.max(F.when(c("role") == r, c(n))).alias(f"{r}{n}") for r in ("train", "test") for n in names])
    return wide.where((c("train_n") >= min_rows) & (c("test_n") > 0))


def linear_scores(moments: DataFrame, params: list, xs: list[str], folds: range | None = None) -> DataFrame:
    """(trial, fold, n, r2) for ``params``, rows (trial, ridge, scaled, factors): the penalty on the slopes, on unit-variance
    regressors if ``scaled``, of a model with the first ``factors`` regressors."""
    k = len(xs)
    params = [(int(p["trial"]), float(p["ridge"]), bool(p["scaled"]), int(p["factors"])) for p in params]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            side = lambda r: pdf[[x for x in pdf if x.startswith(r + "_")]].rename(columns=lambda x: x[len(r):])
            n, mx, my, sxx, sxy, _ = _unpack(side("train"), k)
            m, tx, ty, txx, txy, tyy = _unpack(side("test"), k)
            rows = []
            for trial, ridge, scaled, q in params:
                own = sxx[:, :q, :q]
                weight = np.diagonal(own, axis1=1, axis2=2) if scaled else np.ones((len(n), q))
                penalty = np.zeros_like(own)
                penalty[:, np.arange(q), np.arange(q)] = weight * (ridge / n)[:, None]
                beta = np.einsum("gij,gj->gi", _inverse(own + penalty), sxy[:, :q])
                alpha = my - np.einsum("gi,gi->g", beta, mx[:, :q])
                off = ty - alpha - np.einsum("gi,gi->g", beta, tx[:, :q])  # mean error
                spread = tyy - 2 * np.einsum("gi,gi->g", beta, txy[:, :q]) + np.einsum("gi,gij,gj->g", beta, txx[:, :q, :q], beta)
                rows.append(pd.DataFrame({"trial": trial, "fold": pdf["fold"], "n": m.astype("int64"), "sse": m * (spread + off * off), "sy": m * ty, "syy": m * (tyy + ty * ty)}))
            yield pd.concat(rows).groupby(["trial", "fold"], as_index=False).sum()[["trial", "fold", "n", "sse", "sy", "syy"]]

    if folds is not None:
        moments = moments.where(c("fold").isin(list(folds)))
    out = moments.mapInPandas(run, "trial int, fold int, n long, sse double, sy double, syy double").groupBy("trial", "fold").agg(
        *[F.sum(x).alias(x) for x in ("n", "sse", "sy", "syy")])
    total = c("syy") - c("sy") * c("sy") / c("n")
    return out.select("trial", "fold", "n", (1 - c("sse") / F.nullif(total, F.lit(0.0))).alias("r2"))


def linear_search(frame: DataFrame, split: DataFrame, xs: list[str], points: DataFrame, folds: int, y: str = "y", keys=("symbol",), eta: int = 2,
                  min_rows=estimate.MIN_ROWS) -> DataFrame:
    """The history of a halving search over linear models; rows are read once and kept as moments."""
    moments = fold_moments(frame, split, xs, y, keys, min_rows).persist()
    params = {r["trial"]: r for r in points.collect()}  # as many rows as trials were asked for
    if max((p["factors"] for p in params.values()), default=0) > len(xs):
        raise ValueError("more factors in the space than regressors")
    try:
        score = lambda alive, part: [tuple(r) for r in linear_scores(moments, [params[t] for t in alive], xs, part).select("trial", "fold", "r2").collect()]
        return history(points, halving(sorted(params), folds, score, eta))
    finally:
        moments.unpersist()


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tree_search(train: DataFrame, split: DataFrame, features: list[str], points: DataFrame, folds: int, label="target", eta: int = 2, seed=42) -> DataFrame:
    """The history of a halving search over boosted trees (points: trial, trees, depth, rate).

    Rows and split are written once; fits and scores, which read them many times over, go to what is written."""
    params = {r["trial"]: r for r in points.collect()}
    rows = _kept(train.where(c(label).isNotNull()).select("date", *features, label), "search-rows").join(_kept(split, "search-split"), "date")

    def score(alive, part):
        for fold in part:
            own = rows.where(c("fold") == fold)
            fit, test = own.where("role = 'train'").drop("fold", "role"), own.where("role = 'test'").drop("fold", "role")
            if fit.isEmpty() or test.isEmpty():
                continue
            for t in alive:
                p = params[t]
                model = ml.boosted_trees(fit, features, label, int(p["trees"]), int(p["depth"]), float(p["rate"]), seed)
                yield t, fold, ml.regression_metrics(ml.score_trees(model, test, features), [], label).first()["r2"]

    return history(points, halving(sorted(params), folds, lambda a, b: list(score(a, b)), eta))
