"""Search over declared spaces (M17): points against SQL, halving and both model families against brute force."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorframe.operators import ml, search

DAY0 = dt.date(2020, 1, 1)


def brute(scores, trials, folds, eta, sign):
    """The survivors of every rung by plain sorting."""
    alive, upto, out = list(trials), 1, []
    while True:
        mean = {t: (None if any(scores.get((t, f)) is None for f in range(upto)) else sum(scores[t, f] for f in range(upto)) / upto) for t in alive}
        ranked = sorted([t for t in alive if mean[t] is not None], key=lambda t: (-sign * mean[t], t)) + sorted(t for t in alive if mean[t] is None)
        keep = 1 if upto == folds else int(np.ceil(len(alive) / eta))
        out.append((upto, ranked, keep))
        if upto == folds:
            return out
        alive, upto = ranked[:keep], min(folds, upto * eta)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 20), st.integers(1, 7), st.integers(2, 4), st.booleans(), st.randoms(use_true_random=False))
def test_halving_order(n, folds, eta, maximize, random):
    scores = {(t, f): random.choice([None, 0.0, 0.5, 0.5, random.random()]) for t in range(n) for f in range(folds)}
    asked = []

    def score(alive, part):
        asked.extend((t, f) for t in alive for f in part)
        return [(t, f, scores[t, f]) for t in alive for f in part]

    got = search.halving(list(range(n)), folds, score, eta, maximize)
    for rung, (upto, ranked, keep) in enumerate(brute(scores, range(n), folds, eta, 1 if maximize else -1)):
        own = [r for r in got if r.rung == rung]
        assert [r.trial for r in own] == ranked and [r.kept for r in own] == [i < keep for i in range(len(ranked))] and {r.folds for r in own} == {upto}
    assert len(asked) == len(set(asked))  # nothing is fitted twice
    assert sum(r.kept for r in got if r.folds == folds) == 1


def test_points_can_be_repeated_in_sql(spark):
    import duckdb

    from factorframe.plans.q_ml import SEED, _space_sql

    space = search.LINEAR | search.TREES
    got = search.points(spark, space, 300, SEED).toPandas()
    want = duckdb.sql(_space_sql(space, 300)).df()
    for name in got:
        if got[name].dtype == float:
            assert np.allclose(got[name], want[name], rtol=1e-12)
        else:
            assert (got[name] == want[name]).all()
    assert got.ridge.between(1e-4, 100).all() and set(got.factors) == {1, 2} and got.trees.between(20, 200).all() and got.depth.between(3, 8).all()
    with pytest.raises(ValueError):
        search.points(spark, {}, 3)
    with pytest.raises(ValueError):
        search.points(spark, {"x": ("gauss", 0, 1)}, 3)


def panel(spark, n=240):
    rng = np.random.default_rng(5)
    rows = []
    for s in "abc":
        x = rng.normal(size=(n, 2)) * [1.0, 5.0] + [0.3, -2.0]
        y = 0.1 + x @ [0.5, -0.2] + rng.normal(0, 0.4, n)
        rows += [(s, DAY0 + dt.timedelta(i), *map(float, x[i]), float(y[i])) for i in range(n)]
    return pd.DataFrame(rows, columns=["symbol", "date", "a", "b", "y"])


def test_linear_scores_from_moments_are_those_of_the_rows(spark):
    pdf = panel(spark)
    df = spark.createDataFrame(pdf)
    split = ml.purged_split(ml.date_index(df), folds=3)
    params = [{"trial": 0, "ridge": 0.0, "scaled": False, "factors": 2}, {"trial": 1, "ridge": 500.0, "scaled": False, "factors": 2},
              {"trial": 2, "ridge": 500.0, "scaled": True, "factors": 2}, {"trial": 3, "ridge": 1.0, "scaled": True, "factors": 1}]
    got = {(r.trial, r.fold): (r.n, r.r2) for r in search.linear_scores(search.fold_moments(df, split, ["a", "b"], min_rows=5), params, ["a", "b"]).collect()}
    roles = split.toPandas().merge(pdf, on="date")
    for p in params:
        for fold in range(3):
            errors, actual = [], []
            for s in "abc":
                own = roles[(roles.fold == fold) & (roles.symbol == s)]
                train, test = own[own.role == "train"], own[own.role == "test"]
                x = train[["a", "b"][:p["factors"]]].to_numpy()
                xc, yc = x - x.mean(0), train.y.to_numpy() - train.y.mean()
                weight = xc.var(0) if p["scaled"] else np.ones(x.shape[1])
                beta = np.linalg.solve(xc.T @ xc / len(x) + np.diag(weight) * p["ridge"] / len(x), xc.T @ yc / len(x))
                t = test[["a", "b"][:p["factors"]]].to_numpy()
                errors += list(test.y - (train.y.mean() + (t - x.mean(0)) @ beta))
                actual += list(test.y)
            want = 1 - np.mean(np.square(errors)) / np.var(actual)
            assert got[p["trial"], fold] == (len(actual), pytest.approx(want, abs=1e-9))


def test_rows_are_read_once_whatever_the_number_of_points(spark):
    df = spark.createDataFrame(panel(spark))
    split = ml.purged_split(ml.date_index(df), folds=3)
    moments = search.fold_moments(df, split, ["a", "b"], min_rows=5)
    assert moments.count() == 9
    out = search.linear_search(df, split, ["a", "b"], search.points(spark, search.LINEAR, 9), 3, min_rows=5)
    assert out.where("folds = 3 and kept").count() == 1 and out.where("rung = 0").count() == 9
    with pytest.raises(ValueError):
        search.linear_search(df, split, ["a"], search.points(spark, {**search.LINEAR, "factors": ("int", 2, 2)}, 2), 3)


def test_trees_are_fitted_again_only_for_survivors(spark, monkeypatch):
    pdf = panel(spark, 90)
    df = spark.createDataFrame(pdf).withColumnRenamed("y", "target")
    split = ml.purged_split(ml.date_index(df), folds=2)
    pts = search.points(spark, {"trees": ("int", 1, 3), "depth": ("int", 1, 3), "rate": ("log", 0.1, 1.0)}, 3, 1)
    fits, fit = [], ml.boosted_trees
    monkeypatch.setattr(ml, "boosted_trees", lambda *a: fits.append(a[3:6]) or fit(*a))
    out = search.tree_search(df, split, ["a", "b"], pts, 2).collect()
    assert len(fits) == 3 + 2
    scores = {}
    for p in pts.collect():
        for fold in range(2):
            rows = df.join(split.where(F.col("fold") == fold), "date")
            model = fit(rows.where("role = 'train'"), ["a", "b"], "target", p.trees, p.depth, p.rate, 42)
            scores[p.trial, fold] = ml.regression_metrics(ml.score_trees(model, rows.where("role = 'test'"), ["a", "b"]), [], "target").first().r2
    for upto, ranked, keep in brute(scores, range(3), 2, 2, 1):
        own = sorted((r for r in out if r.folds == upto), key=lambda r: r.place)
        assert [r.trial for r in own] == ranked and sum(r.kept for r in own) == keep
        assert all(r.mean_score == pytest.approx(np.mean([scores[r.trial, f] for f in range(upto)]), abs=1e-6) for r in own)


def test_trees_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    df = spark.createDataFrame(panel(spark, 90)).withColumnRenamed("y", "target").withColumn("a", F.udf(counted, "double")("a"))
    pts = search.points(spark, {"trees": ("int", 1, 2), "depth": ("int", 1, 2), "rate": ("log", 0.1, 1.0)}, 3, 1)
    out = search.tree_search(df, ml.purged_split(ml.date_index(df.select("date")), folds=2), ["a", "b"], pts, 2)
    assert out.where("folds = 2 and kept").count() == 1 and seen.value == 270
