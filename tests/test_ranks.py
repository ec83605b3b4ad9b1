"""Ranks, quantiles and row numbers over many buckets against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorframe.functions import ranks


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(ranks, "PER_PART", 16)


def values(seed=2, n=4000):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 100, n).round(1))  # one value holds two fifths of all rows
    return pd.DataFrame({"g": np.where(np.arange(n) < 30, "b", "a"), "i": np.arange(n), "x": x})


def buckets(spark, n):
    df = spark.range(n).select((F.col("id") * 1.0).alias("x"), F.col("id").alias("i"))
    keyed, by = ranks._keyed(df, [])
    return ranks._tag_buckets(keyed, by, "x", True).select("_bucket").distinct().count()


def test_more_rows_are_more_parts(spark, small_parts):
    few, many = buckets(spark, 500), buckets(spark, 5000)
    assert 15 <= few <= 60 and 200 <= many <= 450


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_and_quantiles_are_exact_over_many_parts(spark, small_parts, by):
    pdf = values()
    pdf.loc[5, "x"] = None
    df = spark.createDataFrame([(g, int(i), None if np.isnan(x) else float(x)) for g, i, x in pdf.itertuples(index=False)], "g string, i long, x double")
    got = ranks.percent_rank(df, by, "x", "r").toPandas().sort_values("i")
    groups = pdf.groupby("g").x if by else pdf.x
    assert got.r.to_numpy() == pytest.approx(groups.rank(pct=True).to_numpy(), nan_ok=True)
    q = ranks.quantiles(df, by, "x", {"lo": 0.01, "mid": 0.5, "hi": 0.93}).toPandas()
    for row in q.itertuples():
        own = pdf[pdf.g == row.g].x if by else pdf.x
        assert [row.lo, row.mid, row.hi] == pytest.approx(own.quantile([0.01, 0.5, 0.93]).tolist())


def test_rows_of_one_value_are_split(spark, small_parts):
    pdf = values()
    df = spark.createDataFrame(pdf)
    got = ranks.row_numbers(df, [], "x", ["i"]).toPandas().sort_values("row_num")
    want = pdf.sort_values(["x", "i"])
    assert got.row_num.tolist() == list(range(1, len(pdf) + 1)) and got.i.tolist() == want.i.tolist()
    hot = df.where("x = 7.0").selectExpr("*", "struct(x, i) as o", "0 as k")
    parts = ranks._tag_buckets(hot, ["k"], "o", False).groupBy("_bucket").count().toPandas()["count"]
    assert len(parts) > 40 and parts.max() < 200


def test_group_without_values(spark, small_parts):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0)], "g string, x double")
    got = {(r.g, r.x): r.r for r in ranks.percent_rank(df, ["g"], "x", "r").collect()}
    assert got == {("a", None): None, ("b", 1.0): 1.0}
    assert ranks.row_numbers(df.where("x > 5"), [], "x", ["g"]).count() == 0
