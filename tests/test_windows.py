"""Trailing ranks and decayed sums against brute force."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from factorframe.functions import windows


def slow_rank(xs, i, n, least):
    frame = [x for x in xs[max(0, i - n + 1):i + 1] if x is not None]
    if xs[i] is None or len(frame) < max(least, 1):
        return None
    return (sum(x < xs[i] for x in frame) + (sum(x == xs[i] for x in frame) + 1) / 2) / len(frame)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-4, 4), st.floats(-1e9, 1e9)), max_size=70), st.integers(1, 40), st.integers(0, 40))
def test_frame_rank_is_the_rank_in_the_frame(xs, n, least):
    seen = np.array([x is not None for x in xs], dtype=bool)
    got = windows.frame_rank(np.array([0.0 if x is None else x for x in xs], dtype=float), seen, n, least)
    assert [None if math.isnan(g) else g for g in got.tolist()] == [slow_rank(xs, i, n, least) for i in range(len(xs))]


def series(spark, rows):
    return spark.createDataFrame([(s, dt.date(2020, 1, 1) + dt.timedelta(i), x) for s, i, x in rows], "symbol string, date date, x double")


def test_series_do_not_mix_and_order_is_by_date(spark):
    rng = np.random.default_rng(3)
    rows = [(s, i, None if rng.random() < 0.1 else float(rng.integers(0, 9))) for s in "ab" for i in range(60)] + [("c", 0, 1.0), ("d", 0, None)]
    of = {s: [x for t, _, x in rows if t == s] for s in "abcd"}
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    got = windows.rolling_ranks(series(spark, shuffled), {"r": ("x", 7, 3), "q": ("x", 20, 1)}).collect()
    assert len(got) == len(rows)
    for g in got:
        i = (g.date - dt.date(2020, 1, 1)).days
        assert (g.r, g.q) == (slow_rank(of[g.symbol], i, 7, 3), slow_rank(of[g.symbol], i, 20, 1))


def test_empty_table_has_no_ranks(spark):
    got = windows.rolling_ranks(series(spark, []), {"r": ("x", 7, 3)})
    assert got.columns == ["symbol", "date", "x", "r"] and got.count() == 0


def test_decayed_sums_are_finite_exponential_sums(spark):
    rng = np.random.default_rng(5)
    xs = {s: [None if rng.random() < 0.1 else float(rng.normal(50, 20)) for _ in range(50)] for s in "ab"}
    df = series(spark, [(s, i, x) for s in xs for i, x in enumerate(xs[s])])
    got = windows.decayed_sums(df, "x", {"e": (7, 0.8), "f": (21, 0.95), "g": (1, 1.0)}).toPandas()
    assert set(got.columns) == {"symbol", "date", "x", "e", "f", "g"}
    for s in xs:
        own = got[got.symbol == s].sort_values("date")
        for name, n, a in (("e", 7, 0.8), ("f", 21, 0.95), ("g", 1, 1.0)):
            want = [sum(a**k * (xs[s][i - k] or 0.0) for k in range(min(n, i + 1))) for i in range(50)]
            assert own[name].tolist() == pytest.approx(want, rel=1e-12)
    assert pd.api.types.is_float_dtype(got["e"])
