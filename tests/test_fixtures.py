"""Hand-made cases against pandas, numpy or brute force."""

import datetime as dt
import itertools
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorframe.functions import joins, pairs, ranks
from factorframe.functions.gram import student_p
from factorframe.functions.windows import ewm_means, rolling_sums
from factorframe.operators import align, analytics, crosssection, estimate, portfolio, quality, signals, technical, transforms, universe
from factorframe.sources import io
from factorframe.streaming import monitor

DAY0 = dt.date(2020, 1, 1)


def bars(spark, closes: dict[str, list[float]]):
    rows = [(s, DAY0 + dt.timedelta(i), *[float(x)] * 4, 100.0) for s, xs in closes.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def frame(df, *order):
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)


def test_constant_price_gives_no_nan(spark):
    out = frame(technical.technical_panel(bars(spark, {"A": [100.0] * 30}), (5,), (5,)), "date")
    num = out.select_dtypes("number")
    assert not np.isinf(num.to_numpy(dtype=float)).any()
    assert (out["volatility_5d"].dropna() == 0).all() and out["rsi_14"].isna().all() and out["bb_position"].isna().all()
    assert out["stochastic_k"].dropna().eq(0).all()


def test_straight_line_rsi_is_100(spark):
    out = frame(technical.rsi(bars(spark, {"A": [100.0 + i for i in range(30)]})), "date")
    assert out["rsi_14"].isna().sum() == 13 and (out["rsi_14"].dropna() == 100).all()


def test_nothing_leaks_between_symbols_or_from_later_dates(spark):
    rng = np.random.default_rng(1)
    a, b = list(100 * np.exp(rng.normal(0, 0.02, 80).cumsum())), list(50 * np.exp(rng.normal(0, 0.02, 20).cumsum()))
    cols = ["momentum_5d", "volatility_10d", "ema_12", "macd_signal", "rsi_14", "adx", "cci", "volume_price_trend"]
    block = lambda c: technical.technical_panel(bars(spark, c), (5,), (10,)).select("symbol", "date", *cols)
    both, alone = frame(block({"A": a, "B": b}), "symbol", "date"), frame(block({"B": b}), "symbol", "date")
    pd.testing.assert_frame_equal(both[both.symbol == "B"].reset_index(drop=True), alone)
    early = frame(block({"A": a[:60]}), "symbol", "date")
    pd.testing.assert_frame_equal(both[both.symbol == "A"].head(60).reset_index(drop=True), early)


def test_partitioning_and_order_change_nothing(spark):
    rng = np.random.default_rng(2)
    df = bars(spark, {s: list(100 * np.exp(rng.normal(0, 0.02, 40).cumsum())) for s in "ABC"})
    x = frame(technical.bollinger(df), "symbol", "date")
    y = frame(technical.bollinger(df.orderBy(F.rand(3)).repartition(5)), "symbol", "date")
    pd.testing.assert_frame_equal(x, y)


def test_ewm_matches_pandas_with_gaps_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 900)
    v[[0, 5, 300, 301]] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": range(900), "v": v})).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    got = frame(ewm_means(df, {"e9": ("v", 9), "e26": ("v", 26)}), "date")
    s = pd.Series(v)
    for span in (9, 26):
        np.testing.assert_allclose(got[f"e{span}"], s.ewm(span=span).mean(), rtol=0, atol=1e-12)


def test_rolling_sums(spark):
    v = np.random.default_rng(4).normal(0, 1, 533)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "date": range(533), "v": v}))
    got = frame(rolling_sums(df, ["v"], 60), "date")
    np.testing.assert_allclose(got["v_sum"], pd.Series(v).rolling(60, min_periods=1).sum(), atol=1e-12)
    assert got["_rows"].tolist() == [min(i + 1, 60) for i in range(533)]


def test_ranks_and_quantiles_with_one_hot_group_and_many_ties(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": np.where(rng.random(4000) < 0.7, "hot", rng.integers(0, 9, 4000).astype(str)),
                        "v": np.round(rng.normal(0, 1, 4000), 1), "i": range(4000)})
    pdf.loc[rng.random(4000) < 0.3, "v"] = 0.0  # a tie group with a third of all rows
    df = spark.createDataFrame(pdf)
    got = frame(ranks.percent_rank(df, ["g"], "v", "r"), "i")
    np.testing.assert_allclose(got["r"], pdf.groupby("g")["v"].rank(pct=True), atol=1e-12)
    q = frame(ranks.quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.93}), "g").set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.01, 0.5, 0.93]).unstack()
    np.testing.assert_allclose(q[["a", "b", "c"]].to_numpy(), want.loc[q.index].to_numpy(), atol=1e-12)
    n = frame(ranks.row_numbers(df, [], "v", ["i"], "n"), "i")
    assert n["n"].tolist() == pdf.sort_values(["v", "i"]).reset_index().assign(n=range(1, 4001)).sort_values("i")["n"].tolist()


def test_asof_gap_and_neighbours(spark):
    d = lambda n: DAY0 + dt.timedelta(n)
    left = spark.createDataFrame([("A", d(0)), ("A", d(5)), ("A", d(9)), ("B", d(5))], "symbol string, date date")
    right = spark.createDataFrame([("A", d(1), 1.0), ("A", d(8), 2.0)], "symbol string, date date, v double")
    got = {(r.symbol, r.date): r.v for r in joins.asof(left, right, ["symbol"], ["v"]).collect()}
    assert got == {("A", d(0)): None, ("A", d(5)): 1.0, ("A", d(9)): 2.0, ("B", d(5)): None}
    near = {r.date: r.v for r in joins.nearest(left.where("symbol = 'A'"), right, ["symbol"], ["v"]).collect()}
    assert near == {d(0): 1.0, d(5): 2.0, d(9): 2.0}


def test_next_in_time_for_a_hot_key(spark):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"k": np.where(rng.random(500) < 0.8, "hot", "b"), "t": rng.permutation(500), "v": rng.normal(size=500)})
    got = frame(joins.next_in_time(spark.createDataFrame(pdf), "k", ["t"], F.floor(F.col("t") / 37), ["v"]), "t")
    want = pdf.sort_values("t").groupby("k")["v"].shift(-1).reset_index(drop=True)
    np.testing.assert_allclose(got["next_v"].astype(float), want, equal_nan=True)


def test_week_key_splits_at_new_year(spark):
    days = [dt.date(2019, 12, 25) + dt.timedelta(i) for i in range(400)]
    df = spark.createDataFrame([(x,) for x in days], "date date")
    got = frame(df.select("date", transforms.rebalance_bucket("weekly").alias("w")), "date")
    assert got["w"].tolist() == [x.strftime("%Y-%W") for x in days]


def test_known_regression(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 0.01, (200, 5))
    y = 0.5 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.001, 200)
    pdf = pd.DataFrame(x, columns=estimate.FF5).assign(symbol="A", y=y)
    row = estimate.fit(spark.createDataFrame(pdf), estimate.FF5).first()
    X = np.column_stack([np.ones(200), x])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    res = y - X @ beta
    se = np.sqrt(res @ res / 194 * np.linalg.inv(X.T @ X).diagonal())
    np.testing.assert_allclose([row["alpha"], *[row[f"b_{f}"] for f in estimate.FF5]], beta, rtol=1e-9)
    np.testing.assert_allclose([row["t_alpha"], row["t_SMB"]], [beta[0] / se[0], beta[2] / se[2]], rtol=1e-8)


def test_collinear_factors_fall_back(spark):
    pdf = pd.DataFrame({"symbol": "A", "a": np.arange(60.0), "b": 2 * np.arange(60.0), "y": 3 * np.arange(60.0)})
    row = estimate.fit(spark.createDataFrame(pdf), ["a", "b"]).first()
    assert abs(row["b_a"] + 2 * row["b_b"] - 3) < 1e-9


def test_student_p_against_integration():
    def tail(t, v):
        x = np.linspace(0, t, 200_001)
        c = math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(v * math.pi)
        y = c * (1 + x * x / v) ** (-(v + 1) / 2)
        return 1 - 2 * float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())

    for t, v in itertools.product([0.1, 1.0, 2.5, 6.0], [2.0, 10.0, 250.0]):
        assert abs(student_p(np.array([t]), np.array([v]))[0] - tail(t, v)) < 1e-8


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.03), ("d", 0.5), ("e", None)], "feature string, p_value double")
    got = {r.feature: (r.p_adjusted, r.significant) for r in estimate.fdr(df).collect()}
    assert [got[x][1] for x in "abcde"] == [True, True, True, False, False]
    assert got["b"][0] == pytest.approx(0.04) and got["e"][0] is None


def test_pair_moments_across_blocks(spark):
    rng = np.random.default_rng(8)
    x = pd.DataFrame(rng.normal(size=(300, 9)), columns=list("ABCDEFGHI")).mask(rng.random((300, 9)) < 0.2)
    long = x.reset_index().melt("index", var_name="symbol", value_name="v").dropna()
    long["date"] = [DAY0 + dt.timedelta(int(i)) for i in long["index"]]
    df = spark.createDataFrame(long[["symbol", "date", "v"]])
    m = pairs.pair_moments(df, "v", per_block=2, dates_per_chunk=64).toPandas()
    assert len(m) == 45 and (m.s1 <= m.s2).all()
    for r in m.itertuples():
        ok = x[r.s1].notna() & x[r.s2].notna()
        assert r.n == ok.sum() and r.sxy == pytest.approx((x[r.s1] * x[r.s2])[ok].sum()) and r.sx == pytest.approx(x[r.s1][ok].sum())
        assert r.syy == pytest.approx((x[r.s2][ok] ** 2).sum())
    for how in ("spearman", "kendall"):
        got = pairs.rank_correlations(df, "v", how, per_block=3).toPandas()
        for r in got.sample(12, random_state=1).itertuples():
            y = x[[r.s1, r.s2]].dropna().to_numpy()
            a, b = y[:, 0], y[:, 1]
            if how == "spearman":
                want = np.corrcoef(a.argsort().argsort(), b.argsort().argsort())[0, 1]
            else:
                i, j = np.triu_indices(len(a), 1)
                want = (np.sign(a[i] - a[j]) * np.sign(b[i] - b[j])).mean()
            assert r.corr == pytest.approx(want)


def test_mean_variance_against_brute_force(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(3, 3))
    c, mu = a @ a.T * 0.3, np.array([0.3, 0.1, 0.25])
    sel = spark.createDataFrame([("s", DAY0, n, float(m), g) for n, m, g in zip("ABC", mu, ["x", "x", "y"])], "strategy string, date date, symbol string, signal double, size string")
    cov = spark.createDataFrame([("ABC"[i], "ABC"[j], float(c[i, j])) for i in range(3) for j in range(i, 3)], "s1 string, s2 string, cov double")
    grid = [np.array([i, j, 200 - i - j]) / 200 for i in range(201) for j in range(201 - i)]
    for cap, limits in ((1.0, []), (0.5, []), (0.7, [("size", "x", 0.55)])):
        got = {r.symbol: r.weight for r in portfolio.mean_variance(sel, cov, cap=cap, limits=limits).collect()}
        w = np.array([got[x] for x in "ABC"])
        value = lambda z: mu @ z - z @ c @ z
        ok = [z for z in grid if z.max() <= cap + 1e-9 and (not limits or z[0] + z[1] <= 0.55 + 1e-9)]
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= -1e-9 and w.max() <= cap + 1e-9
        assert not limits or w[0] + w[1] <= 0.55 + 1e-6
        assert value(w) >= max(value(z) for z in ok) - 1e-9


def test_optimiser_never_relaxes_its_limits(spark):
    def solve(names, **limits):
        sel = spark.createDataFrame([("s", DAY0, n, m, g) for n, m, g in names], "strategy string, date date, symbol string, signal double, size string")
        cov = spark.createDataFrame([(n, n, 0.1) for n, _, _ in names], "s1 string, s2 string, cov double")
        rows = portfolio.mean_variance(sel, cov, **limits).collect()
        return {r.symbol: r.weight for r in rows}, {r.status for r in rows}

    three = [("A", 0.3, "x"), ("B", 0.1, "x"), ("C", 0.25, "x")]
    assert solve(three, cap=0.1) == ({"A": None, "B": None, "C": None}, {"infeasible"})
    assert solve(three, cap=0.5, limits=[("size", "x", 0.4)])[1] == {"infeasible"}
    assert solve(three, limits=[("size", "y", 0.4, 0.2)])[1] == {"infeasible"}  # a least weight without names
    got, status = solve([*three, ("D", 0.0, "y")], cap=0.6, limits=[("size", "y", 0.5, 0.2)])
    assert status == {"optimal"} and abs(got["D"] - 0.2) < 1e-6 and abs(sum(got.values()) - 1) < 1e-9
    got, status = solve([("A", 1.0, "x"), ("B", 0.0, "x")], cap=1.5, low=-0.5)  # closed form of two names, clipped at the bounds
    assert status == {"optimal"} and abs(got["A"] - 1.5) < 1e-9 and abs(got["B"] + 0.5) < 1e-9
    got, _ = solve([("A", 0.1, "x"), ("B", 0.0, "x")])
    assert abs(got["A"] - 0.75) < 1e-9  # mu difference / (risk aversion * 2 * variance) + 1 / 2


def test_bars_order_fills_by_full_keys(spark):
    from factorframe.sources.panel import Panel

    p = Panel(spark, "/root/testdata/sf0.001")
    rows = [("S", DAY0, float(10 * line + key % 7), 5, line, 3 + key * 2**20) for line in (1, 8, 9, 17) for key in (0, 1, 2)]
    p.__dict__["fills"] = spark.createDataFrame([(s, d, px, o, line, key, 1.0) for s, d, px, o, line, key in rows],
                                                "symbol string, date date, px double, l_orderkey long, l_linenumber int, l_partkey long, l_quantity double")
    bar = p.bars.first()
    ordered = sorted(rows, key=lambda r: r[3:])
    assert bar.open == ordered[0][2] and bar.close == ordered[-1][2]


def test_prediction_log_drops_old_rows(spark, tmp_path):
    from factorframe.streaming import monitor

    at = lambda day, n: (dt.datetime(2024, 1, 1) + dt.timedelta(day), f"p{n}")
    batch = spark.createDataFrame([at(0, 1), at(12, 2), at(20, 3), at(20, 3)], "ts timestamp, prediction_id string")
    assert sorted(r.prediction_id for r in monitor.prediction_log(batch, 10).collect()) == ["p2", "p3"]
    late = spark.createDataFrame([at(1, 4), at(15, 5)], "ts timestamp, prediction_id string")
    spark.createDataFrame([at(0, 1), at(20, 3), at(20, 3)], batch.schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    seen = []

    def run():
        q = monitor.prediction_log(stream, 10).writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(
            lambda df, _: seen.extend(r.prediction_id for r in df.collect())).start()
        q.awaitTermination()

    run()
    late.coalesce(1).write.parquet(f"{tmp_path}/in/b")
    run()
    assert sorted(seen) == ["p1", "p3", "p5"]  # p4 is older than the watermark


def test_position_ledger_against_a_loop(spark):
    rng = np.random.default_rng(10)
    n = 1500
    side = np.where(rng.random(n) < 0.55, "BUY", "SELL")
    qty, price = rng.integers(1, 60, n).astype(float), rng.uniform(5, 500, n)
    df = spark.createDataFrame([("A", DAY0 + dt.timedelta(i), str(side[i]), float(qty[i]), float(price[i])) for i in range(n)],
                               "symbol string, date date, side string, quantity double, price double")
    got = frame(analytics.position_ledger(df), "date")
    q = cost = 0.0
    for i in range(n):
        if side[i] == "BUY":
            cost = (q * cost + qty[i] * price[i]) / (q + qty[i])
            q += qty[i]
        else:
            q -= qty[i]
            if q < 0:
                q = cost = 0.0
        assert got["quantity"][i] == pytest.approx(q, abs=1e-9) and got["average_cost"][i] == pytest.approx(cost, rel=1e-9, abs=1e-9), i


def test_fitted_strategy_weights(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 0.01, (300, 3))
    y = 0.6 * x[:, 0] + 0.4 * x[:, 1]
    days = [DAY0 + dt.timedelta(i) for i in range(300)]
    r = spark.createDataFrame([(s, d, float(x[i, j])) for j, s in enumerate("abc") for i, d in enumerate(days)], "strategy string, date date, daily_return double")
    t = spark.createDataFrame([(d, float(v)) for d, v in zip(days, y)], "date date, target_return double")
    for method, pen in (("lasso", 1e-9), ("ridge", 1e-9)):
        w = {q.strategy: q.weight for q in signals.fit_weights(r, t, method, pen).collect()}
        assert w["a"] == pytest.approx(0.6, abs=1e-3) and w["b"] == pytest.approx(0.4, abs=1e-3) and w["c"] == pytest.approx(0, abs=1e-3)


def test_lasso_that_leaves_no_weight_has_nothing_to_scale(spark):
    rng = np.random.default_rng(11)
    days = [DAY0 + dt.timedelta(i) for i in range(50)]
    x = rng.normal(0, 1e-4, (50, 2))
    r = spark.createDataFrame([(s, d, float(x[i, j])) for j, s in enumerate("ab") for i, d in enumerate(days)], "strategy string, date date, daily_return double")
    t = spark.createDataFrame([(d, float(v)) for d, v in zip(days, x.mean(axis=1))], "date date, target_return double")
    assert all(np.isnan(q.weight) for q in signals.fit_weights(r, t, "lasso", 1e-7).collect())  # 0 / 0 in its SQL too
    assert sum(q.weight for q in signals.fit_weights(r, t, "lasso", 1e-10).collect()) == pytest.approx(1)
    assert all(q.weight is None for q in signals.fit_weights(r, t, "lasso", 1e-10, rounds=1).collect())


def test_weights_sum_to_one_and_residuals_are_orthogonal(spark):
    rng = np.random.default_rng(12)
    s = spark.createDataFrame([("x", DAY0 + dt.timedelta(i), n, float(v)) for i in range(5) for n, v in zip("ABCD", rng.normal(size=4))], "strategy string, date date, symbol string, signal double")
    w = signals.long_only(s).groupBy("date").agg(F.sum("weight").alias("t")).toPandas()
    assert np.allclose(w["t"], 1)
    pdf = pd.DataFrame(rng.normal(size=(80, 3)), columns=["MKT", "SMB", "y"]).assign(symbol="A", date=[DAY0 + dt.timedelta(i) for i in range(80)])
    f = spark.createDataFrame(pdf)
    res = estimate.residuals(f, estimate.fit(f, ["MKT", "SMB"]), ["MKT", "SMB"]).toPandas()
    assert abs((res["residual"] * res["MKT"]).sum()) < 1e-9 and abs(res["residual"].sum()) < 1e-9


def test_significance_repeats_and_finds_a_real_edge(spark):
    rng = np.random.default_rng(13)
    rows = [(s, DAY0 + dt.timedelta(i), float(rng.normal(m, 0.01))) for s, m in (("edge", 0.002), ("none", 0.0)) for i in range(500)]
    df = spark.createDataFrame(rows, "strategy string, date date, daily_return double")
    a = {r.strategy: r.p_value for r in analytics.significance(df, draws=400).collect()}
    b = {r.strategy: r.p_value for r in analytics.significance(df.repartition(3), draws=400).collect()}
    assert a == b and a["edge"] < 0.01 and a["none"] > 0.05


def test_draws_are_even_and_apart():
    keys = analytics.draw_keys(np.arange(400), 500, 42)
    hits = np.bincount((keys % 500).ravel(), minlength=500)
    assert abs(((hits - 400) ** 2 / 400).sum() - 499) < 6 * (2 * 499) ** 0.5  # chi-square of even draws
    x = (keys / analytics.DRAW_PRIME) - 0.5
    for a, b in ((x[1:], x[:-1]), (x[:, 1:], x[:, :-1]), (x[7:, 3:], x[:-7, :-3])):
        assert abs((a * b).mean() * 12) < 5 / a.size**0.5
    assert abs(x.mean(1).std() * (12 * 500) ** 0.5 - 1) < 0.2
    first = np.argsort(keys, axis=1)[:, 0]
    assert len(set(first.tolist())) > 250  # permutations start anywhere
    con = duckdb.connect()
    sql = f"SELECT {analytics.draw_keys_sql('d', 'i', 42)} FROM (SELECT unnest(range(3)) AS d), (SELECT unnest(range(9)) AS i) ORDER BY d, i"
    assert [r[0] for r in con.execute(sql).fetchall()] == keys[:3, :9].ravel().tolist()


def test_significance_of_every_figure_equals_plain_numpy(spark):
    rng = np.random.default_rng(14)
    r, b = rng.normal(0.001, 0.01, 60), rng.normal(0, 0.01, 60)
    day = lambda i: DAY0 + dt.timedelta(int(i))
    rows = [("s", day(i), float(r[i])) for i in rng.permutation(60)] + [("s", day(60), None), ("one", day(0), 0.01)]
    df = spark.createDataFrame(rows, "strategy string, date date, daily_return double")
    bench = spark.createDataFrame([(day(i), float(b[i])) for i in range(60)], "date date, bench_return double")
    keys, year = analytics.draw_keys(np.arange(50), 60, 42), 252**0.5
    ratio = lambda x: x.mean() / x.std(ddof=1) * year
    ex = lambda x: x - 0.02 / 252
    figures = {
        "sharpe": (lambda x: ratio(ex(x)), 0.02 / 252), "sortino": (lambda x: ex(x).mean() / ex(x)[ex(x) < 0].std(ddof=1) * year, 0.02 / 252),
        "total_return": (lambda x: (1 + x).prod() - 1, 0), "alpha": (lambda x: (1 + x).prod() - (1 + b).prod(), b.mean()), "information_ratio": (lambda x: ratio(x - b), None)}
    for metric, (figure, shift) in figures.items():
        null = [figure(r[np.argsort(k, kind="stable")] if shift is None else (r - r.mean() + shift)[k % 60]) for k in keys]
        want = (figure(r), np.mean(null), np.std(null, ddof=1), np.quantile(null, 0.95), np.mean(np.array(null) >= figure(r)))
        against = bench if metric in ("alpha", "information_ratio") else None
        got = {x.strategy: x for x in analytics.significance(df, against, metric, draws=50, per_task=7).collect()}
        assert np.allclose(got["s"][1:], want, atol=1e-9) and all(np.isfinite(got["one"][1:]))


def test_drift_flags_a_shifted_feature(spark):
    rng = np.random.default_rng(14)
    make = lambda m: spark.createDataFrame(pd.DataFrame({"feature": "f", "value": rng.normal(m, 1, 600)}).assign(feature=np.repeat(["f", "g"], 300)))
    same = {r.feature: r.drift_detected for r in monitor.drift(make(0), make(1.0)).collect()}
    assert same == {"f": True, "g": True}


def test_duplicate_and_outlier_cleaning(spark):
    df = spark.createDataFrame([(float(i), 1.0 * (i % 3)) for i in range(40)] + [(1e6, 1.0), (5.0, 2.0)], "a double, b double")
    out = quality.clean(df, ["a", "b"]).toPandas()
    assert len(out) == 40 and out["a"].max() == 39


def test_interpolation_stays_inside_a_symbol(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 2, None), ("A", 3, 3.0), ("A", 4, None), ("B", 1, None), ("B", 2, 8.0)], "symbol string, date int, v double")
    out = frame(transforms.fill(df, "v", "interpolate"), "symbol", "date")["v"]
    assert out.tolist()[:4] == [1.0, 2.0, 3.0, 3.0] and math.isnan(out[4]) and out[5] == 8.0


def test_strict_box_gate_raises(spark):
    df = spark.createDataFrame([("x", 1)], "box string, n int")
    with pytest.raises(Exception, match="box below minimum"):
        universe.box_gate(df, df, "box", 2, strict=True).collect()


def test_universe_gates_and_padding(spark, tmp_path):
    path = str(tmp_path / "universe.csv")
    rows = ["ticker,country_code,source_sheet,weight,yfinance_ticker", "5,HK, A ,3,", "0700,HK,A,2,", "12345,HK,A,9,", "abc.JP,,B,1,", "xyz,GR,B,4,own.LN", ",GR,B,5,lost.DE", "5,HK,A,1,"]
    (tmp_path / "universe.csv").write_text("\n".join(rows) + "\n")
    names = lambda **f: sorted(r.symbol for r in io.read_universe(spark, path, f).collect())
    assert names() == ["0005.HK", "0700.HK", "12345.HK", "ABC.T", "OWN.L"]
    assert names(include_boxes=["A", "B"], per_box_min_n=3) == names()
    assert names(include_boxes=["A"], per_box_top_n=2) == ["0005.HK", "12345.HK"]
    assert names(include_boxes=["A", "C"], per_box_min_n=1, fail_fast=False) == ["0005.HK", "0700.HK", "12345.HK"]
    for filters, said in (({"include_boxes": ["A", "C"], "per_box_min_n": 1}, "C"), ({"include_boxes": ["A", "B"], "per_box_min_n": 4}, "B"), ({"min_weight": 100}, "no symbol")):
        with pytest.raises(ValueError, match=said):
            names(**filters)
    (tmp_path / "plain.csv").write_text("ticker\nabc\n")
    with pytest.raises(ValueError, match="source_sheet"):
        io.read_universe(spark, str(tmp_path / "plain.csv"), {"include_boxes": ["A"]})
    got = spark.createDataFrame([("a ", "tt"), ("b", "v"), (" ", "US"), (None, None), ("c", "ZZ")], "t string, k string")
    got = [r[0] for r in got.select(universe.provider_candidates("t", "k", {"ZZ": ".Z"})).collect()]
    assert got == [["A.TW", "A.TWO", "A"], ["B.V", "B.TO", "B"], [], [], ["C.Z", "C"]]
