"""Portfolio construction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorframe.functions import joins, ranks
from factorframe.functions.windows import c, ratio

DAY = ("strategy", "date")


def select_in_boxes(signals: DataFrame, boxes: DataFrame, n=3, minimum=1, by=DAY) -> DataFrame:
    """Top n names by signal of every box and date (symbol order on ties); boxes with fewer than ``minimum`` go.

    boxes(symbol, box); a name without a signal sorts last, so a box without any yields its first n names.
    """
    by = list(by)
    df = signals.join(boxes.select("symbol", "box"), "symbol")
    top = ranks.top_n(df, [*by, "box"], [F.desc_nulls_last("signal"), F.asc("symbol")], n, "position")
    if minimum > 1:
        sizes = top.groupBy(*by, "box").agg(F.count(F.lit(1)).alias("_n")).where(c("_n") >= minimum)
        top = top.join(sizes.select(*by, "box"), [*by, "box"], "left_semi")
    return top.select(*by, "box", "symbol", "signal")


def equal_box_targets(spark: SparkSession, dims: dict[str, list[str]]) -> DataFrame:
    """The same target for every combination of classes; a table of product-of-lists rows."""
    names = list(dims)
    total = int(np.prod([len(v) for v in dims.values()]))
    df = spark.range(1).select(*[F.explode(F.array(*[F.lit(v) for v in dims[names[0]]])).alias(names[0])])
    for d in names[1:]:
        df = df.withColumn(d, F.explode(F.array(*[F.lit(v) for v in dims[d]])))
    return df.select(F.concat_ws("_", *names).alias("box"), F.lit(1.0 / total).alias("target"))


def with_targets(df: DataFrame, targets: DataFrame, unknown=1.0) -> DataFrame:
    """Target weight of each row's box; an unknown box gets ``unknown``."""
    return df.join(targets.select("box", "target"), "box", "left").withColumn("target", F.coalesce("target", F.lit(float(unknown))))


def coverage(boxes: DataFrame, targets: DataFrame) -> DataFrame:
    """(box, status, stocks, target): covered, no_target or no_stocks."""
    have = boxes.groupBy("box").agg(F.count(F.lit(1)).alias("stocks"))
    out = have.join(targets.select("box", "target"), "box", "full_outer")
    status = F.when(c("stocks").isNull(), "no_stocks").when(c("target").isNull(), "no_target").otherwise("covered")
    return out.select("box", status.alias("status"), F.coalesce("stocks", F.lit(0)).alias("stocks"), F.coalesce("target", F.lit(0.0)).alias("target"))


def equal_in_box(selected: DataFrame, by=DAY) -> DataFrame:
    """The box target in equal parts."""
    out = ranks.with_group_stats(selected, [*by, "box"], _n=F.count(F.lit(1)))
    return out.select(*by, "box", "symbol", (c("target") / c("_n")).alias("weight"))


def proportional_in_box(selected: DataFrame, by=DAY, threshold=1e-6) -> DataFrame:
    """The box target in proportion to the signals above the threshold; equal parts when there is none."""
    above = c("signal") > threshold
    out = ranks.with_group_stats(selected, [*by, "box"], _n=F.count(F.lit(1)), _t=F.sum(F.when(above, c("signal"))))
    weight = F.when(c("_t").isNull(), c("target") / c("_n")).when(above, c("target") * c("signal") / c("_t")).otherwise(0.0)
    return out.select(*by, "box", "symbol", weight.alias("weight"))


def _exchange(mu, q, w, low, cap) -> bool:
    """max mu.w - w.q.w / 2 with the sum of w kept and low <= w <= cap, in place: move weight between the two names that
    gain most.  True if no move gains any more."""
    g = mu - q @ w
    for _ in range(200 * len(w)):
        i = int(np.argmax(np.where(w < cap - 1e-12, g, -np.inf)))
        j = int(np.argmin(np.where(w > low + 1e-12, g, np.inf)))
        gain = g[i] - g[j]
        if not gain > 1e-10:
            return True
        curve = q[i, i] + q[j, j] - 2 * q[i, j]
        d = min(cap - w[i], w[j] - low, gain / curve if curve > 1e-15 else np.inf)
        w[i] += d
        w[j] -= d
        g -= d * (q[:, i] - q[:, j])
    return False


def _feasible(n, total, low, cap, classes) -> bool:
    """Whether bounds and the class limits of each dimension alone can be met; classes: dimension -> [(mask, most, least)]."""
    if not n * low - 1e-9 <= total <= n * cap + 1e-9:
        return False
    for rules in classes.values():
        rest = n - sum(int(m.sum()) for m, _, _ in rules)
        most = rest * cap + sum(min(hi, m.sum() * cap) for m, hi, _ in rules)
        least = rest * low + sum(max(lo, m.sum() * low) for m, _, lo in rules)
        if least > total + 1e-9 or most < total - 1e-9 or any(max(lo, m.sum() * low) > min(hi, m.sum() * cap) + 1e-9 for m, hi, lo in rules):
            return False
    return True


def _mean_variance(mu, cov, risk_aversion, total, low, cap, classes) -> tuple[str, np.ndarray]:
    """Status and mean-variance weights; class limits enter as penalties with multipliers and slack."""
    n = len(mu)
    w, q = np.full(n, total / n), risk_aversion * cov
    if not _feasible(n, total, low, cap, classes):
        return "infeasible", w
    rows = [(m, hi) for rules in classes.values() for m, hi, _ in rules if np.isfinite(hi)]
    rows += [(-m, -lo) for rules in classes.values() for m, _, lo in rules if np.isfinite(lo)]
    if not rows:
        return ("optimal" if _exchange(mu, q, w, low, cap) else "not_converged"), w
    m, lim = np.stack([x for x, _ in rows]), np.array([x for _, x in rows])
    rho = max(1.0, float(np.abs(mu).max()))
    slack, u = np.maximum(lim - m @ w, 0), np.zeros(len(lim))
    for _ in range(500):
        done = _exchange(mu - rho * m.T @ (slack - lim + u), q + rho * m.T @ m, w, low, cap)
        slack = np.maximum(lim - m @ w - u, 0)
        miss = m @ w + slack - lim
        u += miss
        if done and np.abs(miss).max() < 1e-9:
            return "optimal", w
    return "not_converged", w


def mean_variance(selected: DataFrame, cov: DataFrame, by=DAY, group: str | None = None, risk_aversion=2.0, cap=1.0,
                  limits: list[tuple] = (), default_variance=0.04, low=0.0) -> DataFrame:
    """Mean-variance weights of every date (and box, with ``group``) in one job, with their status.

    selected(strategy, date, symbol, signal[, target, dims]) holds the chosen names of a
    date (W1 or W9, so a bounded number); cov(s1, s2, cov) has s1 <= s2.  A group
    reaches one task with its names and their covariances.  Weights lie in [low, cap];
    a negative ``low`` allows short positions.  ``limits`` are (dimension column, class, most[, least]) on
    the weight of a class.  Where bounds and limits cannot be met (``infeasible``) or the iteration
    has not ended (``not_converged``) the weights are null: nothing is relaxed.
    """
    keys = list(by) + ([group] if group else [])
    full = cov.select("s1", "s2", "cov").unionByName(cov.where("s1 <> s2").select(c("s2").alias("s1"), c("s1").alias("s2"), "cov"))
    # the chosen names of a date meet each other first; toDF gives each use of the selection its own columns
    own, partner = selected.select(*keys, "symbol").toDF(*keys, "symbol"), selected.select(*keys, "symbol").toDF(*keys, "s2")
    need = own.join(partner, keys).join(full.withColumnRenamed("s1", "symbol"), ["symbol", "s2"])
    need = need.toDF(*need.columns)
    dims = sorted({x[0] for x in limits})
    total = c("target") if "target" in selected.columns else F.lit(1.0)
    name = F.struct("symbol", F.coalesce("signal", F.lit(0.0)).alias("signal"), total.cast("double").alias("total"), *dims)
    # one row per group: its few chosen names and their covariances as arrays
    names = selected.groupBy(*keys).agg(F.array_sort(F.collect_list(name)).alias("_n"))
    pairs = need.groupBy(*keys).agg(F.collect_list(F.struct("symbol", "s2", "cov")).alias("_p"))
    rows = names.join(pairs.toDF(*pairs.columns), keys, "left").select(
        *keys, *[c(f"_n.{x}").alias(f"_{x}") for x in ("symbol", "signal", "total", *dims)],
        c("_p.symbol").alias("_s1"), c("_p.s2").alias("_s2"), c("_p.cov").alias("_cov"))
    fields = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def weigh(r) -> tuple[str, np.ndarray]:
        s = list(r["_symbol"])
        at = {x: i for i, x in enumerate(s)}
        m = np.diag(np.full(len(s), default_variance))
        if r["_s1"] is not None:
            for x, y, v in zip(r["_s1"], r["_s2"], r["_cov"]):
                m[at[x], at[y]] = v
        classes: dict[str, list] = {}
        for d, v, most, *least in limits:
            mask = np.array([float(x == v) for x in r[f"_{d}"]])
            if mask.any() or (least and least[0] > 0):
                classes.setdefault(d, []).append((mask, most, least[0] if least else -np.inf))
        return _mean_variance(np.asarray(r["_signal"], dtype=float), m, risk_aversion, float(r["_total"][0]), low, cap, classes)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                status, weights = weigh(r)
                out += [{**{k: r[k] for k in keys}, "symbol": x, "weight": w if status == "optimal" else None, "status": status}
                        for x, w in zip(r["_symbol"], weights)]
            yield pd.DataFrame(out, columns=[*keys, "symbol", "weight", "status"])

    return rows.mapInPandas(run, f"{fields}, symbol string, weight double, status string")


def _bounded(weights: DataFrame, low: float, cap: float) -> DataFrame:
    """Null weights where equal shares of 1 break the bounds, as the optimiser answers limits that cannot be met."""
    return weights.withColumn("weight", F.when(c("weight").between(low - 1e-9, cap + 1e-9), c("weight")))


def equal_weight(df: DataFrame, by=DAY, low=0.0, cap=1.0) -> DataFrame:
    """Equal shares; null where they leave [low, cap]."""
    return _bounded(ranks.with_group_stats(df, list(by), _n=F.count(F.lit(1))).select(*by, "symbol", (1 / c("_n")).alias("weight")), low, cap)


def top_n_weight(df: DataFrame, n=10, by=DAY, low=0.0, cap=1.0) -> DataFrame:
    """Equal shares of the n strongest names; null where they leave [low, cap]."""
    return equal_weight(ranks.top_n(df, list(by), [F.desc_nulls_last("signal"), F.asc("symbol")], n), by, low, cap)


def exposure_check(weights: DataFrame, classes: DataFrame, limits: DataFrame, dims=("size", "style", "region", "sector"), by=DAY) -> DataFrame:
    """Weight per date, dimension and class against limits(dimension, value, cap)."""
    tagged = weights.join(classes, "symbol").select(*by, "weight", F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), c(d).alias("value")) for d in dims])).alias("k")).select(*by, "weight", "k.*")
    sums = tagged.groupBy(*by, "dimension", "value").agg(F.sum("weight").alias("exposure"))
    return sums.join(limits, ["dimension", "value"]).withColumn("within", c("exposure") <= c("cap") + 1e-9)


def strongest(signals: DataFrame, n=20, by=DAY) -> DataFrame:
    """N largest absolute signals per date."""
    return ranks.top_n(signals, list(by), [F.desc_nulls_last(F.abs("signal")), F.asc("symbol")], n)


def sample_boxes(names: DataFrame, signals: DataFrame | None, n=3, seed=42) -> DataFrame:
    """N names per box(symbol, box): by signal where the box has signals, else by a repeatable random order."""
    df = names if signals is None else names.join(signals.select("symbol", "signal"), "symbol", "left")
    if signals is None:
        df = df.withColumn("signal", F.lit(None).cast("double"))
    order = [F.desc_nulls_last("signal"), F.md5(F.concat_ws("|", "symbol", F.lit(str(seed)))).asc(), F.asc("symbol")]
    return ranks.top_n(df, ["box"], order, n).select("box", "symbol", "signal")


def normalized(weights: DataFrame, by=DAY) -> DataFrame:
    """Weights over their sum; all zero when the sum is."""
    out = ranks.with_group_stats(weights, list(by), _t=F.sum("weight"))
    return out.withColumn("weight", F.when(F.abs("_t") < 1e-6, 0.0).otherwise(c("weight") / F.nullif(c("_t"), F.lit(0.0)))).drop("_t")


def constrained(weights: DataFrame, minimum=0.0, max_leverage: float | None = 1.0, maximum: float | None = None, by=DAY, rounds=1) -> DataFrame:
    """Drop small weights, scale to the leverage, normalise, clip at the maximum, normalise.

    One clip leaves room above the cap after the last step; more ``rounds`` close it.
    """
    out = weights.where(c("weight") >= minimum) if minimum > 0 else weights
    if max_leverage is not None:
        out = ranks.with_group_stats(out, list(by), _t=F.sum("weight"))
        out = out.withColumn("weight", F.when(c("_t") > max_leverage, c("weight") * max_leverage / c("_t")).otherwise(c("weight"))).drop("_t")
    out = normalized(out, by)
    for _ in range(rounds if maximum is not None else 0):
        out = normalized(out.withColumn("weight", F.least("weight", F.lit(maximum))), by)
    return out


def weight_totals(weights: DataFrame, max_gross=1.0, tolerance=1e-6, by=DAY) -> DataFrame:
    """Gross and net exposure per date with verdicts."""
    out = weights.groupBy(*by).agg(F.sum(F.abs("weight")).alias("gross"), F.sum("weight").alias("net"))
    return out.select("*", (c("gross") <= max_gross + tolerance).alias("gross_ok"), (F.abs(c("net") - 1) <= tolerance).alias("net_ok"))


def carried(weights: DataFrame, dates: DataFrame, key="strategy") -> DataFrame:
    """Weights of the last rebalance at or before each date, of the first one before that, renormalised.

    Only the distinct rebalance dates are matched in time; the weights follow by an equality join.
    """
    marks = weights.select(key, "date").distinct().withColumn("rebalance", c("date"))
    grid = dates.select("date").distinct()
    keys = weights.select(key).distinct().withColumn("_k", F.lit(0))
    days = grid.agg(F.sort_array(F.collect_set("date")).alias("_days")).withColumn("_k", F.lit(0))
    grid = keys.join(F.broadcast(days), "_k").select(key, F.explode("_days").alias("date"))
    first = marks.groupBy(key).agg(F.min("rebalance").alias("_first"))
    at = joins.asof(grid, marks, [key], ["rebalance"]).join(first, key)
    at = at.select(key, "date", F.coalesce("rebalance", "_first").alias("rebalance"))
    out = at.join(weights.withColumnRenamed("date", "rebalance"), [key, "rebalance"]).select(key, "date", "symbol", "weight")
    return normalized(out, (key, "date"))


def recommendations(weights: DataFrame, signals: DataFrame, classes: DataFrame, by=DAY) -> DataFrame:
    """Held names with signal, box and risk score, strongest weight first."""
    out = weights.where("weight > 0").join(signals.select(*by, "symbol", "signal"), [*by, "symbol"], "left").join(classes, "symbol", "left")
    s = F.coalesce("signal", F.lit(0.0))
    return out.select(*by, "symbol", "weight", s.alias("signal_strength"), (0.5 * F.abs(s)).alias("risk_score"), "box").orderBy(
        *by, F.desc("weight"), "symbol")


def outlook(weights: DataFrame, signals: DataFrame, by=DAY) -> DataFrame:
    """Expected return, risk and diversification per date."""
    out = weights.join(signals.select(*by, "symbol", "signal"), [*by, "symbol"], "left").where("weight > 0")
    return out.groupBy(*by).agg(
        (F.sum(c("weight") * F.coalesce("signal", F.lit(0.0))) * 252).alias("expected_return"),
        (F.sqrt(F.sum(c("weight") * c("weight"))) * 0.2).alias("expected_risk"),
        F.least(F.count(F.lit(1)) / 10, F.lit(1.0)).alias("diversification"), F.count(F.lit(1)).alias("positions"))
