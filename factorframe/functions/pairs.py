"""Moments of all pairs of names, as a blocked matrix product.

Names are dealt into blocks; a task gets two blocks of names over one chunk of
dates (a bounded number of rows), multiplies two dense matrices and returns one
row per pair.  No row pairs are ever joined: the shuffle carries each input row
once per block, not once per partner.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import c

MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy", "sxxyy"]


def _dealt(df: DataFrame, value: str, key: str, order: str, per_block: int, extra: list):
    """Every row once for each unordered pair of blocks its name takes part in."""
    rows = df.where(c(value).isNotNull()).select(c(key).alias("s"), c(order).alias("d"), c(value).cast("double").alias("v"))
    names = rows.select("s").distinct().count()
    blocks = max(1, -(-names // per_block))
    rows = rows.withColumn("_own", F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int"))
    others = F.array(*[F.lit(i) for i in range(blocks)]) if blocks <= 64 else F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = rows.withColumn("_other", F.explode(others))
    return rows.select("*", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), *extra)


def _matrix(pdf: pd.DataFrame, own: int):
    part = pdf[pdf["_own"] == own]
    return part.pivot(index="d", columns="s", values="v").sort_index()


def pair_moments(df: DataFrame, value: str, key="symbol", order="date", per_block=128, dates_per_chunk=256) -> DataFrame:
    """(s1, s2, n, sx, sy, sxx, syy, sxy, sxxyy) for s1 <= s2 over the dates both have; (name, date) must be unique.

    Values are used as they are; pass returns or demeaned values for well conditioned results.
    """
    chunk = F.floor(F.datediff(c("d"), F.lit("1900-01-01").cast("date")) / dates_per_chunk).cast("int").alias("_chunk")
    dealt = _dealt(df, value, key, order, per_block, [chunk])

    def multiply(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        a = _matrix(pdf, i)
        b = a if i == j else _matrix(pdf, j)
        days = a.index.intersection(b.index)
        out = {k: np.array([], dtype=object) for k in ("s1", "s2")} | {m: np.array([], dtype=float) for m in MOMENTS}
        if len(days):
            xa, xb = a.loc[days].to_numpy(), b.loc[days].to_numpy()
            ma, mb = ~np.isnan(xa), ~np.isnan(xb)
            xa, xb, ma, mb = np.nan_to_num(xa), np.nan_to_num(xb), ma.astype(float), mb.astype(float)
            full = [ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa**2).T @ mb, ma.T @ xb**2, xa.T @ xb, (xa**2).T @ xb**2]
            na, nb = a.columns.to_numpy(dtype=object), b.columns.to_numpy(dtype=object)
            r, s = np.nonzero(full[0] > 0)
            if i == j:
                keep = na[r] <= nb[s]
                r, s = r[keep], s[keep]
            swap = na[r] > nb[s]
            out["s1"], out["s2"] = np.where(swap, nb[s], na[r]).astype(object), np.where(swap, na[r], nb[s]).astype(object)
            for name, (m, t) in zip(MOMENTS, [(0, 0), (1, 2), (2, 1), (3, 4), (4, 3), (5, 5), (6, 6)]):
                out[name] = np.where(swap, full[t][r, s], full[m][r, s])
        return pd.DataFrame(out)

    schema = "s1 string, s2 string, " + ", ".join(f"{m} double" for m in MOMENTS)
    parts = dealt.groupBy("_i", "_j", "_chunk").applyInPandas(multiply, schema)
    return parts.groupBy("s1", "s2").agg(*[F.sum(m).alias(m) for m in MOMENTS])


def covariances(df: DataFrame, value: str, key="symbol", order="date", min_rows=2) -> DataFrame:
    """(s1, s2, n, cov, corr): sample covariance and correlation over common dates; corr null if a side is constant."""
    centre = df.groupBy(key).agg(F.avg(value).alias("_centre"))
    moved = df.select(key, order, value).join(centre, key).withColumn("_v", c(value) - c("_centre"))
    m = pair_moments(moved, "_v", key, order)
    cov = (c("sxy") - c("sx") * c("sy") / c("n")) / (c("n") - 1)
    vx = (c("sxx") - c("sx") * c("sx") / c("n")) / (c("n") - 1)
    vy = (c("syy") - c("sy") * c("sy") / c("n")) / (c("n") - 1)
    m = m.where(c("n") >= min_rows).select("s1", "s2", c("n").cast("long").alias("n"), cov.alias("cov"), vx.alias("_vx"), vy.alias("_vy"))
    tiny = 1e-30
    return m.select("s1", "s2", "n", "cov",
                    F.when((c("_vx") > tiny) & (c("_vy") > tiny), c("cov") / F.sqrt(c("_vx") * c("_vy"))).alias("corr"))


def _average_ranks(x: np.ndarray) -> np.ndarray:
    _, inv, cnt = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(cnt) - (cnt - 1) / 2)[inv]


def _pearson(x, y):
    x, y = x - x.mean(), y - y.mean()
    d = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / d) if d > 0 else None


def _discordant(y: np.ndarray) -> int:
    """Pairs out of order, by merging sorted runs."""
    runs, bad = [y[i:i + 1] for i in range(len(y))], 0
    while len(runs) > 1:
        nxt = []
        for i in range(0, len(runs) - 1, 2):
            l, r = runs[i], runs[i + 1]
            bad += len(l) * len(r) - int(np.searchsorted(l, r, side="right").sum())
            nxt.append(np.sort(np.concatenate([l, r]), kind="stable"))
        if len(runs) % 2:
            nxt.append(runs[-1])
        runs = nxt
    return bad


def _kendall(x, y):
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n = len(x)
    pairs = n * (n - 1) // 2
    ties = lambda v: int((lambda k: (k * (k - 1) // 2).sum())(np.unique(v, return_counts=True, axis=0)[1]))
    tx, ty, txy = ties(x), ties(y), ties(np.stack([x, y], 1))
    d = np.sqrt(float(pairs - tx) * float(pairs - ty))
    s = pairs - tx - ty + txy - 2 * _discordant(y)
    return float(s / d) if d > 0 else None


def rank_correlations(df: DataFrame, value: str, method: str, key="symbol", order="date", per_block=16) -> DataFrame:
    """(s1, s2, n, corr): Spearman or Kendall (tau-b) over common dates.

    Ranks depend on the pair, so a task takes two small blocks of names with all
    their dates, at most 2 * per_block calendars.
    """
    dealt = _dealt(df, value, key, order, per_block, [])
    how = {"spearman": lambda x, y: _pearson(_average_ranks(x), _average_ranks(y)), "kendall": _kendall}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
        a = _matrix(pdf, i)
        b = a if i == j else _matrix(pdf, j)
        days = a.index.intersection(b.index)
        a, b, rows = a.loc[days], b.loc[days], []
        xa, xb = a.to_numpy(), b.to_numpy()
        for p, s in enumerate(a.columns):
            for q, t in enumerate(b.columns):
                if i == j and s > t:
                    continue
                ok = ~np.isnan(xa[:, p]) & ~np.isnan(xb[:, q])
                if ok.sum() >= 2:
                    rows.append((min(s, t), max(s, t), int(ok.sum()), how(xa[ok, p], xb[ok, q])))
        out = pd.DataFrame(rows, columns=["s1", "s2", "n", "corr"])
        return out.astype({"s1": object, "s2": object, "n": "int64", "corr": "float64"})

    return dealt.groupBy("_i", "_j").applyInPandas(run, "s1 string, s2 string, n long, corr double")
