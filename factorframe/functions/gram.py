"""Least squares of any number of groups: moments by hash aggregation, one small solve per group.

The moments are Spark's mergeable covariances (centred, so well conditioned);
only one row per group reaches Python, where a batch of groups is solved with
stacked numpy matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moment_columns(xs: list[str], y: str) -> list[Column]:
    out = [F.count(F.lit(1)).cast("double").alias("_n"), F.avg(y).alias("_my"), (F.var_pop(y)).alias("_syy")]
    out += [F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)]
    out += [F.covar_pop(x, y).alias(f"_y{i}") for i, x in enumerate(xs)]
    out += [F.covar_pop(xs[i], xs[j]).alias(f"_x{i}_{j}") for i in range(len(xs)) for j in range(i + 1)]
    return out


def gram(df: DataFrame, keys: list[str], xs: list[str], y: str) -> DataFrame:
    """Means and population covariances of the complete rows, one row per group."""
    return df.dropna(subset=xs + [y]).groupBy(*keys).agg(*moment_columns(xs, y))


def _unpack(pdf: pd.DataFrame, k: int):
    n = pdf["_n"].to_numpy()
    mx = np.stack([pdf[f"_m{i}"].to_numpy() for i in range(k)], axis=1) if k else np.zeros((len(pdf), 0))
    sxy = np.stack([pdf[f"_y{i}"].to_numpy() for i in range(k)], axis=1) if k else np.zeros((len(pdf), 0))
    sxx = np.empty((len(pdf), k, k))
    for i in range(k):
        for j in range(i + 1):
            sxx[:, i, j] = sxx[:, j, i] = pdf[f"_x{i}_{j}"].to_numpy()
    return n, mx, pdf["_my"].to_numpy(), sxx, sxy, pdf["_syy"].to_numpy()


def _inverse(m: np.ndarray) -> np.ndarray:
    if not len(m):
        return m
    bad = np.linalg.cond(m) > 1e12
    inv = np.empty_like(m)
    if (~bad).any():
        inv[~bad] = np.linalg.inv(m[~bad])
    if bad.any():
        inv[bad] = np.linalg.pinv(m[bad], rcond=1e-12, hermitian=True)
    return inv


def solve(moments: DataFrame, keys: list[str], xs: list[str], *, ridge: float | str = 0.0, standardize: bool = False,
          t_stats: bool = True) -> DataFrame:
    """alpha, b_{x}, r2, rss, n and (for plain least squares) t_alpha, p_alpha, t_{x}.

    ``ridge`` is the penalty on the slopes (the intercept is free), a number or
    the name of a column of ``moments`` so that a grid of penalties shares one pass.
    With ``standardize`` the slopes are on unit-variance regressors.
    """
    k = len(xs)
    fields = [moments.schema[key] for key in keys]
    names = ["n", "alpha"] + [f"b_{x}" for x in xs] + ["r2", "rss"]
    if t_stats:
        names += ["t_alpha", "p_alpha"] + [f"t_{x}" for x in xs] + [f"p_{x}" for x in xs]
    schema = T.StructType(
        fields + [T.StructField(x, T.LongType() if x == "n" else T.DoubleType()) for x in names]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            n, mx, my, sxx, sxy, syy = _unpack(pdf, k)
            if standardize:
                sd = np.sqrt(np.diagonal(sxx, axis1=1, axis2=2))
                sd = np.where(sd > 0, sd, 1.0)
                sxx = sxx / (sd[:, :, None] * sd[:, None, :])
                sxy = sxy / sd
                mx = np.zeros_like(mx)
            lam = pdf[ridge].to_numpy() if isinstance(ridge, str) else np.full(len(pdf), float(ridge))
            inv = _inverse(sxx + (lam / n)[:, None, None] * np.eye(k))
            beta = np.einsum("gij,gj->gi", inv, sxy)
            alpha = my - np.einsum("gi,gi->g", beta, mx)
            rss = n * (syy - 2 * np.einsum("gi,gi->g", beta, sxy) + np.einsum("gi,gij,gj->g", beta, sxx, beta))
            rss = np.maximum(rss, 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                r2 = np.where(syy > 0, 1 - rss / (n * syy), np.nan)
                out = {key: pdf[key] for key in keys}
                out["n"] = n.astype("int64")
                out["alpha"] = alpha
                out |= {f"b_{x}": beta[:, i] for i, x in enumerate(xs)}
                out["r2"], out["rss"] = r2, rss
                if t_stats:
                    dof = n - k - 1
                    s2 = np.where(dof > 0, rss / dof, np.nan)
                    var_a = s2 / n * (1 + np.einsum("gi,gij,gj->g", mx, inv, mx))
                    t_a = np.where(var_a > 0, alpha / np.sqrt(var_a), np.nan)
                    out["t_alpha"], out["p_alpha"] = t_a, student_p(t_a, dof)
                    var_b = s2[:, None] / n[:, None] * np.diagonal(inv, axis1=1, axis2=2)
                    t_b = np.where(var_b > 0, beta / np.sqrt(var_b), np.nan)
                    out |= {f"t_{x}": t_b[:, i] for i, x in enumerate(xs)}
                    out |= {f"p_{x}": student_p(t_b[:, i], dof) for i, x in enumerate(xs)}
            res = pd.DataFrame(out, index=pdf.index)[[f.name for f in schema.fields]]
            yield res

    return _nan_to_null(moments.mapInPandas(run, schema))


def _nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.nanvl(F.col(f.name), F.lit(None).cast("double")).alias(f.name) if isinstance(f.dataType, T.DoubleType)
          else F.col(f.name) for f in df.schema.fields]
    )


def student_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p-value: regularised incomplete beta I_{v/(v+t^2)}(v/2, 1/2) by its continued fraction."""
    t, dof = np.asarray(t, float), np.broadcast_to(np.asarray(dof, float), np.shape(t)).copy()
    ok = np.isfinite(t) & (dof > 0)
    tt, v = np.where(ok, t, 0.0), np.where(ok, dof, 1.0)
    x = v / (v + tt * tt)
    p = np.where(tt == 0, 1.0, _betainc(v / 2, np.full_like(v, 0.5), x))
    return np.where(ok, p, np.nan)


def _lgamma(a: np.ndarray) -> np.ndarray:
    from math import lgamma

    flat = np.unique(a)
    table = dict(zip(flat.tolist(), [lgamma(z) for z in flat.tolist()]))
    return np.vectorize(table.get, otypes=[float])(a) if a.size else a


def _betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-300, 1 - 1e-16)
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
    tiny = 1e-300
    cc, d = np.ones_like(xx), 1 - (aa + bb) * xx / (aa + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        even = m * (bb - m) * xx / ((aa + 2 * m - 1) * (aa + 2 * m))
        d = 1 / _nz(1 + even * d, tiny)
        cc = _nz(1 + even / cc, tiny)
        h *= d * cc
        odd = -(aa + m) * (aa + bb + m) * xx / ((aa + 2 * m) * (aa + 2 * m + 1))
        d = 1 / _nz(1 + odd * d, tiny)
        cc = _nz(1 + odd / cc, tiny)
        step = d * cc
        h *= step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    res = front * h
    return np.where(flip, 1 - res, res)


def _nz(z, tiny):
    return np.where(np.abs(z) < tiny, tiny, z)
