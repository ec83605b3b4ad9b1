"""Column helpers for ordered panels.

A panel has one row per (symbol, date), so the rows behind one symbol are
bounded by the trading calendar (about 252 a year) however large the panel
is; windows keyed by symbol or strategy are therefore safe.  Cross-sections
(all symbols of a date) have no such bound: for those use
``factorframe.functions.ranks`` or an aggregate joined back.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(keys=("symbol",), order=("date",)):
    return Window.partitionBy(*_seq(keys)).orderBy(*_seq(order))


def trailing(n: int, keys=("symbol",), order=("date",)):
    return ordered(keys, order).rowsBetween(-(n - 1), 0)


def running(keys=("symbol",), order=("date",)):
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def whole(keys=("symbol",)):
    return Window.partitionBy(*_seq(keys))


def _seq(x):
    return [x] if isinstance(x, str) else list(x)


def rolling(agg, x, n: int, keys=("symbol",), order=("date",), min_periods: int | None = None) -> Column:
    """Trailing aggregate that is null until ``min_periods`` (default n) values are in the frame."""
    w = trailing(n, keys, order)
    return F.when(F.count(c(x)).over(w) >= (min_periods or n), agg(c(x)).over(w))


def rolling_mean(x, n, **kw) -> Column:
    return rolling(F.avg, x, n, **kw)


def rolling_std(x, n, **kw) -> Column:
    return rolling(F.stddev_samp, x, n, **kw)


def rolling_sum(x, n, **kw) -> Column:
    return rolling(F.sum, x, n, **kw)


def rolling_min(x, n, **kw) -> Column:
    return rolling(F.min, x, n, **kw)


def rolling_max(x, n, **kw) -> Column:
    return rolling(F.max, x, n, **kw)


def ratio(a, b) -> Column:
    """a / b, null when b is 0, so that NaN and infinity never arise."""
    return c(a) / F.nullif(c(b), F.lit(0.0))


def lagged(x, k: int = 1, keys=("symbol",), order=("date",)) -> Column:
    return F.lag(c(x), k).over(ordered(keys, order))


def change(x, k: int = 1, keys=("symbol",), order=("date",)) -> Column:
    """x / lag(x, k) - 1."""
    return ratio(x, lagged(x, k, keys, order)) - 1


def log_change(x, k: int = 1, keys=("symbol",), order=("date",)) -> Column:
    q = ratio(x, lagged(x, k, keys, order))
    return F.when(q > 0, F.ln(q))


def positive_log(x) -> Column:
    x = c(x)
    return F.when(x > 0, F.ln(x))


def frame_rank(values: np.ndarray, seen: np.ndarray, n: int, least: int) -> np.ndarray:
    """Average-method percent rank of each value among the seen values of the n rows up to it; NaN where fewer than
    ``least`` are seen or the row itself is not.

    Rows are cut into blocks of 1, 2, 4, ... rows, each sorted; a frame is at most two blocks of every size, so counting what
    lies below a value takes two binary searches a size.  Time per row grows with log n, not with n.
    """
    size = len(values)
    out = np.full(size, np.nan)
    if not seen.any():
        return out
    distinct, place = np.unique(values[seen], return_inverse=True)
    top = len(distinct) + 1
    code = np.full(size, top - 1, dtype=np.int64)  # rows that are not seen lie above all others
    code[seen] = place
    rows = np.arange(size)
    upto = np.append(0, np.cumsum(seen))
    held = upto[1:] - upto[np.maximum(rows - n + 1, 0)]
    at = np.flatnonzero(seen & (held >= max(least, 1)))
    lo, hi = np.maximum(at - n + 1, 0), at + 1
    below, within = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    level, keys = 0, rows * top + code
    while (lo < hi).any():
        for block, use in ((lo, (lo & 1 == 1) & (lo < hi)), (hi - 1, (hi & 1 == 1) & (lo < hi))):
            start, key = block[use] << level, block[use] * top + code[at[use]]
            below[use] += np.searchsorted(keys, key, "left") - start
            within[use] += np.searchsorted(keys, key, "right") - start
            if block is lo:
                lo = lo + use
            else:
                hi = hi - use
        lo, hi, level = lo >> 1, hi >> 1, level + 1
        keys = np.sort((rows >> level) * top + code, kind="stable")
    out[at] = (below + (within - below + 1) / 2) / held[at]
    return out


def rolling_ranks(df: DataFrame, specs: dict[str, tuple[str, int, int]], keys=("symbol",), order=("date",)) -> DataFrame:
    """Adds ``{out: (column, rows, least)}``: the rank of the newest value inside its trailing frame (``frame_rank``), all
    columns in one pass over each series.  Null values are no part of a frame and get null."""
    keys, order = _seq(keys), _seq(order)
    schema = StructType([*df.schema.fields, *[StructField(name, DoubleType()) for name in specs]])

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table, sort_keys=[(x, "ascending") for x in order]))
        for name, (col, n, least) in specs.items():
            x = table.column(col).combine_chunks().cast(pa.float64())
            rank = frame_rank(x.fill_null(0.0).to_numpy(zero_copy_only=False), np.asarray(x.is_valid()), n, least)
            table = table.append_column(name, pa.array(rank, pa.float64(), from_pandas=True))
        return table

    return df.groupBy(*keys).applyInArrow(run, schema)


def compounded(r, w) -> Column:
    """prod(1 + r) over a window or group; growth of -100% or less is total loss (0)."""
    g = 1 + c(r)
    dead = F.max(F.when(g <= 0, 1).otherwise(0))
    logs = F.sum(F.when(g > 0, F.ln(g)))
    if w is None:
        return F.when(dead == 1, F.lit(0.0)).otherwise(F.exp(logs))
    return F.when(dead.over(w) == 1, F.lit(0.0)).otherwise(F.exp(logs.over(w)))


def ewm_means(df: DataFrame, specs: dict[str, tuple[str, int]], keys=("symbol",), order=("date",)) -> DataFrame:
    """Exponentially weighted means, ``specs = {out: (column, span)}``, weights a^k normalised over the rows seen.

    Each series is cut into blocks of K rows with a^K < 1e-16.  The weighted sum
    at a row is its block's running sum plus the decayed total of the block
    before it; anything older is below double precision.  That is two cheap
    windows per span instead of a long frame per row.
    """
    keys, order = _seq(keys), _seq(order)
    out = df.withColumn("_rn", F.row_number().over(ordered(keys, order)) - 1)
    drop = ["_rn"]
    for name, (col, span) in specs.items():
        a = 1 - 2 / (span + 1)
        k = math.ceil(37 / -math.log(a))
        blk, off = f"_b_{name}", f"_o_{name}"
        out = out.withColumn(blk, F.floor(F.col("_rn") / k)).withColumn(off, F.col("_rn") % k)
        scale = F.exp(F.col(off) * F.lit(-math.log(a)))
        seen = F.col(col).isNotNull().cast("double")
        here = Window.partitionBy(*keys, blk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        prev = Window.partitionBy(*keys).orderBy(blk).rangeBetween(-1, -1)
        out = out.withColumn(f"_x_{name}", F.coalesce(F.col(col), F.lit(0.0)) * scale).withColumn(
            f"_w_{name}", seen * scale
        )

        def total(part):
            before = F.coalesce(F.sum(f"_{part}_{name}").over(prev), F.lit(0.0))
            return F.sum(f"_{part}_{name}").over(here) + before * F.lit(a**k)

        out = out.withColumn(name, ratio(total("x"), total("w")))
        drop += [blk, off, f"_x_{name}", f"_w_{name}"]
    return out.drop(*drop)


def rolling_sums(df: DataFrame, cols: list[str], n: int, keys=("symbol",), order=("date",)) -> DataFrame:
    """Trailing n-row sums ``{c}_sum`` of many columns in one linear pass, plus ``_rows`` (rows in the frame).

    Blocks of n rows: frame sum = running sum in this block + (total - running sum)
    of the previous block n rows earlier.  No sum is longer than n rows, so there
    is no drift as with differences of whole-history prefix sums.
    """
    keys, order = _seq(keys), _seq(order)
    w = ordered(keys, order)
    out = df.withColumn("_rn", F.row_number().over(w) - 1).withColumn("_blk", F.floor(F.col("_rn") / n))
    here = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    block = Window.partitionBy(*keys, "_blk")
    out = out.select("*", *[F.sum(x).over(here).alias(f"_p_{x}") for x in cols])
    out = out.select("*", *[F.sum(x).over(block).alias(f"_t_{x}") for x in cols])
    tail = lambda x: F.coalesce(F.lag(F.col(f"_t_{x}") - F.col(f"_p_{x}"), n).over(w), F.lit(0.0))
    out = out.select("*", *[(F.col(f"_p_{x}") + tail(x)).alias(f"{x}_sum") for x in cols])
    out = out.withColumn("_rows", F.least(F.col("_rn") + 1, F.lit(n)))
    return out.drop("_rn", "_blk", *[f"_{p}_{x}" for x in cols for p in "pt"])


def decayed_sums(df: DataFrame, col: str, specs: dict[str, tuple[int, float]], keys=("symbol",), order=("date",)) -> DataFrame:
    """Adds ``{out: (n, a)}``: the sum of a^k times the value k rows ago over the n newest rows, linear in rows.

    As in ``rolling_sums``, a frame is the running sum of its block of n rows and what the block before has left; values are
    scaled by their place in the block first, so that one power of ``a`` a row settles all weights (a^n must not vanish).
    Nulls count as 0.
    """
    keys, order = _seq(keys), _seq(order)
    w = ordered(keys, order)
    out = df.withColumn("_rn", F.row_number().over(w) - 1)
    for name, (n, a) in specs.items():
        off, fade = F.col("_rn") % n, lambda k, a=a: F.exp(k * F.lit(math.log(a)))
        out = out.withColumn("_blk", F.floor(F.col("_rn") / n)).withColumn("_x", F.coalesce(F.col(col), F.lit(0.0)) * fade(-off))
        block = Window.partitionBy(*keys, "_blk")
        out = out.withColumn("_p", F.sum("_x").over(block.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn("_left", F.sum("_x").over(block) - F.col("_p"))
        tail = F.coalesce(F.lag("_left", n).over(w), F.lit(0.0)) * F.lit(a**n)
        out = out.withColumn(name, fade(off) * (F.col("_p") + tail)).drop("_blk", "_x", "_p", "_left")
    return out.drop("_rn")
