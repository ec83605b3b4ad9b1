"""Shared helpers: tables, shared folder, words and hashes of whole texts in numpy, running sums that survive hot keys."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of every contract: maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an id list up to which a join may broadcast it (16 bytes a row: 16 MB); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset a local folder, on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors, fixes random choices."""
    spark = df.sparkSession
    path = shared(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes ``tables`` (from ``stored``) that no later step reads, and has Spark remove the shuffle files of jobs that are
    done: it does so once their plans are garbage on the driver.  What came of them is written, so nothing is computed again."""
    jvm = spark._jvm
    for df in tables:
        path = jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
        if path is not None and path.getName().startswith("llm-"):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int, size: int = 4 << 20):
    """Arrow batches of at most ``rows`` rows, and of no more than ``size`` bytes and a row, in what is executed inside."""
    least = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name) for name in least}
    for name, most in least.items():
        digits = re.match(r"-?\d+$", before[name])  # sizes may have a unit
        spark.conf.set(name, str(min(most, int(before[name])) if digits and int(before[name]) > 0 else most))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session, for range partitioning by hand."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_list(df: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """Semi or anti join with a stored list; broadcast only if the list has been counted to be small."""
    small = ids.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if small else ids, on, how)


def repeated(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of ``docs`` by a stored decision (doc_id, text_hash, rows, times): ``times`` copies of the ``rows`` equal ones.
    text_hash is ``xxhash64(text)``."""
    keyed = docs.withColumn("__llm_hash", F.xxhash64("text"))

    def joined(part: DataFrame) -> DataFrame:
        part = part.select(F.col("doc_id").alias("__llm_id"), F.col("text_hash").alias("__llm_h"), F.col("times").alias("__llm_times"))
        part = F.broadcast(part) if part.count() <= BROADCAST_ROWS else part
        return keyed.join(part, F.col("doc_id").cast("long").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_hash") == F.col("__llm_h")))

    out = joined(counts.where("rows = 1 and times > 0"))
    many = counts.where("rows > 1 and times > 0")
    if not many.isEmpty():  # equal rows cannot be told apart: keep one of them, then count it out
        out = out.unionByName(joined(many).dropDuplicates(["__llm_id", "__llm_h"]))
    return out.withColumn("__llm_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__llm_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def ordered(df: DataFrame, keys: list[Column]) -> DataFrame:
    """``df`` dealt by range of ``keys`` and stored with its part in ``_part``; no key value is bound to one task if the
    last key tells rows apart."""
    return stored(df.repartitionByRange(tasks(df), *keys).withColumn("_part", F.spark_partition_id()))


def running(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group up to this one.  ``df`` comes from ``ordered`` by
    group and order.  Sums of each part are taken first, so a hot group is as many tasks as it has parts; the second
    window holds one row for each group and part."""
    df = df.withColumn("_value", value)
    parts = df.groupBy(*group, "_part").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"),
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn(name, F.sum("_value").over(inside)).join(parts, same)
            .withColumn(name, F.col(name) + F.col("_before")).drop("_value", "_before", "_p", *[f"_g{i}" for i in range(len(group))]))


# ---- whole texts in numpy, inside tasks ---------------------------------------------------------------------------

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _BACK)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def pieces(column, limit: int = 2_000_000):
    """Arrow string column -> (first row, bytes, offsets) of consecutive rows with about ``limit`` bytes; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; ``breaks``: the bytes that end words (ASCII white space)."""
    inside = ~(_SPACE if breaks is None else breaks)[data]
    if not inside.any():
        return (np.zeros(0, np.int64),) * 3
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    fresh[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word's bytes, A-Z lower-cased if asked; equal words hash alike wherever they stand."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``k`` words; a row with fewer words has one run of all of them."""
    n = len(words)
    odd = [np.uint64((0xD6E8FEB86659FD93 * (2 * i + 1) + 2 * i) & (2**64 - 1) | 1) for i in range(k)]
    out, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= k:
        out = np.zeros(n - k + 1, dtype=np.uint64)
        for i in range(k):
            out += words[i:n - k + 1 + i] * odd[i]
        whole = rows[:n - k + 1] == rows[k - 1:]
        out, own = mix(out[whole]), rows[:n - k + 1][whole]
    counts = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(k - 1):
            has = counts[short] > i
            extra[has] += words[first[has] + i] * odd[i]
        extra = mix(extra ^ mix(counts[short].astype(np.uint64)))
        out, own = np.concatenate([out, extra]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own
