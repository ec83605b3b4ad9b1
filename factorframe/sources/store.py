"""A bar store of delta files (S2, L9): a batch writes only its own rows, reading merges, compaction is a job of its own.

    {store}/data/batch=<name>/month=<yyyymm>/...   the rows of one batch, split by month and hash of symbol
    {store}/manifest/batch=<name>/...              one row once those files are complete: months, row count, batches replaced

A batch without its manifest row does not exist for readers, so a job that is lost half-way leaves nothing visible and a batch
written again under its name replaces itself.  Of a (symbol, date) the newest load wins on read (``load_ts``).  Compaction
writes the merged rows as a new batch that replaces those it read; readers go from the old set of files to the new one when
its manifest row appears, and ``vacuum`` deletes what has been replaced.

Defined results: an empty batch is recorded and reads as nothing; a store without batches is an error; null dates have month
0 and are read only without a date range; columns that only some batches have are null in the others.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from factorframe.functions.windows import c
from factorframe.operators.universe import between
from factorframe.sources.io import merge_bars

#: Parts by hash of symbol in which the rows of one month are written, so a month is not one task.
SYMBOL_PARTS = 16
MANIFEST = StructType([StructField("name", StringType()), StructField("months", ArrayType(IntegerType())), StructField("rows", LongType()),
                       StructField("replaces", ArrayType(StringType())), StructField("schema", StringType())])


def _month(date) -> Column:
    return F.coalesce(F.year(date) * 100 + F.month(date), F.lit(0))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def append(bars: DataFrame, store: str, name: str | None = None, replaces: list[str] | None = None) -> str:
    """Writes one batch (symbol, date, ..., load_ts), evaluated once, and records it.  The same ``name`` again replaces it."""
    spark, name = bars.sparkSession, name or uuid.uuid4().hex
    data = f"{store}/data/batch={name}"
    split = bars.withColumn("month", _month("date"))
    split = split.repartition("month", F.pmod(F.xxhash64("symbol"), F.lit(SYMBOL_PARTS))).sortWithinPartitions("month", "symbol", "date")
    split.write.mode("overwrite").partitionBy("month").parquet(data)
    written = spark.read.schema(split.schema).parquet(data)
    entry = written.agg(F.lit(name).alias("name"), F.sort_array(F.collect_set("month")).alias("months"), F.count(F.lit(1)).alias("rows"),
                        F.lit(replaces or []).cast("array<string>").alias("replaces"), F.lit(bars.schema.json()).alias("schema"))  # months are a few hundred at most
    entry.coalesce(1).write.mode("overwrite").parquet(f"{store}/manifest/batch={name}")
    return name


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """(name, months, rows, replaces, schema) of every recorded batch."""
    if not _exists(spark, f"{store}/manifest"):
        raise FileNotFoundError(f"no batch has been written to {store}")
    return spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{store}/manifest")


def live(spark: SparkSession, store: str) -> DataFrame:
    """The manifest without replaced batches."""
    every = manifest(spark, store)
    gone = every.select(F.explode("replaces").alias("name")).distinct()
    return every.join(gone, "name", "left_anti")


def deltas(spark: SparkSession, store: str, start=None, end=None, batches: list[str] | None = None) -> DataFrame:
    """The rows of all live batches (or of ``batches``) as loaded; a date range prunes batches, months and row groups."""
    low, high = _month(F.lit(start).cast("date")), _month(F.lit(end).cast("date"))
    wanted = F.col("rows") > 0
    if start is not None:
        wanted &= F.exists("months", lambda m: m >= low)
    if end is not None:
        wanted &= F.exists("months", lambda m: m <= high)
    found = live(spark, store) if batches is None else manifest(spark, store).where(c("name").isin(batches))
    found = sorted(tuple(r) for r in found.select("name", wanted, "schema").collect())  # one row a batch since the last compaction
    fields = {f.name: f for _, _, text in found for f in StructType.fromJson(json.loads(text)).fields}
    schema = StructType([StructField(f.name, f.dataType) for f in fields.values()])
    paths = [f"{store}/data/batch={name}" for name, use, _ in found if use]
    if not paths:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(StructType([*schema.fields, StructField("month", IntegerType())])).option("basePath", f"{store}/data").parquet(*paths)
    if start is not None:
        df = df.where(c("month") >= low)
    if end is not None:
        df = df.where(c("month").between(1, high))
    return between(df, start, end).select(*schema.names)


def read(spark: SparkSession, store: str, start=None, end=None) -> DataFrame:
    """The store's bars, of each (symbol, date) the newest load."""
    df = deltas(spark, store, start, end)
    return merge_bars(df, df.limit(0))


def compact(spark: SparkSession, store: str) -> str | None:
    """Merges all live batches into one; None where there is at most one already.  Batches that arrive meanwhile stay as they are."""
    names = sorted(r["name"] for r in live(spark, store).select("name").collect())
    if len(names) < 2:
        return None
    df = deltas(spark, store, batches=names)
    return append(merge_bars(df, df.limit(0)), store, replaces=names)


def vacuum(spark: SparkSession, store: str) -> int:
    """Deletes the files of replaced batches, to be run when no reader uses them any more; their number."""
    gone = [r["name"] for r in manifest(spark, store).select(F.explode("replaces").alias("name")).distinct().collect()]
    count = 0
    for name in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/data/batch={name}")
        count += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return count
