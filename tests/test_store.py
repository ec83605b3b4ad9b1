"""The bar store: batches, newest load, compaction, batches written again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from factorframe.sources import io, store
from factorframe.streaming import ingest
from factorframe.streaming.storage import work_path

BAR = "symbol string, date date, close double, load_ts long"


def day(m, d=1):
    return dt.date(2020, m, d)


def bars(spark, *rows):
    return spark.createDataFrame(list(rows), BAR)


def held(df):
    return sorted((r.symbol, r.date, r.close) for r in df.collect())


def files(spark, path):
    return {f.split("/data/")[1] for f in spark.read.parquet(path + "/data").inputFiles()}


def test_newest_load_wins_and_a_batch_writes_only_its_rows(spark):
    path = work_path(spark, "store")
    store.append(bars(spark, ("a", day(1), 1.0, 1), ("a", day(2), 2.0, 1), ("b", day(1), 3.0, 5)), path, "one")
    before = files(spark, path)
    store.append(bars(spark, ("a", day(1), 9.0, 2), ("b", day(1), 8.0, 4), ("c", day(3), 7.0, 1)), path, "two")
    after = files(spark, path)
    assert before < after and all(f.startswith("batch=two") for f in after - before)
    assert held(store.read(spark, path)) == [("a", day(1), 9.0), ("a", day(2), 2.0), ("b", day(1), 3.0), ("c", day(3), 7.0)]
    assert held(store.read(spark, path, "2020-02-01", "2020-02-28")) == [("a", day(2), 2.0)]
    assert held(store.read(spark, path, "2021-01-01")) == []


def test_a_batch_written_again_replaces_itself(spark):
    path = work_path(spark, "store")
    store.append(bars(spark, ("a", day(1), 1.0, 1), ("x", day(5), 1.0, 1)), path, "one")
    store.append(bars(spark, ("a", day(1), 2.0, 1)), path, "one")
    assert held(store.read(spark, path)) == [("a", day(1), 2.0)]


def test_unrecorded_files_do_not_exist(spark):
    path = work_path(spark, "store")
    store.append(bars(spark, ("a", day(1), 1.0, 1)), path, "one")
    bars(spark, ("lost", day(1), 1.0, 9)).withColumn("month", F.lit(202001)).write.partitionBy("month").parquet(path + "/data/batch=half")
    assert held(store.read(spark, path)) == [("a", day(1), 1.0)]


def test_compaction_keeps_rows_and_later_batches(spark):
    path = work_path(spark, "store")
    for i in range(4):
        store.append(bars(spark, ("a", day(1), float(i), i), (f"s{i}", day(2 + i), 1.0, i)), path, f"n{i}")
    want = held(store.read(spark, path))
    assert store.compact(spark, path) is not None
    assert held(store.read(spark, path)) == want and store.live(spark, path).count() == 1
    store.append(bars(spark, ("a", day(1), 50.0, 9)), path)
    assert store.vacuum(spark, path) == 4 and store.vacuum(spark, path) == 0
    assert held(store.read(spark, path))[0] == ("a", day(1), 50.0)
    store.append(bars(spark, ("a", day(1), 3.0, 3)), path, "n3")  # a replaced batch that is written again stays replaced
    assert held(store.read(spark, path))[0] == ("a", day(1), 50.0)
    assert store.compact(spark, path) and store.compact(spark, path) is None


def test_empty_batches_nulls_and_new_columns(spark):
    path = work_path(spark, "store")
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    store.append(bars(spark), path, "none")
    assert held(store.read(spark, path)) == []
    store.append(bars(spark, ("a", None, 1.0, 1), (None, day(1), 2.0, 1)), path)
    store.append(bars(spark, ("b", day(1), 3.0, 1)).withColumn("volume", F.lit(5.0)), path)
    got = {(r.symbol, r.date): (r.close, r.volume) for r in store.read(spark, path).collect()}
    assert got == {("a", None): (1.0, None), (None, day(1)): (2.0, None), ("b", day(1)): (3.0, 5.0)}
    assert {r.symbol for r in store.read(spark, path, end="2020-12-31").collect()} == {None, "b"}


def test_a_month_is_more_than_one_task(spark):
    path = work_path(spark, "store")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    store.append(spark.range(2000).select(F.concat(F.lit("s"), "id").alias("symbol"), F.lit(day(1)).alias("date"), F.lit(1.0).alias("close"), F.lit(1).cast("long").alias("load_ts")), path, "one")
    io.write_bars(store.read(spark, path), path + "-whole")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(files(spark, path)) > 2 and len(spark.read.parquet(path + "-whole").inputFiles()) > 2


def test_a_stream_that_starts_again_adds_nothing_twice(spark):
    source, path, state = (work_path(spark, x) for x in ("incoming", "store", "state"))
    bars(spark, ("a", day(1), 1.0, 1)).write.parquet(source)
    for more in (None, ("a", day(1), 4.0, 2), None):
        if more:
            bars(spark, more).write.mode("append").parquet(source)
        ingest.ingest(spark.readStream.schema(BAR).parquet(source), path, state=state).awaitTermination()
    assert held(store.read(spark, path)) == [("a", day(1), 4.0)] and store.deltas(spark, path).count() == 2
