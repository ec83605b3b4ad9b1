"""A table played back as a stream: slices in the order of their time, some rows late, and a heartbeat at the end."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorframe.streaming.storage import work_path


def replay(df: DataFrame, time: str, beat: dict, late: Column, late_days: int, slices: int = 2, files: int = 4) -> DataFrame:
    """Streaming rows of ``df`` in micro-batches of one slice of its time span each; rows come
    ``late`` slices after their own (a condition counts as one).

    A heartbeat row (``beat`` names its values, other columns are null) ends the stream.  It is late enough for a
    watermark of ``late_days`` to close the last day with rows, and no more.  A clock that writes such rows is what makes
    a stream without traffic go on.
    """
    spark, path = df.sparkSession, work_path(df.sparkSession, "replay")
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    ends = df.agg(F.unix_micros(F.min(time)).alias("a"), F.unix_micros(F.max(time)).alias("b")).first()
    if ends["a"] is not None:
        width = (ends["b"] - ends["a"]) // slices + 1
        own = F.expr(f"cast((unix_micros({time}) - {ends['a']}) div {width} as int)") + F.coalesce(late.cast("int"), F.lit(0))
        turn = F.least(own, F.lit(slices - 1))
        for i in range(slices):
            df.where(turn == i).repartition(files).write.mode("append").parquet(path)
        last = datetime(1970, 1, 1) + timedelta(days=ends["b"] // 86_400_000_000 + 1 + late_days)
        values = beat | {time: last}
        row = spark.range(1).select(*[F.lit(str(values[f.name]) if f.name == time else values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
        row.write.mode("append").parquet(path)
    else:
        df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)
