"""Incremental bars (L9): S2 as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factorframe.sources import store
from factorframe.streaming.storage import work_path


def ingest(stream: DataFrame, path: str, available_now=True, state: str | None = None):
    """Append every micro-batch of bars (with load_ts) to the store as a batch of its own; ``store.read`` gives the newest load
    of a symbol-date.  A micro-batch that runs again after a failure replaces itself, since ``state`` (the checkpoint) and its
    number name it."""
    state = state or work_path(stream.sparkSession, "ingest-state")
    run = state.rstrip("/").split("/")[-1]

    def write(batch: DataFrame, number: int) -> None:
        store.append(batch, path, f"{run}-{number:09d}")

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
    return (w.trigger(availableNow=True) if available_now else w).start()
