"""Structured Streaming: incremental ingestion, session counters, expiry and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pageloom.operators import manifest as M
from pageloom.sources.sinks import replace_table


def windowed_counts(events: DataFrame, time: str, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n, total): counts by tumbling window, late rows taken until the watermark."""
    e = events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    g = e.groupBy(F.window("__ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def _number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else 0
    for pdf in batches:
        pdf = pdf.sort_values(["created_at", "id"])
        pdf["turn_index"] = range(last + 1, last + 1 + len(pdf))
        last += len(pdf)
        yield pdf[["session_id", "id", "turn_index"]]
    state.update((last,))


def number_turns(turns: DataFrame) -> DataFrame:
    """(session_id, id, turn_index): turns of a stream numbered on within their sessions; the state is a counter."""
    rows = turns.select("session_id", "id", "created_at")
    return rows.groupBy("session_id").applyInPandasWithState(_number, "session_id string, id long, turn_index int", "last int", "append", GroupStateTimeout.NoTimeout)


def _expire(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"task_id": [key[0]], "status": ["expired"]})
        return
    status = None
    for pdf in batches:
        status = str(pdf.sort_values("updated_at")["status"].iloc[-1])
    if status in ("done", "failed"):
        if state.exists:
            state.remove()
        yield pd.DataFrame({"task_id": [key[0]], "status": [status]})
    else:
        state.update((status or "",))
        state.setTimeoutDuration(600_000)


def expire_tasks(tasks: DataFrame) -> DataFrame:
    """(task_id, status): tasks that ended, and those silent for 600 seconds as expired."""
    return tasks.groupBy("task_id").applyInPandasWithState(_expire, "task_id string, status string", "status string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def ingest(stream: DataFrame, table: str, key: str = "source_file", order: str | None = None):
    """A writer that upserts every micro-batch of a stream into a table of files; repeating a batch changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = M.upsert(spark.read.parquet(table), rows, key, order)
        replace_table(rows, table)

    return stream.writeStream.foreachBatch(batch)


def run_once(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that is there now through a stream into a table of the session, for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
