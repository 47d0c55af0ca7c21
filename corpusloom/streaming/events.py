"""Structured Streaming over event logs; state is bounded by watermarks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 1) -> DataFrame:
    """An append-only log; offsets are kept by the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def timed(events: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a time with a zone; a stream's naive times are read as the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")) if events.isStreaming else events


def since(events: DataFrame, offset: int, id_col: str = "event_id") -> DataFrame:
    """Events after an offset, for a batch or a stream."""
    return events.where(F.col(id_col) > offset)


def first_sources(events: DataFrame, *keys: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each combination of keys; later than ``late`` they may appear anew."""
    return timed(events, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def windowed_counts(events: DataFrame, *, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """An extension: events and their values in event-time windows."""
    return timed(events, ts).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), by, "n", "total"
    )


def session_ages(events: DataFrame, key: str = "user_id", *, ts: str = "ts", seconds: int = 7200, late: str = "10 minutes") -> DataFrame:
    """``key, started, n, ended``: sessions that end ``seconds`` after they were created, however active they are."""

    def update(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            started, n = state.get
            state.remove()
            yield pd.DataFrame({key: [name[0]], "started": [pd.Timestamp(started, unit="us")], "n": [n], "ended": [True]})
            return
        started, n = state.get if state.exists else (None, 0)
        for rows in batches:
            first = int(rows[ts].min().value // 1000)
            started = first if started is None else min(started, first)
            n += len(rows)
        state.update((started, n))
        ends = max(started // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1)
        state.setTimeoutTimestamp(ends)
        yield pd.DataFrame({key: [name[0]], "started": [pd.Timestamp(started, unit="us")], "n": [n], "ended": [False]})

    kind = dict(events.dtypes)[key]
    return timed(events, ts).withWatermark(ts, late).groupBy(key).applyInPandasWithState(
        update, f"{key} {kind}, started timestamp, n long, ended boolean", "started long, n long", "update", GroupStateTimeout.EventTimeTimeout
    )


def ingest(stream: DataFrame, table: str, checkpoint: str, key: str = "content_hash"):
    """New contents of a stream of documents are appended to a table; known ones are left out.  The table is kept by the first two characters of
    ``key``, a hash, and each batch reads its own parts of it alone."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key]).withColumn("_part", F.substring(key, 1, 2))
        parts = [r["_part"] for r in fresh.select("_part").distinct().collect()]  # at most 256 of a hexadecimal hash
        try:
            known = spark.read.parquet(table).where(F.col("_part").isin(parts)).select(key)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("append").partitionBy("_part").parquet(table)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
