"""Incremental ingestion as an extension: file streams upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foralia.sources.partitioned import append_batch, drop_judged, upsert_partitions
from foralia.sources.store import upsert


def stream_upsert(rows: DataFrame, path: str, checkpoint: str, keys: list[str], digest: str = "content_hash", partition_by: list[str] | None = None) -> StreamingQuery:
    """Starts a query that upserts each micro-batch into the table at `path`; a batch that is replayed changes nothing.

    With `partition_by` a batch reads and replaces only the partitions it adds to, and conflicts are left alone.
    """
    def write(batch: DataFrame, _: int) -> None:
        if partition_by:
            drop_judged(upsert_partitions(path, batch, keys, partition_by, digest))
        else:
            upsert(path, batch, keys, digest).collect()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_log(rows: DataFrame, path: str, checkpoint: str, by: str) -> StreamingQuery:
    """Starts a query that appends each micro-batch to the log at `path`, exactly once: batches keep their numbers when they are replayed."""
    def write(batch: DataFrame, number: int) -> None:
        append_batch(path, batch, f"{number:012d}", by)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_arrivals(rows: DataFrame, keys: list[str], digest: str, time: str, delay: str) -> DataFrame:
    """Drops rows that repeat key and hash within `delay`, with state bounded by the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, digest])


def windowed_counts(rows: DataFrame, time: str, by: str, width: str, delay: str) -> DataFrame:
    """Arrivals per window and value, late rows up to `delay` included."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
