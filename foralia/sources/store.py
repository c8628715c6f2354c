"""Tables on disk that upserts run against. A new state is written beside the old one and takes its place by renaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foralia.operators.ingest import classify_upsert, idempotent_upsert
from foralia.runtime import drop_scratch, materialize


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def upsert(path: str, incoming: DataFrame, keys: list[str], digest: str = "content_hash", partition_by: list[str] | None = None, overwrite: bool = True) -> DataFrame:
    """Upserts into the Parquet table at `path` and returns (outcome, n); a second run adds nothing.

    The new state is written in whole beside the table, then both change names: a job that fails on the way leaves the
    old state, and the next upsert or `current` puts it back if it was caught between the two names. Writers of one
    table take turns; the store must rename folders.
    """
    spark = incoming.sparkSession
    recover(spark, path)
    incoming = materialize(incoming, "incoming")
    before = spark.read.parquet(path) if exists(spark, path) else incoming.limit(0)
    counts = materialize(classify_upsert(before, incoming, keys, digest).groupBy("outcome").count().withColumnRenamed("count", "n"), "outcomes")
    replace(path, idempotent_upsert(before, incoming, keys, digest, overwrite=overwrite), partition_by)
    drop_scratch(incoming)
    return counts


def replace(path: str, rows: DataFrame, partition_by: list[str] | None = None) -> None:
    """`rows`, which may be read from the table itself, take the place of the table at `path` by renaming."""
    spark = rows.sparkSession
    recover(spark, path)
    after = materialize(rows, "replaced")
    writer = after.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path + NEW)
    if exists(spark, path):
        _rename(spark, path, path + OLD)
    _rename(spark, path + NEW, path)
    _delete(spark, path + OLD)
    drop_scratch(after)


NEW, OLD = "__new", "__old"


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def _rename(spark: SparkSession, path: str, to: str) -> None:
    target, files = _files(spark, path)
    if not files.rename(target, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot rename {path} to {to}")


def _delete(spark: SparkSession, path: str) -> None:
    target, files = _files(spark, path)
    files.delete(target, True)


def recover(spark: SparkSession, path: str) -> None:
    """Puts a table right whose last upsert died: the old state comes back where none is in place, leftovers go."""
    if not exists(spark, path) and exists(spark, path + OLD):
        _rename(spark, path + OLD, path)
    for leftover in (path + OLD, path + NEW):
        if exists(spark, leftover):
            _delete(spark, leftover)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table as its last complete upsert left it."""
    recover(spark, path)
    return spark.read.parquet(path)


def append_log(path: str, rows: DataFrame) -> None:
    """Appends to a log that is never rewritten."""
    rows.write.mode("append").parquet(path)


def recent(spark: SparkSession, path: str, order: str, n: int) -> DataFrame:
    """The newest `n` entries of a log."""
    from pyspark.sql import functions as F

    return spark.read.parquet(path).orderBy(F.desc(order)).limit(n)
