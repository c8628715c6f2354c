"""Tables of entities that are saved again and again: the first save's day stays, the newest save's content counts.

Rows lie in partitions by a hash of their key. A batch of saves reads and replaces only the partitions its keys fall in, and a
lookup reads only those of the keys asked for. Batches may come late or twice: the outcome is that of all saves in order of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foralia.runtime import drop_scratch, materialize
from foralia.sources.partitioned import _put, leaves, read_partitions, recover

#: Partitions of a new table; it is a property of the table and must stay with it. At some 256 MB a partition: 1 TB.
BUCKETS = 4096
BY = ["bucket"]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")


def latest(saves: DataFrame, keys: list[str], rest: list[str]) -> DataFrame:
    """One row a key out of rows with created_at and updated_at: the first day, the last one and the content of the last.

    Of saves at the same time the one with the greatest content, column by column, counts; a save without a time is older than any.
    Keys with null are keys like others. Saves are folded before they are shuffled, so a key saved very often is no burden.
    """
    newest = F.max(F.struct("updated_at", *rest)).alias("_newest")
    return saves.groupBy(keys).agg(F.min("created_at").alias("created_at"), newest).select(*keys, "created_at", "_newest.*")


def save(path: str, saves: DataFrame, keys: list[str], at: str, buckets: int = BUCKETS) -> int:
    """Saves rows (keys, `at`, content) into the table at `path` and returns how many partitions that replaced.

    The table has the keys, created_at, updated_at and the content. Columns of the content that clash with created_at, updated_at
    or bucket are an error; so are maps and variants, which have no order. No rows change nothing.
    """
    spark = saves.sparkSession
    rest = [c for c in saves.columns if c not in (*keys, at)]
    clash = {"created_at", "updated_at", "bucket"} & {*keys, *rest}
    if clash:
        raise ValueError(f"columns of the table's own: {sorted(clash)}")
    recover(spark, path, BY)
    arrived = saves.select(*keys, F.col(at).alias("created_at"), F.col(at).alias("updated_at"), *rest)
    batch = materialize(latest(arrived, keys, rest).select("*", _bucket(keys, buckets)), "saves")
    touched = [f"bucket={r['bucket']}" for r in batch.select("bucket").distinct().collect()]
    if touched:
        before = read_partitions(spark, path, BY, touched, batch)
        _put(path, latest(before.unionByName(batch), [*keys, *BY], rest).select(batch.columns), BY)
    drop_scratch(batch)
    return len(touched)


def find(spark: SparkSession, path: str, wanted: DataFrame, keys: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The stored rows of the keys in `wanted`; keys that were never saved give none. Only their partitions are read."""
    recover(spark, path, BY)
    asked = wanted.select(*keys, _bucket(keys, buckets)).distinct()
    only = {f"bucket={r['bucket']}" for r in asked.select("bucket").distinct().collect()}
    known = [leaf for leaf in leaves(spark, path, 1) if leaf in only]
    stored = read_partitions(spark, path, BY, known) if known else read_partitions(spark, path, BY).limit(0)
    match = stored["bucket"] == asked["bucket"]
    for k in keys:
        match = match & stored[k].eqNullSafe(asked[k])
    return stored.join(asked, match, "left_semi").drop("bucket")
