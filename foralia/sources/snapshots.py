"""Snapshots of norms, the base line of change detection: a broken one is an error, never a first run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foralia.sources import store

BLOCKS = "boe_id string, last_checked_at date, reference_date date, article_id string, hash string"
ARTICLES = "boe_id string, last_checked_at date, reference_date date, article_id string, effective_from date, effective_to date, text_hash string, modified_by string"


def checked(rows: DataFrame, digest: str) -> DataFrame:
    """`rows` with hashes in lower case; reading a row without id, dates or a SHA-256 in hexadecimals is an error."""
    named = F.concat_ws(" ", F.lit("broken snapshot:"), F.coalesce("boe_id", F.lit("?")), F.coalesce("article_id", F.lit("?")))
    whole = F.col("boe_id").isNotNull() & F.col("article_id").isNotNull() & F.col("last_checked_at").isNotNull() & F.col("reference_date").isNotNull()
    right = F.coalesce(whole & F.lower(digest).rlike("^[0-9a-f]{64}$"), F.lit(False))
    return rows.withColumn(digest, F.when(right, F.lower(digest)).otherwise(F.raise_error(named).cast("string")))


def save(path: str, rows: DataFrame, digest: str = "hash") -> None:
    """Puts the snapshots of the norms in `rows` in place of their old ones; other norms' stay.

    The table changes at once, as in store.upsert; blocks that a norm no longer has leave with its old snapshot.
    """
    spark = rows.sparkSession
    fresh = checked(rows, digest)
    if store.exists(spark, path):
        before = store.current(spark, path)
        stay = before.join(fresh.select("boe_id").distinct(), "boe_id", "left_anti")
        fresh = stay.unionByName(fresh)
    store.replace(path, fresh)


def load(spark: SparkSession, path: str, schema: str = BLOCKS, digest: str = "hash") -> DataFrame:
    """The snapshots under `path`, without rows where none was ever saved (a first run); a broken one is an error."""
    store.recover(spark, path)
    if not store.exists(spark, path):
        return spark.createDataFrame([], schema)
    return checked(spark.read.schema(schema).option("mode", "FAILFAST").parquet(path), digest)

