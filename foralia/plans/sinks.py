"""Queries on the driver tables for partitioned sinks, ledgers and logs, with their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foralia.runtime import materialize, scratch_dir, table
from foralia.sources import partitioned, repositories


def _by_day(spark, sf_dir: str) -> DataFrame:
    columns = ["user_id", "event_type", F.col("ts").cast("date").alias("day"), F.col("props").alias("content_hash"), "event_id"]
    return table(spark, sf_dir, "events").select(columns)


def partitioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a table by day, by user and type within a day: a third of them first, then the others, then all again.

    Returns the outcomes of the second batch, those of the third in all, and each day's rows after it.
    """
    path, keys, by = f"{scratch_dir(spark)}/events-by-day-{uuid.uuid4().hex}", ["user_id", "event_type"], ["day"]
    events = _by_day(spark, sf_dir)
    put = lambda rows: partitioned.upsert_partitions(path, rows, keys, by, order=["event_id"])
    put(events.where("event_id % 3 = 0"))
    second = partitioned.outcome_counts(put(events.where("event_id % 3 <> 0")), by)
    third = partitioned.outcome_counts(put(events), by).select("day", F.col("added").alias("added_again"))
    after = partitioned.read_partitions(spark, path, by).groupBy("day").agg(F.count("*").alias("rows_after"), F.sum("event_id").alias("ids_after"))
    return after.join(third, "day").join(second, "day", "left").select(
        F.col("day").cast("string").alias("day"), "rows_after", "ids_after", "added_again", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "duplicate", "conflict"))
    )


PARTITIONED_SQL = """
WITH e AS (SELECT *, CAST(ts AS DATE) AS day, event_id % 3 <> 0 AS later FROM events),
w AS (SELECT *, first_value(event_id) OVER k AS kept, first_value(props) OVER k AS kept_props FROM e WINDOW k AS (PARTITION BY day, user_id, event_type ORDER BY later, event_id))
SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (event_id = kept) AS rows_after, CAST(sum(event_id) FILTER (event_id = kept) AS BIGINT) AS ids_after, 0 AS added_again,
       count(*) FILTER (later AND event_id = kept) AS added,
       count(*) FILTER (later AND event_id <> kept AND props IS NOT DISTINCT FROM kept_props) AS duplicate,
       count(*) FILTER (later AND event_id <> kept AND props IS DISTINCT FROM kept_props) AS conflict
FROM w GROUP BY day
"""


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events logged in batches of a type each, one of them sent twice; the newest 500 of all and the newest 50 of one user."""
    path, events = f"{scratch_dir(spark)}/audit-{uuid.uuid4().hex}", table(spark, sf_dir, "events")
    rows = events.select("event_id", "user_id", "event_type", "ts", F.col("ts").cast("date").cast("string").alias("day"))
    for kind in ("click", "error", "purchase", "view", "click"):
        partitioned.append_batch(path, rows.where(F.col("event_type") == kind), kind, "day")
    partitioned.append_batch(path, rows.where(~F.coalesce(F.col("event_type").isin("click", "error", "purchase", "view"), F.lit(False))), "rest", "day")
    newest = partitioned.recent_entries(spark, path, "day", "event_id", 500).withColumn("asked", F.lit("all"))
    mine = partitioned.recent_entries(spark, path, "day", "event_id", 50, F.col("user_id") == 1).withColumn("asked", F.lit("user 1"))
    found = materialize(newest.unionByName(mine), "audit-found")
    return found.select("asked", "event_id", "user_id", "event_type", "day", "batch")


AUDIT_SQL = """
WITH e AS (SELECT event_id, user_id, event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
   CASE WHEN event_type IN ('click', 'error', 'purchase', 'view') THEN event_type ELSE 'rest' END AS batch FROM events)
SELECT * FROM (SELECT 'all' AS asked, * FROM e ORDER BY day DESC, event_id DESC LIMIT 500)
UNION ALL SELECT * FROM (SELECT 'user 1' AS asked, * FROM e WHERE user_id = 1 ORDER BY day DESC, event_id DESC LIMIT 50)
"""

def entity_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as saves of a session for each user and type, in three batches out of order, one of them sent twice."""
    path, keys = f"{scratch_dir(spark)}/sessions-{uuid.uuid4().hex}", ["user_id", "event_type"]
    saves = table(spark, sf_dir, "events").select(*keys, "ts", "event_id", "props")
    for k in (2, 0, 2, 1):
        repositories.save(path, saves.where(F.coalesce(F.col("event_id") % 3, F.lit(0)) == k), keys, "ts", 8)
    stored = repositories.find(spark, path, saves, keys, 8)
    written = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return stored.select(*keys, written("created_at"), written("updated_at"), "event_id", "props")


SAVES_SQL = """
WITH w AS (SELECT *, min(ts) OVER (PARTITION BY user_id, event_type) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST, props DESC NULLS LAST) AS k FROM events)
SELECT user_id, event_type, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS updated_at, event_id, props FROM w WHERE k = 1
"""

QUERIES = {
    "entity_saves": (entity_saves, SAVES_SQL),
    "partitioned_upsert": (partitioned_upsert, PARTITIONED_SQL),
    "audit_log": (audit_log, AUDIT_SQL),
}
