"""Ingestion of a range of days: fetch, parse, classify, build, persist; a ledger of finished days makes it resumable."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foralia.operators.gazette import build_norms, document_hash, parse_summaries
from foralia.operators.ingest import classify
from foralia.runtime import drop_scratch, materialize
from foralia.sources import partitioned

#: Days that are fetched and committed together: what a run that dies has to fetch again at most.
BATCH_DAYS = 31
KEYS, BY = ["boe_id", "effective_from"], ["year"]


def date_range(spark: SparkSession, first: date, last: date) -> DataFrame:
    """(day) from `first` to `last`, both included; none where `last` lies before `first`."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return days.where(F.lit(first <= last))


def pending(days: DataFrame, ledger: str) -> DataFrame:
    """The days that the ledger does not name as finished."""
    spark = days.sparkSession
    partitioned.recover(spark, ledger, ["month", "batch"])
    if not partitioned.leaves(spark, ledger, 2):
        return days
    return days.join(finished(spark, ledger).select("day"), "day", "left_anti")


def finished(spark: SparkSession, ledger: str) -> DataFrame:
    """(day, status, items, accepted, rejected, built, fetch_errors, added, duplicate, conflict) of each finished day."""
    return partitioned.read_partitions(spark, ledger, ["month", "batch"])


def fetched(rows: DataFrame, key: str, fetch: Callable[[object], str]) -> DataFrame:
    """`rows` with payload and error from fetch(key): nothing there (LookupError) gives neither, any other failure its text."""
    schema = T.StructType([*rows.schema.fields, T.StructField("payload", T.StringType()), T.StructField("error", T.StringType())])

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            payloads, errors = [], []
            for ident in frame.column(key).to_pylist():
                payload = error = None
                try:
                    payload = fetch(ident)
                except LookupError:
                    pass
                except Exception as problem:  # noqa: BLE001  any fetcher's failure is data here
                    error = f"{type(problem).__name__}: {problem}"
                payloads.append(payload)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(payloads, pa.string()), pa.array(errors, pa.string())], names=[*frame.schema.names, "payload", "error"])

    return rows.mapInArrow(batches, schema)


def _one_batch(days: DataFrame, fetch_summary, fetch_document, path: str | None, parallel: int) -> DataFrame:
    """One row a day: what ingesting it came to; the norms built are persisted under `path` where that is given."""
    summaries = materialize(fetched(days.repartition(parallel, "day"), "day", fetch_summary), "summaries")
    items, refused = parse_summaries(summaries.where("payload is not null").select("day", "payload"))
    judged = classify(items.withColumn("fecha", F.col("day")))
    judged = materialize(judged.withColumn("accepted", F.col("kind").isNotNull() & (F.col("relevance") != "no_fiscal")), "judged-items")
    named = judged.where("accepted").select("day", F.col("identificador").alias("boe_id")).distinct()
    documents = fetched(named.repartition(parallel, "boe_id"), "boe_id", fetch_document)
    hashed = materialize(documents.withColumn("content_hash", document_hash(F.col("payload"))).drop("payload"), "document-hashes")
    whole = hashed.where("content_hash is not null").select("boe_id", "day", "content_hash")
    # Of an item that a day announces more than once one counts.
    norms = build_norms(judged.where("accepted")).withColumn("day", F.date_sub("effective_from", 1)).dropDuplicates(["boe_id", "day"])
    norms = materialize(norms.join(whole, ["boe_id", "day"]).withColumn("year", F.year("enacted_at")), "norms")
    n = lambda test, name: F.count_if(test).cast("long").alias(name)
    counts = judged.groupBy("day").agg(F.count("*").alias("items"), n(F.col("accepted"), "accepted"), n(~F.col("accepted"), "rejected"))
    errors = hashed.groupBy("day").agg(n(F.col("content_hash").isNull(), "fetch_errors"), n(F.col("content_hash").isNotNull(), "built"))
    out = summaries.join(refused.select("day", F.lit(True).alias("_refused")), "day", "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("_refused"), "unreadable").when(F.col("payload").isNull(), "no_publication").otherwise("done")
    out = out.select("day", status.alias("status"), "error").join(counts, "day", "left").join(errors, "day", "left")
    if path is None:
        put = days.select("day").limit(0).withColumns({c: F.lit(0).cast("long") for c in ("added", "duplicate", "conflict")})
    else:
        outcomes = partitioned.upsert_partitions(path, norms, KEYS, BY)
        put = partitioned.outcome_counts(outcomes.withColumn("day", F.date_sub("effective_from", 1)), ["day"])
    numbers = ("items", "accepted", "rejected", "built", "fetch_errors", "added", "duplicate", "conflict")
    report = materialize(out.join(put, "day", "left").select("day", "status", "error", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers)), "day-report")
    for scratch in (summaries, judged, hashed, norms):
        drop_scratch(scratch)
    return report


def ingest_days(
    spark: SparkSession, first: date, last: date, fetch_summary: Callable[[date], str], fetch_document: Callable[[str], str], path: str, ledger: str, batch_days: int = BATCH_DAYS, dry_run: bool = False
) -> DataFrame:
    """Ingests the days of a range that are not finished and returns one row for each of them.

    Days are taken in batches in their order. A batch's norms are persisted by year (known ones are duplicates, known ones with
    another hash are conflicts and left alone), then its days enter the ledger; a run that dies between the two does that batch
    again and adds nothing twice. A day without a publication is finished; one that could not be fetched or read is not, and
    comes again in the next run. `dry_run` does all but write. `fetch_summary` and `fetch_document` run in tasks; nothing there is
    a LookupError.
    """
    reports = []
    todo = sorted(r["day"] for r in pending(date_range(spark, first, last), ledger).collect())  # days of a range: a few thousand
    for start in range(0, len(todo), batch_days):
        days = todo[start : start + batch_days]
        frame = spark.createDataFrame([(d,) for d in days], "day date")
        report = _one_batch(frame, fetch_summary, fetch_document, None if dry_run else path, min(len(days), spark.sparkContext.defaultParallelism))
        if not dry_run:
            entered = report.where("status in ('done', 'no_publication')").drop("error").withColumn("month", F.date_format("day", "yyyy-MM"))
            again = len(partitioned.leaves(spark, ledger, 2))  # a batch of days of which some failed before is another batch
            partitioned.append_batch(ledger, entered, f"{days[0]}-{days[-1]}-{again}", "month")
        reports.append(report)
    if not reports:
        return _empty(spark)
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "day date, status string, error string, items long, accepted long, rejected long, built long, fetch_errors long, added long, duplicate long, conflict long")
