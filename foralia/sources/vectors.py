"""The vector table: chunks embedded in batches; batches that fail are kept with their error and can be run again alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foralia.operators.ingest import first_wins
from foralia.runtime import drop_scratch, materialize
from foralia.sources import store

BATCH = 32


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = BATCH) -> DataFrame:
    """(chunk_id, content_hash, embedding, error): texts go to `embed` in batches; a batch that it refuses, or answers with vectors of
    another number or length, gives its error in each of its rows. Null texts are embedded as empty ones."""
    schema = f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, content_hash string, embedding array<double>, error string"

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, batch):
                part = frame.slice(at, batch)
                vectors, error = [None] * part.num_rows, None
                try:
                    found = [list(map(float, v)) for v in embed([t or "" for t in part.column("text").to_pylist()])]
                    if [len(v) for v in found] != [dim] * part.num_rows:
                        raise ValueError(f"{len(found)} vectors of lengths {sorted({len(v) for v in found})}, {part.num_rows} of {dim} expected")
                    vectors = found
                except Exception as problem:  # noqa: BLE001  any provider's failure is data here
                    error = f"{type(problem).__name__}: {problem}"
                yield pa.RecordBatch.from_arrays(
                    [part.column("chunk_id"), part.column("content_hash"), pa.array(vectors, pa.list_(pa.float64())), pa.array([error] * part.num_rows, pa.string())],
                    names=["chunk_id", "content_hash", "embedding", "error"],
                )

    return chunks.select("chunk_id", "content_hash", "text").mapInArrow(batches, schema)


def index_corpus(path: str, failed_path: str, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], dim: int, batch: int = BATCH, only_failed: bool = False) -> DataFrame:
    """Brings the vector table at `path` up to `chunks` (chunk_id, text) and returns (outcome, n): added, duplicate, conflict, failed.

    Chunks whose text is stored already are not embedded again (duplicate); one with another text takes the place of the stored one
    (conflict). What fails is left out and noted at `failed_path` with its error; `only_failed` takes just the chunks noted
    there. A chunk leaves the notes when it is embedded. A run that dies before its notes are written embeds less the next time,
    never more. Of rows with one chunk_id the least text counts; null ids are left out; no rows give no outcomes.
    """
    spark = chunks.sparkSession
    known = chunks.where("chunk_id is not null").select("chunk_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))
    wanted = first_wins(known, ["chunk_id"], ["text"])
    notes = failures(spark, failed_path, wanted)
    if only_failed:
        wanted = wanted.join(notes.select("chunk_id").distinct(), "chunk_id", "left_semi")
    before = store.current(spark, path) if store.exists(spark, path) or store.exists(spark, path + store.OLD) else None
    stored = wanted.select("chunk_id", "content_hash").limit(0) if before is None else before.select("chunk_id", "content_hash")
    todo = wanted.join(stored, ["chunk_id", "content_hash"], "left_anti")
    same = wanted.join(stored, ["chunk_id", "content_hash"], "left_semi").count()
    tried = materialize(embedded(todo, embed, dim, batch), "embedded")
    good, bad = tried.where("error is null"), tried.where("error is not null").select("chunk_id", "content_hash", "error")
    left = notes.join(tried.select("chunk_id"), "chunk_id", "left_anti").join(wanted.join(stored, ["chunk_id", "content_hash"], "left_semi").select("chunk_id"), "chunk_id", "left_anti")
    noted = materialize(left.unionByName(bad), "notes")  # before the table changes, as it reads it
    outcomes = store.upsert(path, good.drop("error"), ["chunk_id"]) if not good.isEmpty() else None
    store.replace(failed_path, noted)
    counts = tried.agg(F.lit("failed").alias("outcome"), F.count("error").alias("n")).unionByName(spark.createDataFrame([("duplicate", same)], "outcome string, n long"))
    counts = counts if outcomes is None else counts.unionByName(outcomes.select("outcome", "n"))
    done = materialize(counts.groupBy("outcome").agg(F.sum("n").alias("n")).where("n > 0"), "index-outcomes")
    drop_scratch(tried)
    drop_scratch(noted)
    return done


def failures(spark: SparkSession, failed_path: str, like: DataFrame) -> DataFrame:
    """(chunk_id, content_hash, error) of the chunks whose last try failed."""
    if store.exists(spark, failed_path) or store.exists(spark, failed_path + store.OLD):
        return store.current(spark, failed_path)
    return like.select("chunk_id", "content_hash", F.lit(None).cast("string").alias("error")).limit(0)
