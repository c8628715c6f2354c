"""Mixing sources to target weights along a time-varying curriculum.

Each source's weight is a function of training time t in [0, 1]; its integral is the source's cumulative demand for
tokens. Documents of a source form a stream (hashed order, then the same order again), and inverting the demand at a
copy's place in that stream gives the time at which training wants it. Documents are range-sorted by that time.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foralia.runtime import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Weight over time is target * (1 + slope * (2 t - 1)): falling, level and rising sources, in turn.
SLOPES = (-0.5, 0.0, 0.5)
BUDGET = 1.5
MOST_EPOCHS = 2
#: Rows of a source that one window task orders: hot sources are cut into ranges of the hash.
ROWS_A_RANGE = 20_000


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, budget: float = BUDGET, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, rank, source_size, target, slope) per source; sizes: (source, size) per document.

    A source gets min(most * size, level * weight), with the one level at which all add up to budget * all sizes: what
    handing the excess of capped sources to the others again and again ends in. One row per source passes through
    the ordered windows below, never one per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("rank") % len(values))
    per = per.withColumn("rank", rank).withColumn("weight", pick(weights)).withColumn("slope", pick(slopes))
    per = per.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    others = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (budget * F.sum("source_size").over(every) - capped) / others)
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "rank", "level"))).over(every)["level"]
    per = per.withColumn("chosen", level)
    share = F.col("chosen") * F.col("weight")
    target = F.when(F.col("ratio") < F.col("chosen"), F.col("cap").cast("double")).otherwise(F.coalesce(share, F.col("cap").cast("double")))
    return per.select("source", "rank", "source_size", target.alias("target"), F.col("slope").cast("double").alias("slope"))


def demand_time(words: Column, target: Column, slope: Column) -> Column:
    """The t at which the integral of target * (1 + slope * (2 t - 1)) reaches `words`; null where nothing is wanted."""
    u = F.try_divide(words, target)
    return 2 * u / ((1 - slope) + F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u))


def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, budget: float = BUDGET, most: int = MOST_EPOCHS) -> DataFrame:
    """All columns of `docs` (doc_id, source, size among them), plus source_size, target and `copies`.

    copies: array<struct<copy, words, position>> of the copies taken, the last one of a source in part so that taken
    words add up to floor(target). Order within a source: md5 of doc_id, doc_id, size; a null doc_id hashes as 'null'.
    Null source is a source of its own; a source without words wants none and gives none; rows that repeat are streamed
    one after another; empty input gives no rows.
    """
    docs = docs.drop("source_size", "target", "copies")
    per = materialize(targets(docs.select("source", "size"), weights, slopes, budget, most), "mix-sources")
    n = docs.count()
    ranges = max(64, -(-n // ROWS_A_RANGE))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    per_key = per.select(F.col("source").alias("_source"), F.col("rank").alias("_rank"), "source_size", "target", F.col("slope").alias("_slope"))
    keyed = docs.join(per_key, docs["source"].eqNullSafe(per_key["_source"])).drop("_source").withColumn("_hash", digest)
    keyed = keyed.withColumn("_range", F.shiftright(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long") * ranges, 32))
    sums = keyed.groupBy("_rank", "_range").agg(F.sum("size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_rank").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = materialize(sums.select("_rank", "_range", before.alias("_before")), "mix-ranges")
    running = Window.partitionBy("_rank", "_range").orderBy("_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_in_range", F.coalesce(F.sum("size").over(running), F.lit(0))).join(starts, ["_rank", "_range"])
    whole = F.floor("target")

    def copy(k: int) -> Column:
        start = F.col("_before") + F.col("_in_range") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), whole - start)).cast("long")
        return F.struct(F.lit(k).alias("copy"), words.alias("words"), demand_time(start, F.col("target"), F.col("_slope")).alias("position"))

    copies = F.filter(F.array(*map(copy, range(most))), lambda c: c["words"] > 0)
    return placed.withColumn("copies", copies).select(*docs.columns, "source_size", "target", "copies")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy taken (copy, words, position), range-sorted by position."""
    rows = mixed.select("*", F.inline("copies")).drop("copies")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy")


def cut_to_words(docs: DataFrame) -> DataFrame:
    """Cuts `text` after its first `words` words where it has more (`size`): the last copy of a source, in part."""

    @F.pandas_udf("string")
    def first_words(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([None if text is None else text[: next(islice((m.end() for m in re.finditer(WORD, text)), n - 1, None))] for text, n in zip(texts, words, strict=True)], dtype=object)

    longer = F.col("words") < F.col("size")
    cut = first_words(F.when(longer, F.col("text")), "words")
    return docs.withColumn("text", F.when(longer, cut).otherwise(F.col("text")))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All `documents`, those not taken last; see mix for edge cases. Null text has size 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    mixed = mix(materialize(docs, "mix-sizes"))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda n, c: n + c["words"])
    out = mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.array_min(F.transform("copies", lambda c: c["position"])).alias("position"))
    return out.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM d GROUP BY source
), w AS (
  SELECT *, CASE rnk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         CASE rnk % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS slope, 2 * source_size AS cap FROM s
), r AS (
  SELECT *, cap::DOUBLE / weight AS ratio FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM r)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY ratio, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r
), c AS (
  SELECT level AS chosen FROM l WHERE ratio >= level ORDER BY ratio, rnk LIMIT 1
), t AS (
  SELECT l.source, l.source_size, l.slope, CASE WHEN l.ratio < c.chosen THEN l.cap::DOUBLE ELSE coalesce(c.chosen * l.weight, l.cap::DOUBLE) END AS target FROM l LEFT JOIN c ON true
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.slope,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, 'null')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT *, greatest(0, least(size, CAST(floor(target) AS BIGINT) - start)) AS first_words,
         greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - source_size)) AS second_words FROM p
)
SELECT doc_id, size, source_size, target, CAST(first_words + second_words AS BIGINT) AS taken,
       CASE WHEN first_words > 0 THEN 2 * (start / target) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * (start / target))) END AS position
FROM k
"""
