"""Importance resampling towards a target distribution: hashed word runs, log ratio gains, Gumbel draws.

Two passes over the texts in Arrow batches. The first counts each partition's features into one vector of buckets
(`np.bincount`) and a tree of tasks adds the vectors, so the driver receives one vector whatever the corpus holds. The
second carries the broadcast gains (one number a bucket) and sums them over each document's features
(`np.bincount` with weights). Scores are whole numbers in a range that does not grow with the corpus, so the draw is
found from their histogram; no sort meets in one task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foralia.runtime import materialize, table, text_batches

BUCKETS = 10_000
MAX_RUN = 1
SEED = 2024
LEAST_WORDS = 20
#: Share of the eligible documents to draw, in hundredths.
PERCENT = 10
#: Bytes that end a word, and capital letters to their small ones.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes: only A-Z are lower-cased, only ASCII characters other than letters and digits separate."""
    return text.translate(_TO_WORDS).split() if text else []


def _features(texts: list[bytes | None], max_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of every feature, each text's features and each text's words. Features of a run follow one another by text."""
    words = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    if max_run == 1:
        flat = [zlib.crc32(w) for ws in words for w in ws]
    else:
        flat = [zlib.crc32(b" ".join(ws[k : k + n])) for ws in words for n in range(1, max_run + 1) for k in range(len(ws) - n + 1)]
    counts = sum(np.maximum(n_words - n + 1, 0) for n in range(1, max_run + 1))
    return np.array(flat, np.int64), counts, n_words


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, max_run: int = MAX_RUN) -> np.ndarray:
    """Features in each bucket over all rows of the column `text`; no rows give zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            hashes, _, _ = _features(batch.column(0).to_pylist(), max_run)
            total += np.bincount(hashes % buckets, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    text_batches(texts.sparkSession)
    vectors = texts.select(F.col("text").cast("string").cast("binary")).mapInArrow(count, "counts binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, np.int64)
    zero = (np.zeros(buckets, np.int64).tobytes(),)
    added = vectors.map(tuple).treeAggregate(zero, _add, _add, depth=3)
    return np.frombuffer(added[0], np.int64)


def _add(a: tuple[bytes], b: tuple[bytes]) -> tuple[bytes]:
    return ((np.frombuffer(a[0], np.int64) + np.frombuffer(b[0], np.int64)).tobytes(),)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    wide, in_target, in_source = len(source), int(target.sum()), int(source.sum())
    ratio = lambda t, s: (int(t) + 1) * (in_source + wide) / ((int(s) + 1) * (in_target + wide))
    return np.array([math.floor(1000 * math.log(ratio(t, s))) for t, s in zip(target, source, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, max_run: int = MAX_RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features, 0 where it has none."""
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = shared.value
        for batch in batches:
            hashes, counts, n_words = _features(batch.column("text").to_pylist(), max_run)
            owner = np.repeat(np.arange(len(counts)), counts)
            sums = np.bincount(owner, weights=by_bucket[hashes % len(by_bucket)], minlength=len(counts)).astype(np.int64)
            weight = np.where(counts > 0, sums // np.maximum(counts, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, counts, weight))], names=["doc_id", "n_words", "n_features", "weight"]
            )

    text_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x a standard Gumbel draw) that a document keeps between runs; a null id draws as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds `rank`: 1, 2, 3... over the floor(percent * N / 100) best of the N rows with `least_words` words, else null.

    scored: doc_id, n_words, score; materialized, as it is read twice. Ties go to the smaller doc_id, null ids last. The
    histogram of scores is as long as their range: a mean of gains plus a draw within -3,100..22,900. A score's rows meet
    in one window; since every document draws for itself, that is about one in 2,700 at most, whatever their weights.
    """
    eligible = scored.where(F.col("n_words") >= least_words)
    counts = eligible.groupBy("score").agg(F.count("*").alias("here"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("score", F.coalesce(F.sum("here").over(above), F.lit(0)).alias("before"), F.floor(F.sum("here").over(Window.partitionBy()) * percent / 100).alias("wanted"))
    taken = F.broadcast(places.where("before < wanted"))
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id")))
    drawn = scored.join(taken, (scored["score"] == taken["score"]) & (scored["n_words"] >= least_words), "left").select(scored["*"], "before", "wanted")
    ranked = drawn.where("before is not null").withColumn("rank", F.col("before") + inside)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.col("wanted"), F.col("rank")))
    rest = drawn.where("before is null").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("before", "wanted")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, max_run: int = MAX_RUN, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of `docs`; rank is null where it is not drawn.

    docs: doc_id, text; target: text; other columns are ignored. Null and empty texts have no features, weight 0 and are
    not eligible. Repeated rows count and draw once each and share a score; of equal (score, doc_id) any order is right.
    Without target texts gains follow the source alone; without documents there are no rows.
    """
    gain = gains(bucket_counts(docs, buckets, max_run), bucket_counts(target, buckets, max_run))
    weighed = weigh(docs, gain, max_run)
    return draw(materialize(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "importance"), percent, least_words)


def op12_importance(spark, sf_dir: str) -> DataFrame:
    """All `documents`, drawn towards `benchmark`; see resample for edge cases."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: DuckDB has no crc32: one step for each bit of each byte, on distinct words only.
_BIT = "xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)"
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
f AS (SELECT doc_id, unnest(ws) AS w FROM d),
u AS (SELECT DISTINCT w FROM (SELECT w FROM f UNION ALL SELECT w FROM b)),
k AS (SELECT w, CAST(xor(list_reduce(list_transform(range(0, length(hex(encode(w))) // 2), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
   lambda c, o: list_reduce(range(0, 8), lambda x, i: {_BIT}, xor(c, o)), 4294967295), 4294967295) % 10000 AS INT) AS bucket FROM u),
s AS (SELECT bucket, count(*) AS s FROM f JOIN k USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN k USING (w) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM f)::DOUBLE AS s_all, (SELECT count(*) FROM b)::DOUBLE AS t_all),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT doc_id, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM f JOIN k USING (w) JOIN g USING (bucket) GROUP BY 1),
x AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
   CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
r AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place, sum((n_features >= 20)::INT) OVER () AS eligible FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= eligible * 10 // 100 THEN place END AS rank FROM r
"""
