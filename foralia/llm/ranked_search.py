"""Ranked lexical search by the threshold algorithm over impact-sorted lists and a forward index.

Texts go through Python once a block of items: they become a forward index of the block's terms (document, length, terms,
occurrences), a Parquet table from which document frequencies are counted. Each task then takes its documents shard by
shard. A shard's postings are sorted by impact within each term. For each item the lists are read round-robin, some entries
at a time from all of them; every document met for the first time gets its whole score by random access to the forward
index; and reading stops as soon as the sum of the lists' next impacts falls strictly below the k-th best score so far.
Strictly, because a document that reaches the threshold may tie and win by its smaller id. The k best of a task start its
next shard, so later shards stop sooner. The k best of all tasks meet at the end; no list is longer than a shard.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foralia.llm.importance import words_of
from foralia.runtime import materialize, table, text_batches

K = 10
#: Postings in a shard: a bound on a task's memory, some 100 MB. A longer document is a shard of its own.
SHARD_POSTINGS = 2_000_000
#: Entries read from each list in the first round; doubled each round up to the second number.
FIRST_READ, MOST_READ = 8, 1024
#: A block of items is what the driver and each worker hold of the queries: texts of so many bytes (or one longer item) and so many items.
BLOCK_BYTES, BLOCK_ITEMS = 16 << 20, 10_000
#: Stands for a null doc_id inside a task: last among ties.
NO_ID = (1 << 63) - 1


class Items:
    """One block of items: their terms as numbers, and how often each item has them."""

    def __init__(self, rows: list[tuple]) -> None:
        bags: dict[object, Counter] = {}
        for item_id, text in rows:
            bags.setdefault(item_id, Counter()).update(words_of(text))
        self.ids = list(bags)
        self.numbers = {w: k for k, w in enumerate(sorted(set().union(*bags.values())))}
        self.terms = [np.array(sorted(self.numbers[w] for w in bag), np.int64) for bag in bags.values()]
        names = sorted(self.numbers)
        self.times = [np.array([bag[names[t]] for t in terms.tolist()], np.int64) for terms, bag in zip(self.terms, bags.values(), strict=True)]


def forward_index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times) of every document with a term; n counts all its terms, `terms` are those of `numbers`."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, wide = shared.value.get, max(1, len(shared.value))
        for batch in batches:
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            n = np.array([len(ws) for ws in words], np.int64)
            found = np.array([get(w, -1) for ws in words for w in ws], np.int64)
            keys = (np.repeat(np.arange(len(n)), n) * wide + found)[found >= 0]
            keys, times = np.unique(keys, return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(n) + 1) * wide)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, kind)) for v, kind in ((keys % wide, pa.int32()), (times, pa.int64()))]
            rows = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])
            yield rows.filter(pa.array(n > 0))

    text_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(index, "doc_id long, n long, terms array<int>, times array<long>")


class Corpus:
    """Counts over all documents and the weights of a block's terms."""

    def __init__(self, index: DataFrame, terms: int) -> None:
        self.docs, words = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        self.words = max(1, words)
        df = np.zeros(terms, np.int64)
        for term, n in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        self.weights = np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """Each document's length against the mean, in hundredths; by unbounded integers where 64 bits are too few."""
        if len(n) and int(n.max()) * 75 * self.docs >= 1 << 63:
            return np.array([25 + 75 * int(x) * self.docs // self.words for x in n], np.int64)
        return 25 + 75 * n * self.docs // self.words


class Shard:
    """Documents of one task: a forward index by document and the same postings by term in descending impact."""

    def __init__(self, corpus: Corpus, doc_ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        self.doc_ids, self.terms = doc_ids, terms
        self.ends = np.concatenate(([0], np.cumsum(sizes)))
        owners = np.repeat(np.arange(len(sizes)), sizes)
        self.impacts = corpus.weights[terms] * (1_000_000_000 * times // (1000 * times + 8 * corpus.lengths(n)[owners]))
        order = np.lexsort((-self.impacts, terms))
        self.list_docs, self.list_impacts = owners[order], self.impacts[order]
        self.list_ends = np.searchsorted(terms[order], np.arange(len(corpus.weights) + 1))
        self.asked = np.zeros(len(corpus.weights), np.int64)
        self.seen = np.zeros(len(sizes), bool)
        self.entries_read = 0

    def _scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores by random access to the forward index."""
        sizes = self.ends[docs + 1] - self.ends[docs]
        first = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.ends[docs] - first, sizes)
        return np.add.reduceat(self.asked[self.terms[at]] * self.impacts[at], first)

    def search(self, terms: np.ndarray, times: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, doc_ids) of `best` and this shard, by score and then by doc_id; only scores above 0."""
        scores, ids = best
        starts, ends = self.list_ends[terms], self.list_ends[terms + 1]
        self.asked[terms] = times
        met, read = [], FIRST_READ
        while True:
            on = starts < ends
            least = int(scores[k - 1]) if len(scores) >= k else 1
            if int((times[on] * self.list_impacts[starts[on]]).sum()) < least:
                break
            at = starts[on, None] + np.arange(read)
            at = at[at < ends[on, None]]
            self.entries_read += len(at)
            docs = self.list_docs[at]
            docs = np.unique(docs[~self.seen[docs]])
            if len(docs):
                self.seen[docs] = True
                met.append(docs)
                new = self._scores(docs)
                good = new >= least
                scores, ids = np.concatenate((scores, new[good])), np.concatenate((ids, self.doc_ids[docs[good]]))
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
            starts, read = starts + read, min(2 * read, MOST_READ)
        self.asked[terms] = 0
        for docs in met:
            self.seen[docs] = False
        return scores, ids


def _shards(corpus: Corpus, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    def column(x: pa.Array) -> np.ndarray:
        return x.to_numpy(zero_copy_only=False)

    def shard() -> Shard:
        return Shard(corpus, *(np.concatenate(x) for x in zip(*held, strict=True)))

    held, postings = [], 0
    for batch in batches:
        terms = batch.column("terms")
        sizes = column(terms.value_lengths()).astype(np.int64)
        part = [column(batch.column("doc_id").fill_null(NO_ID)), column(batch.column("n")), sizes, column(terms.flatten()).astype(np.int64), column(batch.column("times").flatten())]
        if held and postings + len(part[3]) > most:
            yield shard()
            held, postings = [], 0
        held.append(part)
        postings += len(part[3])
    if held:
        yield shard()


def _block(docs: DataFrame, rows: list[tuple], k: int, shard_postings: int) -> tuple[DataFrame, Items]:
    """(item, doc_id, score, rank) of the k best for a block of items, which are numbered by their place in Items.ids."""
    spark = docs.sparkSession
    items = Items(rows)
    index = materialize(forward_index(docs, items.numbers), "forward-index")
    shared = spark.sparkContext.broadcast((Corpus(index, len(items.numbers)), items.terms, items.times))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, terms, times = shared.value
        none = np.zeros(0, np.int64)
        found = [(none, none)] * len(terms)
        for shard in _shards(corpus, batches, shard_postings):
            found = [shard.search(t, n, b, k) for t, n, b in zip(terms, times, found, strict=True)]
        for start in range(0, len(found), 1000):
            part = found[start : start + 1000]
            ids = np.concatenate([i for _, i in part])
            scores = np.concatenate([s for s, _ in part])
            item = np.repeat(np.arange(start, start + len(part)), [len(s) for s, _ in part])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    hits = index.mapInArrow(best, "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), items


def search(docs: DataFrame, items: DataFrame, k: int = K, shard_postings: int = SHARD_POSTINGS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, equal scores by ascending doc_id.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Null and empty texts have no terms: such documents
    count nowhere and such items have no rows. Rows of `items` that repeat count once; different texts of one item_id, null
    among them, are one item. Repeated documents are documents each; a null doc_id comes last among ties. Items are taken
    in blocks by a hash of item_id, so that any number of them can be asked; each block reads the texts once.
    """
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).where("text is not null").distinct()
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size // block_bytes), -(-n // BLOCK_ITEMS))
    kind = items.schema["item_id"].dataType.simpleString()
    out = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        best, block = _block(docs, sorted(map(tuple, rows), key=str), k, shard_postings)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        out.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The ten best of all `documents` for each item of `benchmark`; see search for edge cases."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS t FROM benchmark) GROUP BY 1, 2),
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
c AS (SELECT count(*) AS n_all, CAST(sum(len(ws)) AS BIGINT) AS l_all FROM d WHERE len(ws) > 0),
p AS (SELECT doc_id, t, CAST(n AS BIGINT) AS n, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY t, n_all),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all)))) AS BIGINT) AS score
  FROM p JOIN w USING (t) JOIN q USING (t), c GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
