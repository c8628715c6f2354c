"""Exact cosine search for sets of queries: blocked matrix products, k best kept per task, merged by a window.

Queries are taken in blocks of bounded bytes, each block one pass over the vectors. A task multiplies blocks of vectors
with blocks of queries and keeps, for each query, what can still be among its k best; a product only proposes, the score
that decides is computed pair by pair, so equal vectors get equal scores wherever they lie and ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of normalised queries that are broadcast at once, and the blocks multiplied at once: a bound on a task's memory.
QUERY_BYTES = 32 << 20
VECTOR_BLOCK, QUERY_BLOCK, PAIR_BLOCK = 4096, 1024, 8192
#: Products of normalised vectors differ by less than this from the deciding score.
SLACK = 1e-9


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of length 1 from lists of numbers; null lists and zeros give zeros; other lengths than `dim` are an error."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    known = sizes >= 0
    if dim is None:
        dim = int(sizes.max()) if known.any() else 0
    if (sizes[known] != dim).any():
        raise ValueError(f"vectors of {sorted(set(sizes[known].tolist()))} dimensions, {dim} expected")
    out = np.zeros((len(sizes), dim))
    if known.any():
        out[known] = column.drop_null().flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore"):
        length = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length != 0)


class _Best:
    """The k best of each query among the vectors seen so far."""

    def __init__(self, queries: np.ndarray, k: int, least: float) -> None:
        self.queries, self.k, self.least = queries, k, least
        self.found: list[list[tuple[float, object]]] = [[] for _ in range(len(queries))]
        self.floor = np.full(len(queries), least - SLACK)

    def add(self, ids: list, vectors: np.ndarray) -> None:
        for start in range(0, len(self.queries), QUERY_BLOCK):
            block = self.queries[start : start + QUERY_BLOCK]
            products = vectors @ block.T
            products[np.isnan(products)] = -np.inf
            floor = self.floor[start : start + QUERY_BLOCK]
            if len(ids) > self.k:
                floor = np.maximum(floor, np.partition(products, len(ids) - self.k, axis=0)[len(ids) - self.k] - SLACK)
            rows, columns = np.nonzero(products >= floor)
            for at in range(0, len(rows), PAIR_BLOCK):
                r, c = rows[at : at + PAIR_BLOCK], columns[at : at + PAIR_BLOCK]
                exact = (vectors[r] * block[c]).sum(1)
                for row, column, score in zip(r.tolist(), c.tolist(), exact.tolist(), strict=True):
                    if score >= self.least:
                        self.found[start + column].append((-score, ids[row]))
            for q in set((columns + start).tolist()):
                if len(self.found[q]) >= self.k:
                    self.found[q] = heapq.nsmallest(self.k, self.found[q])
                    self.floor[q] = max(self.floor[q], -self.found[q][-1][0] - SLACK)


def _search_block(chunks: DataFrame, asked: list, dim: int, k: int, min_score: float, kind: str) -> DataFrame:
    """(query, chunk_id, score): the k best of each task for one block of queries, numbered in their order."""
    spark = chunks.sparkSession
    shared = spark.sparkContext.broadcast(_matrix(pa.array([list(r["embedding"]) if r["embedding"] is not None else None for r in asked], pa.list_(pa.float64())), dim))
    arrow = {}

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Best(shared.value, k, min_score)
        for batch in batches:
            arrow["kind"] = batch.column("chunk_id").type
            for at in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(at, VECTOR_BLOCK)
                vectors = _matrix(part.column("embedding"), dim)
                found.add(part.column("chunk_id").to_pylist(), vectors)
        for start in range(0, len(found.found), 1000):
            rows = [(start + q, i, -s) for q, hits in enumerate(found.found[start : start + 1000]) for s, i in heapq.nsmallest(k, hits)]
            if rows:
                query, ids, scores = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, arrow["kind"]), pa.array(scores, pa.float64())], names=["query", "chunk_id", "score"])

    return chunks.select("chunk_id", "embedding").mapInArrow(best, f"query int, chunk_id {kind}, score double")


def search(chunks: DataFrame, queries: DataFrame, k: int, min_score: float = 0.0, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, chunk_id, score, rank) by exact cosine for any number of queries; both sides carry `embedding`.

    A null or zero vector has score 0 with everything, one that holds NaN or a null is never found; vectors of different lengths are an
    error. Rows with a null chunk_id are no chunks; repeated chunks are found once each, repeated query ids are one query with the hits of all.
    """
    from foralia.operators.retrieval import top_k

    spark = chunks.sparkSession
    asked = queries.select("query_id", "embedding")
    n, dim = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = max(0, dim or 0) or max(0, chunks.agg(F.max(F.size("embedding"))).first()[0] or 0)
    per_block = max(1, query_bytes // (8 * max(1, dim)))
    blocks = max(1, -(-n // per_block))
    if blocks > 1:
        blocks *= 2  # hashing fills blocks unevenly; none may be much larger than the bound
    kind, query_kind = chunks.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    known, out = chunks.where("chunk_id is not null"), []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if rows or b == 0:
            hits = _search_block(known, rows, dim, k, min_score, kind)
            names = spark.createDataFrame([(q, r["query_id"]) for q, r in enumerate(rows)], f"query int, query_id {query_kind}")
            out.append(hits.join(F.broadcast(names), "query").select("query_id", "chunk_id", "score"))
    return top_k(reduce(DataFrame.unionByName, out), k)
