import math
import random

import pytest

from foralia.operators import retrieval, vector_search


def plain(chunks, queries, k, least):
    def cosine(a, b):
        if a is None or b is None:
            return 0.0
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / (na * nb) if na and nb else 0.0

    out = []
    for q in {q for q, _ in queries}:
        best = sorted((-round(cosine(v, e), 12), i) for own, e in queries if own == q for i, v in chunks if cosine(v, e) >= least)[:k]
        out += [(q, i, round(-s, 9) + 0.0, r + 1) for r, (s, i) in enumerate(best)]
    return sorted(out, key=lambda r: (r[0], r[3]))


def run(spark, chunks, queries, k, least, kind="string", **how):
    c = spark.createDataFrame(chunks, f"chunk_id {kind}, embedding array<float>").repartition(3)
    q = spark.createDataFrame(queries, "query_id int, embedding array<double>")
    rows = vector_search.search(c, q, k, least, **how).collect()
    return sorted(((r["query_id"], r["chunk_id"], round(r["score"], 9) + 0.0, r["rank"]) for r in rows), key=lambda r: (r[0], r[3]))


@pytest.mark.parametrize("k,least,how", [(5, 0.0, {}), (3, -1.0, {"query_bytes": 300}), (40, 0.3, {}), (1, 0.0, {"query_bytes": 1})])
def test_equals_comparing_every_pair(spark, monkeypatch, k, least, how):
    monkeypatch.setattr(vector_search, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector_search, "PAIR_BLOCK", 5)
    rng = random.Random(7)
    vectors = [[float(rng.randint(-4, 4)) for _ in range(6)] for _ in range(25)]
    chunks = [(f"c{n:03d}", rng.choice(vectors)) for n in range(90)] + [("zero", [0.0] * 6), ("null", None)]
    queries = [(n, rng.choice(vectors)) for n in range(9)] + [(20, [0.0] * 6), (21, None)]
    assert run(spark, chunks, queries, k, least, **how) == plain(chunks, queries, k, least)


def test_numbers_as_ids_and_no_rows(spark):
    assert run(spark, [(3, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0]), (9, [float("nan"), 1.0])], [(1, [2.0, 0.0])], 5, 0.0, "long") == [(1, 2, 1.0, 1), (1, 3, 1.0, 2)]
    assert run(spark, [], [(1, [2.0, 0.0])], 5, 0.0) == []
    assert run(spark, [("a", [1.0])], [], 5, 0.0) == []


def test_other_lengths_are_an_error(spark):
    with pytest.raises(Exception, match="dimensions"):
        run(spark, [("a", [1.0, 2.0])], [(1, [1.0])], 5, 0.0)


def test_more_queries_than_one_block_holds(spark):
    """An id stays with its vector whichever block it is hashed to."""
    chunks = [(f"{n:04d}", [math.cos(n), math.sin(n)]) for n in range(300)]
    queries = [(n, [math.cos(n), math.sin(n)]) for n in range(300)]
    assert [(q, i) for q, i, *_ in run(spark, chunks, queries, 1, 0.5, query_bytes=16 * 40)] == [(n, f"{n:04d}") for n in range(300)]
    assert retrieval.DENSE_K == 50
