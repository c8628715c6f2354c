import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from foralia.llm import language_model as lm


def test_base_scores_match_brute_force(docs, rows):
    for head in (5, 100_000):
        got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], r["held_out"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score_documents(docs, head).collect()))
        out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        counts = Counter(w for r in rows if not out(r[0]) for w in [*(r[1] or "").encode().lower().split(), b""])
        n, v = sum(counts.values()), len(counts)
        want = []
        for r in rows:
            words = [*(r[1] or "").encode().lower().split(), b""]
            score = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
            want.append((r[0] is None, r[0] or 0, len(words), sum(counts[w] > 0 for w in words), out(r[0]), n, round(score, 6)))
        assert got == sorted(want)


def test_probabilities_sum_to_one(docs, monkeypatch):
    counts = lm.word_counts(docs)
    table = {r["token"]: r["n"] for r in counts.collect()}
    monkeypatch.setattr(lm, "CLASS_WORDS", 2)
    vocabulary, start = lm.vocabulary_of(counts)
    assert vocabulary.tail[:, 1].sum() > 0
    rng = np.random.default_rng(0)
    start.outer[:] = rng.normal(size=start.outer.shape)
    start.inner[:] = rng.normal(size=start.inner.shape)
    total = 0.0
    for token, n in [*table.items(), *((None, k) for k in range(lm.TAIL_CLASSES))]:
        if token is None:
            cls, place = lm.HEAD_CLASSES + n, -1
        else:
            place = vocabulary.places.get(token.encode(), -1)
            cls = place // lm.CLASS_WORDS if place >= 0 else lm.tail_class(token.encode())
        hashes = np.array([1, 2, 3, 4], np.uint32)
        outer, inner = lm.features(hashes, np.array([3]), np.array([cls]), vocabulary.rows)
        p = lm.probabilities(start.outer, start.outer_bias, outer)[0, cls]
        if place >= 0:
            p *= lm.probabilities(start.inner, start.inner_bias[[cls]], inner)[0, place % lm.CLASS_WORDS]
        else:
            p *= (1 if token is None else n + 1) / vocabulary.denominators()[cls - lm.HEAD_CLASSES]
        total += p
    assert abs(total - 1) < 1e-3


def test_model_beats_base_on_held_out_text(spark):
    rng = np.random.default_rng(1)
    left, right = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    rows = [(k, " ".join(rng.choice(left if k % 2 else right, 80))) for k in range(600)]
    got = [r for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert len(got) > 50
    assert np.mean([r["score"] - r["base_score"] for r in got]) > 10


def test_the_512_most_frequent_words_depend_on_their_context(spark):
    counts = spark.createDataFrame([(f"w{k}", 1000 - k) for k in range(600)], "token string, n long")
    vocabulary, start = lm.vocabulary_of(counts)
    assert set(vocabulary.places) == {f"w{k}".encode() for k in range(512)}
    assert start.inner_bias.size == 512 and len(start.inner) == 2 * 8192
    hashes = np.arange(1, 60_000, dtype=np.uint32)
    at = np.arange(3, len(hashes))
    _, inner = lm.features(hashes, at, np.zeros(len(at), int), vocabulary.rows)
    assert inner.max() >= 2 * 8192 - 100


def test_empty(none, spark):
    assert lm.score_documents(none).collect() == []
    only = lm.score_documents(spark.createDataFrame([(1, None), (1, None)], "doc_id long, text string")).collect()
    assert [r["n_tokens"] for r in only] == [1, 1]


def test_tables_follow_the_vocabulary_within_bounds():
    assert [lm.Rows.of(n).short for n in (0, 1000, 256 << 11, 256 << 12, 1 << 40)] == [1 << 12, 1 << 12, 1 << 12, 1 << 13, 1 << 13]
    rows = lm.Rows.of(256 << 12)
    hashes = np.random.default_rng(2).integers(0, 1 << 32, 200_000).astype(np.uint32)
    at = np.arange(3, len(hashes))
    outer, inner = lm.features(hashes, at, np.zeros(len(at), int), rows)
    assert outer.max() == 3 * rows.short + rows.pair - 1 and inner.max() == 2 * rows.inner - 1


def test_another_corpus_in_the_same_session_changes_nothing(spark):
    """Workers are used again: what they keep of one fit must not reach the next."""
    rng = np.random.default_rng(3)
    corpus = lambda letter: spark.createDataFrame([(k, " ".join(rng.choice([f"{letter}{j}" for j in range(40)], 30))) for k in range(60)], "doc_id long, text string").coalesce(2).cache()
    first, second = corpus("a"), corpus("b")
    score = lambda df: {r["doc_id"]: r["score"] for r in lm.score_documents(df).collect()}
    before, other, after = score(first), score(second), score(first)
    assert all(x <= 0 for scores in (before, other, after) for x in scores.values())
    assert all(abs(before[k] - after[k]) < 0.1 for k in before)
    assert abs(np.mean(list(before.values())) - np.mean(list(other.values()))) < 2


def test_large_ids_beside_nulls(spark):
    big = 2**53 + 1
    got = lm.score_documents(spark.createDataFrame([(big, "a b"), (None, "a")], "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"] for r in got} == {big, None}


@pytest.mark.parametrize("n_rows", [40, 1 << 17])
def test_row_sums(n_rows):
    random = np.random.default_rng(3)
    rows, error = random.integers(0, 40, 500), random.standard_normal((500, 32)).astype(np.float32)
    got, sums = lm.row_sums(rows, error, n_rows)
    assert got.tolist() == sorted(set(rows.tolist()))
    assert np.allclose(sums, [error[rows == r].sum(axis=0) for r in got], atol=1e-4)


def frequent_and(spark, rare):
    """A vocabulary of 512 frequent words and these, equally rare."""
    return lm.vocabulary_of(spark.createDataFrame([(f"w{k}", 10_000 - k) for k in range(512)] + [(w, 3) for w in rare], "token string, n long"))


def test_rare_words_of_one_class_depend_on_the_word_before(spark):
    vocabulary, start = frequent_and(spark, ["aend", "bend"])
    assert lm.tail_class(b"aend") == lm.tail_class(b"bend")
    lookup = lm.Lookup(vocabulary)
    texts = pd.DataFrame({"text": ["w1 aend", "w2 bend"] * 2000})
    (state,) = lm.train_task(iter([texts]), start, lookup)
    weights = lm.Weights.unpack(np.concatenate([np.frombuffer(w, "<f2").astype(np.float32) for w in state["weights"]]), vocabulary.rows)
    asked = pd.DataFrame({"doc_id": "1", "held_out": False, "text": ["w1 aend", "w1 bend", "w2 aend", "w2 bend"]})
    score = lambda w: pd.concat(lm.score_task(iter([asked]), w, lookup))["model_sum"].to_numpy()
    before, after = score(start), score(weights)
    assert abs(before[0] - before[1]) < 1e-4 and abs(before[2] - before[3]) < 1e-4
    assert after[0] - after[1] > 1 and after[3] - after[2] > 1


def test_probabilities_of_known_rare_words_sum_to_their_class(spark):
    rare = [f"x{k}end" for k in range(300)]
    vocabulary, start = frequent_and(spark, rare)
    rng = np.random.default_rng(0)
    for weights in (start.outer, start.path):
        weights[:] = rng.normal(size=weights.shape)
    lookup = lm.Lookup(vocabulary)
    cls = lm.tail_class(b"x0end")
    hashes = np.array([zlib.crc32(b"\n"), zlib.crc32(b"\n"), zlib.crc32(b"w7"), 0], np.uint32)
    of_class = lm.probabilities(start.outer, start.outer_bias, lm.features(hashes, np.array([3]), np.array([cls]), vocabulary.rows)[0])[0, cls]
    paths = [sum(math.log10(lm.probabilities(start.path, bias, on)[0, digit[0]]) for bias, on, digit in lookup.path(np.append(hashes[:3], np.uint32(zlib.crc32(w.encode()))), np.array([3]), np.array([cls]))) for w in rare]
    ends = [lookup.end(np.array([zlib.crc32(w.encode())], np.uint32), np.array([cls]))[0] for w in rare]
    of = of_class * np.sum(10 ** np.array([p + e for p, e in zip(paths, ends, strict=True)]) * 4) / vocabulary.denominators()[cls - lm.HEAD_CLASSES]
    unknown = of_class / vocabulary.denominators()[cls - lm.HEAD_CLASSES]
    assert abs(of + unknown - of_class) < 1e-3 * of_class


def test_words_joined_score_as_words_of_the_head(spark):
    rng = np.random.default_rng(4)
    words = [f"v{k}" for k in range(1500)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words, 60))) for k in range(200)], "doc_id long, text string").coalesce(1).cache()
    score = lambda head: {r["doc_id"]: r["score"] for r in lm.score_documents(docs, head).collect()}
    joined, head = score(600), score(100_000)
    assert all(abs(joined[k] - head[k]) < 0.01 for k in head)


def test_paths_grow_with_the_vocabulary_without_bound():
    assert [lm.Rows.of(n).digits for n in (0, 256 << 5, 256 << 10, 256 << 15, 256 << 20)] == [1, 1, 2, 3, 4]
    assert [lm.Rows.of(n).path for n in (0, 256 << 12, 256 << 15, 256 << 20)] == [1 << 13, 1 << 13, 1 << 16, 1 << 21]
