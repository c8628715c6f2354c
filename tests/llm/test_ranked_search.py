import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from foralia.llm import ranked_search as rs

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def plain(docs, items, k):
    bags = [(d, ws) for d, t in docs if (ws := words(t))]
    n_all, l_all = len(bags), sum(len(ws) for _, ws in bags)
    df = Counter(w for _, ws in bags for w in set(ws))
    asked = {}
    for item, text in set(items):
        asked.setdefault(item, Counter()).update(words(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, ws in bags:
            tf, m = Counter(ws), 100 - 75 + (75 * len(ws) * n_all) // l_all
            score = sum(times * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, times in terms.items() if tf[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "Tax law, tax LAW rate year"), (2, "ñandú 日本語 é rent"), (3, None), (4, ""), (5, "nowhere"), (1, "Tax law, tax LAW rate year"), (6, "rent"), (6, "child child"), (None, "claim form"), (7, "x"), (8, " ".join(["tax", "sum", "due"] * 40))]


@pytest.mark.parametrize("k,postings,block_bytes", [(10, 2_000_000, 1 << 24), (3, 40, 30), (1, 1, 1 << 24), (100, 100, 1 << 24)])
def test_equals_scoring_everything(spark, docs, rows, k, postings, block_bytes):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id int, text string, doc_id string, score int")
    got = rs.search(docs, items, k, postings, block_bytes)
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == plain([(r[0], r[1]) for r in rows], ITEMS, k)


def test_reading_stops_early_and_loses_nothing():
    class Fixed(rs.Corpus):
        def __init__(self, docs, words, weights):
            self.docs, self.words, self.weights = docs, words, np.array(weights, np.int64)

    rng = np.random.default_rng(5)
    n_docs = 20_000
    sizes = np.full(n_docs, 3)
    times = rng.zipf(1.6, 3 * n_docs).clip(1, 10**6)
    n = times.reshape(-1, 3).sum(1)
    corpus = Fixed(n_docs, int(n.sum()), [900, 500, 100])
    ids = rng.permutation(n_docs)
    shard = rs.Shard(corpus, ids, n, sizes, np.tile(np.arange(3), n_docs), times)
    none = np.zeros(0, np.int64)
    terms, asked = np.array([0, 2]), np.array([1, 3])
    scores, found = shard.search(terms, asked, (none, none), 10)
    whole = shard.impacts.reshape(-1, 3)[:, [0, 2]] @ asked
    order = np.lexsort((ids, -whole))[:10]
    assert found.tolist() == ids[order].tolist() and scores.tolist() == whole[order].tolist()
    assert shard.entries_read < 2 * n_docs / 2
    assert not shard.seen.any() and not shard.asked.any()


def test_ties_at_the_threshold_go_to_the_smaller_id(spark):
    rng = random.Random(2)
    docs = [(k, rng.choice(["tax law", "law tax", "tax sum"])) for k in rng.sample(range(10_000), 300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    items = [(1, "tax"), (2, "law sum")]
    assert sorted(map(tuple, rs.search(frame, spark.createDataFrame(items, "item_id long, text string"), 10, 25).collect()), key=str) == plain(docs, items, 10)


def test_lengths_beyond_64_bits():
    class Fixed(rs.Corpus):
        def __init__(self):
            self.docs, self.words = 10**13, 10**15

    assert Fixed().lengths(np.array([10**7, 3])).tolist() == [25 + 75 * 10**7 // 100, 25 + 75 * 3 // 100]


def test_empty_tables(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert rs.search(none, items).count() == 0
    assert rs.search(docs, items.where("false")).count() == 0
