import random
from collections import Counter

import numpy as np
import pytest

from foralia.llm import suffix_dedup as sd

from .conftest import SCHEMA


def brute(rows):
    """Per row the kept bytes; rows with equal doc_id and text are one document."""
    order = sorted({(r[0] is None, r[0] or 0, (r[1] or "").encode()) for r in rows})
    seen, kept = set(), {}
    for key in order:
        data = key[2]
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        kept[key] = (int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()) if len(data) else 0, np.frombuffer(data, np.uint8)[~gone].tobytes())
    return Counter((r[0], len((r[1] or "").encode()), *kept[(r[0] is None, r[0] or 0, (r[1] or "").encode())]) for r in rows)


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéñ", k=rng.randint(2, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 60))) for _ in range(6)]
    out = []
    for _ in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 50))), rng.choice(passages)[rng.randint(0, 30) :], word(), rng.choice(passages)]
        out.append(" ".join(rng.sample(parts, rng.randint(1, 4))))
    return [*out, out[3], out[3], "a" * 400, "ab" * 150, "x" * 99, "y" * 100, "y" * 100, "", None]


@pytest.mark.parametrize(("seed", "hot"), [(0, False), (1, False), (2, True)])
def test_matches_brute_force(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(sd, "HOT_SAMPLE", 1)
        monkeypatch.setattr(sd, "HOT_LEAST", 3)
        monkeypatch.setattr(sd, "HOT_SHARE", 0.0)
    rows = [(k, t) for k, t in enumerate(texts(seed))]
    rows += [(3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (None, None)]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got.collect()) == brute(rows)


def test_blocks_do_not_matter(monkeypatch):
    data = [(t or "").encode() for t in texts(2)] + [" ".join(map(str, range(900))).encode()]
    windows = lambda: sorted((int(o), int(s) + k) for own, start, count, *_ in sd.runs_of(data) for o, s, c in zip(own, start, count, strict=True) for k in range(int(c)))
    whole = windows()
    assert whole == sorted((k, s) for k, d in enumerate(data) for s in range(len(d) - 99))
    monkeypatch.setattr(sd, "BLOCK", 256)
    assert windows() == whole


def test_edges(spark, docs, rows, none):
    assert sd.remove_repeats(none).collect() == []
    assert sd.remove_repeats(docs).count() == len(rows)
    assert sd.remove_repeats(spark.createDataFrame([(1, "short", None, None, None, None, None, None, None)], SCHEMA)).collect()[0]["n_removed"] == 0


def test_a_filler_in_every_document_is_hot(spark, monkeypatch):
    """One home with most of all rows: whichever way it goes, the result is the same."""
    rng = random.Random(8)
    rows = [(k, "".join(rng.choices("abc ", k=rng.randint(0, 60))) + "ab" * rng.randint(60, 200) + str(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = lambda: Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.remove_repeats(df).collect())
    assert found() == brute(rows)
    monkeypatch.setattr(sd, "HOT_SAMPLE", 1)
    assert sd.hot_homes(sd._keyed(df))
    assert found() == brute(rows)


def test_a_home_with_many_rows_is_hot_whatever_its_share(spark, monkeypatch):
    passage = "a passage that a few of very many documents share, and which is long enough to be found as a repeat by its bytes; "
    texts = [f"{k} " * 9 + (passage if k % 4 == 0 else "") + "".join(chr(97 + (k * j * j + j) % 26) for j in range(300)) for k in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(sd, "HOT_SAMPLE", 1)
    monkeypatch.setattr(sd, "HOT_SHARE", 0.5)
    usual = sorted(map(tuple, sd.remove_repeats(df).collect()))
    assert not sd.hot_homes(sd._keyed(df))
    monkeypatch.setattr(sd, "HOT_MOST", 5)
    assert sd.hot_homes(sd._keyed(df))
    assert sorted(map(tuple, sd.remove_repeats(df).collect())) == usual and any(r[2] for r in usual)
