import random

import pytest

WORDS = ["tax", "law", "rate", "year", "income", "rent", "child", "court", "claim", "form", "line", "sum", "base", "due", "paid", "norm"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rank int, mark string, h1 string"


def corpus(seed: int = 0, n: int = 60) -> list[tuple]:
    """Documents with nulls in every column, empty and long texts, ties, repeated rows, near copies and clashing extra columns."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 120))) for _ in range(n // 3)]
    texts += [t.replace("rent", "RENT", 1) for t in texts[:8]] + [t + " extra words" for t in texts[:8]]
    shared = "This Shared Line is longer than twenty characters"
    texts += [f"{rng.choice(WORDS)} {k}\n  {shared} \nlast {k}" for k in range(6)] + [shared.lower(), shared + "\n" + shared]
    texts += ["", " \t\n", None, "x", "ñandú É ﬁ 日本語 🙂", " ".join(rng.choices(WORDS, k=6000))]
    rows = [(k, t, rng.choice(["en", "es", None]), rng.choice(["a", "b", "é", "", None]), len(t or ""), "s", k % 3, "m", None) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], rows[-1], (None, texts[1], None, None, None, None, None, None, None), (None, None, "en", "a", 0, "", 0, "", "")]
    return rows


@pytest.fixture
def rows():
    return corpus()


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
