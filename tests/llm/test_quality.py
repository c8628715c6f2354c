import math
import random
import re

import numpy as np
import pytest

from foralia.llm import quality


def slow(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    marks = set()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            marks.update((i, i + 1, i + 2))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(marks), n < 50 or 100 * len(marks) > 50 * n


def test_counts_match_brute_force(rows):
    extra = ["a b a b a b", "x\nx\n\n\nx ", "# | <>%\r\n# | <>%", " ".join(random.Random(1).choices("abc", k=200)), "a b c", "a b"]
    for text in [*extra, *(r[1] for r in rows if len(r[1] or "") < 3000)]:
        assert quality.measure(text or "")[:6] == slow(text)


def test_binomial_is_exact():
    for n, p in ((30, 0.1), (200, 0.005), (5, 0.5)):
        for k in range(n + 1):
            assert quality.at_most(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_certify_stops_at_the_first_step_without_proof():
    assert quality.certify([0, 0, 1, 59], [5, 25, 5, 55], 5000, 0.005, 0.001) == 2
    assert quality.certify([0, 0, 1, 59], [5, 25, 5, 55], 100, 0.005, 0.001) == 0


def test_false_rejection_of_all_rules_together_stays_under_the_risk():
    """Many holdouts of one stratum whose rules reject more and more good documents: the bound fails in no more than `level` of them."""
    rng = np.random.default_rng(4)
    shares, risk, level, n = np.full(12, 0.004), 0.02, 0.05, 1200
    wrong, taken = 0, 0
    for _ in range(2000):
        good = rng.multinomial(n, [*shares, 1 - shares.sum()])[:-1]
        steps = quality.certify(good.tolist(), [1000] * 12, n, risk, level)
        wrong, taken = wrong + (shares[:steps].sum() > risk + 1e-12), taken + steps
    assert wrong / 2000 <= level and taken / 2000 > 1


def test_paths_take_the_step_that_gains_most():
    none = {r: np.zeros(len(g), int) for r, g in quality.RULES.items()}
    good, bad = dict(none), dict(none)
    bad["symbol_rate"] = np.arange(len(none["symbol_rate"])) * 10
    good["bang_rate"], bad["bang_rate"] = none["bang_rate"] + 5, none["bang_rate"] + 45
    assert quality.draw_path(none, none) == []
    path = quality.draw_path(good, bad)
    assert path == [("symbol_rate", len(none["symbol_rate"]) - 1)]


def test_copies_are_one_trial(spark):
    docs, labels = make(spark, 60)
    again = docs.union(docs.selectExpr("doc_id + 1000", "text", "lang")).union(docs.selectExpr("doc_id + 2000", "concat(text, ' more')", "lang"))
    marks = labels.union(labels.selectExpr("doc_id + 1000", "quality")).union(labels.selectExpr("doc_id + 2000", "quality"))
    measured = quality.features(again).drop("text")
    assert 60 <= quality.trials(measured, marks).count() <= 75


def make(spark, n):
    rng = random.Random(7)
    vocabulary = [f"word{k}" for k in range(3000)]
    rows, labels = [], []
    for k in range(n):
        words = rng.choices(vocabulary, k=80)
        bad = k % 4 == 0
        if bad:
            words = [w + "###" for w in words] if k % 8 else [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words), "en"))
        labels.append((k, int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_rejects_bad_and_keeps_good(spark):
    docs, labels = make(spark, 4000)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(got[k] for k in got if k % 4) and not any(got[k] for k in got if k % 4 == 0)
    assert {r["doc_id"] for r in quality.keep_good(docs, labels).collect()} == {k for k in got if got[k]}


def test_few_labels_certify_nothing(spark):
    docs, labels = make(spark, 200)
    assert all(r["kept"] for r in quality.judge(docs, labels).collect())


def test_strata_draw_paths_from_each_other_and_large_ids_survive(spark):
    docs, labels = make(spark, 1800)
    big = 2**53 + 1
    docs = docs.selectExpr("doc_id", "text", "if(doc_id % 3 = 0, 'en', if(doc_id % 3 = 1, 'es', null)) as lang")
    docs = docs.union(spark.createDataFrame([(big, "x", "en"), (None, "y", "en")], docs.schema)).coalesce(1)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert {big, None} < set(got)
    assert all(got[k] for k in range(1800) if k % 4) and not any(got[k] for k in range(0, 1800, 4))


def test_edges(spark, docs, rows, none):
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 0), (1, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["base_failed"]) for r in got) == sorted((str(r[0]), slow(r[1])[0] if len(r[1] or "") < 3000 else 6000, quality.measure(r[1] or "")[5]) for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    assert quality.judge(none, labels).collect() == [] == quality.keep_good(none, labels).collect()
