import random

import numpy as np
import pytest

from foralia.llm import toxicity


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(800)]
    rows = []
    for k in range(900):
        text = rng.choices(words, k=rng.randint(20, 90))
        toxic = k % 5 == 0
        for _ in range(rng.randint(1, 6) * toxic):
            text[rng.randrange(len(text))] = rng.choice(["vile", "Awful!!", "nasty", "rotten,"])
        rows.append((k, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy_and_order(spark, labelled):
    docs = spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in labelled if r[0] < 600] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(model.vocabulary) == {"vile", "awful", "nasty", "rotten"}
    assert (model.weights >= 0).all() and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in labelled if r[0] >= 600]
    assert all(got[r[0]]["toxic"] == bool(r[2]) for r in held)
    mild, severe = model.scores(["vile w1"]), model.scores(["vile awful nasty rotten w1"])
    p = model.grade_probabilities(np.concatenate([mild, severe]))
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    assert p.shape == (2, 2) and p[1, 1] > p[0, 1]


def log_loss(p, grades):
    return -np.mean(np.log(np.maximum(p[np.arange(len(grades)), grades], 1e-9)))


def test_graded_labels_share_weights_across_ordered_thresholds(spark):
    """Grade 2 holds words of its own and more of the common ones: held-out loss beats the base rates, severity follows the grade."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(600)]
    rows = []
    for k in range(1500):
        text, grade = rng.choices(words, k=rng.randint(20, 60)), (0, 0, 0, 1, 2)[k % 5]
        for _ in range((0, 1, 3)[grade]):
            text[rng.randrange(len(text))] = rng.choice(["vile", "awful", "nasty"] if grade == 1 or rng.random() < 0.4 else ["murder", "maim"])
        rows.append((k, " ".join(text), grade))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 1000], "doc_id long, toxic int"))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    held = [r for r in rows if r[0] >= 1000]
    grades = np.array([r[2] for r in held])
    p = model.grade_probabilities(model.scores([r[1] for r in held]))
    assert log_loss(p, grades) < 0.5 * log_loss(np.tile([0.6, 0.2, 0.2], (len(held), 1)), grades)
    severity = p @ np.arange(3)
    assert [severity[grades == g].mean() for g in range(3)] == sorted(severity[grades == g].mean() for g in range(3))
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert np.allclose([got[r[0]]["expected_severity"] for r in held], severity)


def test_equal_texts_with_different_labels_agree_over_reruns(spark, labelled):
    rows = labelled + [(2000 + k, labelled[k][1], 1 - labelled[k][2]) for k in range(100)]
    models = []
    for parts in (1, 5):
        docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(parts)
        models.append(toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int").repartition(parts)))
    assert models[0].vocabulary == models[1].vocabulary and np.allclose(models[0].weights, models[1].weights)


def test_copies_of_one_passage_are_no_evidence(spark, labelled):
    passage = "quiet harmless passage repeated word for word"
    rows = labelled + [(1000 + k, f"{passage} vile w{k} w{k + 1}", 1) for k in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert "harmless" not in model.vocabulary and "vile" in model.vocabulary


def test_edges(spark, docs, rows, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and not any(r["toxic"] for r in got)
    assert toxicity.score(none, model).collect() == []


def test_grades_far_apart_are_levels_of_their_own(spark, labelled):
    docs = spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string")
    most = 2**31 - 1
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2] * most) for r in labelled], "doc_id long, toxic long"))
    assert model.levels.tolist() == [0, most] and len(model.thresholds) == 1
    got = toxicity.score(docs, model).collect()
    assert {r["grade"] for r in got} == {0, most} and all(0 <= r["expected_severity"] <= most for r in got)
    with pytest.raises(ValueError, match="different grades"):
        toxicity.fit(docs, spark.createDataFrame([(r[0], 1 + k) for k, r in enumerate(labelled)], "doc_id long, toxic long"))
