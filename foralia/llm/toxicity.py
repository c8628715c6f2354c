"""Toxicity by cumulative-link ordinal regression on sparse words.

One weight vector serves all thresholds: P(grade <= k) = sigmoid(threshold_k - w.x), thresholds increasing. Grades are
the labels' own, from 0 for clean upwards, up to MAX_GRADES of them; labels that say only yes or no give two grades, one
threshold, and an expected severity that is the probability of toxic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foralia.runtime import materialize, table

#: Labelled documents used to fit (the first by hash of doc_id), and words kept as features: bounds of the fit alone.
MAX_LABELLED = 20_000
MAX_FEATURES = 4096
#: Different grades that labels may have; more are an error.
MAX_GRADES = 100
#: A word must follow so many different words in toxic documents, and half as many as it has toxic documents: copies of
#: one passage repeat their contexts and prove nothing more than the first.
MIN_CONTEXTS = 5
MIN_WEIGHT = 2.5
RIDGE = 0.02
STEPS = 800
#: A document is called toxic from this probability of grade 1 or more: one marker word in a long text suffices.
TOXIC_FROM = 0.1
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def contexts_of(text: str) -> list[tuple[str, str]]:
    """Distinct (word, word before it)."""
    words = WORD.findall(text.lower())
    return sorted(set(zip(words, ["", *words], strict=False)))


@dataclass
class OrdinalModel:
    vocabulary: dict[str, int]
    weights: np.ndarray
    #: One fewer than grades.
    thresholds: np.ndarray
    #: The grades, from 0 for clean upwards: thresholds lie between neighbours, whatever their distance.
    levels: np.ndarray

    def scores(self, texts) -> np.ndarray:
        known = self.vocabulary.keys()
        return np.array([self.weights[[self.vocabulary[w] for w in sorted(words_of(x or "") & known)]].sum() for x in texts])

    def grade_probabilities(self, scores: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))
        return np.diff(below, axis=1, prepend=0.0, append=1.0)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from a sparse 0/1 matrix by full-batch Adam; weights are not negative (features are words of evidence); thresholds are a first value and positive gaps."""
    n = max(len(grades), 1)
    params = np.concatenate([np.zeros(n_features), [1.0], np.zeros(n_grades - 2)])
    low, high = np.zeros_like(params), np.zeros_like(params)
    pick = np.arange(len(grades))
    for step in range(1, steps + 1):
        w, raw = params[:n_features], params[n_features:]
        theta = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        score = np.bincount(rows, w[cols], len(grades)) if len(rows) else np.zeros(len(grades))
        cut = np.concatenate([[-np.inf], theta, [np.inf]])
        with np.errstate(over="ignore"):
            upper = 1 / (1 + np.exp(score - cut[grades + 1]))
            lower = 1 / (1 + np.exp(score - cut[grades]))
        p = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = upper * (1 - upper) / p, lower * (1 - lower) / p
        d_score = d_upper - d_lower
        grad_theta = np.zeros(n_grades + 1)
        np.add.at(grad_theta, grades[pick] + 1, -d_upper)
        np.add.at(grad_theta, grades[pick], d_lower)
        inner = grad_theta[1:n_grades]
        tail = np.cumsum(inner[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, d_score[rows], n_features) + ridge * w, [tail[0]], tail[1:] * np.exp(raw[1:])]) / n
        low = 0.9 * low + 0.1 * grad
        high = 0.99 * high + 0.01 * grad * grad
        params = params - 0.1 * (low / (1 - 0.9**step)) / (np.sqrt(high / (1 - 0.99**step)) + 1e-9)
        params[:n_features] = np.maximum(params[:n_features], 0)
    raw = params[n_features:]
    return params[:n_features], np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Fits on at most `max_labelled` labelled documents, equal texts once, with at most `max_features` words.

    `labels.toxic` is the grade, any of up to MAX_GRADES different numbers; under zero counts as zero. Labels without doc_id or grade are left out; of several for
    a document, and of equal texts, the worst counts. Without toxic examples no word has weight and nothing is found
    toxic. Other columns are ignored; rows that repeat change nothing; reruns agree.
    """
    grade = F.greatest(F.lit(0).cast("long"), F.max(F.col("toxic").cast("long")))
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(grade.alias("grade"))
    place, span = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), 1 << 30
    share = min(1.0, 1.2 * max_labelled / max(marks.count(), 1))  # so that tasks do not each hand on max_labelled rows
    sample = marks.where(place < int(share * span)).orderBy(place, "doc_id").limit(max_labelled).select("doc_id", "grade")
    split = F.pandas_udf(lambda texts: texts.map(lambda x: sorted(words_of(x))), "array<string>")
    pairs = F.pandas_udf(lambda texts: texts.map(contexts_of), "array<struct<word:string,before:string>>")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy(F.xxhash64("text").alias("same")).agg(F.first("text").alias("text"), F.max("grade").alias("grade"), F.min("doc_id").alias("doc_id"))
    texts = materialize(texts.withColumn("toxic", (F.col("grade") > 0).cast("int")), "labelled")
    bags = materialize(texts.select("doc_id", "same", "grade", "toxic", split("text").alias("words")), "bags")
    total = bags.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    n_toxic, n_clean = total["t"], total["n"] - total["t"]
    counts = bags.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    strong = counts.withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT)
    around = texts.where("toxic = 1").select(F.inline(pairs.asNondeterministic()("text"))).distinct().groupBy("word").agg(F.count("*").alias("contexts"))
    strong = strong.join(around, "word").where((F.col("contexts") >= MIN_CONTEXTS) & (2 * F.col("contexts") >= F.col("t")))
    best = strong.orderBy(F.desc(F.col("t") * F.col("weight")), "word").limit(max_features).collect()
    words = [r["word"] for r in best]
    vocabulary = {w: k for k, w in enumerate(words)}
    keep = F.array_intersect("words", F.array(*map(F.lit, words))) if words else F.array().cast("array<string>")
    known = bags.select("doc_id", "same", "grade", keep.alias("words")).toPandas().sort_values(["doc_id", "same"], kind="stable")
    grades = known["grade"].to_numpy(np.int64)
    if not grades.any():
        return OrdinalModel({}, np.zeros(0), np.array([50.0]), np.array([0, 1]))
    levels = np.unique(np.append(grades, 0))
    if len(levels) > MAX_GRADES:
        raise ValueError(f"{len(levels)} different grades, at most {MAX_GRADES}")
    lists = [[vocabulary[w] for w in ws] for ws in known["words"]]
    cols = np.array([c for x in lists for c in x], np.int64)
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists]).astype(np.int64)
    return OrdinalModel(vocabulary, *fit_ordinal(rows, cols, np.searchsorted(levels, grades), len(words), len(levels)), levels)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, toxic, grade, expected_severity, p_clean) per row of `docs`; null text has no words, rows that repeat score alike."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("toxic boolean, grade long, expected_severity double, p_clean double")
    def run(texts: pd.Series) -> pd.DataFrame:
        p = shared.value.grade_probabilities(shared.value.scores(texts))
        return pd.DataFrame({"toxic": p[:, 0] <= 1 - TOXIC_FROM, "grade": shared.value.levels[p.argmax(axis=1)], "expected_severity": p @ shared.value.levels, "p_clean": p[:, 0]})

    return docs.select("doc_id", run(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of every document, from a model fitted on `labels`; repeated rows score alike, no documents give no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
