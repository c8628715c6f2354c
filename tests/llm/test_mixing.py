import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from foralia.llm import mixing


def shares(sizes, weights, budget):
    """Targets by handing excess on, exactly."""
    total = Fraction(budget) * sum(sizes.values())
    target, capped = {}, set()
    while True:
        rest = [s for s in sizes if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        for s in rest:
            target[s] = left * weights[s] / sum(weights[x] for x in rest)
        over = [s for s in rest if target[s] > 2 * sizes[s]]
        if not over:
            return target
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            capped.add(s)


def test_targets_and_takes(docs, rows):
    sized = docs.drop("size").withColumn("size", mixing.word_count("text"))
    got = mixing.mix(sized).collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += count(r[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = shares(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, Fraction(3, 2))
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == count(r["text"]) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(float(want[r["source"]]))
        taken[r["source"]] += sum(c["words"] for c in r["copies"])
        assert all(0 < c["words"] <= r["size"] and 0 <= c["position"] <= 1 for c in r["copies"])
    assert all(abs(taken[s] - float(want[s])) < 1.001 for s in sizes)


def test_positions_invert_demand(spark):
    for slope in (-0.5, 0.0, 0.5, 1.0, -1.0):
        t = [k / 10 for k in range(11)]
        rows = [(100.0 * (x + slope * (x * x - x)), 100.0, slope, x) for x in t]
        df = spark.createDataFrame(rows, "words double, target double, slope double, t double")
        if slope == 1.0:
            df = df.where("words > 0")
        for r in df.select("t", mixing.demand_time(F.col("words"), F.col("target"), F.col("slope")).alias("u")).collect():
            assert r["u"] == pytest.approx(r["t"], abs=1e-9)


def test_order_reruns_and_cuts(docs):
    sized = docs.drop("size").withColumn("size", mixing.word_count("text"))
    runs = [sorted(str(r) for r in mixing.mix(sized.repartition(n)).select("doc_id", "size", "source", "copies").collect()) for n in (1, 5)]
    assert runs[0] == runs[1]
    copies = mixing.mix(sized).select("*", F.inline("copies")).drop("copies")
    cut = mixing.cut_to_words(copies).withColumn("now", mixing.word_count("text"))
    assert cut.where("now <> words").count() == 0
    ordered = mixing.in_training_order(mixing.mix(sized)).select("position", F.spark_partition_id().alias("p")).collect()
    spans = defaultdict(list)
    for r in ordered:
        spans[r["p"]].append(r["position"])
    assert all(x == sorted(x) for x in spans.values())
    bounds = [(min(spans[p]), max(spans[p])) for p in sorted(spans)]
    assert all(a[1] <= b[0] for a, b in zip(bounds, bounds[1:], strict=False))


def test_empty(none):
    assert mixing.mix(none.drop("size").withColumn("size", F.lit(0).cast("long"))).collect() == []


def test_hash_order_is_md5():
    assert hashlib.md5(b"1").hexdigest() < hashlib.md5(b"2").hexdigest()


def test_sources_and_tables_without_words(spark):
    rows = [(1, "a b c", "x"), (2, "", "y"), (3, None, "y"), (4, " \t", None)]
    form = "doc_id long, text string, source string"
    for part in (rows, rows[1:]):
        got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(part, form).withColumn("size", mixing.word_count("text"))).collect()}
        assert len(got) == len(part)
        assert all(not got[k]["copies"] and got[k]["target"] == 0 for k in (2, 3, 4))
    ordered = mixing.in_training_order(mixing.mix(spark.createDataFrame(rows, form).withColumn("size", mixing.word_count("text"))))
    assert sum(r["words"] for r in ordered.collect()) in (4, 5, 6)
