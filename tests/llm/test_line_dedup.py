from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foralia.llm import line_dedup

from .conftest import SCHEMA, corpus

UPPER = {ord(a): a.lower() for a in line_dedup.UPPER}


def brute(rows):
    key = lambda line: line.strip(line_dedup.SPACES).translate(UPPER)
    holders = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r[0])
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        gone = []
        for line in lines:
            ids = holders.get(key(line), ())
            gone.append(len(ids) >= 3 and max((i for i in ids if i is not None), default=None) != r[0])
        out.append((r[0], "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (6, 3)])
def test_matches_brute_force(spark, batches, fanout):
    rows = corpus(4)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), batches=batches, fanout=fanout)
    found = Counter((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect())
    assert found == Counter(brute(rows))
    assert any(k[3] for k in found)


def keys(spark, batch):
    return spark.createDataFrame([(h, h, batch, 1) for h in range(batch * 5, batch * 5 + 10)], "h1 long, h2 long, owner long, n_docs long")


def test_runs_carry_counts_and_owners_and_leave_nothing_behind(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(keys(spark, k))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    rows = [r for n in runs.names() for r in spark.table(n).collect()]
    assert {r["h1"]: (r["n_docs"], r["owner"]) for r in rows} == {h: (2 if 5 <= h < 25 else 1, min(4, h // 5)) for h in range(30)}
    assert len(rows) == 30
    assert {r["h1"] for r in runs.repeated(2).collect()} == set(range(5, 25))
    names = runs.names()
    runs.drop()
    assert not [t.name for t in spark.catalog.listTables() if t.name in names]


def test_a_named_index_takes_later_batches(spark):
    first = line_dedup.LineRuns(spark, fanout=2, index="kept_index")
    for k in range(3):
        first.add(keys(spark, k))
    again = line_dedup.LineRuns(spark, fanout=2, index="kept_index")
    assert again.levels == first.levels and again.names()
    again.add(keys(spark, 3))
    assert {r["h1"]: r["owner"] for r in again.repeated(2).collect()} == {h: h // 5 for h in range(5, 20)}
    again.drop()


def test_documents_that_come_later_meet_the_lines_of_earlier_ones(spark):
    line = "this shared line is longer than twenty characters"
    batch = lambda ids: spark.createDataFrame([(k, f"own text of {k}\n{line}") for k in ids], "doc_id long, text string")
    early = line_dedup.dedup_lines(batch([1, 2]), index="two_jobs").collect()
    assert all(r["n_dropped"] == 0 for r in early)
    late = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(batch([3, 4]), index="two_jobs").collect()}
    assert late == {3: 1, 4: 0}
    line_dedup.LineRuns(spark, index="two_jobs").drop()


def bytes_under(runs):
    from pathlib import Path

    return {str(p): p.stat().st_size for p in Path(runs.root.removeprefix("file://")).rglob("*.parquet")}


def test_a_batch_writes_no_run_again(spark):
    runs = line_dedup.LineRuns(spark, fanout=9)
    big = spark.range(60_000).select("id", F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(1), "id").alias("h2"))
    part = lambda low, high: big.where(f"id >= {low} AND id < {high}").select("h1", "h2", F.col("id").alias("owner"), F.lit(1).cast("long").alias("n_docs"))
    runs.add(part(0, 50_000))
    sizes = [sum(bytes_under(runs).values())]
    before = bytes_under(runs)
    for k in range(3):
        runs.add(part(49_900 + 100 * k, 50_100 + 100 * k))
        sizes.append(sum(bytes_under(runs).values()))
    assert before.items() <= bytes_under(runs).items()
    assert all(b - a < 0.05 * sizes[0] for a, b in zip(sizes, sizes[1:], strict=False))
    assert runs.repeated(2).count() == 300
    runs.drop()


def state(spark, index):
    runs = line_dedup.LineRuns(spark, fanout=2, index=index)
    return {r["h1"]: (r["n_docs"], r["owner"]) for n in runs.names() for r in spark.table(n).collect()}


@pytest.mark.parametrize("step", ["_write", "_rename", "_forget"])
def test_a_batch_that_dies_counts_whole_or_not_at_all(spark, monkeypatch, step):
    index = f"dies_at{step}"
    for k in range(3):
        line_dedup.LineRuns(spark, fanout=2, index=index).add(keys(spark, k))
    before = state(spark, index)
    runs = line_dedup.LineRuns(spark, fanout=2, index=index)

    def fail(*args, **kwargs):
        raise OSError("lost")

    calls, write = [], runs._write

    def second_write_fails(*args):
        calls.append(1)
        return fail() if len(calls) == 2 else write(*args)

    with monkeypatch.context() as patch:
        if step == "_write":
            patch.setattr(runs, "_write", second_write_fails)
        elif step == "_rename":
            patch.setattr(line_dedup, "_rename", fail)
        else:
            patch.setattr(runs, "commit", lambda *a: (patch.setattr(runs, "_forget", fail), line_dedup.LineRuns.commit(runs, *a)))
        with pytest.raises(OSError, match="lost"):
            runs.add(keys(spark, 3))
    after = state(spark, index)
    whole = before | {h: (2 if h < 20 else 1, 3) for h in range(15, 25)}
    assert after == (whole if step == "_forget" else before)
    if after == before:
        line_dedup.LineRuns(spark, fanout=2, index=index).add(keys(spark, 3))
    assert state(spark, index) == whole
    line_dedup.LineRuns(spark, index=index).drop()


def test_another_session_with_other_partitions_finds_the_index(spark):
    first = line_dedup.LineRuns(spark, fanout=2, index="found_by_path")
    first.add(keys(spark, 0))
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "7")
    for folder in first._folders():
        spark.sql(f"DROP TABLE IF EXISTS {first._name(folder)}")
    again = line_dedup.LineRuns(other, fanout=2, index="found_by_path")
    assert again.buckets == first.buckets
    again.add(keys(other, 1))
    assert {r["h1"]: r["owner"] for r in again.repeated(2).collect()} == {h: 1 for h in range(5, 10)}
    again.drop()


def test_a_named_job_counts_once(spark):
    line = "this shared line is longer than twenty characters"
    docs = spark.createDataFrame([(k, line) for k in (1, 2)], "doc_id long, text string")
    for _ in range(3):
        assert [r["n_dropped"] for r in line_dedup.dedup_lines(docs, index="job_once", job="monday").collect()] == [0, 0]
    line_dedup.LineRuns(spark, index="job_once").drop()


def test_empty(none):
    assert line_dedup.dedup_lines(none).collect() == []
