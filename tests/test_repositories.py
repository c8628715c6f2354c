"""Entities saved again and again against a loop over their saves."""

import random
from pathlib import Path

import pytest

from foralia.runtime import scratch_dir
from foralia.sources import partitioned, repositories

SCHEMA = "id string, at long, body string, more long"


def table_of(spark, name):
    return f"{scratch_dir(spark)}/{name}"


def loop(saves):
    out = {}
    for key, at, body, more in saves:
        order = lambda r: tuple((x is not None, x) for x in r)
        first, last = out.get(key, (None, None))
        known = [t for t in (first, at) if t is not None]
        out[key] = (min(known, default=None), (at, body, more) if last is None else max(last, (at, body, more), key=order))
    return out


def stored(spark, path):
    return {r["id"]: (r["created_at"], (r["updated_at"], r["body"], r["more"])) for r in partitioned.read_partitions(spark, path, ["bucket"]).collect()}


def test_batches_in_any_order_and_twice_give_what_a_loop_gives(spark):
    rng = random.Random(5)
    saves = [(rng.choice(["a", "b", "c", "ñ", "", None]), rng.choice([1, 2, 3, 4, None]), rng.choice(["x", "y", None]), rng.choice([1, None])) for _ in range(60)]
    batches, path = [saves[:20], saves[20:21], saves[21:], [], saves[:20]], table_of(spark, "saved")
    for batch in reversed(batches):
        repositories.save(path, spark.createDataFrame(batch, SCHEMA), ["id"], "at", 4)
    assert stored(spark, path) == loop(saves)
    wanted = spark.createDataFrame([("a",), ("a",), (None,), ("zz",)], "id string")
    found = repositories.find(spark, path, wanted, ["id"], 4).collect()
    assert sorted(str(r["id"]) for r in found) == ["None", "a"] and "bucket" not in found[0].asDict()


def test_other_partitions_keep_their_files(spark):
    path = table_of(spark, "kept_files")
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(path.removeprefix("file://")).rglob("*.parquet")}
    many = spark.range(200).selectExpr("cast(id as string) id", "id as at", "'x' body", "id as more")
    assert repositories.save(path, many, ["id"], "at", 16) == 16
    before = files()
    assert repositories.save(path, spark.createDataFrame([("7", 999, "new", 0)], SCHEMA), ["id"], "at", 16) == 1
    after = files()
    assert sum(before[p] == after.get(p) for p in before) >= len(before) * 14 // 16
    assert stored(spark, path)["7"] == (7, (999, "new", 0)) and len(stored(spark, path)) == 200


@pytest.mark.parametrize("step", ["staged", "moved"])
def test_a_save_that_dies_is_undone_or_finished(spark, monkeypatch, step):
    path = table_of(spark, f"dies_{step}")
    repositories.save(path, spark.createDataFrame([("a", 1, "old", 1)], SCHEMA), ["id"], "at", 2)

    def fail(*args):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(partitioned, "_rename" if step == "staged" else "_install", fail)
        with pytest.raises(OSError, match="lost"):
            repositories.save(path, spark.createDataFrame([("a", 2, "new", 1)], SCHEMA), ["id"], "at", 2)
    assert stored(spark, path) == {"a": (1, (1, "old", 1) if step == "staged" else (2, "new", 1))}


def test_clashing_columns_are_an_error(spark):
    with pytest.raises(ValueError, match="created_at"):
        repositories.save(table_of(spark, "clash"), spark.createDataFrame([("a", 1, 2)], "id string, at long, created_at long"), ["id"], "at")
