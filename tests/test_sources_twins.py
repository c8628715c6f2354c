import json
from datetime import date

import pytest

from foralia.sources import catalogues, vectors


def embed_but(words):
    def embed(texts):
        for t in texts:
            for w in words:
                if w in t:
                    raise RuntimeError(f"refused {w}")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def run(spark, tmp_path, rows, words=(), **how):
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").coalesce(1)
    got = vectors.index_corpus(str(tmp_path / "v"), str(tmp_path / "failed"), chunks, embed_but(words), 2, batch=2, **how)
    table = {r["chunk_id"]: tuple(r["embedding"]) for r in spark.read.parquet(str(tmp_path / "v")).collect()}
    return {r["outcome"]: r["n"] for r in got.collect()}, table, {r["chunk_id"]: r["error"] for r in spark.read.parquet(str(tmp_path / "failed")).collect()}


def test_failed_batches_are_noted_and_run_again_alone(spark, tmp_path):
    rows = [("a", "uno"), ("b", None), ("c", "malo"), ("d", "cuatro!"), ("e", "cinco"), ("a", "uno"), (None, "nadie")]
    outcomes, table, failed = run(spark, tmp_path, rows, ["malo"])
    assert outcomes["failed"] == len(failed) and outcomes["added"] == len(table) == 5 - len(failed) and "c" in failed and "malo" in failed["c"]
    outcomes, table, still = run(spark, tmp_path, rows + [("new", "x")], [], only_failed=True)
    assert outcomes == {"added": len(failed)} and still == {} and set(table) == set("abcde") and table["b"] == (0.0, 1.0)
    outcomes, table, _ = run(spark, tmp_path, [("a", "otro texto"), ("b", None)])
    assert outcomes == {"conflict": 1, "duplicate": 1} and table["a"] == (10.0, 1.0)


def test_vectors_of_another_length_fail(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "x")], "chunk_id string, text string")
    got = vectors.index_corpus(str(tmp_path / "v"), str(tmp_path / "failed"), chunks, lambda ts: [[1.0] for _ in ts], 2)
    assert [tuple(r) for r in got.collect()] == [("failed", 1)]
    assert "2 expected" in spark.read.parquet(str(tmp_path / "failed")).first()["error"]


def test_strict_and_permissive_readers(spark, tmp_path):
    norm = lambda i, title: {"boe_id": i, "kind": "ley", "title": title, "enacted_at": "2020-01-01"}
    version = lambda i, day, note: {"norma_boe_id": i, "effective_from": day, "status": "vigente", "notes": note}
    path = str(tmp_path)
    (tmp_path / "b.json").write_text(json.dumps({"normas": [norm("N1", "second"), norm("N2", "own")], "versions": [version("N1", "2020-01-01", "second"), version("lost", "2020-01-01", "")]}))
    (tmp_path / "a.json").write_text(json.dumps({"normas": [norm("N1", "first")], "versions": [version("N1", "2020-01-01", "first"), version("N1", "2021-01-01", "next")]}))
    assert catalogues.read_json_strict(spark, path, "normas", catalogues.NORM).count() == 3
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text('{"other": 1}')
    with pytest.raises(ValueError, match="c.json: broken JSON"):
        catalogues.read_json_strict(spark, path, "normas", catalogues.NORM)
    norms, versions, refused = catalogues.merge_normas(spark, path)
    assert {(r["boe_id"], r["title"]) for r in norms.collect()} == {("N1", "first"), ("N2", "own")}
    assert {(r["norma_boe_id"], r["effective_from"], r["notes"]) for r in versions.collect()} == {("N1", date(2020, 1, 1), "first"), ("N1", date(2021, 1, 1), "next")}
    assert sorted((r["file"][-6:], r["pos"], r["problem"]) for r in refused.where("pos is not null").collect()) == [("b.json", 0, "norm known before"), ("b.json", 0, "version known before"), ("b.json", 1, "unknown norm")]
    assert {(r["file"][-6:], r["problem"]) for r in refused.where("pos is null").collect()} == {("c.json", "broken JSON"), ("d.json", "no list normas")}
