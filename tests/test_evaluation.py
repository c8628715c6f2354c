"""Norms on broadcast rules and in a join, whole quotas, families' freshness and the state of a catalogue."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from foralia.operators import drift, rules
from foralia.plans import evaluation

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_norms_in_a_join_decide_as_norms_on_the_rules(spark, monkeypatch):
    on_rules = evaluation.norm_cascade(spark, SF)
    plan = on_rules._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning(profile_id" not in plan
    expected = rows(on_rules)
    assert {r[2] for r in expected} == {"applies", "does_not_apply", "pending_validation"} and {r[3] for r in expected} == {0.95, 0.85, 0.3, 0.2}
    monkeypatch.setattr(rules, "MAX_CITED_VERSIONS", 0)
    assert rows(evaluation.norm_cascade(spark, SF)) == expected


def test_a_catalogue_that_asks_for_too_many_facts_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(rules, "MAX_PATHS", 0)
    from foralia.plans.tax import _profiles, _rules

    with pytest.raises(ValueError, match="different facts"):
        rules.evaluate(_profiles(spark, SF), _rules(spark))


DAYS = "id string, day date"


def fresh(spark, **families):
    made = {k: None if v is None else spark.createDataFrame(v, DAYS) for k, v in families.items()}
    return drift.families_freshness(spark, made, "day", "id", F.lit(date(2024, 3, 1)), 30, "rulings").first().asDict()


def test_families_are_one_check(spark):
    young, old = date(2024, 2, 20), date(2023, 1, 1)
    got = fresh(spark, court=[("c2", old), ("c1", None)], letters=None, tribunal=[("t9", young), ("t10", young)])
    assert got == {"check": "rulings", "latest": young, "latest_id": "t10", "age_days": 10, "ok": True, "skipped": False}
    assert fresh(spark, court=[("z", young)], letters=[("a", young)])["latest_id"] == "z"
    assert fresh(spark, court=[("z", old)])["ok"] is False


def test_no_family_is_a_skipped_check_and_an_empty_one_is_not_fresh(spark):
    unset = fresh(spark, court=None, letters=None)
    assert (unset["ok"], unset["skipped"], unset["latest"]) == (True, True, None)
    for rulings in ([], [("x", None)]):
        empty = fresh(spark, court=rulings, letters=None)
        assert (empty["ok"], empty["skipped"], empty["age_days"]) == (False, False, None)


def test_corpus_meta(spark):
    made = "id string, last_reviewed_at date, sources array<struct<boe_id:string>>"
    normas = spark.createDataFrame([("A",), ("A",)], "boe_id string")
    both = [("r1", date(2024, 1, 2), [{"boe_id": None}, {"boe_id": "X"}]), ("r2", None, None)]
    meta = lambda r: drift.corpus_meta(spark.createDataFrame(r, made), normas, ["id"]).first()
    got, turned = meta(both), meta(both[::-1])
    assert got == turned and got["count"] == 2 and got["last_reviewed_at"] == date(2024, 1, 2) and got["normas_registered"] is False
    more = meta([*both, ("r3", date(2025, 1, 1), [{"boe_id": "A"}])])
    assert more["normas_registered"] is True and more["fingerprint_sha256"] != got["fingerprint_sha256"]
    none = meta([])
    assert none["count"] == 0 and none["last_reviewed_at"] is None and none["normas_registered"] is False
