import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from foralia.functions.facts import compare, fact_map, typed
from foralia.functions.scales import progressive_amount, tiered_amount
from foralia.operators import quota, rules, temporal

BRACKETS = "array<struct<up_to:double,rate:double>>"


def slow_scale(base, brackets):
    total, low = 0.0, 0.0
    for up, rate in brackets:
        top = base if up is None else min(base, up)
        total += max(0.0, top - low) * rate
        low = low if up is None else up
    return total if base > 0 else 0.0


def test_progressive_amount_at_and_around_the_edges(spark):
    brackets = [(12450.0, 0.095), (20200.0, 0.12), (35200.0, 0.15), (None, 0.225)]
    bases = [0.0, -5.0, 0.01, 12450.0, 12450.01, 20200.0, 35200.0, 1e6, None]
    rows = spark.createDataFrame([(b, brackets) for b in bases] + [(9.0, []), (9.0, None)], f"b double, s {BRACKETS}")
    got = [r[0] for r in rows.select(progressive_amount(F.col("b"), F.col("s"))).collect()]
    assert got[:8] == pytest.approx([slow_scale(b, brackets) for b in bases[:8]])
    assert got[8:] == [None, 0.0, 0.0]


def test_a_closed_scale_leaves_what_lies_above(spark):
    df = spark.createDataFrame([(50.0, [(10.0, 0.5), (20.0, 0.1)])], f"b double, s {BRACKETS}")
    assert df.select(progressive_amount(F.col("b"), F.col("s"))).first()[0] == pytest.approx(6.0)


def test_tiered_amount_and_caps(spark):
    tiers = "array<struct<up_to:double,percentage:double,alternate_percentage:double,alternate_when_field:string>>"
    t = [(250.0, 0.8, None, None), (None, 0.4, 0.45, "loyal")]
    rows = [(1000.0, t, {"loyal": False}, None, None, None), (1000.0, t, {"loyal": True}, None, None, None), (1000.0, t, {}, 300.0, 310.0, None), (1000.0, t, {}, None, None, 12.5), (0.0, t, {}, -5.0, None, None), (None, t, {}, None, None, None)]
    df = spark.createDataFrame(rows, f"b double, t {tiers}, a map<string,boolean>, c double, l double, d double")
    got = [r[0] for r in df.select(tiered_amount(*(F.col(c) for c in ("b", "t", "a", "c", "l", "d")))).collect()]
    assert got == pytest.approx([500.0, 537.5, 300.0, 12.5, 0.0, 0.0])


VALUES = ["5", "5.0", "true", "1", "null", '"x"', '"5"', "[1,2]", "[5]", "false", "0"]
MISSING = object()


def python_compare(value, op, expected):
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    match op:
        case "exists":
            return value is not None
        case "not_exists":
            return value is None
        case "==":
            return value == expected
        case "!=":
            return value != expected
        case "in":
            return isinstance(expected, list) and value in expected
    return number(value) and number(expected) and {">": value > expected, ">=": value >= expected, "<": value < expected, "<=": value <= expected}[op]


def test_compare_has_no_coercion(spark):
    cases = [(v, op, e) for v in VALUES for op in ("==", "!=", ">", ">=", "<", "<=", "in", "exists", "not_exists") for e in VALUES]
    df = spark.createDataFrame([(k, f'{{"a":{v}}}', op, e) for k, (v, op, e) in enumerate(cases)], "k int, v string, op string, e string")
    fact = F.element_at(fact_map(F.parse_json("v"), ["a"]), F.lit("a"))
    got = {r["k"]: r["r"] for r in df.select("k", compare(fact, F.col("op"), typed(F.parse_json("e"))).alias("r")).collect()}
    want = {k: python_compare(json.loads(v), op, json.loads(e)) for k, (v, op, e) in enumerate(cases)}
    assert {k: cases[k] for k in got if got[k] != want[k]} == {}


def profile(spark, facts, documents=("d",), region="Madrid", year=2024, day=None):
    rows = [(1, year, region, day, json.dumps(facts), list(documents))]
    return spark.createDataFrame(rows, "profile_id int, tax_year int, region string, devengo_date date, j string, documents array<string>").withColumn("facts", F.parse_json("j")).drop("j")


def rule(spark, *specs):
    base = {"name": "n", "tax_year": 2024, "scope": "autonomico", "category": "deduccion", "requirements": [], "calculation": {"type": "fixed_amount", "fixed_amount": 10.0}, "incompatibilities": [], "required_documents": [], "sources": [], "validation_status": "validada"}
    text = [(json.dumps(base | s),) for s in specs]
    return spark.createDataFrame(text, "j string").select(F.from_json("j", rules.RULE.replace("\n", " ")).alias("r")).select("r.*")


CASES = [
    ({"effective_from": "2025-01-01"}, "does_not_apply", 0.95),
    ({"effective_to": "2024-12-30"}, "does_not_apply", 0.95),
    ({"effective_to": "2024-12-31"}, "applies", 0.85),
    ({"tax_year": 2023}, "does_not_apply", 0.9),
    ({"region": "GALICIA"}, "does_not_apply", 0.9),
    ({"region": "MADRID"}, "applies", 0.85),
    ({"validation_status": "borrador", "requirements": [{"field": "zz", "operator": "exists", "value": None}]}, "pending_validation", 0.2),
    ({"requirements": [{"field": "zz", "operator": "not_exists", "value": None}, {"field": "a.n", "operator": ">", "value": 9}]}, "missing_data", 0.5),
    ({"requirements": [{"field": "a.n", "operator": ">", "value": 9}], "required_documents": ["z"]}, "does_not_apply", 0.8),
    ({"required_documents": ["d", "z"]}, "missing_evidence", 0.7),
    ({"calculation": {"type": "manual_review"}}, "requires_manual_calculation", 0.6),
    ({"requirements": [{"field": "a.nil", "operator": "not_exists", "value": None}, {"field": "a.n", "operator": "in", "value": [1, 5]}]}, "applies", 0.85),
]


def test_status_cascade(spark):
    specs = [{"id": f"r{k:02d}"} | s for k, (s, _, _) in enumerate(CASES)]
    got = {r["deduction_id"]: r for r in rules.evaluate(profile(spark, {"a": {"n": 5, "nil": None}}), rule(spark, *specs)).collect()}
    for k, (_, status, confidence) in enumerate(CASES):
        r = got[f"r{k:02d}"]
        assert (r["status"], r["confidence"]) == (status, confidence), CASES[k]
    assert got["r07"]["missing_fields"] == ["zz"] and got["r09"]["missing_documents"] == ["z"]
    assert got["r09"]["estimated_amount"] == 10.0 and got["r10"]["estimated_amount"] == 0.0


def test_norms_stop_rules_in_the_order_of_sources(spark):
    normas = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "boe_id string")
    day = date(2000, 1, 1)
    versions = spark.createDataFrame([("A", day, None, "vigente"), ("B", day, None, "suspendida"), ("C", day, None, "derogada"), ("D", day, date(2001, 1, 1), "vigente")], "norma_boe_id string, effective_from date, effective_to date, status string")
    src = lambda *ids: [{"boe_id": i, "article": "art. 1"} for i in ids]
    specs = [{"id": "1", "sources": src("A")}, {"id": "2", "sources": src("A", "B", "C")}, {"id": "3", "sources": src("C", "B")}, {"id": "4", "sources": src("X", None, "D")}, {"id": "5", "sources": src("X")}]
    got = {r["deduction_id"]: (r["status"], r["confidence"]) for r in rules.evaluate(profile(spark, {}), rule(spark, *specs), normas, versions).collect()}
    assert got == {"1": ("applies", 0.85), "2": ("pending_validation", 0.3), "3": ("does_not_apply", 0.95), "4": ("pending_validation", 0.2), "5": ("applies", 0.85)}


def test_amounts(spark):
    calc = lambda **k: {"calculation": k}
    specs = [
        calc(type="percentage_with_cap", base_field="a.n", percentage=0.5) | {"id": "p"}, calc(type="percentage_with_cap", base_field="a.n", percentage=0.5, cap=2.0) | {"id": "c", "limit": 1.5},
        calc(type="percentage_with_cap", base_field="a.neg", percentage=0.5, cap=2.0) | {"id": "m"}, calc(type="percentage_with_cap", base_field="a.b", percentage=0.5) | {"id": "b"},
        calc(type="amount_field", base_field="a.n") | {"id": "f", "limit": 3.0}, calc(type="fixed_amount", fixed_amount=7.0) | {"id": "x", "limit": 3.0},
        calc(type="tiered_progressive", base_field="a.n", tiers=[{"up_to": 2.0, "percentage": 1.0}, {"percentage": 0.1}], cap_field="a.n", cap_percentage=0.1) | {"id": "t"},
    ]
    got = {r["deduction_id"]: r["estimated_amount"] for r in rules.evaluate(profile(spark, {"a": {"n": 5, "neg": -4, "b": True}}), rule(spark, *specs)).collect()}
    assert got == pytest.approx({"p": 2.5, "c": 1.5, "m": -2.0, "b": 0.0, "f": 3.0, "x": 7.0, "t": 0.5})


def test_exclusive_rules_become_a_choice(spark):
    specs = [{"id": "a", "incompatibilities": ["b", "zz"]}, {"id": "b", "incompatibilities": []}, {"id": "c", "incompatibilities": ["b"], "calculation": {"type": "fixed_amount", "fixed_amount": 30.0}}, {"id": "d"}, {"id": "e", "incompatibilities": ["d"], "tax_year": 2020}]
    got = {r["deduction_id"]: r for r in rules.resolve_incompatibilities(rules.evaluate(profile(spark, {}), rule(spark, *specs))).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "requires_user_choice", "b": "requires_user_choice", "c": "requires_user_choice", "d": "applies", "e": "does_not_apply"}
    assert [(x["id"], x["amount"]) for x in got["a"]["alternatives"]] == [("c", 30.0), ("b", 10.0)]
    assert got["c"]["estimated_amount"] == 0.0 and got["c"]["own_amount"] == 30.0 and got["d"]["alternatives"] is None


SCALES = [
    (0, 2024, "estatal", "general", None, [(10000.0, 0.1), (None, 0.2)], date(2024, 1, 1), None),
    (1, 2024, "estatal", "ahorro", None, [(None, 0.1)], date(2024, 1, 1), None),
    (2, 2024, "autonomico", "general", "Madrid", [(None, 0.5)], date(2024, 1, 1), None),
    (3, 2024, "autonomico", "general", "MADRID", [(None, 0.1)], date(2024, 1, 1), None),
]


def scales(spark):
    return spark.createDataFrame(SCALES, f"ordinal int, tax_year int, scope string, component string, region string, brackets {BRACKETS}, effective_from date, effective_to date")


def test_quota(spark):
    facts = {"income": {"work_net": 30000, "capital_mobiliario_net": 1000, "rental_housing_net": True}, "withholdings": [{"amount": 100}, {"amount": "x"}, 5, {"amount": True}]}
    specs = [
        {"id": "r", "category": "reduccion", "calculation": {"type": "fixed_amount", "fixed_amount": 2000.0}}, {"id": "m", "category": "minimo_personal_familiar", "calculation": {"type": "fixed_amount", "fixed_amount": 5000.0}},
        {"id": "e", "scope": "estatal", "calculation": {"type": "fixed_amount", "fixed_amount": 200.0}}, {"id": "a", "calculation": {"type": "fixed_amount", "fixed_amount": 50.0}},
        {"id": "d", "sources": [{"boe_id": "B", "article": "Art. 81 bis"}], "calculation": {"type": "fixed_amount", "fixed_amount": 1200.0}},
    ]
    people = profile(spark, facts)
    got = quota.compute_quota(people, rules.evaluate(people, rule(spark, *specs)), scales(spark)).first()
    state = slow_scale(28000, SCALES[0][5]) - slow_scale(5000, SCALES[0][5]) + 100
    regional = 2300 + 100
    assert got["base_liquidable_general"] == 28000 and got["cuota_integra_estatal"] == pytest.approx(state) and got["cuota_integra_autonomica"] == pytest.approx(regional)
    assert got["cuota_diferencial"] == pytest.approx(state - 100 + regional - 150 - 100 - 1200)
    other = profile(spark, facts, region="Galicia")
    none = quota.compute_quota(other, rules.evaluate(other, rule(spark, *specs)), scales(spark)).first()
    assert none["cuota_integra_autonomica"] is None and none["cuota_diferencial"] is None and none["cuota_liquida_estatal"] > 0


def test_reductions_and_minimum_flow_over(spark):
    facts = {"income": {"base_imponible_general": 1000, "base_imponible_ahorro": 900}}
    specs = [{"id": "r", "category": "reduccion", "calculation": {"type": "fixed_amount", "fixed_amount": 1300.0}}, {"id": "m", "category": "minimo_personal_familiar", "calculation": {"type": "fixed_amount", "fixed_amount": 5000.0}}]
    people = profile(spark, facts)
    got = quota.compute_quota(people, rules.evaluate(people, rule(spark, *specs)), scales(spark)).first()
    assert (got["base_liquidable_general"], got["base_liquidable_ahorro"], got["minimo_aplicado_base_general"], got["minimo_aplicado_base_ahorro"]) == (0, 600, 0, 5000)


def test_as_of_join_against_brute_force(spark):
    rng = random.Random(4)
    d = lambda: date(2000, 1, 1).fromordinal(730000 + rng.randrange(400))
    versions = []
    for key in range(5):
        for v in range(4):
            a, b = sorted((d(), d()))
            versions.append((key, v, a, None if v == 3 else b))
    facts = [(k, rng.randrange(6), d() if k % 9 else None) for k in range(200)]
    v = spark.createDataFrame(versions, "key int, v int, effective_from date, effective_to date")
    f = spark.createDataFrame(facts, "id int, key int, day date")
    for pick in ("first", "last"):
        got = {r["id"]: r["version"] and r["version"]["v"] for r in temporal.as_of_join(f, v, ["key"], "day", pick=pick, order="v").collect()}
        for i, key, day in facts:
            hits = [x[1] for x in versions if x[0] == key and day and x[2] <= day and (x[3] is None or day <= x[3])]
            assert got[i] == ((min if pick == "first" else max)(hits) if hits else None)


def test_overlaps_orphans_and_filter_modes(spark):
    rows = [("A", date(2020, 1, 1), date(2020, 6, 30)), ("A", date(2020, 7, 1), None), ("B", date(2020, 1, 1), None), ("B", date(2021, 1, 1), None)]
    v = spark.createDataFrame(rows, "k string, effective_from date, effective_to date")
    assert [r["k"] for r in temporal.overlap_violations(v, ["k"]).collect()] == ["B"]
    assert {r["k"] for r in temporal.orphans(v, spark.createDataFrame([("A",)], "k string"), "k").collect()} == {"B"}
    day = F.lit(date(2020, 6, 30))
    for mode in ("strict", "warn", "off"):
        assert [r["verdict"] for r in temporal.temporal_filter(v, day, mode).orderBy("k", "effective_from").collect()] == ["accepted", "rejected", "accepted", "rejected"]
    open_start = spark.createDataFrame([(1, None, None), (2, None, date(2001, 1, 1)), (3, date(2001, 1, 1), date(2002, 1, 1)), (4, date(2020, 6, 30), date(2020, 6, 30))], "k int, effective_from date, effective_to date")
    for mode, want in (("strict", ["rejected", "rejected", "rejected", "accepted"]), ("warn", ["disclaimer", "disclaimer", "rejected", "accepted"]), ("off", ["accepted", "accepted", "rejected", "accepted"])):
        got = temporal.temporal_filter(open_start, day, mode).orderBy("k").collect()
        assert [r["verdict"] for r in got] == want
        assert [r["reason"] for r in got] == [None if mode == "off" else "no_start"] * 2 + ["no_longer_in_force", None]
