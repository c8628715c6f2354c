"""Eligibility rules over profiles: a status cascade, amounts, and mutually exclusive rules.

Every (profile, rule) pair gets a row. The catalogue of rules is small and its size is checked, so profiles are never
shuffled to meet it; what follows is one projection, and only exclusivity groups rows, by profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.functions.facts import compare, fact_map, typed
from foralia.functions.scales import capped, tiered_amount
from foralia.operators.temporal import timelines
from foralia.runtime import materialize

#: A catalogue above this is refused rather than broadcast.
MAX_RULES = 10_000
#: Up to so many versions, counted once for each source that cites them, ride on the broadcast rules; more are joined.
MAX_CITED_VERSIONS = 100_000
#: Different facts that a catalogue may ask for.
MAX_PATHS = 100_000
#: States of a norm that stop a rule.
STOPPING = ("derogada", "inconstitucional", "suspendida")

RULE = """
id string, name string, tax_year int, scope string, region string, category string,
requirements array<struct<field:string,operator:string,value:variant>>,
calculation struct<type:string,base_field:string,percentage:double,cap:double,fixed_amount:double,
  tiers:array<struct<up_to:double,percentage:double,alternate_percentage:double,alternate_when_field:string>>,
  cap_field:string,cap_percentage:double>,
`limit` double, incompatibilities array<string>, required_documents array<string>,
sources array<struct<boe_id:string,article:string>>, effective_from date, effective_to date, validation_status string
"""


def effective_day(profiles: DataFrame) -> Column:
    """The accrual date, by default the last day of the tax year."""
    return F.coalesce("devengo_date", F.make_date("tax_year", F.lit(12), F.lit(31)))


def _paths(rules: DataFrame) -> list[str]:
    fields = F.concat(
        F.transform(F.coalesce("requirements", F.expr("array()")), lambda r: r["field"]),
        F.array("calculation.base_field", "calculation.cap_field"),
        F.transform(F.coalesce("calculation.tiers", F.expr("array()")), lambda t: t["alternate_when_field"]),
    )
    found = rules.select(F.explode(F.array_compact(fields)).alias("path")).distinct().limit(MAX_PATHS + 1).collect()
    if len(found) > MAX_PATHS:
        raise ValueError(f"the rules of a catalogue ask for at most {MAX_PATHS} different facts")
    return [r["path"] for r in found]


def amount(facts: Column) -> Column:
    """The rule's amount for a profile's fact map, by calculation type; unknown types and manual review give 0."""
    calc, limit = F.col("calculation"), F.col("limit")
    number = lambda field: F.try_element_at(facts, field)["num"]
    base = number(calc["base_field"])
    flags = F.transform_values(facts, lambda _, v: F.coalesce(v["flag"], F.lit(False)))
    percentage = F.when(calc["base_field"].isNull() | calc["percentage"].isNull(), F.lit(0.0)).otherwise(capped(F.coalesce(base, F.lit(0.0)) * calc["percentage"], calc["cap"], limit))
    dynamic = number(calc["cap_field"]) * calc["cap_percentage"]
    return (
        F.when(calc["type"] == "fixed_amount", F.coalesce(calc["fixed_amount"], F.lit(0.0)))
        .when((calc["type"] == "amount_field") & calc["base_field"].isNotNull(), F.least(F.coalesce(base, F.lit(0.0)), limit))
        .when(calc["type"] == "percentage_with_cap", percentage)
        .when(calc["type"] == "tiered_progressive", tiered_amount(base, calc["tiers"], flags, calc["cap"], limit, dynamic))
        .otherwise(F.lit(0.0))
    )


def _stop_code(timeline: Column, day: Column) -> Column:
    """Why a known norm with these spans stops a rule on `day`; empty where it does not."""
    hit = F.filter(timeline, lambda v: (day >= v["effective_from"]) & (v["effective_to"].isNull() | (day <= v["effective_to"])))
    return F.coalesce(F.try_element_at(hit, F.lit(1))["code"], F.lit("no_version"))


def _cited(rules: DataFrame, normas: DataFrame, versions: DataFrame) -> DataFrame:
    """(id, pos, timeline) of each source whose norm is known: spans with the state if it stops rules, else an empty code.

    A norm without versions has no timeline.
    """
    code = lambda v: F.when(v["status"].isin(*STOPPING), v["status"]).otherwise(F.lit("")).alias("code")
    span = lambda v: F.struct(v["effective_from"].alias("effective_from"), v["effective_to"].alias("effective_to"), code(v))
    sources = rules.select("id", F.posexplode("sources").alias("pos", "source")).select("id", "pos", F.col("source.boe_id").alias("boe_id"))
    time = timelines(versions.withColumnRenamed("norma_boe_id", "boe_id").join(sources.select("boe_id").distinct(), "boe_id", "left_semi"), ["boe_id"], "effective_from")
    return sources.join(normas.select("boe_id").distinct(), "boe_id", "left_semi").join(time, "boe_id", "left").select("id", "pos", F.transform("timeline", span).alias("timeline"))


def _norm_block(cited: DataFrame, pairs: DataFrame) -> DataFrame:
    """(profile_id, id, norm_block): the first source in order whose norm stops the rule on the profile's date."""
    told = pairs.join(cited, "id").withColumn("code", _stop_code(F.col("timeline"), F.col("day")))
    return told.where("code <> ''").groupBy("profile_id", "id").agg(F.min_by("code", "pos").alias("norm_block"))


def _pairs(prepared: DataFrame, rules: DataFrame, normas: DataFrame | None, versions: DataFrame | None) -> DataFrame:
    """Every profile with every rule and `norm_block`, the reason why the first such norm it cites stops it.

    The timelines of cited norms ride on the rules, so that pairs are never shuffled; where there are too many to broadcast,
    pairs meet them in a join.
    """
    if normas is None:
        return prepared.crossJoin(F.broadcast(rules)).withColumn("norm_block", F.lit(None).cast("string"))
    cited = materialize(_cited(rules, normas, versions), "cited")
    total = cited.agg(F.sum(F.greatest(F.size("timeline"), F.lit(1)))).first()[0] or 0
    if total > MAX_CITED_VERSIONS:
        blocks = _norm_block(cited, prepared.select("profile_id", "day").crossJoin(F.broadcast(rules.select("id"))))
        return prepared.crossJoin(F.broadcast(rules)).join(blocks, ["profile_id", "id"], "left")
    norms = cited.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "timeline"))).alias("norms"))
    codes = F.filter(F.transform("norms", lambda n: _stop_code(n["timeline"], F.col("day"))), lambda c: c != "")
    pairs = prepared.crossJoin(F.broadcast(rules.join(norms, "id", "left")))
    return pairs.withColumn("norm_block", F.try_element_at(codes, F.lit(1))).drop("norms")


def evaluate(profiles: DataFrame, rules: DataFrame, normas: DataFrame | None = None, versions: DataFrame | None = None) -> DataFrame:
    """(profile_id, rule columns of note, status, estimated_amount, confidence, missing_fields, missing_documents).

    profiles: profile_id, tax_year, region, devengo_date, facts VARIANT, documents array<string>. The first step of
    the cascade that decides wins: own validity, norms cited, tax year, region, validation, missing data, failed
    requirements, missing documents, manual calculation, applies.
    """
    if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
        raise ValueError(f"a rule catalogue has at most {MAX_RULES} rules")
    prepared = profiles.select("profile_id", F.col("tax_year").alias("p_year"), F.col("region").alias("p_region"), effective_day(profiles).alias("day"), "documents", fact_map(F.col("facts"), _paths(rules)).alias("facts"))
    pairs = _pairs(prepared, rules, normas, versions)
    fact = lambda field: F.try_element_at(F.col("facts"), field)
    asked = F.coalesce("requirements", F.expr("array()").cast("array<struct<field:string,operator:string,value:variant>>"))
    absent = F.transform(F.filter(asked, lambda r: ~F.coalesce(fact(r["field"])["found"], F.lit(False))), lambda r: r["field"])
    failed = F.exists(asked, lambda r: ~compare(fact(r["field"]), r["operator"], typed(r["value"])))
    papers = F.filter(F.coalesce("required_documents", F.expr("array()").cast("array<string>")), lambda d: ~F.coalesce(F.array_contains("documents", d), F.lit(False)))
    steps = pairs.withColumn("missing_fields", absent).withColumn("failed", failed).withColumn("papers", papers).withColumn("computed", amount(F.col("facts")))
    day = F.col("day")
    ladder = [
        ((day < F.col("effective_from")) | (day > F.col("effective_to")), "does_not_apply", 0.95),
        (F.col("norm_block").isin("derogada", "inconstitucional"), "does_not_apply", 0.95),
        (F.col("norm_block") == "suspendida", "pending_validation", 0.3),
        (F.col("norm_block") == "no_version", "pending_validation", 0.2),
        (F.col("tax_year") != F.col("p_year"), "does_not_apply", 0.9),
        ((F.col("region") != "") & (F.lower("region") != F.lower("p_region")), "does_not_apply", 0.9),
        (F.col("validation_status") != "validada", "pending_validation", 0.2),
        (F.size("missing_fields") > 0, "missing_data", 0.5),
        (F.col("failed"), "does_not_apply", 0.8),
        (F.size("papers") > 0, "missing_evidence", 0.7),
        (F.col("calculation.type") == "manual_review", "requires_manual_calculation", 0.6),
    ]
    verdict = F.struct(F.lit("applies").alias("status"), F.lit(0.85).alias("confidence"))
    for test, status, confidence in reversed(ladder):
        verdict = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))).otherwise(verdict)
    judged = steps.withColumn("v", verdict)
    status = F.col("v.status")
    nothing = F.expr("array()").cast("array<string>")
    return judged.select(
        "profile_id", F.col("id").alias("deduction_id"), "name", "category", "scope", "sources", "incompatibilities", status.alias("status"),
        F.when(status.isin("applies", "missing_evidence"), F.col("computed")).otherwise(F.lit(0.0)).alias("estimated_amount"), F.col("v.confidence").alias("confidence"),
        F.when(status == "missing_data", F.col("missing_fields")).otherwise(nothing).alias("missing_fields"),
        F.when(status == "missing_evidence", F.col("papers")).otherwise(nothing).alias("missing_documents"),
    )


def component_labels(members: Column, edges: Column) -> Column:
    """map<id, label>: each edge (a, b) of an array relabels one side's whole component; labels are the least id."""
    start = F.map_from_arrays(members, members)

    def merge(labels: Column, e: Column) -> Column:
        a, b = F.try_element_at(labels, e["a"]), F.try_element_at(labels, e["b"])
        low, high = F.least(a, b), F.greatest(a, b)
        both = a.isNotNull() & b.isNotNull()
        return F.transform_values(labels, lambda _, v: F.when(both & (v == high), low).otherwise(v))

    return F.aggregate(edges, start, merge)


def resolve_incompatibilities(evaluations: DataFrame) -> DataFrame:
    """Evaluations with rules that exclude each other turned into requires_user_choice, amount 0, with `alternatives`.

    Exclusion is symmetric and transitive among the rules that apply to one profile; a profile's rows, as many as the
    catalogue has rules, meet in one group.
    """
    applies = F.col("status") == "applies"
    own = F.struct("deduction_id", "estimated_amount", F.coalesce("incompatibilities", F.expr("array()").cast("array<string>")).alias("others"))
    groups = evaluations.where(applies).groupBy("profile_id").agg(F.array_sort(F.collect_list(own)).alias("in_force"))
    groups = groups.withColumn("ids", F.array_distinct(F.transform("in_force", lambda r: r["deduction_id"])))
    edges = F.flatten(F.transform("in_force", lambda r: F.transform(r["others"], lambda o: F.struct(r["deduction_id"].alias("a"), o.alias("b")))))
    groups = groups.withColumn("labels", component_labels(F.col("ids"), edges)).select("profile_id", "in_force", "labels")
    joined = evaluations.join(groups, "profile_id", "left")
    label = F.try_element_at("labels", F.col("deduction_id"))
    rivals = F.filter("in_force", lambda r: (F.try_element_at(F.col("labels"), r["deduction_id"]) == label) & (r["deduction_id"] != F.col("deduction_id")))
    rivals = F.transform(rivals, lambda r: F.struct((-r["estimated_amount"]).alias("k"), r["deduction_id"].alias("id"), r["estimated_amount"].alias("amount")))
    ordered = F.transform(F.array_sort(rivals), lambda r: F.struct(r["id"].alias("id"), r["amount"].alias("amount")))
    joined = joined.withColumn("alternatives", F.when(applies, ordered))
    conflict = F.coalesce(F.size("alternatives") > 0, F.lit(False)) & applies
    return (
        joined.withColumn("own_amount", F.col("estimated_amount"))
        .withColumn("estimated_amount", F.when(conflict, F.lit(0.0)).otherwise(F.col("estimated_amount")))
        .withColumn("alternatives", F.when(conflict, F.col("alternatives")))
        .withColumn("status", F.when(conflict, F.lit("requires_user_choice")).otherwise(F.col("status")))
        .drop("labels", "in_force")
    )
