"""The tax quota of each profile from its evaluations and the scales in force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.functions.scales import progressive_amount, round_half_up
from foralia.operators.rules import effective_day
from foralia.operators.temporal import covers

GENERAL = ("work_net", "capital_inmobiliario_net", "economic_activity_net", "rental_housing_net", "imputaciones_renta")
SAVINGS = ("capital_mobiliario_net", "ganancias_patrimoniales_net")


def _number(facts: Column, path: str) -> Column:
    value = F.try_variant_get(facts, "$." + path, "variant")
    numeric = F.schema_of_variant(value).rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    return F.when(numeric, F.try_variant_get(value, "$", "double"))


def taxable_base(facts: Column, explicit: str, parts: tuple[str, ...]) -> Column:
    """income.<explicit> if it is a number, else the sum of the parts that are."""
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(_number(facts, f"income.{part}"), F.lit(0.0))
    return F.coalesce(_number(facts, f"income.{explicit}"), total)


def withholdings(facts: Column) -> Column:
    """Sum of the numeric amounts in the array `withholdings`; other entries are ignored."""
    rows = F.coalesce(F.try_variant_get(facts, "$.withholdings", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    return F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + F.coalesce(_number(r, "amount"), F.lit(0.0)))


def select_scale(profiles: DataFrame, scales: DataFrame, scope: str, component: str, into: str) -> DataFrame:
    """Adds `into`, the brackets of the last scale in load order (column ordinal) that fits year, region and day."""
    mine = scales.where((F.col("scope") == scope) & (F.col("component") == component))
    keys = [F.col("tax_year").alias("_year"), F.lower("region").alias("_region")] if scope == "autonomico" else [F.col("tax_year").alias("_year")]
    known = mine.select(*keys, F.struct("ordinal", "brackets", "effective_from", "effective_to").alias("scale"))
    known = known.groupBy(*(c for c in known.columns if c != "scale")).agg(F.array_sort(F.collect_list("scale")).alias("scales"))
    match = profiles["tax_year"] == known["_year"]
    if scope == "autonomico":
        match = match & (F.lower(profiles["region"]) == known["_region"])
    joined = profiles.join(known, match, "left")
    hit = F.try_element_at(F.filter("scales", lambda s: covers(F.col("day"), s["effective_from"], s["effective_to"])), F.lit(-1))
    return joined.withColumn(into, hit["brackets"]).drop("scales", "_year", "_region")


def deduction_buckets(evaluations: DataFrame) -> DataFrame:
    """(profile_id, reductions, minimum, state, regional, differential): what applies, summed by kind and scope.

    State deductions are shared half and half between the state and regional quota; those citing article 81 come off
    at the end instead.
    """
    last = F.exists(F.coalesce("sources", F.expr("array()").cast("array<struct<boe_id:string,article:string>>")), lambda s: F.coalesce(F.lower(F.trim(s["article"])).startswith("art. 81"), F.lit(False)))
    kind = F.col("category")
    bucket = F.when(kind == "reduccion", "reductions").when(kind == "minimo_personal_familiar", "minimum").when(kind == "deduccion", F.when(last, "differential").when(F.col("scope") == "estatal", "state").otherwise("regional"))
    mine = evaluations.where(F.col("status") == "applies").withColumn("bucket", bucket)
    total = lambda name, share=1.0: F.sum(F.when(F.col("bucket") == name, F.col("estimated_amount") * share).otherwise(0.0))
    return mine.groupBy("profile_id").agg(
        total("reductions").alias("reductions"), total("minimum").alias("minimum"), total("state", 0.5).alias("state"),
        (total("state", 0.5) + total("regional")).alias("regional"), total("differential").alias("differential"),
    )


def compute_quota(profiles: DataFrame, evaluations: DataFrame, scales: DataFrame) -> DataFrame:
    """One row per profile. Without a regional scale everything regional is null: unknown is not zero."""
    own = profiles.withColumn("day", effective_day(profiles))
    for scope, component, into in (("estatal", "general", "s_general"), ("estatal", "ahorro", "s_savings"), ("autonomico", "general", "r_general")):
        own = select_scale(own, scales, scope, component, into)
    own = own.join(deduction_buckets(evaluations), "profile_id", "left")
    zero = F.lit(0.0)
    for c in ("reductions", "minimum", "state", "regional", "differential"):
        own = own.withColumn(c, F.coalesce(c, zero))
    facts = F.col("facts")
    own = own.withColumn("big", taxable_base(facts, "base_imponible_general", GENERAL)).withColumn("bia", taxable_base(facts, "base_imponible_ahorro", SAVINGS))
    own = own.withColumn("blg", F.greatest(zero, F.col("big") - F.col("reductions")))
    own = own.withColumn("bla", F.greatest(zero, F.col("bia") - F.greatest(zero, F.col("reductions") - F.col("big"))))
    own = own.withColumn("min_general", F.least("minimum", "blg")).withColumn("min_savings", F.col("minimum") - F.col("min_general"))
    net = lambda brackets, base, low: F.greatest(zero, progressive_amount(F.col(base), F.col(brackets)) - progressive_amount(F.col(low), F.col(brackets)))
    savings = net("s_savings", "bla", "min_savings")
    own = own.withColumn("q_state", net("s_general", "blg", "min_general") + savings)
    own = own.withColumn("q_regional", F.when(F.col("r_general").isNotNull(), net("r_general", "blg", "min_general") + savings))
    own = own.withColumn("l_state", F.greatest(zero, F.col("q_state") - F.col("state")))
    own = own.withColumn("l_regional", F.when(F.col("q_regional").isNotNull(), F.greatest(zero, F.col("q_regional") - F.col("regional"))))
    paid = withholdings(facts)
    liquid = F.col("l_state") + F.col("l_regional")
    out = {
        "base_imponible_general": F.col("big"), "base_imponible_ahorro": F.col("bia"), "reducciones_aplicadas": F.col("reductions"),
        "base_liquidable_general": F.col("blg"), "base_liquidable_ahorro": F.col("bla"), "minimo_personal_familiar": F.col("minimum"),
        "minimo_aplicado_base_general": F.col("min_general"), "minimo_aplicado_base_ahorro": F.col("min_savings"),
        "cuota_integra_estatal": F.col("q_state"), "cuota_integra_autonomica": F.col("q_regional"), "cuota_integra_total": F.col("q_state") + F.col("q_regional"),
        "deducciones_cuota_estatal": F.col("state"), "deducciones_cuota_autonomica": F.col("regional"), "deducciones_cuota_diferencial": F.col("differential"),
        "cuota_liquida_estatal": F.col("l_state"), "cuota_liquida_autonomica": F.col("l_regional"), "cuota_liquida_total": liquid,
        "retenciones_y_pagos_cuenta": paid, "cuota_diferencial": liquid - paid - F.col("differential"),
    }
    return own.select("profile_id", "tax_year", "region", F.col("day").alias("devengo_date"), *(round_half_up(x).alias(name) for name, x in out.items()))
