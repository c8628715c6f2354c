"""Queries on the driver tables for rules under norms, whole quotas and the state of a catalogue, with their DuckDB equivalents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foralia.operators import drift, quota, rules
from foralia.plans.retrieval import _SUMS
from foralia.plans.tax import _q, _values
from foralia.runtime import table

#: Rules and the norms they cite, in order: norm 3 is known and has no version, norm 4 is unknown, null is no norm.
CITED = {"N1": [0], "N2": [1, 2], "N3": [3], "N4": [4, None], "N5": [], "N6": [1, 2, 0], "N7": [4, 1]}
KNOWN = (0, 1, 2, 3)
#: A norm annulled, then in force, then repealed; one in force; one suspended for a year.
NORM_VERSIONS = [
    (0, date(1992, 1, 1), date(1993, 12, 31), "inconstitucional"),
    (0, date(1994, 1, 1), date(1996, 6, 30), "vigente"),
    (0, date(1997, 1, 1), None, "derogada"),
    (1, date(1990, 1, 1), None, "vigente"),
    (2, date(1995, 1, 1), date(1995, 12, 31), "suspendida"),
    (2, date(1996, 1, 1), None, "vigente"),
]


def _citing_rules(spark: SparkSession) -> DataFrame:
    source = lambda n: f"named_struct('boe_id', {_q(n)}, 'article', 'art. 1')"
    calculation = "from_json('{\"type\":\"fixed_amount\",\"fixed_amount\":100.0}', 'type string, base_field string, percentage double, cap double, fixed_amount double, tiers array<struct<up_to:double,percentage:double,alternate_percentage:double,alternate_when_field:string>>, cap_field string, cap_percentage double')"
    fixed = f"""'name' as name, 2024 as tax_year, 'estatal' as scope, cast(null as string) as region, 'deduccion' as category,
        cast(null as array<struct<field:string,operator:string,value:variant>>) as requirements, {calculation} as calculation, cast(null as double) as `limit`,
        cast(null as array<string>) as incompatibilities, cast(null as array<string>) as required_documents,
        cast(null as date) as effective_from, cast(null as date) as effective_to, 'validada' as validation_status"""
    rows = [f"select '{i}' as id, cast(array({', '.join(map(source, norms))}) as array<struct<boe_id:string,article:string>>) as sources, {fixed}" for i, norms in CITED.items()]
    return spark.sql(" union all ".join(rows))


def norm_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a profile on its day against rules that cite norms: the first source whose norm was not in force decides."""
    profiles = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("profile_id"), F.lit(2024).alias("tax_year"), F.lit("Madrid").alias("region"), F.to_date("o_orderdate").alias("devengo_date"),
        F.parse_json(F.lit("{}")).alias("facts"), F.array(F.lit("deed")).alias("documents"),
    )
    versions = spark.createDataFrame([(str(n), a, b, s) for n, a, b, s in NORM_VERSIONS], "norma_boe_id string, effective_from date, effective_to date, status string")
    normas = spark.createDataFrame([(str(n),) for n in KNOWN], "boe_id string")
    found = rules.evaluate(profiles, _citing_rules(spark), normas, versions)
    return found.select("profile_id", "deduction_id", "status", "confidence", "estimated_amount")


_SOURCES = _values([(i, pos, n) for i, norms in CITED.items() for pos, n in enumerate(norms)])
NORM_SQL = f"""
WITH v(norm, a, b, status) AS (VALUES {_values(NORM_VERSIONS)}), s(id, pos, norm) AS (VALUES {_SOURCES}), known(norm) AS (VALUES {_values([(n,) for n in KNOWN])}),
r(id) AS (VALUES {_values([(i,) for i in CITED])}), o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders),
told AS (
  SELECT o.o_orderkey, s.id, s.pos, CASE WHEN v.norm IS NULL THEN 'no_version' ELSE v.status END AS code
  FROM o CROSS JOIN s JOIN known ON known.norm = s.norm LEFT JOIN v ON v.norm = s.norm AND o.day >= v.a AND (v.b IS NULL OR o.day <= v.b)
), block AS (
  SELECT o_orderkey, id, arg_min(code, pos) AS code FROM told WHERE code <> 'vigente' GROUP BY 1, 2
)
SELECT o.o_orderkey AS profile_id, r.id AS deduction_id,
       CASE WHEN block.code IN ('derogada', 'inconstitucional') THEN 'does_not_apply' WHEN block.code IS NOT NULL THEN 'pending_validation' ELSE 'applies' END AS status,
       CASE block.code WHEN 'derogada' THEN 0.95 WHEN 'inconstitucional' THEN 0.95 WHEN 'suspendida' THEN 0.3 WHEN 'no_version' THEN 0.2 ELSE 0.85 END::DOUBLE AS confidence,
       CASE WHEN block.code IS NULL THEN 100.0 ELSE 0.0 END::DOUBLE AS estimated_amount
FROM o CROSS JOIN r LEFT JOIN block ON block.o_orderkey = o.o_orderkey AND block.id = r.id
"""

#: (scope, component, region, brackets): Galicia has no scale of its own.
QUOTA_SCALES = [
    ("estatal", "general", None, [(1000.0, 0.095), (4000.0, 0.12), (None, 0.15)]),
    ("estatal", "ahorro", None, [(500.0, 0.095), (None, 0.105)]),
    ("autonomico", "general", "Madrid", [(2000.0, 0.085), (None, 0.205)]),
]


def whole_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quota of every customer from its balance, its nation's capital income, withholdings and line items as applied rules."""
    key = F.col("c_custkey")
    text = lambda c: F.format_string("%.2f", c)
    income = F.concat(F.lit('"income":{"work_net":'), text(F.col("c_acctbal")), F.lit(',"rental_housing_net":"many","ganancias_patrimoniales_net":'), (F.col("c_nationkey") * 100).cast("string"))
    income = F.concat(income, F.when(key % 10 == 0, F.lit(',"base_imponible_general":5000}')).otherwise(F.lit("}")))
    paid = F.concat(F.lit('"withholdings":[{"amount":'), (key % 7 * 25).cast("string"), F.lit('},{"amount":null},{"amount":"1"},7,{"amount":12.5}]'))
    facts = F.parse_json(F.concat(F.lit("{"), income, F.when(key % 4 != 0, F.concat(F.lit(","), paid)).otherwise(F.lit("")), F.lit("}")))
    region = F.when(F.col("c_nationkey") % 2 == 0, "MADRID").when(F.col("c_nationkey") % 3 == 0, "Galicia")
    people = table(spark, sf_dir, "customer").select(key.alias("profile_id"), F.lit(2024).alias("tax_year"), region.alias("region"), F.lit(None).cast("date").alias("devengo_date"), facts.alias("facts"))
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    evaluations = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 200).alias("profile_id"), F.when(F.col("l_linestatus") == "O", "applies").otherwise("missing_data").alias("status"),
        F.when(flag == "A", "reduccion").when(line == 1, "minimo_personal_familiar").otherwise("deduccion").alias("category"), F.when(line == 2, "estatal").otherwise("autonomico").alias("scope"),
        F.array(F.struct(F.lit("B").alias("boe_id"), F.when(line == 4, F.lit(" ART. 81")).otherwise(F.lit("art. 68")).alias("article"))).alias("sources"), F.col("l_quantity").alias("estimated_amount"),
    )
    rows = [(k, 2024, *s, date(2024, 1, 1), None) for k, s in enumerate(QUOTA_SCALES)]
    scales = spark.createDataFrame(rows, "ordinal int, tax_year int, scope string, component string, region string, brackets array<struct<up_to:double,rate:double>>, effective_from date, effective_to date")
    return quota.compute_quota(people, evaluations, scales).drop("devengo_date")


def _tax(base: str, brackets: list) -> str:
    """SQL of the tax of `base` under `brackets`, added up from the lowest."""
    lows = [0.0, *(up for up, _ in brackets)]
    parts = [f"greatest(0.0::DOUBLE, {base if up is None else f'least({base}, {up}::DOUBLE)'} - {low}::DOUBLE) * {rate}::DOUBLE" for low, (up, rate) in zip(lows, brackets, strict=False)]
    return f"CASE WHEN {base} <= 0 THEN 0.0::DOUBLE ELSE {' + '.join(parts)} END"


def _net(base: str, low: str, brackets: list) -> str:
    return f"greatest(0.0::DOUBLE, ({_tax(base, brackets)}) - ({_tax(low, brackets)}))"


_OUT = {
    "base_imponible_general": "big", "base_imponible_ahorro": "bia", "reducciones_aplicadas": "red", "base_liquidable_general": "blg", "base_liquidable_ahorro": "bla",
    "minimo_personal_familiar": "least_living", "minimo_aplicado_base_general": "mg", "minimo_aplicado_base_ahorro": "ms", "cuota_integra_estatal": "qs",
    "cuota_integra_autonomica": "qr", "cuota_integra_total": "qs + qr", "deducciones_cuota_estatal": "ds", "deducciones_cuota_autonomica": "dr",
    "deducciones_cuota_diferencial": "dd", "cuota_liquida_estatal": "ls", "cuota_liquida_autonomica": "lr", "cuota_liquida_total": "ls + lr",
    "retenciones_y_pagos_cuenta": "paid", "cuota_diferencial": "ls + lr - paid - dd",
}
_STATE, _SAVINGS, _REGION = (brackets for _, _, _, brackets in QUOTA_SCALES)
QUOTA_SQL = f"""
WITH e AS (
  SELECT l_orderkey % 200 AS k, l_quantity::DOUBLE AS x,
         CASE WHEN l_returnflag = 'A' THEN 'red' WHEN l_linenumber = 1 THEN 'min' WHEN l_linenumber = 4 THEN 'last' WHEN l_linenumber = 2 THEN 'state' ELSE 'region' END AS kind
  FROM lineitem WHERE l_linestatus = 'O'
), d AS (
  SELECT k, sum(CASE kind WHEN 'red' THEN x ELSE 0 END) AS red, sum(CASE kind WHEN 'min' THEN x ELSE 0 END) AS least_living, sum(CASE kind WHEN 'state' THEN x / 2 ELSE 0 END) AS ds,
         sum(CASE kind WHEN 'state' THEN x / 2 WHEN 'region' THEN x ELSE 0 END) AS dr, sum(CASE kind WHEN 'last' THEN x ELSE 0 END) AS dd
  FROM e GROUP BY k
), p AS (
  SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'MADRID' WHEN c_nationkey % 3 = 0 THEN 'Galicia' END AS region,
         CASE WHEN c_custkey % 10 = 0 THEN 5000.0::DOUBLE ELSE CAST(format('{{:.2f}}', c_acctbal) AS DOUBLE) END AS big, (c_nationkey * 100)::DOUBLE AS bia,
         CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 7 * 25)::DOUBLE + 12.5::DOUBLE ELSE 0.0::DOUBLE END AS paid,
         coalesce(red, 0.0)::DOUBLE AS red, coalesce(least_living, 0.0)::DOUBLE AS least_living, coalesce(ds, 0.0)::DOUBLE AS ds, coalesce(dr, 0.0)::DOUBLE AS dr, coalesce(dd, 0.0)::DOUBLE AS dd
  FROM customer LEFT JOIN d ON k = c_custkey
), b AS (
  SELECT *, greatest(0.0::DOUBLE, big - red) AS blg, greatest(0.0::DOUBLE, bia - greatest(0.0::DOUBLE, red - big)) AS bla FROM p
), m AS (
  SELECT *, least(least_living, blg) AS mg, least_living - least(least_living, blg) AS ms FROM b
), q AS (
  SELECT *, {_net("blg", "mg", _STATE)} + {_net("bla", "ms", _SAVINGS)} AS qs,
         CASE WHEN region = 'MADRID' THEN {_net("blg", "mg", _REGION)} + {_net("bla", "ms", _SAVINGS)} END AS qr FROM m
), l AS (
  SELECT *, greatest(0.0::DOUBLE, qs - ds) AS ls, CASE WHEN qr IS NOT NULL THEN greatest(0.0::DOUBLE, qr - dr) END AS lr FROM q
)
SELECT c_custkey AS profile_id, 2024 AS tax_year, region, {", ".join(f"floor(({x}) * 100 + 0.5) / 100 AS {name}" for name, x in _OUT.items())} FROM l
"""


def family_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status as families of rulings: all of them, two of which one is empty, an empty one, and none set up."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    of = lambda status: orders.where(F.col("o_orderstatus") == status)
    none = of("no such")
    checks = {"all": {"court": of("P"), "letters": of("F"), "tribunal": of("O")}, "one": {"court": none, "letters": of("P"), "tribunal": None}, "empty": {"court": none}, "unset": {"court": None, "letters": None}}
    today, found = F.lit(date(2002, 1, 1)), None
    for name, families in checks.items():
        row = drift.families_freshness(spark, families, "day", "id", today, 1500, name)
        found = row if found is None else found.unionByName(row)
    return found.withColumn("latest", F.col("latest").cast("string")).withColumn("age_days", F.coalesce("age_days", F.lit(-1)))


FAMILY_SQL = """
WITH f AS (
  SELECT 'all' AS c, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS family, CAST(o_orderdate AS DATE) AS d, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus IN ('P', 'F', 'O')
  UNION ALL SELECT 'one', 1, CAST(o_orderdate AS DATE), CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'P'
), n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC, family, id) AS k FROM f),
w(c, skipped) AS (VALUES ('all', false), ('one', false), ('empty', false), ('unset', true))
SELECT w.c AS "check", CAST(d AS VARCHAR) AS latest, id AS latest_id, coalesce(CAST(DATE '2002-01-01' - d AS INT), -1) AS age_days,
       CASE WHEN skipped THEN true ELSE coalesce(DATE '2002-01-01' - d <= 1500, false) END AS ok, skipped
FROM w LEFT JOIN n ON n.c = w.c AND n.k = 1
"""


def corpus_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rules that cite suppliers as norms: count, last review, whether norms are known, fingerprint."""
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", "p_size", F.date_add(F.lit(date(2020, 1, 1)), F.col("p_size").cast("int")).alias("last_reviewed_at"),
        F.array(F.struct(F.lit(None).cast("string").alias("boe_id")), F.struct(F.col("p_partkey").cast("string").alias("boe_id"))).alias("sources"),
    )
    normas = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("boe_id"))
    found = drift.corpus_meta(parts, normas, ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    return found.withColumn("last_reviewed_at", F.col("last_reviewed_at").cast("string"))


STATE_SQL = f"""
WITH h AS (SELECT *, sha256(concat_ws('|', p_partkey::VARCHAR, coalesce(p_name, '~'), coalesce(p_brand, '~'), coalesce(p_type, '~'), coalesce(p_size::VARCHAR, '~'))) AS d FROM part)
SELECT count(*) AS count, CAST(max(DATE '2020-01-01' + p_size::INT) AS VARCHAR) AS last_reviewed_at,
       count(*) FILTER (p_partkey IN (SELECT s_suppkey FROM supplier)) > 0 AS normas_registered, sha256(concat_ws('-', count(*)::VARCHAR, {_SUMS})) AS fingerprint_sha256 FROM h
"""

QUERIES = {
    "norm_cascade": (norm_cascade, NORM_SQL),
    "whole_quota": (whole_quota, QUOTA_SQL),
    "family_freshness": (family_freshness, FAMILY_SQL),
    "corpus_state": (corpus_state, STATE_SQL),
}
