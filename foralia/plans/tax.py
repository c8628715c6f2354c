"""Queries on the driver tables for rules, scales, version timelines and quotas, with their DuckDB equivalents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foralia.functions.facts import fact_map
from foralia.functions.scales import progressive_amount, round_half_up, tiered_amount
from foralia.operators import quota, rules, temporal
from foralia.runtime import table

BRACKETS = "array<struct<up_to:double,rate:double>>"

#: A timeline of scales that straddles the order dates; the last one has no end.
SCALES = [
    ("S1", date(1990, 1, 1), date(1996, 12, 31), [(12450.0, 0.095), (20200.0, 0.12), (None, 0.15)]),
    ("S2", date(1997, 1, 1), date(1999, 12, 31), [(50000.0, 0.1), (150000.0, 0.185), (None, 0.225)]),
    ("S3", date(2000, 6, 1), None, [(100000.0, 0.19), (None, 0.245)]),
]

#: Versions of three norms: a gap, a repealed end, and one open from the start.
VERSIONS = [
    (0, date(1995, 1, 1), date(1996, 6, 30), "vigente"),
    (0, date(1997, 1, 1), None, "derogada"),
    (1, date(1990, 1, 1), None, "vigente"),
    (2, date(1999, 5, 5), date(1999, 5, 5), "suspendida"),
]

#: Overlapping scales of one key: the last in load order wins.
OVERLAPPING = [(0, "A", date(1995, 1, 1), None), (1, "B", date(1996, 1, 1), date(1998, 12, 31)), (2, "C", date(1997, 6, 1), date(1997, 12, 31))]


def _days(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))


def progressive_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tax of each order's total under the scale in force on its date; null where no scale was."""
    scales = spark.createDataFrame([("x", *s) for s in SCALES], f"kind string, scale_id string, effective_from date, effective_to date, brackets {BRACKETS}")
    facts = _days(spark, sf_dir).withColumn("kind", F.lit("x"))
    hit = temporal.as_of_join(facts, scales, ["kind"], "day")
    amount = F.when(F.col("version").isNotNull(), round_half_up(progressive_amount(F.col("o_totalprice"), F.col("version.brackets"))))
    return hit.select("o_orderkey", F.col("version.scale_id").alias("scale_id"), amount.alias("tax"))


def _scale_rows() -> str:
    return ", ".join(
        f"('{name}', DATE '{a}', {f"DATE '{b}'" if b else 'NULL'}, {low}, {'NULL' if up is None else up}, {rate})"
        for name, a, b, brackets in SCALES
        for low, (up, rate) in zip([0.0, *(u for u, _ in brackets)], brackets, strict=False)
    )


PROGRESSIVE_SQL = f"""
WITH s(scale_id, a, b, low, up, rate) AS (VALUES {_scale_rows()}),
k AS (SELECT DISTINCT scale_id, a, b FROM s),
o AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders),
h AS (SELECT o.*, k.scale_id FROM o LEFT JOIN k ON o.day >= k.a AND (k.b IS NULL OR o.day <= k.b)),
t AS (SELECT h.o_orderkey, h.scale_id,
        sum(greatest(0.0::DOUBLE, least(h.o_totalprice, coalesce(s.up, h.o_totalprice)::DOUBLE) - s.low::DOUBLE) * s.rate::DOUBLE ORDER BY s.low) AS tax
      FROM h LEFT JOIN s ON h.scale_id = s.scale_id GROUP BY ALL)
SELECT o_orderkey, scale_id, floor(tax * 100 + 0.5) / 100 AS tax FROM t
"""

TIERS = [(1000.0, 0.8, 0.9, "f"), (None, 0.4, 0.45, "f")]


def tiered_amount_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tiers over the account balance, a higher alternate for building customers, fixed and dynamic caps."""
    tiers = F.array(*(F.struct(F.lit(u).cast("double").alias("up_to"), F.lit(p).alias("percentage"), F.lit(q).alias("alternate_percentage"), F.lit(f).alias("alternate_when_field")) for u, p, q, f in TIERS))
    building = F.create_map(F.lit("f"), F.col("c_mktsegment") == "BUILDING")
    cap = F.when(F.col("c_nationkey") % 2 == 0, F.lit(2500.0))
    dynamic = F.when(F.col("c_nationkey") % 3 == 0, F.col("c_acctbal") * 0.35)
    amount = tiered_amount(F.col("c_acctbal"), tiers, building, cap, F.lit(None).cast("double"), dynamic)
    return table(spark, sf_dir, "customer").select("c_custkey", round_half_up(amount).alias("amount"))


TIERED_SQL = """
WITH a AS (
  SELECT c_custkey, c_acctbal AS b, c_nationkey AS n,
         least(c_acctbal, 1000.0::DOUBLE) * CASE WHEN c_mktsegment = 'BUILDING' THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END
         + greatest(0.0::DOUBLE, c_acctbal - 1000.0::DOUBLE) * CASE WHEN c_mktsegment = 'BUILDING' THEN 0.45::DOUBLE ELSE 0.4::DOUBLE END AS x
  FROM customer
), c AS (
  SELECT c_custkey, CASE WHEN b IS NULL OR b <= 0 THEN 0.0::DOUBLE
    ELSE least(x, CASE WHEN n % 2 = 0 THEN 2500.0::DOUBLE ELSE x END, CASE WHEN n % 3 = 0 THEN b * 0.35::DOUBLE ELSE x END) END AS x FROM a
)
SELECT c_custkey, floor(x * 100 + 0.5) / 100 AS amount FROM c
"""


def _versions(spark) -> DataFrame:
    return spark.createDataFrame(VERSIONS, "norm int, effective_from date, effective_to date, status string")


def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of the order's norm in force on its date, if any."""
    facts = _days(spark, sf_dir).withColumn("norm", (F.col("o_custkey") % 4).cast("int"))
    hit = temporal.as_of_join(facts, _versions(spark), ["norm"], "day")
    return hit.select("o_orderkey", "norm", F.col("version.effective_from").cast("string").alias("effective_from"), F.col("version.status").alias("status"))


def _values(rows) -> str:
    lit = lambda x: "NULL" if x is None else f"DATE '{x}'" if isinstance(x, date) else repr(x)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


ASOF_SQL = f"""
WITH v(norm, effective_from, effective_to, status) AS (VALUES {_values(VERSIONS)})
SELECT o.o_orderkey, CAST(o.o_custkey % 4 AS INT) AS norm, CAST(v.effective_from AS VARCHAR) AS effective_from, v.status
FROM orders o LEFT JOIN v ON v.norm = o.o_custkey % 4 AND CAST(o.o_orderdate AS DATE) >= v.effective_from
  AND (v.effective_to IS NULL OR CAST(o.o_orderdate AS DATE) <= v.effective_to)
"""


def select_scale_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several scales in force the last loaded one is taken."""
    scales = spark.createDataFrame(OVERLAPPING, "ordinal int, scale_id string, effective_from date, effective_to date")
    scales = scales.select("*", F.array("scale_id").alias("brackets"), F.lit(2024).alias("tax_year"), F.lit("estatal").alias("scope"), F.lit("general").alias("component"), F.lit(None).cast("string").alias("region"))
    orders = _days(spark, sf_dir).withColumn("tax_year", F.lit(2024))
    return quota.select_scale(orders, scales, "estatal", "general", "scale").select("o_orderkey", F.try_element_at("scale", F.lit(1)).alias("scale_id"))


LAST_WINS_SQL = f"""
WITH s(ordinal, scale_id, a, b) AS (VALUES {_values(OVERLAPPING)}),
m AS (SELECT o.o_orderkey, s.scale_id, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY s.ordinal DESC NULLS LAST) AS rn
  FROM orders o LEFT JOIN s ON CAST(o.o_orderdate AS DATE) >= s.a AND (s.b IS NULL OR CAST(o.o_orderdate AS DATE) <= s.b))
SELECT o_orderkey, scale_id FROM m WHERE rn = 1
"""


def overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer taken as versions of 90 days: those that reach the next one's start."""
    spans = _days(spark, sf_dir).select("o_custkey", "o_orderkey", F.col("day").alias("effective_from"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add("day", 90)).alias("effective_to"))
    first = spans.groupBy("o_custkey", "effective_from").agg(F.max("effective_to").alias("effective_to"))
    found = temporal.overlap_violations(first, ["o_custkey"])
    return found.select("o_custkey", *(F.col(c).cast("string").alias(c) for c in ("effective_from", "effective_to", "next_start")))


OVERLAP_SQL = """
WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS a, max(CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 90 END) AS b FROM orders GROUP BY 1, 2),
n AS (SELECT *, lead(a) OVER (PARTITION BY o_custkey ORDER BY a) AS c FROM s)
SELECT o_custkey, CAST(a AS VARCHAR) AS effective_from, CAST(b AS VARCHAR) AS effective_to, CAST(c AS VARCHAR) AS next_start FROM n WHERE c <= coalesce(b, DATE '9999-12-31')
"""


def _profiles(spark, sf_dir: str) -> DataFrame:
    """Customers as profiles; segment decides which facts are absent, null or of another type."""
    segment = F.col("c_mktsegment")
    income = F.concat(F.lit('{"income":{"work_net":'), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("}"))
    age = F.when(segment == "BUILDING", F.lit("")).when(segment == "MACHINERY", F.lit(',"personal":{"age":null}')).otherwise(F.concat(F.lit(',"personal":{"age":'), (F.col("c_custkey") % 90).cast("string"), F.lit("}")))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("profile_id"), F.lit(2024).alias("tax_year"), F.when(F.col("c_nationkey") % 2 == 0, "Madrid").otherwise("Galicia").alias("region"),
        F.lit(None).cast("date").alias("devengo_date"), F.parse_json(F.concat(income, age, F.lit("}"))).alias("facts"),
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("deed"))).otherwise(F.array(F.lit("deed"), F.lit("receipt"))).alias("documents"),
    )


def _rules(spark) -> DataFrame:
    calc = lambda kind, field=None, pct=None, cap=None, fixed=None: f"named_struct('type','{kind}','base_field',{_q(field)},'percentage',cast({_n(pct)} as double),'cap',cast({_n(cap)} as double),'fixed_amount',cast({_n(fixed)} as double),'tiers',cast(null as array<struct<up_to:double,percentage:double,alternate_percentage:double,alternate_when_field:string>>),'cap_field',cast(null as string),'cap_percentage',cast(null as double))"
    need = lambda field, op, value: f"array(named_struct('field','{field}','operator','{op}','value',parse_json('{value}')))"
    none = "cast(array() as array<struct<field:string,operator:string,value:variant>>)"
    rows = [
        ("R1", 2024, "Madrid", need("personal.age", ">=", "65"), calc("fixed_amount", fixed=300.0), "array('receipt')", "array('R2')", "date'2020-01-01'", "null", "validada"),
        ("R2", 2024, None, need("income.work_net", ">", "0"), calc("percentage_with_cap", "income.work_net", 0.1, 400.0), "cast(array() as array<string>)", "cast(array() as array<string>)", "null", "null", "validada"),
        ("R3", 2024, None, need("personal.age", "not_exists", "null"), calc("manual_review"), "cast(array() as array<string>)", "cast(array() as array<string>)", "null", "null", "validada"),
        ("R4", 2023, None, none, calc("fixed_amount", fixed=1.0), "cast(array() as array<string>)", "cast(array() as array<string>)", "null", "null", "validada"),
        ("R5", 2024, None, none, calc("fixed_amount", fixed=1.0), "cast(array() as array<string>)", "cast(array() as array<string>)", "date'2025-01-01'", "null", "validada"),
        ("R6", 2024, None, none, calc("fixed_amount", fixed=1.0), "cast(array() as array<string>)", "cast(array() as array<string>)", "null", "null", "borrador"),
    ]
    parts = [
        f"select '{i}' as id, '{i}' as name, {y} as tax_year, 'estatal' as scope, {_q(region)} as region, 'deduccion' as category, {req} as requirements, {c} as calculation, cast(null as double) as `limit`, {inc} as incompatibilities, {docs} as required_documents, cast(array() as array<struct<boe_id:string,article:string>>) as sources, cast({a} as date) as effective_from, cast({b} as date) as effective_to, '{v}' as validation_status"
        for i, y, region, req, c, docs, inc, a, b, v in rows
    ]
    return spark.sql(" union all ".join(parts))


def _q(x) -> str:
    return "cast(null as string)" if x is None else f"'{x}'"


def _n(x) -> str:
    return "null" if x is None else repr(x)


def rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer against six rules, exclusivity resolved."""
    found = rules.resolve_incompatibilities(rules.evaluate(_profiles(spark, sf_dir), _rules(spark)))
    return found.select("profile_id", "deduction_id", "status", round_half_up(F.col("estimated_amount")).alias("estimated_amount"), "confidence", F.array_join("missing_fields", ",").alias("missing_fields"), F.array_join("missing_documents", ",").alias("missing_documents"))


CASCADE_SQL = """
WITH p AS (
  SELECT c_custkey AS profile_id, CASE WHEN c_nationkey % 2 = 0 THEN 'Madrid' ELSE 'Galicia' END AS region, c_acctbal AS net, c_custkey % 3 = 0 AS no_receipt,
         c_mktsegment AS seg, c_custkey % 90 AS age FROM customer
), e AS (
  SELECT profile_id, 'R1' AS id, CASE WHEN region <> 'Madrid' THEN 'does_not_apply/0.9' WHEN seg = 'BUILDING' THEN 'missing_data/0.5'
      WHEN seg = 'MACHINERY' OR age < 65 THEN 'does_not_apply/0.8' WHEN no_receipt THEN 'missing_evidence/0.7' ELSE 'applies/0.85' END AS s, 300.0::DOUBLE AS x FROM p
  UNION ALL SELECT profile_id, 'R2', CASE WHEN net > 0 THEN 'applies/0.85' ELSE 'does_not_apply/0.8' END, least(net * 0.1::DOUBLE, 400.0::DOUBLE) FROM p
  UNION ALL SELECT profile_id, 'R3', CASE WHEN seg = 'BUILDING' THEN 'missing_data/0.5' WHEN seg = 'MACHINERY' THEN 'requires_manual_calculation/0.6' ELSE 'does_not_apply/0.8' END, 0.0 FROM p
  UNION ALL SELECT profile_id, 'R4', 'does_not_apply/0.9', 0.0 FROM p
  UNION ALL SELECT profile_id, 'R5', 'does_not_apply/0.95', 0.0 FROM p
  UNION ALL SELECT profile_id, 'R6', 'pending_validation/0.2', 0.0 FROM p
), f AS (
  SELECT *, split_part(s, '/', 1) AS status, count(*) FILTER (WHERE id IN ('R1', 'R2') AND s LIKE 'applies%') OVER (PARTITION BY profile_id) AS n_both FROM e
), g AS (
  SELECT *, n_both = 2 AND id IN ('R1', 'R2') AS clash FROM f
)
SELECT profile_id, id AS deduction_id, CASE WHEN clash THEN 'requires_user_choice' ELSE status END AS status,
       CASE WHEN clash OR status NOT IN ('applies', 'missing_evidence') THEN 0.0::DOUBLE ELSE floor(x * 100 + 0.5) / 100 END AS estimated_amount,
       CAST(split_part(s, '/', 2) AS DOUBLE) AS confidence,
       CASE WHEN status = 'missing_data' THEN 'personal.age' ELSE '' END AS missing_fields, CASE WHEN status = 'missing_evidence' THEN 'receipt' ELSE '' END AS missing_documents
FROM g
"""


def _events_json() -> F.Column:
    k = F.get_json_object("props", "$.k")
    return F.when(F.col("event_id") % 3 == 0, F.lit('{"a":{}}')).when(F.col("event_id") % 3 == 1, F.lit('{"a":{"k":null}}')).otherwise(F.concat(F.lit('{"a":{"k":'), k, F.lit("}}")))


def missing_vs_null_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dotted path that is absent, null or a number."""
    fact = F.try_element_at(fact_map(F.parse_json(_events_json()), ["a.k"]), F.lit("a.k"))
    events = table(spark, sf_dir, "events").select("event_id", fact.alias("f"))
    return events.select("event_id", F.col("f.found").alias("found"), F.col("f.is_null").alias("is_null"), F.col("f.num").alias("num"))


MISSING_SQL = """
SELECT event_id, event_id % 3 <> 0 AS found, event_id % 3 = 1 AS is_null, CASE WHEN event_id % 3 = 2 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS num FROM events
"""


def incompatibility_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per region its nations, with an edge between two whose keys differ by three: the label fold gives components."""
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("ids"))
    edges = F.flatten(F.transform("ids", lambda a: F.transform(F.filter("ids", lambda b: b == a + 3), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    labels = rules.component_labels(F.col("ids"), edges)
    return nations.select("n_regionkey", F.explode(labels).alias("n_nationkey", "component"))


COMPONENTS_SQL = """
WITH RECURSIVE e AS (
  SELECT x.n_regionkey, x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND abs(x.n_nationkey - y.n_nationkey) IN (0, 3)
), r AS (
  SELECT n_regionkey, a, b FROM e UNION SELECT r.n_regionkey, r.a, e.b FROM r JOIN e ON e.n_regionkey = r.n_regionkey AND e.a = r.b
)
SELECT n_regionkey, a AS n_nationkey, min(b) AS component FROM r GROUP BY 1, 2
"""


def quota_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as applied rules of their order, summed into the quota's buckets."""
    items = table(spark, sf_dir, "lineitem")
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    article = F.when(line == 4, F.lit("Art. 81 bis")).otherwise(F.lit("art. 68"))
    evaluations = items.select(
        (F.col("l_orderkey") % 1000).alias("profile_id"), F.when(F.col("l_linestatus") == "O", "applies").otherwise("missing_data").alias("status"),
        F.when(flag == "A", "reduccion").when(line == 1, "minimo_personal_familiar").otherwise("deduccion").alias("category"), F.when(line == 2, "estatal").otherwise("autonomico").alias("scope"),
        F.array(F.struct(F.lit("B").alias("boe_id"), article.alias("article"))).alias("sources"), F.col("l_quantity").alias("estimated_amount"),
    )
    return quota.deduction_buckets(evaluations)


BUCKETS_SQL = """
WITH e AS (
  SELECT l_orderkey % 1000 AS profile_id, l_quantity AS x,
         CASE WHEN l_returnflag = 'A' THEN 'reductions' WHEN l_linenumber = 1 THEN 'minimum' WHEN l_linenumber = 4 THEN 'differential' WHEN l_linenumber = 2 THEN 'state' ELSE 'regional' END AS k
  FROM lineitem WHERE l_linestatus = 'O'
)
SELECT profile_id, sum(CASE WHEN k = 'reductions' THEN x ELSE 0.0 END)::DOUBLE AS reductions, sum(CASE WHEN k = 'minimum' THEN x ELSE 0.0 END)::DOUBLE AS minimum,
       sum(CASE WHEN k = 'state' THEN x / 2 ELSE 0.0 END)::DOUBLE AS state, sum(CASE WHEN k = 'state' THEN x / 2 WHEN k = 'regional' THEN x ELSE 0.0 END)::DOUBLE AS regional,
       sum(CASE WHEN k = 'differential' THEN x ELSE 0.0 END)::DOUBLE AS differential
FROM e GROUP BY profile_id
"""


def missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the required priorities that no order has, in order."""
    required = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    have = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("have"))
    return have.select("o_custkey", F.array_join(F.filter(required, lambda d: ~F.array_contains("have", d)), "|").alias("missing"))


DOCUMENTS_SQL = """
WITH r(ord, d) AS (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (3, '3-MEDIUM'), (4, '4-NOT SPECIFIED'), (5, '5-LOW')),
c AS (SELECT DISTINCT o_custkey FROM orders), h AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders)
SELECT c.o_custkey, coalesce(string_agg(r.d, '|' ORDER BY r.ord) FILTER (WHERE h.o_custkey IS NULL), '') AS missing
FROM c CROSS JOIN r LEFT JOIN h ON h.o_custkey = c.o_custkey AND h.o_orderpriority = r.d GROUP BY c.o_custkey
"""

QUERIES = {
    "progressive_scale": (progressive_scale, PROGRESSIVE_SQL),
    "tiered_amount_caps": (tiered_amount_caps, TIERED_SQL),
    "asof_version": (asof_version, ASOF_SQL),
    "select_scale_last_wins": (select_scale_last_wins, LAST_WINS_SQL),
    "overlap_violations": (overlap_violations, OVERLAP_SQL),
    "rule_cascade": (rule_cascade, CASCADE_SQL),
    "missing_vs_null_path": (missing_vs_null_path, MISSING_SQL),
    "incompatibility_components": (incompatibility_components, COMPONENTS_SQL),
    "quota_buckets": (quota_buckets, BUCKETS_SQL),
    "missing_documents": (missing_documents, DOCUMENTS_SQL),
}
