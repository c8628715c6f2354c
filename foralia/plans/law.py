"""Queries on the driver tables for identifiers, dates, consolidated law, VAT, corpus chunks and catalogue filters."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foralia.functions import ids
from foralia.functions import text as tx
from foralia.functions.scales import round_half_up
from foralia.operators import asof_merge, catalog, chunking, corpus, gazette, legal_xml, manual_tree, manuals, quota, temporal, vat
from foralia.runtime import table


def temporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chunks valid for 200 days, a third without end and a seventh without start, against one day in every mode."""
    start = F.when(F.col("o_orderkey") % 7 != 0, F.to_date("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", start.alias("effective_from"), F.when(F.col("o_orderkey") % 3 != 0, F.date_add(F.to_date("o_orderdate"), 200)).alias("effective_to"))
    judged = [temporal.temporal_filter(rows, F.lit(date(1998, 7, 1)), mode).select("o_orderkey", F.lit(mode).alias("mode"), "verdict", "reason") for mode in ("strict", "warn", "off")]
    return reduce(DataFrame.unionByName, judged)


TEMPORAL_SQL = """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS a, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) + 200 END AS b FROM orders),
m(mode, kept) AS (VALUES ('strict', 'rejected'), ('warn', 'disclaimer'), ('off', 'accepted'))
SELECT o_orderkey, mode, CASE WHEN a IS NULL THEN kept WHEN a > DATE '1998-07-01' OR b < DATE '1998-07-01' THEN 'rejected' ELSE 'accepted' END AS verdict,
  CASE WHEN a IS NULL AND mode = 'off' THEN NULL WHEN a IS NULL THEN 'no_start' WHEN a > DATE '1998-07-01' THEN 'not_yet_in_force' WHEN b < DATE '1998-07-01' THEN 'no_longer_in_force' END AS reason
FROM o CROSS JOIN m
"""


def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of three families written from keys, in their canonical form; every fifth is malformed."""
    key = F.col("o_custkey").cast("string")
    bad = F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise("")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", ids.ruling_number(F.concat(bad, F.lit(" v"), key, F.lit("-2024"))).alias("ruling"), ids.claim_number(F.concat(bad, F.lit("R.G. "), key, F.lit("/23"))).alias("claim"),
        ids.ecli(F.concat(bad, F.lit("ecli:es:ts:2024:"), key, F.lit(":S2"))).alias("ecli"),
    )
    return rows


IDS_SQL = """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'V' || CASE WHEN o_custkey < 10000 THEN lpad(o_custkey::VARCHAR, 4, '0') ELSE o_custkey::VARCHAR END || '-24' END AS ruling,
       CASE WHEN o_orderkey % 5 <> 0 THEN '00/' || CASE WHEN o_custkey < 100000 THEN lpad(o_custkey::VARCHAR, 5, '0') ELSE o_custkey::VARCHAR END || '/2023' END AS claim,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'ECLI:ES:TS:2024:' || o_custkey END AS ecli FROM orders
"""


def written_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written out in words and read back, and the day of a title without a year."""
    day = F.to_date("o_orderdate")
    month = F.element_at(F.array(*map(F.lit, ids.MONTHS)), F.month(day))
    words = F.concat_ws(" de ", F.day(day).cast("string"), month, F.year(day).cast("string"))
    title = F.concat(F.lit("Ley 7/2001, de "), F.day(day).cast("string"), F.lit(" de "), F.initcap(month), F.lit(", de algo"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ids.written_date(words).cast("string").alias("written"), gazette.enacted_at(title, day).cast("string").alias("enacted"))
    return rows


DATES_SQL = """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT o_orderkey, CAST(d AS VARCHAR) AS written, CAST(CASE WHEN month(d) = 2 AND day(d) = 29 THEN d ELSE make_date(2001, month(d), day(d)) END AS VARCHAR) AS enacted FROM o
"""


def article_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consolidated XML built from each customer's nation and balance: two versions of one article, read back.

    Both quote a law in the text; footnotes name who modified the first by its id or, for odd keys, by its number alone; none the second.
    """
    version = lambda day, body, note: F.concat(F.lit(f'<version fecha_vigencia="{day}"><p class="parrafo">'), body, F.lit('</p><p class="cita">véase BOE-A-1999-9</p>'), note, F.lit("</version>"))
    footnote = F.when(F.col("c_custkey") % 2 == 0, '<p class="nota_pie">Ley 1/2001</p><p class="nota_pie_2">por BOE-A-2014-1</p>').otherwise('<p class="nota_pie_2">por el Real Decreto 7/2013</p>')
    xml = F.concat(F.lit('<bloque id="a1" tipo="precepto">'), version("20100101", F.col("c_name"), footnote), version("20200101", F.concat(F.lit("<b>Art.</b>  "), F.col("c_mktsegment")), F.lit("")), F.lit("</bloque>"))
    texts = table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml"))
    rows = legal_xml.article_versions(texts, ["c_custkey"])
    return rows.select("c_custkey", "article_id", F.col("effective_from").cast("string").alias("effective_from"), F.col("effective_to").cast("string").alias("effective_to"), "text", "text_hash", "modified_by")


ARTICLE_SQL = """
WITH v AS (SELECT c_custkey, '2010-01-01' AS effective_from, '2019-12-31' AS effective_to, c_name || chr(10) || 'véase BOE-A-1999-9' AS text,
    CASE WHEN c_custkey % 2 = 0 THEN 'BOE-A-2014-1' ELSE 'law:Real Decreto 7/2013' END AS modified_by FROM customer
  UNION ALL SELECT c_custkey, '2020-01-01', NULL, 'Art. ' || c_mktsegment || chr(10) || 'véase BOE-A-1999-9', NULL FROM customer)
SELECT c_custkey, 'a1' AS article_id, effective_from, effective_to, text, sha256(text) AS text_hash, modified_by FROM v
"""


def clause_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of two numbered clauses, the first with two letters, cut apart."""
    body = F.concat(F.lit("1. Uno: a) "), F.col("p_name"), F.lit(". b) "), F.col("p_brand"), F.lit(".\n2. "), F.col("p_type"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(chunking.clauses(body)).alias("c"))
    return rows.select("p_partkey", F.col("c.number").alias("number"), F.col("c.text").alias("text"))


CLAUSE_SQL = """
SELECT p_partkey, '1' AS number, '1. Uno:' AS text FROM part UNION ALL SELECT p_partkey, '1.a)', 'a) ' || p_name || '.' FROM part
UNION ALL SELECT p_partkey, '1.b)', 'b) ' || p_brand || '.' FROM part UNION ALL SELECT p_partkey, '2', '2. ' || p_type FROM part
"""

RATES = [("1-URGENT", 0.21), ("2-HIGH", 0.1), ("3-MEDIUM", 0.04), ("5-LOW", None)]


def vat_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAT of orders by priority: one priority is exempt, one has no rate on file."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("code"), F.col("o_totalprice").alias("base"))
    return vat.vat_quota(rows, spark.createDataFrame(RATES, "code string, rate double")).select("o_orderkey", "code", "rate", "quota")


VAT_SQL = f"""
WITH r(code, rate) AS (VALUES {", ".join(f"('{c}', {'NULL' if r is None else f'{r}::DOUBLE'})" for c, r in RATES)})
SELECT o_orderkey, o_orderpriority AS code, r.rate, floor(o_totalprice * r.rate * 100 + 0.5) / 100 AS quota FROM orders LEFT JOIN r ON r.code = o_orderpriority
"""


def withholding_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric amounts of a JSON list with other entries in between, and a taxable base from its parts."""
    amount = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    facts = F.parse_json(F.concat(F.lit('{"withholdings":[{"amount":'), amount, F.lit('},{"amount":"x"},7,{"amount":2.5},{"amount":true}],"income":{"work_net":'), amount, F.lit(',"rental_housing_net":10,"imputaciones_renta":null}}')))
    rows = table(spark, sf_dir, "customer").select("c_custkey", round_half_up(quota.withholdings(facts)).alias("withheld"), round_half_up(quota.taxable_base(facts, "base_imponible_general", quota.GENERAL)).alias("base"))
    return rows


WITHHOLDING_SQL = """
SELECT c_custkey, floor((CAST(c_acctbal AS DECIMAL(12,2))::DOUBLE + 2.5) * 100 + 0.5) / 100 AS withheld, floor((CAST(c_acctbal AS DECIMAL(12,2))::DOUBLE + 10) * 100 + 0.5) / 100 AS base FROM customer
"""


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as rules: a region lets state rules through."""
    rules = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit(2024).alias("tax_year"), F.when(F.col("s_nationkey") % 3 == 0, "Madrid").when(F.col("s_nationkey") % 3 == 1, "Galicia").alias("region"), F.when(F.col("s_nationkey") % 3 == 2, "estatal").otherwise("autonomico").alias("scope"), F.lit("deduccion").alias("category"))
    return catalog.rule_catalog(rules, 2024, "madrid").select("s_suppkey", "region", "scope")


RULE_CATALOG_SQL = """
SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'Madrid' END AS region, CASE s_nationkey % 3 WHEN 2 THEN 'estatal' ELSE 'autonomico' END AS scope FROM supplier WHERE s_nationkey % 3 IN (0, 2)
"""


def drift_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as norms with one version each: which of them a drift run checks on one day."""
    key, day = F.col("c_custkey"), F.lit(date(2024, 1, 1))
    people = table(spark, sf_dir, "customer")
    ident = F.concat(F.when(key % 7 == 0, "BOCM-").otherwise("BOE-A-2000-"), key.cast("string"))
    status = F.when(key % 5 == 0, "derogada").when(key % 5 == 1, "suspendida").otherwise("vigente")
    versions = people.where("c_custkey % 4 <> 0").select(ident.alias("norma_boe_id"), F.date_sub(day, 10).alias("effective_from"), F.when(key % 3 == 0, F.date_sub(day, 1)).alias("effective_to"), status.alias("status"))
    return gazette.eligible(people.select(ident.alias("boe_id")), versions, day)


ELIGIBLE_SQL = """
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'BOCM-' ELSE 'BOE-A-2000-' END || c_custkey AS boe_id, CASE c_custkey % 5 WHEN 0 THEN 'derogada' WHEN 1 THEN 'suspendida' ELSE 'vigente' END AS s FROM customer)
SELECT boe_id, CASE WHEN k % 7 = 0 THEN 'not_state' WHEN k % 4 = 0 OR k % 3 = 0 THEN 'no_version' WHEN s <> 'vigente' THEN 'status_' || s END AS skip_reason FROM c
"""


def corpus_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norm and manual chunks in one schema, built from suppliers and parts."""
    normas = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("boe_id"), F.lit("ley").alias("kind"), F.col("s_name").alias("title"))
    versions = normas.select(F.col("boe_id").alias("norma_boe_id"), F.lit(date(2020, 1, 1)).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.lit("vigente").alias("status"), F.when(F.col("boe_id").cast("int") % 2 == 0, "nota").alias("notes"))
    manual = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("chunk_id"), F.col("p_name").alias("titulo"), F.col("p_type").alias("contenido"), F.col("p_brand").alias("fuente"))
    return corpus.corpus_chunks(corpus.norm_chunks(normas, versions), corpus.manual_chunks(manual)).select("chunk_id", "source_type", "text", "status", "fuente")


FAMILIES_SQL = """
SELECT 'norma::' || s_suppkey || '::v2020-01-01' AS chunk_id, 'norma' AS source_type, s_name || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || chr(10) || 'nota' ELSE '' END AS text, 'vigente' AS status, NULL::VARCHAR AS fuente FROM supplier
UNION ALL SELECT 'manual::' || p_partkey, 'manual', p_name || chr(10) || chr(10) || p_type, NULL, p_brand FROM part
"""


def manual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with form feeds cut into numbered pages, words broken at line ends joined."""
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.concat(F.col("p_name"), F.lit("\fpre-\nfijo  "), F.col("p_brand")).alias("value"))
    return manuals.pages(files)


PAGES_SQL = """
SELECT p_partkey::VARCHAR AS path, 1 AS page_number, trim(p_name) AS text FROM part UNION ALL SELECT p_partkey::VARCHAR, 2, trim('prefijo ' || p_brand) FROM part
"""


def subject_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents share their first twelve words."""
    return table(spark, sf_dir, "documents").groupBy(tx.subject_key(F.col("text")).alias("subject")).agg(F.count("*").alias("n"))


SUBJECT_SQL = """
SELECT array_to_string(list_slice(regexp_extract_all(lower(text), '[a-záéíóúñ0-9]+'), 1, 12), ' ') AS subject, count(*) AS n FROM documents GROUP BY 1
"""

def _pages(spark, sf_dir: str) -> DataFrame:
    """Parts as pages of ten manuals: chapters, headings of two and three numbers, and pages without a heading."""
    key, name = F.col("p_partkey"), F.col("p_name")
    number = lambda *parts: F.concat_ws(".", *((key % n + 1).cast("string") for n in parts))
    chapter = F.concat(F.lit("Capítulo "), (key % 97 + 1).cast("string"), F.lit(". "), F.upper("p_name"), F.lit("\n"))
    heading = lambda n: F.concat(n, F.lit(". T"), name, F.lit("\n"))
    head = F.when(key % 50 < 10, chapter).when(key % 3 == 0, heading(number(7, 5))).when(key % 3 == 1, heading(number(7, 5, 11))).otherwise("")
    return table(spark, sf_dir, "part").select((key % 10).alias("manual"), key.alias("page_number"), F.concat(head, "p_type").alias("text"))


def manual_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of ten manuals: headings, pages, ancestors and the hash of each body."""
    found = manual_tree.leaves(manual_tree.elements(_pages(spark, sf_dir), ["manual"]), ["manual"])
    return found.select(
        "manual", F.col("leaf").cast("long").alias("leaf"), "start", "kind", "numbering", "title", "page_start", F.sha2("body", 256).alias("body_hash"),
        F.col("capitulo.numbering").alias("chapter"), F.col("seccion.numbering").alias("section"),
    )


MANUAL_LEAVES_SQL = """
WITH p AS (SELECT p_partkey % 10 AS manual, p_partkey AS page, p_type AS rest,
  CASE WHEN p_partkey % 50 < 10 THEN 1 WHEN p_partkey % 3 = 0 THEN 2 WHEN p_partkey % 3 = 1 THEN 3 ELSE 0 END AS rank,
  CASE WHEN p_partkey % 50 < 10 THEN (p_partkey % 97 + 1)::VARCHAR WHEN p_partkey % 3 = 0 THEN (p_partkey % 7 + 1) || '.' || (p_partkey % 5 + 1)
       WHEN p_partkey % 3 = 1 THEN (p_partkey % 7 + 1) || '.' || (p_partkey % 5 + 1) || '.' || (p_partkey % 11 + 1) END AS num,
  CASE WHEN p_partkey % 50 < 10 THEN upper(p_name) ELSE 'T' || p_name END AS title FROM part),
t AS (SELECT *, CASE WHEN rank = 1 THEN 'Capítulo ' ELSE '' END AS lead_text, CASE WHEN rank = 0 THEN rest ELSE num || '. ' || title || chr(10) || rest END AS tail FROM p),
o AS (SELECT *, coalesce(sum(length(lead_text) + length(tail) + 2) OVER (PARTITION BY manual ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_start,
  sum((rank > 0)::INT) OVER (PARTITION BY manual ORDER BY page) AS sec FROM t),
q AS (SELECT manual, sec, page, substr(tail, length(title) + 1) AS piece FROM o WHERE rank > 0
  UNION ALL SELECT manual, sec - (rank > 0)::INT, page, CASE WHEN rank = 0 THEN tail ELSE lead_text END FROM o),
b AS (SELECT manual, sec, trim(string_agg(piece, chr(10) || chr(10) ORDER BY page), chr(10) || ' ') AS body FROM q WHERE sec > 0 GROUP BY 1, 2),
e AS (SELECT o.*, b.body, (page_start + length(lead_text))::BIGINT AS start, lead(rank) OVER w > rank AS parent,
  max(CASE WHEN rank = 1 THEN sec END) OVER before AS c_sec, max(CASE WHEN rank = 2 THEN sec END) OVER before AS s_sec FROM o JOIN b USING (manual, sec) WHERE rank > 0
  WINDOW w AS (PARTITION BY manual ORDER BY sec), before AS (PARTITION BY manual ORDER BY sec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT e.manual, row_number() OVER (PARTITION BY e.manual ORDER BY e.sec) - 1 AS leaf, e.start, CASE e.rank WHEN 1 THEN 'capitulo' WHEN 2 THEN 'seccion' ELSE 'subseccion' END AS kind,
  e.num AS numbering, e.title || CASE WHEN e.parent THEN ' (preámbulo)' ELSE '' END AS title, e.page AS page_start, sha256(e.body) AS body_hash,
  CASE WHEN e.rank > 1 THEN c.num END AS chapter, CASE WHEN e.rank > 2 AND (e.c_sec IS NULL OR e.s_sec > e.c_sec) THEN s.num END AS section
FROM e LEFT JOIN e c ON c.manual = e.manual AND c.sec = e.c_sec LEFT JOIN e s ON s.manual = e.manual AND s.sec = e.s_sec
WHERE coalesce(e.parent, false) = false OR e.body <> ''
"""


def asof_merge_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the shipping day in force on their date, for three keys whose timelines hold all days: each lasts two days at most."""
    items = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3).alias("key"), F.col("l_shipdate").cast("date").alias("effective_from"), "l_orderkey").where("pmod(datediff(effective_from, date'1990-01-01'), 5) <> 0")
    versions = items.groupBy("key", "effective_from").agg(F.min("l_orderkey").alias("first_order"))
    following = F.lead("effective_from").over(Window.partitionBy("key").orderBy("effective_from"))
    versions = versions.withColumn("effective_to", F.least(F.date_add("effective_from", 1), F.date_sub(following, 1)))
    facts = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("key"), F.col("o_orderdate").cast("date").alias("day"))
    hit = asof_merge.as_of_merge(facts, versions, ["key"], "day")
    return hit.select("o_orderkey", "key", F.col("version.effective_from").cast("string").alias("effective_from"), F.coalesce("version.first_order", F.lit(-1)).cast("long").alias("first_order"))


ASOF_MERGE_SQL = """
WITH i AS (SELECT l_partkey % 3 AS key, CAST(l_shipdate AS DATE) AS a, min(l_orderkey) AS first_order FROM lineitem WHERE datediff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) % 5 <> 0 GROUP BY 1, 2),
v AS (SELECT *, least(CAST(a + 1 AS DATE), CAST(lead(a) OVER (PARTITION BY key ORDER BY a) - 1 AS DATE)) AS b FROM i)
SELECT o.o_orderkey, o.o_custkey % 4 AS key, CAST(v.a AS VARCHAR) AS effective_from, coalesce(v.first_order, -1) AS first_order
FROM orders o LEFT JOIN v ON v.key = o.o_custkey % 4 AND CAST(o.o_orderdate AS DATE) BETWEEN v.a AND coalesce(v.b, DATE '9999-12-31')
"""

QUERIES = {
    "temporal_filter": (temporal_filter, TEMPORAL_SQL),
    "canonical_ids": (canonical_ids, IDS_SQL),
    "written_dates": (written_dates, DATES_SQL),
    "article_timeline": (article_timeline, ARTICLE_SQL),
    "clause_split": (clause_split, CLAUSE_SQL),
    "vat_quota": (vat_quota, VAT_SQL),
    "withholding_sums": (withholding_sums, WITHHOLDING_SQL),
    "rule_catalog": (rule_catalog, RULE_CATALOG_SQL),
    "drift_eligibility": (drift_eligibility, ELIGIBLE_SQL),
    "corpus_families": (corpus_families, FAMILIES_SQL),
    "manual_pages": (manual_pages, PAGES_SQL),
    "manual_leaves": (manual_leaves, MANUAL_LEAVES_SQL),
    "asof_merge": (asof_merge_join, ASOF_MERGE_SQL),
    "subject_keys": (subject_keys, SUBJECT_SQL),
}
