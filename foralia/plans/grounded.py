"""Queries on the driver tables for law chunks, court rulings, sources of answers and the checks on them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foralia.operators import citations, context, corpus, legal_chunks, rulings, temporal
from foralia.runtime import parts_to_fold, table


def law_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as norms of two headings and two articles, the first of two wordings and two clauses; every third is no state norm, every fifth version is repealed."""
    c = table(spark, sf_dir, "customer")
    boe = F.concat(F.when(F.col("c_custkey") % 3 == 0, "BOCM-").otherwise("BOE-A-"), F.lit("2000-"), F.col("c_custkey").cast("string"))
    version = lambda day, *body: F.concat(F.lit(f'<version fecha_vigencia="{day}">'), *body, F.lit("</version>"))
    block = lambda ident, kind, *body: F.concat(F.lit(f'<bloque id="{ident}" tipo="{kind}">'), *body, F.lit("</bloque>"))
    xml = F.concat(
        block("t1", "encabezado", version("20000101", F.lit("<p>TÍTULO I. "), F.col("c_mktsegment"), F.lit("</p>"))),
        block("x", "encabezado", version("20000101", F.lit("<p>Capítulo I</p>"))),
        block("a1bis", "precepto", version("20000101", F.lit("<p>Uno "), F.col("c_name"), F.lit("</p>")), version("20100101", F.lit("<p>1. Primero.</p><p>2. Tras "), F.col("c_nationkey").cast("string"), F.lit("</p>"))),
        block("t2", "encabezado", version("20000101", F.lit("<p>TÍTULO II</p>"))),
        block("dtprimera", "precepto", version("20150101", F.lit("<p>Nueva "), F.col("c_name"), F.lit("</p>"))),
    )
    texts = c.select(boe.alias("boe_id"), xml.alias("xml"))
    normas = c.select(boe.alias("boe_id"), F.lit("ley").alias("kind"))
    starts = c.select(boe.alias("norma_boe_id"), F.explode(F.array(F.lit("2005-01-01"), F.lit("2016-06-01"))).alias("start"), "c_custkey")
    status = F.when((F.col("c_custkey") % 5 == 0) & (F.col("start") == "2005-01-01"), "derogada").otherwise("vigente")
    versions = starts.select("norma_boe_id", F.col("start").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), status.alias("status"))
    found = legal_chunks.legal_chunks(normas, versions, texts)
    return found.select("chunk_id", "text", "articulo", "apartado", F.array_join("jerarquia", " > ").alias("headings"), F.col("effective_from").cast("string").alias("effective_from"))


LAW_SQL = """
WITH n AS (SELECT 'BOE-A-2000-' || c_custkey AS b, c_custkey AS k, c_name, c_nationkey, 'TÍTULO I. ' || c_mktsegment || ' > Capítulo I' AS h FROM customer WHERE c_custkey % 3 <> 0),
a AS (SELECT b, h, 'a1bis' AS block, 'art. 1 bis' AS art, NULL AS num, 'Uno ' || c_name AS body, '2005-01-01' AS d FROM n WHERE k % 5 <> 0
  UNION ALL SELECT b, h, 'a1bis', 'art. 1 bis', '1', '1. Primero.', '2016-06-01' FROM n
  UNION ALL SELECT b, h, 'a1bis', 'art. 1 bis', '2', '2. Tras ' || c_nationkey, '2016-06-01' FROM n
  UNION ALL SELECT b, 'TÍTULO II', 'dtprimera', 'DT primera', NULL, 'Nueva ' || c_name, '2016-06-01' FROM n)
SELECT concat_ws('::', 'norma', b, block, 'ap' || num, 'v' || d) AS chunk_id, h || chr(10) || chr(10) || concat_ws(', apartado ', art, num) || chr(10) || chr(10) || body AS text,
  art AS articulo, num AS apartado, h AS headings, d AS effective_from FROM a
"""


def court_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as court rulings: matter, chamber and text by key and segment."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    header = F.create_map(F.lit("materia"), F.when(key % 3 == 0, "Derecho Tributario: IVA"), F.lit("sala"), F.when(key % 5 == 0, "Sala Tercera").otherwise("Sala Primera"), F.lit("seccion"), F.lit("Sección Segunda"))
    body = F.when(F.col("c_mktsegment") == "BUILDING", "El IRPF y la Ley General Tributaria.").when(F.col("c_mktsegment") == "MACHINERY", "Vía administrativa.").otherwise(F.col("c_name"))
    return c.select("c_custkey", rulings.classify(header, body).alias("r")).select("c_custkey", "r.relevance", F.array_join("r.keywords", "|").alias("keywords"))


COURT_SQL = """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'fiscal' WHEN c_mktsegment = 'BUILDING' THEN 'probable' ELSE 'no_fiscal' END AS relevance,
  CASE WHEN c_custkey % 3 = 0 THEN 'tributari|iva' WHEN c_custkey % 5 = 0 THEN '' WHEN c_mktsegment = 'BUILDING' THEN 'ley general tributaria|irpf' ELSE '' END AS keywords FROM customer
"""

CODES = ("TS", "TSJM", "TC", "AN", "ANX", "APM", "XX")


def ruling_organs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Court codes and tribunal headers by customer."""
    c = table(spark, sf_dir, "customer")
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("c_custkey") % len(CODES) + 1).cast("int"))
    header = F.create_map(F.lit("unidad"), F.when(F.col("c_custkey") % 2 == 0, "Tribunal Económico-Administrativo Local de Madrid"))
    number = F.when(F.col("c_custkey") % 4 == 1, "00/1/2020").otherwise("28/1/2020")
    return c.select("c_custkey", rulings.court_organ(code).alias("court"), rulings.tribunal_organ(header, number).alias("tribunal"))


ORGANS_SQL = """
SELECT c_custkey, ['TS', 'TSJ', 'TC', 'AN', NULL, 'AP', NULL][(c_custkey % 7 + 1)::INT] AS court,
  CASE WHEN c_custkey % 2 = 0 THEN 'teal' WHEN c_custkey % 4 = 1 THEN 'teac' ELSE 'tear' END AS tribunal FROM customer
"""


def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders, three at most, as sources of two families, with headings, metadata and hints."""
    o = table(spark, sf_dir, "orders")
    law, day = F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "yyyy-MM-dd")
    chunks = o.select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.when(law, "norma").otherwise("consulta_dgt").alias("source_type"), F.col("o_orderpriority").alias("text"),
        F.when(law, F.concat(F.lit("BOE-A-1-"), F.col("o_orderkey").cast("string"))).alias("boe_id"), F.when(law, "art. 7").alias("articulo"), F.when(law & (F.col("o_orderkey") % 2 == 0), "1.a)").alias("apartado"),
        F.when(~law, F.concat(F.lit("V"), F.col("o_orderkey").cast("string"))).alias("numero"), F.when(~law, "iva").alias("impuesto"), F.when(~law, day).alias("fecha"), F.when(law, day).alias("effective_from"),
    )
    numbered = chunks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", *[c for c in chunks.columns if c not in ("query_id", "chunk_id")]))).alias("all"))
    ranked = numbered.select("query_id", F.posexplode("all").alias("at", "c")).select("query_id", (F.col("at") + 1).alias("rank"), "c.*")
    return context.sources(ranked, 3).select("chunk_id", "place", "rendered", "hint")


SOURCES_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS d, o_orderkey % 2 = 0 AS even FROM orders),
x AS (SELECT *, chr(10) AS nl FROM r WHERE place <= 3)
SELECT o_orderkey AS chunk_id, CAST(place AS INT) AS place, CASE WHEN o_orderstatus = 'O' THEN
    '[FUENTE ' || place || '] Norma — BOE-A-1-' || o_orderkey || ', art. 7' || CASE WHEN even THEN '.1.a)' ELSE '' END || nl || 'BOE-ID: BOE-A-1-' || o_orderkey || nl || 'Pinpoint: art. 7'
      || CASE WHEN even THEN ', apartado 1.a)' ELSE '' END || nl || 'Vigencia: desde ' || d || nl || o_orderpriority
  ELSE '[FUENTE ' || place || '] Consulta DGT V' || o_orderkey || ' (' || d || ', IVA)' || nl || 'Número: V' || o_orderkey || nl || 'Impuesto: IVA' || nl || o_orderpriority END AS rendered,
  CASE WHEN o_orderstatus = 'O' THEN 'art. 7' || CASE WHEN even THEN '.1.a)' ELSE '' END || ' (BOE-A-1-' || o_orderkey || ')' ELSE 'Consulta DGT V' || o_orderkey || ' (' || d || ')' END AS hint FROM x
"""


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based UUIDs of all documents' ids."""
    return table(spark, sf_dir, "documents").select("doc_id", corpus.point_id(F.concat(F.lit("doc::"), F.col("doc_id").cast("string"))).alias("point_id"))


POINT_SQL = """
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc::' || doc_id)) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9'
  WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS point_id FROM h
"""


def grounding_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers over their lines as sources, numbered as the lines are.

    Each answer refers to sources 1 and 4 and to three citations: an id that stands in the text of its first line, an alias that resolves
    to an id in the metadata of every third answer, and a year out of range, which is blocked unless a fifth of the answers' text holds it.
    Some sources were rejected by date.
    """
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key, text = F.col("o_orderkey"), lambda c: c.cast("string")
    answer = F.concat(F.lit("Véase BOE-A-2001-"), text(key % 9 + 1), F.lit(" y la LIRPF [FUENTE 1]; también BOE-A-2999-7 [fuente  4]."))
    answers = o.select(key.alias("answer_id"), answer.alias("answer"))
    name = F.concat_ws("-", text(F.col("l_orderkey")), text(F.col("l_linenumber")))
    sources = lines.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("index"), name.alias("chunk_id"))
    bodies = F.array(F.concat(F.lit("Según boe-a-2001-"), text(key % 4 + 1), F.lit(" ")), F.when(key % 5 == 0, "el BOE-A-2999-7 dice"))
    contexts = o.select(key.alias("answer_id"), bodies.alias("bodies"), F.when(key % 3 == 0, F.array(F.lit("BOE-ID: BOE-A-2006-20764"))).alias("metadata"))
    norms = spark.createDataFrame([("BOE-A-2006-20764", date(2007, 1, 1), None, "vigente")] + [(f"BOE-A-2001-{n}", date(2001, 1, 1), None, "vigente") for n in range(1, 9)], "norma_boe_id string, effective_from date, effective_to date, status string")
    pins = spark.createDataFrame([], "boe_id string, number string, suffix string")
    issues = citations.verify(answers, "answer_id", F.lit(date(2024, 1, 1)), norms.select(F.col("norma_boe_id").alias("boe_id")), norms, pins, this_year=2024, text="answer")
    rejected = lines.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).select(name.alias("chunk_id"))
    grounded = citations.ground(answers, contexts, "answer_id", metadata="metadata")
    found = citations.grounding(issues, "answer_id", sources, grounded, rejected, citations.source_references(answers, sources, "answer_id"))
    return found.select("answer_id", "verdict", F.array_join("problems", "; ").alias("problems"))


GROUNDING_SQL = """
WITH a AS (SELECT o_orderkey AS k FROM orders), l AS (SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem),
p AS (SELECT l_orderkey AS k, 2 AS level, 'REJECTED_SOURCE ' || l_orderkey || '-' || l_linenumber AS problem FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45
  UNION ALL SELECT k, 2, 'SOURCE_NOT_GIVEN ' || n FROM a CROSS JOIN (VALUES (1), (4)) v(n) WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.k = a.k AND l.n = v.n)
  UNION ALL SELECT k, CASE WHEN k % 9 = 8 THEN 2 ELSE 1 END, CASE WHEN k % 9 = 8 THEN 'BLOCKED_NOT_IN_CONTEXT 0' ELSE 'NOT_IN_CONTEXT 0' END FROM a WHERE k % 9 <> k % 4
  UNION ALL SELECT k, 1, 'NOT_IN_CONTEXT 1' FROM a WHERE k % 3 <> 0
  UNION ALL SELECT k, 2, 'BLOCKED_NOT_IN_CONTEXT 2' FROM a WHERE k % 5 <> 0),
g AS (SELECT k, max(level) AS level, list_sort(list_distinct(list(problem))) AS problems FROM p GROUP BY 1),
e AS (SELECT k FROM a UNION SELECT k FROM l)
SELECT e.k AS answer_id, CASE level WHEN 2 THEN 'block' WHEN 1 THEN 'warn' ELSE 'safe' END AS verdict, coalesce(array_to_string(problems, '; '), '') AS problems FROM e LEFT JOIN g ON g.k = e.k
"""


def applicable_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rules that name their lines' suppliers as norms; nations stand for the versions' first day."""
    mention = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("B"), F.col("l_suppkey").cast("string")).alias("boe_id"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", mention.alias("mention"))
    parts = parts_to_fold(lines)
    folded = lines.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("mention")).alias("sources"))
    days = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day"))
    rules = folded.join(days.repartition(parts, "l_orderkey"), "l_orderkey")
    start = F.date_add(F.lit("1993-01-01").cast("date"), (F.col("s_nationkey") * 60).cast("int"))
    versions = table(spark, sf_dir, "supplier").select(F.concat(F.lit("B"), F.col("s_suppkey").cast("string")).alias("norma_boe_id"), start.alias("effective_from"), F.date_add(start, 900).alias("effective_to"))
    found = temporal.applicable_versions(rules, versions, "day", "l_orderkey")
    return found.select("l_orderkey", F.col("place").cast("long").alias("place"), "boe_id", F.col("version.effective_from").cast("string").alias("effective_from"))


APPLICABLE_SQL = """
WITH c AS (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'B' || l_suppkey) - 1 AS pos FROM lineitem),
f AS (SELECT l_orderkey, l_suppkey, min(pos) AS place FROM c GROUP BY 1, 2),
v AS (SELECT s_suppkey, DATE '1993-01-01' + (s_nationkey * 60)::INT AS a FROM supplier)
SELECT l_orderkey, place, 'B' || l_suppkey AS boe_id, strftime(a, '%Y-%m-%d') AS effective_from
FROM f JOIN v ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey WHERE CAST(o_orderdate AS DATE) BETWEEN a AND a + 900
"""

def ruling_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of three families straight to chunks: courts of five codes, one of them unknown, half of them about taxes; numbers of rulings, every seventh broken."""
    key = lambda c: F.col(c).cast("string")
    p = lambda *parts: F.concat(F.lit("<p>"), *(x if not isinstance(x, str) else F.lit(x) for x in parts), F.lit("</p>"))
    code = F.element_at(F.array(*map(F.lit, ("TS", "TSJM", "AN", "APM", "XX"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    matter = F.when(F.col("c_custkey") % 2 == 0, "IRPF").otherwise("Laboral")
    reasons = "Fijamos como criterio interpretativo que la cuantía no se integra en la base."
    court = F.concat(p("ECLI: ECLI:ES:", code, ":2024:", key("c_custkey")), p("Materia: ", matter), p("Número de resolución: ", key("c_custkey"), "/2024"), p("Fecha: 01/02/2024"), p("Fundamentos de derecho"), p(), p(reasons), p(), p("FALLO"), p("Estimamos el recurso."))
    number = F.when(F.col("s_suppkey") % 7 == 0, "sin").otherwise(F.format_string("V%04d-24", "s_suppkey"))
    office = F.concat(p("Núm. Consulta: ", number), p("Fecha salida: 05/02/2024"), p("Asunto: IVA"), p("Cuestión planteada"), p("Si tributa."), p("Contestación completa"), p("En consecuencia, ", F.col("s_name")))
    claim = F.when(F.col("p_partkey") % 7 == 0, "sin").otherwise(F.format_string("%02d/%05d/2023", (F.col("p_partkey") % 3).cast("int"), "p_partkey"))
    tribunal = F.concat(p("Número de resolución: ", claim), p("Fecha: 3 de mayo de 2023"), p("Asunto: IVA "), p("Criterio:"), p("El IVA de ", F.col("p_name")), p("Fallo"), p("Acuerda DESESTIMAR."))
    page = lambda name, html: table(spark, sf_dir, name).select(html.alias("html"))
    found = rulings.chunks_of(page("customer", court), page("supplier", office), page("part", tribunal))
    return found.select("chunk_id", "source_type", "text", "organo", F.col("fecha").cast("string").alias("fecha"), F.col("tier").cast("long").alias("tier"))


RULING_PAGES_SQL = """
WITH c AS (SELECT c_custkey AS k, ['TS', 'TSJM', 'AN', 'APM', 'XX'][c_custkey % 5 + 1] AS code, ['TS', 'TSJ', 'AN', 'AP'][c_custkey % 5 + 1] AS organ, [20, 40, 30, 61][c_custkey % 5 + 1] AS tier FROM customer),
t AS (SELECT printf('%02d/%05d/2023', p_partkey % 3, p_partkey) AS num, CASE p_partkey % 3 WHEN 0 THEN 'teac' ELSE 'tear' END AS organ, CASE p_partkey % 3 WHEN 0 THEN 41 ELSE 60 END AS tier, p_name FROM part WHERE p_partkey % 7 <> 0)
SELECT 'sentencia::ECLI:ES:' || code || ':2024:' || k AS chunk_id, 'sentencia' AS source_type,
  code || ' ' || k || '/2024 (2024-02-01)' || chr(10) || chr(10) || 'Ratio: Fijamos como criterio interpretativo que la cuantía no se integra en la base.' || chr(10) || chr(10) || 'Fallo: FALLO' || chr(10) || 'Estimamos el recurso.' AS text,
  organ AS organo, '2024-02-01' AS fecha, tier::BIGINT AS tier FROM c WHERE organ IS NOT NULL AND k % 2 = 0
UNION ALL SELECT 'consulta_dgt::' || printf('V%04d-24', s_suppkey), 'consulta_dgt', 'DGT ' || printf('V%04d-24', s_suppkey) || ' (2024-02-05) — IVA' || chr(10) || chr(10) || 'Cuestión: Cuestión planteada' || chr(10) || 'Si tributa.'
  || chr(10) || chr(10) || 'Criterio: ' || 'Contestación completa' || chr(10) || 'En consecuencia, ' || s_name, NULL, '2024-02-05', 50 FROM supplier WHERE s_suppkey % 7 <> 0
UNION ALL SELECT 'resolucion_teac::' || num, 'resolucion_teac', upper(organ) || ' ' || num || ' (2023-05-03, ordinaria) — IVA' || chr(10) || chr(10) || 'Criterio: Criterio:' || chr(10) || 'El IVA de ' || p_name, organ, '2023-05-03', tier FROM t
"""

QUERIES = {
    "law_chunks": (law_chunks, LAW_SQL),
    "court_relevance": (court_relevance, COURT_SQL),
    "ruling_organs": (ruling_organs, ORGANS_SQL),
    "answer_sources": (answer_sources, SOURCES_SQL),
    "point_ids": (point_ids, POINT_SQL),
    "grounding_levels": (grounding_levels, GROUNDING_SQL),
    "ruling_pages": (ruling_pages, RULING_PAGES_SQL),
    "applicable_versions": (applicable_versions, APPLICABLE_SQL),
}
