"""Queries on the driver tables for retrieval, texts, citations, ingestion and drift, with their DuckDB equivalents."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foralia.functions import text as tx
from foralia.functions.scales import round_half_up
from foralia.operators import calendar, chunking, citations, doctrine, drift, ingest, posting_index, retrieval, vat
from foralia.runtime import scratch_dir, spread, table

QUERY = "the thing and eaner de la the"
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


def _chunks(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def _query(spark) -> DataFrame:
    return spark.createDataFrame([(1, QUERY)], "query_id int, text string")


def _asked(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each document whose id is divisible by 20, through an index that was built in two batches."""
    index = posting_index.PostingIndex(spark, f"{scratch_dir(spark)}/postings-{uuid.uuid4().hex}", "long")
    docs = _chunks(spark, sf_dir)
    index.add(docs.where("chunk_id % 2 = 0"), "even")
    index.add(docs.where("chunk_id % 2 = 1"), "odd")
    return _ranked(index.search(_asked(spark, sf_dir), 50))


def bm25_every_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for a fixed query, by the plan that scores every document that holds one of its tokens."""
    return _ranked(retrieval.bm25(_chunks(spark, sf_dir), _query(spark)))


def _bm25_sql(asked: str) -> str:
    return f"""
WITH q AS (SELECT query_id, token, count(*) AS times FROM (SELECT query_id, unnest({TOKENS}) AS token FROM ({asked})) GROUP BY 1, 2),
d AS (SELECT doc_id, {TOKENS} AS tokens FROM documents),
n AS (SELECT count(*)::DOUBLE AS n, avg(len(tokens)) AS a FROM d),
w AS (SELECT doc_id, len(tokens)::DOUBLE AS l, unnest(tokens) AS token FROM d),
c AS (SELECT doc_id, l, token, count(*)::DOUBLE AS f FROM w WHERE token IN (SELECT token FROM q) GROUP BY 1, 2, 3),
s AS (SELECT token, count(*)::DOUBLE AS df FROM c GROUP BY 1),
x AS (SELECT q.query_id, c.doc_id AS chunk_id, sum(CAST(floor(1e12::DOUBLE * (q.times * ln((n.n - s.df + 0.5) / (s.df + 0.5) + 1) * c.f * 2.5 / (c.f + 1.5 * (1 - 0.75 + 0.75 * c.l / n.a)))) AS BIGINT))::DOUBLE / 1e12 AS score
  FROM c JOIN q ON q.token = c.token JOIN s ON s.token = c.token CROSS JOIN n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x WHERE score > 0)
SELECT query_id, chunk_id, floor(score * 1000000 + 0.5) / 1000000 AS score, rank FROM r WHERE rank <= 50
"""


def _vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _asked_vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("query_id", "chunk_id", round_half_up(F.col("score"), 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 vectors nearest to each one whose id is divisible by 20."""
    return _ranked(retrieval.dense(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir)))


def filter_then_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest among three labels, with a least score, for the same queries."""
    return _ranked(retrieval.dense(_vectors(spark, sf_dir).where(F.col("label").isin(1, 3, 5)), _asked_vectors(spark, sf_dir), 20, 0.05))


def _dense_sql(where: str, k: int, least: float) -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0),
x AS (SELECT q.query_id, vec_id AS chunk_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.q) AS score FROM embeddings CROSS JOIN q {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM x WHERE score >= {least})
SELECT query_id, chunk_id, floor(score * 1000000 + 0.5) / 1000000 AS score, rank FROM r WHERE rank <= {k}
"""


def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of the documents, by length and by id hash, fused."""
    docs = _chunks(spark, sf_dir).withColumn("query_id", F.lit(1))
    long = retrieval.top_k(docs.withColumn("score", F.length("text").cast("double")), 200)
    spread = retrieval.top_k(docs.withColumn("score", (F.col("chunk_id") * 7919 % 1009).cast("double")), 200)
    found = retrieval.rrf(long, spread, k=100)
    return found.select("chunk_id", round_half_up(F.col("score"), 9).alias("score"), F.col("rank").cast("long").alias("rank"))


RRF_SQL = """
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS r FROM documents),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id * 7919 % 1009 DESC, doc_id) AS r FROM documents),
u AS (SELECT doc_id, 1.0::DOUBLE / (60 + r) AS p FROM a WHERE r <= 200 UNION ALL SELECT doc_id, 1.0::DOUBLE / (60 + r) FROM b WHERE r <= 200),
s AS (SELECT doc_id AS chunk_id, sum(p) AS score FROM u GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT chunk_id, floor(score * 1000000000 + 0.5) / 1000000000 AS score, rank FROM k WHERE rank <= 100
"""


def hash_embedding_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sparse hash vector in 1024 dimensions, one row per place."""
    return retrieval.sparse_embeddings(_chunks(spark, sf_dir)).withColumnRenamed("chunk_id", "doc_id")


HASH_SQL = f"""
WITH w AS (SELECT doc_id, unnest({TOKENS}) AS token FROM documents)
SELECT doc_id, CAST(('0x' || substr(sha256(token), 1, 8))::BIGINT % 1024 AS INT) AS place, count(*) AS n FROM w GROUP BY 1, 2
"""


def context_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve longest documents of each language as one context."""
    order = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    ranked = table(spark, sf_dir, "documents").withColumn("rank", F.row_number().over(order)).where("rank <= 12")
    ranked = ranked.select(F.col("lang").alias("query_id"), "rank", F.lit("doc").alias("source_type"), F.col("doc_id").alias("chunk_id"), "text")
    built = retrieval.build_context(ranked.withColumn("chunk_id", F.col("chunk_id").cast("string")))
    return built.select(F.col("query_id").alias("lang"), F.sha2("context", 256).alias("context_hash"))


CONTEXT_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT lang, sha256(string_agg('[' || rank || '] doc | ' || doc_id || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank)) AS context_hash FROM r WHERE rank <= 12 GROUP BY lang
"""


def doctrine_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rulings: court by status, chamber by priority, matter by customer."""
    orders = table(spark, sf_dir, "orders")
    rulings = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 50 == 0, "TC").otherwise("TS").alias("organo"), F.col("o_orderpriority").alias("sala"), F.col("o_orderstatus").alias("fallo_sentido"), F.concat(F.lit("Asunto número "), F.col("o_custkey").cast("string")).alias("resumen"))
    return doctrine.ruling_weights(rulings).select("o_orderkey", "weight")


DOCTRINE_SQL = """
WITH r AS (SELECT o_orderkey, o_orderkey % 50 = 0 AS tc, count(*) OVER (PARTITION BY o_orderkey % 50 = 0, o_orderpriority, o_orderstatus, o_custkey) AS n FROM orders)
SELECT o_orderkey, CASE WHEN tc THEN 'binding' WHEN n >= 2 THEN 'consolidated' ELSE 'isolated' END AS weight FROM r
"""


def _texts(spark, sf_dir: str) -> DataFrame:
    """Line items as sentences with a citation of one family each."""
    items = table(spark, sf_dir, "lineitem")
    key, part = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    by = F.col("l_orderkey") % 6
    sentence = (
        F.when(by == 0, F.concat(F.lit("según BOE-A-2006-"), part))
        .when(by == 1, F.concat(F.lit("el art. "), part, F.lit(" bis de la LIRPF")))
        .when(by == 2, F.concat(F.lit("consulta V"), F.lpad((F.col("l_partkey") % 10000).cast("string"), 4, "0"), F.lit("-24 de la DGT")))
        .when(by == 3, F.concat(F.lit("Ley 35/2006 y artículo "), part))
        .when(by == 4, F.concat(F.lit("BOCM-2024-"), part, F.lit(" sin más")))
        .otherwise(F.concat(F.lit("nada que citar en "), key))
    )
    return items.select("l_orderkey", "l_linenumber", sentence.alias("text"))


def citation_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each sentence cites, with its place."""
    found = citations.extract(_texts(spark, sf_dir)).select("l_orderkey", "l_linenumber", F.explode("citations").alias("c"))
    return found.select("l_orderkey", "l_linenumber", F.col("c.kind").alias("kind"), F.col("c.raw").alias("raw"), F.col("c.start").alias("start"), F.col("c.canonical").alias("canonical"))


EXTRACT_SQL = """
WITH t AS (SELECT l_orderkey, l_linenumber, l_orderkey % 6 AS k, l_partkey AS p, lpad((l_partkey % 10000)::VARCHAR, 4, '0') AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, 'boe_state' AS kind, 'BOE-A-2006-' || p AS raw, 6 AS start, NULL::VARCHAR AS canonical FROM t WHERE k = 0
UNION ALL SELECT l_orderkey, l_linenumber, 'article', 'art. ' || p || ' bis ', 3, NULL FROM t WHERE k = 1
UNION ALL SELECT l_orderkey, l_linenumber, 'alias', 'LIRPF', 19 + length(p::VARCHAR), NULL FROM t WHERE k = 1
UNION ALL SELECT l_orderkey, l_linenumber, 'jurisprudence', 'V' || v || '-24', 9, 'V' || v || '-24' FROM t WHERE k = 2
UNION ALL SELECT l_orderkey, l_linenumber, 'alias', 'Ley 35/2006', 0, NULL FROM t WHERE k = 3
UNION ALL SELECT l_orderkey, l_linenumber, 'article', 'artículo ' || p, 14, NULL FROM t WHERE k = 3
UNION ALL SELECT l_orderkey, l_linenumber, 'boe_regional', 'BOCM-2024-' || p, 0, NULL FROM t WHERE k = 4
"""


def nearest_carrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The norm that each cited article belongs to."""
    tied = citations.associate(citations.extract(_texts(spark, sf_dir))).select("l_orderkey", "l_linenumber", F.explode("citations").alias("c")).where("c.kind = 'article'")
    return tied.select("l_orderkey", "l_linenumber", F.col("c.article").alias("article"), F.col("c.boe_id").alias("boe_id"))


CARRIER_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey::VARCHAR AS article, 'BOE-A-2006-20764' AS boe_id FROM lineitem WHERE l_orderkey % 6 IN (1, 3)
"""


def citation_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict per sentence against a catalogue of one law with one documented article."""
    texts = _texts(spark, sf_dir).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    normas = spark.createDataFrame([("BOE-A-2006-20764",), ("BOCM-2024-7",)], "boe_id string")
    versions = spark.createDataFrame([("BOE-A-2006-20764", date(2007, 1, 1), None, "vigente"), ("BOCM-2024-7", date(2024, 1, 1), date(2024, 6, 30), "vigente")], "norma_boe_id string, effective_from date, effective_to date, status string")
    pins = citations.documented(spark.createDataFrame([("BOE-A-2006-20764", "art. 7 bis"), ("BOE-A-2006-20764", "artículo 9")], "boe_id string, article string"))
    rulings = spark.createDataFrame([("V0011-24",)], "canonical string")
    issues = citations.verify(texts, "id", F.lit(date(2024, 12, 31)), normas, versions, pins, rulings)
    return citations.verdicts(issues, "id", texts)


VERDICT_SQL = """
WITH v AS (SELECT l_orderkey || '-' || l_linenumber AS id, max(CASE l_orderkey % 6
  WHEN 0 THEN CASE WHEN l_partkey = 20764 THEN 0 ELSE 2 END
  WHEN 1 THEN CASE WHEN l_partkey = 7 THEN 0 ELSE 2 END
  WHEN 2 THEN CASE WHEN l_partkey % 10000 = 11 THEN 0 ELSE 2 END
  WHEN 3 THEN CASE WHEN l_partkey = 9 THEN 0 ELSE 2 END
  WHEN 4 THEN CASE WHEN l_partkey = 7 THEN 1 ELSE 2 END
  ELSE 0 END) AS w FROM lineitem GROUP BY 1)
SELECT id, CASE w WHEN 2 THEN 'block' WHEN 1 THEN 'warn' ELSE 'safe' END AS verdict FROM v
"""


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as rulings' plain text."""
    plain = tx.html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(plain, 256).alias("text_hash"), F.length(plain).alias("n"))


HTML_SQL = r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '<\s*br\s*/?\s*>', chr(10), 'gi'), '</\s*(?:p|div|li|h[1-6]|tr)\s*>', chr(10), 'gi') AS x FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '</\s*td\s*>\s*<\s*td[^>]*>', ': ', 'gi'), '</\s*td\s*>', ' ', 'gi'), '<[^>]+>', '', 'g') AS x FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS x FROM b),
d AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \t\x{00a0}\r]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS x FROM c)
SELECT page_id, sha256(trim(x, ' ' || chr(10))) AS text_hash, CAST(length(trim(x, ' ' || chr(10))) AS INT) AS n FROM d
"""


def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines built from parts; the last of a repeated label wins, unknown labels are ignored."""
    header = F.concat(F.lit("Núm. Consulta: V"), F.col("p_partkey").cast("string"), F.lit("\n\n  Órgano :  "), F.col("p_brand"), F.lit("  \nPRIMERO: no\nAsunto: viejo\nAsunto: "), F.col("p_name"), F.lit("\nfin"))
    fields = tx.header_fields(header, {"num consulta": "numero", "organo": "organo", "asunto": "asunto"})
    parts = spread(table(spark, sf_dir, "part"), 4).select("p_partkey", fields.alias("f"))
    return parts.select("p_partkey", *(F.try_element_at("f", F.lit(k)).alias(k) for k in ("numero", "organo", "asunto")), F.size("f").alias("n"))


HEADER_SQL = "SELECT p_partkey, 'V' || p_partkey AS numero, trim(p_brand) AS organo, trim(p_name) AS asunto, 3 AS n FROM part"


def paragraph_last_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the last line with a marker, else the last line over 50 characters, else the one before."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.last_with_marker(lines, r"License|\bidiot\b"), 256).alias("line_hash"))


MARKER_SQL = r"""
WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS xs FROM documents),
m AS (SELECT doc_id, xs, list_filter(xs, lambda x: regexp_matches(x, 'License|\bidiot\b')) AS hit FROM l)
SELECT doc_id, sha256(coalesce(hit[-1], CASE WHEN length(xs[-1]) > 50 THEN xs[-1] END, CASE WHEN length(xs[-2]) > 50 THEN xs[-2] END)) AS line_hash FROM m
"""


def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as gazette items: department by status, heading by priority, title by customer."""
    status, priority, key = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_custkey")
    items = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(status == "F", "Ministerio de Hacienda").when(status == "O", "Jefatura del Estado").otherwise("Ministerio de Cultura").alias("departamento"),
        F.when(priority == "1-URGENT", "Real Decreto-ley").when(priority == "2-HIGH", "Orden").when(priority == "5-LOW", "Anuncios").otherwise("Ley Orgánica").alias("epigrafe"),
        F.when(key % 4 == 0, "Norma sobre el IVA").when(key % 4 == 1, "Cuestión administrativa").when(key % 4 == 2, "Gestión Tributaria").otherwise("Del Ministerio Fiscal").alias("titulo"),
    )
    return ingest.classify(items).select("o_orderkey", "relevance", "kind", F.array_join("matched", ",").alias("matched"))


CLASSIFY_SQL = """
WITH i AS (SELECT o_orderkey, o_orderstatus AS s, o_custkey % 4 AS k,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'real_decreto_ley' WHEN '2-HIGH' THEN 'orden_ministerial' WHEN '5-LOW' THEN NULL ELSE 'ley_organica' END AS kind FROM orders)
SELECT o_orderkey, kind, CASE WHEN kind IS NULL OR k = 3 THEN 'no_fiscal' WHEN s = 'F' THEN 'fiscal' WHEN s = 'O' AND k IN (0, 2) THEN 'probable' ELSE 'no_fiscal' END AS relevance,
  CASE WHEN kind IS NULL OR k IN (1, 3) THEN '' WHEN k = 0 THEN 'iva' ELSE 'tributari,gestion tributaria' END AS matched FROM i
"""


def accent_fold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold two words, accents aside."""
    operations = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("description"), F.lit(None).cast("array<string>").alias("keywords"))
    return vat.lookup(operations, F.lit(" Être  EAU")).select("doc_id", F.sha2(tx.fold_accents(F.col("description")), 256).alias("folded"))


ACCENT_SQL = f"""
WITH f AS (SELECT doc_id, lower(translate(text, '{tx.ACCENTED}', '{tx.PLAIN}')) AS h FROM documents)
SELECT doc_id, sha256(h) AS folded FROM f WHERE contains(h, 'etre') AND contains(h, 'eau')
"""


def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return ingest.first_wins(table(spark, sf_dir, "documents").withColumn("h", F.sha2("text", 256)), ["h"], ["doc_id"]).select("doc_id", "h")


FIRST_SQL = "SELECT min(doc_id) AS doc_id, sha256(text) AS h FROM documents GROUP BY text"

EVENT_TYPES = ["click", "error", "purchase", "refund", "signup", "view"]


def zero_filled_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, types without events included."""
    return ingest.breakdown(table(spark, sf_dir, "events"), "event_type", EVENT_TYPES)


BREAKDOWN_SQL = f"""
WITH v(event_type) AS (VALUES {", ".join(f"('{x}')" for x in EVENT_TYPES)})
SELECT v.event_type, count(e.event_id) AS n FROM v LEFT JOIN events e ON e.event_type = v.event_type GROUP BY 1
"""


def snapshot_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as two snapshots: some keys in one only, some with another price."""
    orders = table(spark, sf_dir, "orders")
    price = F.floor("o_totalprice").cast("long")
    before = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", price.alias("hash"))
    now = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, price + 1).otherwise(price).alias("hash"))
    found = drift.snapshot_drift(before, now, ["o_orderkey"])
    return found.select("o_orderkey", "kind", *(F.col(c).cast("string").alias(c) for c in ("previous_hash", "current_hash")))


DRIFT_SQL = """
WITH a AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) AS h FROM orders WHERE o_orderkey % 7 <> 0),
b AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS h FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'modified' END AS kind, CAST(a.h AS VARCHAR) AS previous_hash, CAST(b.h AS VARCHAR) AS current_hash
FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.h <> b.h
"""


def timeline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with timelines: key and start, text and end."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.to_date("o_orderdate").alias("effective_from"), F.col("o_orderpriority").alias("text_hash"), F.lit(None).cast("date").alias("effective_to"))
    now = base.where("article_id % 6 <> 0").withColumn("text_hash", F.when(F.col("article_id") % 8 == 0, "x").otherwise(F.col("text_hash"))).withColumn("effective_to", F.when(F.col("article_id") % 10 == 0, F.date_add("effective_from", 9)))
    return drift.timeline_drift(base.where("article_id % 9 <> 0"), now).select("article_id", F.col("effective_from").cast("string").alias("effective_from"), "kind")


TIMELINE_SQL = """
WITH o AS (SELECT o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders)
SELECT k AS article_id, d AS effective_from, CASE WHEN k % 9 = 0 THEN 'added' WHEN k % 6 = 0 THEN 'removed' WHEN k % 8 = 0 THEN 'rewritten' ELSE 'shifted' END AS kind
FROM o WHERE NOT (k % 9 = 0 AND k % 6 = 0) AND (k % 9 = 0 OR k % 6 = 0 OR k % 8 = 0 OR k % 10 = 0)
"""


def impact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as carriers that cite parts as articles of their supplier's law; the carriers of each are counted and hashed."""
    items = table(spark, sf_dir, "lineitem")
    source = F.struct(F.concat(F.lit("L"), F.col("l_suppkey").cast("string")).alias("boe_id"), F.concat(F.lit("art. "), F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, " bis").otherwise("")).alias("article"))
    index = drift.impact_index(items.select(F.col("l_orderkey").cast("string").alias("id"), F.array(source).alias("sources")))
    return index.select("boe_id", F.col("article.number").alias("number"), F.coalesce("article.suffix", F.lit("")).alias("suffix"), F.array_join("carriers", ",").alias("carriers"))


IMPACT_SQL = """
SELECT 'L' || l_suppkey AS boe_id, l_partkey::VARCHAR AS number, CASE WHEN l_linenumber % 2 = 0 THEN 'bis' ELSE '' END AS suffix,
       array_to_string(list_sort(list(DISTINCT l_orderkey::VARCHAR)), ',') AS carriers
FROM lineitem GROUP BY 1, 2, 3
"""


def freshness_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order and event against a fixed day."""
    today = F.lit(date(2024, 2, 15))
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"))
    events = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("event_id").alias("id"))
    both = drift.freshness(orders, "day", "id", today, 365, "orders").unionByName(drift.freshness(events, "day", "id", today, 30, "events"))
    return both.select("check", F.col("latest").cast("string").alias("latest"), "latest_id", "age_days", "ok")


FRESH_SQL = """
WITH r AS (SELECT 'orders' AS c, CAST(o_orderdate AS DATE) AS d, o_orderkey AS id, 365 AS most FROM orders UNION ALL SELECT 'events', CAST(ts AS DATE), event_id, 30 FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY d DESC, id) AS k FROM r)
SELECT c AS "check", CAST(d AS VARCHAR) AS latest, id::VARCHAR AS latest_id, CAST(DATE '2024-02-15' - d AS INT) AS age_days, DATE '2024-02-15' - d <= most AS ok FROM n WHERE k = 1
"""


def deadline_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All deadlines of every schedule over the years of the orders."""
    years = [r["y"] for r in table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct().collect()]
    events = spark.createDataFrame([(s,) for s in calendar.SCHEDULES], "schedule string")
    return calendar.deadlines(events, years).select("schedule", "period", F.col("deadline").cast("string").alias("deadline"))


_PARTS = ", ".join(f"('{name}', {s}, {m}, {d}, '{label}')" for name, ds in calendar.SCHEDULES.items() for s, m, d, label in ds)
CALENDAR_SQL = f"""
WITH p(schedule, s, m, d, label) AS (VALUES {_PARTS}), y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders),
x AS (SELECT schedule, label || ' ' || y AS period, CASE WHEN d = 0 THEN last_day(make_date(y + s, m, 1)) ELSE make_date(y + s, m, d) END AS day FROM p CROSS JOIN y)
SELECT schedule, period, CAST(CASE dayofweek(day) WHEN 6 THEN CAST(day + 2 AS DATE) WHEN 0 THEN CAST(day + 1 AS DATE) ELSE day END AS VARCHAR) AS deadline FROM x
"""


def idempotent_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and type as a table, later events as what comes in; applied twice."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.col("props").alias("hash"))
    keys = ["user_id", "event_type"]
    stored = ingest.first_wins(events.where("event_id % 2 = 0"), keys, ["event_id"])
    incoming = events.where("event_id % 2 = 1")
    once = ingest.idempotent_upsert(stored, incoming, keys, order=["event_id"])
    return ingest.idempotent_upsert(once, incoming, keys, order=["event_id"])


UPSERT_SQL = """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 1)
SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type,
       CASE WHEN b.event_id IS NULL OR a.props = b.props THEN a.event_id ELSE b.event_id END AS event_id, CASE WHEN b.event_id IS NULL OR a.props = b.props THEN a.props ELSE b.props END AS hash
FROM (SELECT * FROM a WHERE k = 1) a FULL OUTER JOIN (SELECT * FROM b WHERE k = 1) b ON a.user_id = b.user_id AND a.event_type = b.event_type
"""


def gazette_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries built from events: one item or a list of two, with and without a heading, a bare item beside some headings,
    the summary at the root or under `data`, and its day by three names."""
    key, ident = F.col("event_id"), F.col("event_id").cast("string")
    item = lambda n: F.concat(F.lit('{"identificador":"I'), ident, F.lit(f'-{n}","titulo":"'), F.col("event_type"), F.lit('","url_pdf":{"texto":"/p"}}'))
    items = F.when(key % 2 == 0, item(1)).otherwise(F.concat(F.lit("["), item(1), F.lit(","), item(2), F.lit("]")))
    beside = F.when(key % 6 == 0, F.concat(F.lit(',"item":'), item(3))).otherwise("")
    under = F.when(key % 3 == 0, F.concat(F.lit('"epigrafe":[{"nombre":"Ley","item":'), items, F.lit("}]"), beside)).otherwise(F.concat(F.lit('"item":'), items))
    day = F.when(key % 5 == 0, '"fechaInv":{"texto":"20240131"}').when(key % 5 == 1, '"fecha":"20240201"').otherwise('"fecha_publicacion":"20240130","fecha":"x"')
    summary = F.concat(F.lit('{"sumario":{"metadatos":{'), day, F.lit('},"diario":[{"seccion":{"nombre":"I","departamento":{"nombre":"Hacienda",'), under, F.lit("}}}]}}"))
    payload = F.when(key % 4 == 0, summary).otherwise(F.concat(F.lit('{"data":'), summary, F.lit("}")))
    rows = ingest.flatten_gazette(table(spark, sf_dir, "events").select("event_id", F.parse_json(payload).alias("payload")))
    return rows.select("event_id", "fecha", "seccion", "departamento", "epigrafe", "identificador", "titulo", "url_pdf")


FLATTEN_SQL = """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN '20240131' WHEN 1 THEN '20240201' ELSE '20240130' END AS fecha, 'I' AS seccion, 'Hacienda' AS departamento,
  CASE WHEN event_id % 3 = 0 THEN 'Ley' END AS epigrafe, 'I' || event_id || '-' || n AS identificador, event_type AS titulo, '/p' AS url_pdf
FROM events CROSS JOIN (VALUES (1), (2)) v(n) WHERE n = 1 OR event_id % 2 = 1
"""


def greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' lines joined to chunks of 60 words, none over 100 but single lines."""
    packed = chunking.greedy_pack(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 60, 100)
    out = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(packed).alias("part", "content"))
    return out.select("doc_id", "part", chunking.count_words(F.col("content")).alias("words"), F.sha2("content", 256).alias("content_hash"))


def hierarchy_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as marks of a structure: titles in force at each turn."""
    level = F.element_at(F.array(*map(F.lit, chunking.LEVELS)), (F.col("turn") * 3 % 5 + 1).cast("int"))
    blocks = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), level.alias("kind"), F.col("turn").cast("string").alias("title"))
    return chunking.hierarchy_context(blocks)


def _hierarchy_sql() -> str:
    last = lambda k: f"max(CASE WHEN lv = {k} THEN pos END) OVER w"
    above = lambda k: f"coalesce(max(CASE WHEN lv < {k} THEN pos END) OVER w, -1)"
    cols = ", ".join(f"CAST(CASE WHEN {last(k)} > {above(k)} THEN {last(k)} END AS VARCHAR) AS {name}" for k, name in enumerate(chunking.LEVELS))
    names = ", ".join(f"'{x}'" for x in chunking.LEVELS)
    return f"""
WITH b AS (SELECT conv_id AS doc_id, turn AS pos, CAST(turn * 3 % 5 AS INT) AS lv, turn::VARCHAR AS title FROM conversations)
SELECT doc_id, pos, ([{names}])[lv + 1] AS kind, title, {cols} FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
"""


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of all parts."""
    return drift.fingerprint(table(spark, sf_dir, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


_SUMS = ", ".join(f"sum(('0x' || substr(d, {1 + 15 * k}, 15))::BIGINT)::VARCHAR" for k in range(4))
FINGERPRINT_SQL = f"""
WITH h AS (SELECT sha256(concat_ws('|', p_partkey::VARCHAR, coalesce(p_name, '~'), coalesce(p_brand, '~'), coalesce(p_type, '~'), coalesce(p_size::VARCHAR, '~'))) AS d FROM part)
SELECT sha256(concat_ws('-', count(*)::VARCHAR, {_SUMS})) AS fingerprint FROM h
"""

QUERIES = {
    "bm25_topk": (bm25_topk, _bm25_sql("SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 20 = 0")),
    "bm25_every_score": (bm25_every_score, _bm25_sql(f"SELECT 1 AS query_id, '{QUERY}' AS text")),
    "dense_topk": (dense_topk, _dense_sql("", 50, 0.0)),
    "filter_then_topk": (filter_then_topk, _dense_sql("WHERE label IN (1, 3, 5)", 20, 0.05)),
    "rrf_hybrid": (rrf_hybrid, RRF_SQL),
    "hash_embedding_sparse": (hash_embedding_sparse, HASH_SQL),
    "context_builder": (context_builder, CONTEXT_SQL),
    "doctrine_weights": (doctrine_weights, DOCTRINE_SQL),
    "citation_extract": (citation_extract, EXTRACT_SQL),
    "nearest_carrier": (nearest_carrier, CARRIER_SQL),
    "citation_verdict": (citation_verdict, VERDICT_SQL),
    "html_to_text": (html_to_text, HTML_SQL),
    "header_fields": (header_fields, HEADER_SQL),
    "paragraph_last_marker": (paragraph_last_marker, MARKER_SQL),
    "keyword_classify": (keyword_classify, CLASSIFY_SQL),
    "accent_fold_lookup": (accent_fold_lookup, ACCENT_SQL),
    "first_wins_dedupe": (first_wins_dedupe, FIRST_SQL),
    "zero_filled_breakdown": (zero_filled_breakdown, BREAKDOWN_SQL),
    "snapshot_drift": (snapshot_drift, DRIFT_SQL),
    "timeline_drift": (timeline_drift, TIMELINE_SQL),
    "impact_index": (impact_index, IMPACT_SQL),
    "freshness_checks": (freshness_checks, FRESH_SQL),
    "deadline_calendar": (deadline_calendar, CALENDAR_SQL),
    "idempotent_upsert": (idempotent_upsert, UPSERT_SQL),
    "gazette_flatten": (gazette_flatten, FLATTEN_SQL),
    "greedy_packing": (greedy_packing, None),
    "hierarchy_context": (hierarchy_context, _hierarchy_sql()),
    "fingerprint": (fingerprint, FINGERPRINT_SQL),
}
