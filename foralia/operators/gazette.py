"""Norms out of gazette items, gazette summaries in XML, document bodies, and which norms a drift run checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.functions.ids import MONTHS, gazette_date
from foralia.functions.text import collapse, decode_entities, fold_accents
from foralia.operators.temporal import as_of_join

ITEM = "STRUCT<_id: STRING, titulo: STRING, urlPdf: STRING>"
HEADING = f"STRUCT<_nombre: STRING, item: ARRAY<{ITEM}>>"
DEPARTMENT = f"STRUCT<_nombre: STRING, epigrafe: ARRAY<{HEADING}>, item: ARRAY<{ITEM}>>"
SECTION = f"STRUCT<_num: STRING, _nombre: STRING, departamento: ARRAY<{DEPARTMENT}>>"
SUMMARY = f"meta STRUCT<fechaInv: STRING, fecha: STRING>, diario ARRAY<STRUCT<seccion: ARRAY<{SECTION}>>>"


def flatten_xml(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The rows of ingest.flatten_gazette from summaries in XML; malformed XML gives no rows."""
    keep = [c for c in payloads.columns if c != column]
    root = payloads.select(*keep, F.from_xml(F.col(column), SUMMARY, {"mode": "PERMISSIVE"}).alias("r"))
    day = gazette_date(F.regexp_replace(F.coalesce("r.meta.fechaInv", "r.meta.fecha"), "-", ""))
    rows = root.select(*keep, day.alias("fecha"), F.explode("r.diario").alias("d")).select(*keep, "fecha", F.explode("d.seccion").alias("s"))
    rows = rows.select(*keep, "fecha", F.col("s._nombre").alias("seccion"), F.explode("s.departamento").alias("p"))
    none = F.expr(f"cast(array() as array<{HEADING}>)")
    bare = F.when(F.size(F.coalesce("p.epigrafe", none)) > 0, none).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("_nombre"), F.col("p.item").alias("item"))))
    rows = rows.select(*keep, "fecha", "seccion", F.col("p._nombre").alias("departamento"), F.explode(F.concat(F.coalesce("p.epigrafe", none), bare)).alias("e"))
    rows = rows.select(*keep, "fecha", "seccion", "departamento", F.col("e._nombre").alias("epigrafe"), F.explode("e.item").alias("i"))
    return rows.select(*keep, "fecha", "seccion", "departamento", "epigrafe", F.col("i._id").alias("identificador"), F.col("i.titulo").alias("titulo"), F.col("i.urlPdf").alias("url_pdf"))


def enacted_at(title: Column, published: Column) -> Column:
    """Day and month from `de D de mes`, the year from `N/YYYY`; the day of publication where either is missing or impossible."""
    tidy = F.regexp_replace(title, r"(\d+)\s*\.?\s*[ºo°]", "$1")
    pattern = r"(?iu)\bde\s+(\d{1,2})\s+de\s+(\p{L}+)"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), fold_accents(F.regexp_extract(tidy, pattern, 2)))
    year = F.coalesce(F.nullif(F.regexp_extract(tidy, r"\b\d+/(\d{4})\b", 1), F.lit("")), F.year(published).cast("string"))
    iso = F.concat_ws("-", year, F.when(month > 0, F.format_string("%02d", month)), F.lpad(F.nullif(F.regexp_extract(tidy, pattern, 1), F.lit("")), 2, "0"))
    return F.coalesce(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), published)


def build_norms(items: DataFrame) -> DataFrame:
    """A norm with its first version for each classified item that has a kind: in force from the day after publication.

    `provisional` says that the start is an assumption to be checked against the norm's final provisions.
    """
    rows = items.where("kind is not null and relevance <> 'no_fiscal'")
    return rows.select(
        F.col("identificador").alias("boe_id"), "kind", F.col("titulo").alias("title"), enacted_at(F.col("titulo"), F.col("fecha")).alias("enacted_at"), F.date_add("fecha", 1).alias("effective_from"),
        F.lit(None).cast("date").alias("effective_to"), F.lit("vigente").alias("status"), F.lit(True).alias("provisional"), "matched", "relevance",
    )


def document_body(xml: Column) -> Column:
    """Normalised text of the document's own <texto>, not those inside its analysis; the whole document where it has none."""
    inner = F.regexp_replace(F.regexp_replace(xml, r"(?s)<(?:analisis|metadatos)\b.*?</(?:analisis|metadatos)>", ""), r"<\?xml[^>]*>", "")
    body = F.regexp_extract(inner, r"(?s)<texto\b[^>]*>(.*)</texto>", 1)
    chosen = F.when(body == "", inner).otherwise(body)
    return collapse(decode_entities(F.regexp_replace(chosen, "<[^>]+>", " ")))


def document_hash(xml: Column) -> Column:
    """SHA-256 of the body; null for an empty one."""
    return F.sha2(F.nullif(document_body(xml), F.lit("")), 256)


def eligible(normas: DataFrame, versions: DataFrame, today: Column) -> DataFrame:
    """Norms with skip_reason: null for those a drift run checks, being of the State and in force."""
    known = versions.withColumnRenamed("norma_boe_id", "boe_id").select("boe_id", "effective_from", "effective_to", "status")
    hit = as_of_join(normas.withColumn("_day", today), known, ["boe_id"], "_day")
    reason = F.when(~F.col("boe_id").startswith("BOE-A-"), "not_state").when(F.col("version").isNull(), "no_version").when(F.col("version.status") != "vigente", F.concat(F.lit("status_"), F.col("version.status")))
    return hit.withColumn("skip_reason", reason).drop("_day", "version")


def verify_seeds(pinned: DataFrame, versions: DataFrame) -> DataFrame:
    """Pinned hashes (boe_id, article_id, day, content_hash) with `ok`: the version in force, or else the last one, has that hash."""
    known = versions.select("boe_id", "article_id", "effective_from", "effective_to", "text_hash")
    live = as_of_join(pinned, known, ["boe_id", "article_id"], "day", pick="last")
    last = known.groupBy("boe_id", "article_id").agg(F.max_by("text_hash", "effective_from").alias("last_hash"))
    found = F.coalesce("version.text_hash", "last_hash")
    return live.join(last, ["boe_id", "article_id"], "left").withColumn("found_hash", found).withColumn("ok", F.coalesce(found == F.col("content_hash"), F.lit(False))).drop("version", "last_hash")


def parse_summaries(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(items, refused rows) of summaries as text: those that start with { are JSON, with < XML; others are refused, and so is broken JSON."""
    from foralia.operators.ingest import flatten_gazette

    start = F.left(F.ltrim(F.regexp_replace(column, r"^\s+", "")), F.lit(1))
    parsed = F.try_parse_json(column)
    is_json, is_xml = F.coalesce((start == "{") & parsed.isNotNull(), F.lit(False)), F.coalesce(start == "<", F.lit(False))
    as_json = flatten_gazette(payloads.where(is_json).withColumn(column, parsed), column)
    return as_json.unionByName(flatten_xml(payloads.where(is_xml), column).withColumn("fecha", F.col("fecha").cast("string"))), payloads.where(~is_json & ~is_xml)
