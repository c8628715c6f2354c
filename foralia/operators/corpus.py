"""Indexable chunks out of the five families of the corpus, in one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.operators.doctrine import BINDING_RULING_TIER, court_tier, ruling_weights, tribunal_tier, tribunal_weights
from foralia.operators.ingest import breakdown, first_wins

HEAD_CHARS = 1500


def _chunk(rows: DataFrame, family: str, ident: Column, parts: list[Column], **columns: Column) -> DataFrame:
    """chunk_id, source_type, text (parts joined by blank lines, nulls left out) and the family's own columns."""
    return rows.select(F.concat_ws("::", F.lit(family), ident).alias("chunk_id"), F.lit(family).alias("source_type"), F.concat_ws("\n\n", *parts).alias("text"), *(c.alias(name) for name, c in columns.items()))


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def _dated(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def norm_chunks(normas: DataFrame, versions: DataFrame) -> DataFrame:
    """One chunk per version of a norm: its title and notes, valid as the version is."""
    rows = normas.join(versions, normas["boe_id"] == versions["norma_boe_id"])
    ident = F.concat_ws("::", "boe_id", F.concat(F.lit("v"), F.col("effective_from").cast("string")))
    return _chunk(rows, "norma", ident, [F.col("title"), F.nullif("notes", F.lit(""))], boe_id=F.col("boe_id"), kind=F.col("kind"), effective_from=F.col("effective_from"), effective_to=F.col("effective_to"), status=F.col("status"))


def ruling_chunks(rulings: DataFrame) -> DataFrame:
    """Court rulings: heading, summary, reasoning and verdict, with rank and weight among all of them."""
    rows = ruling_weights(rulings)
    head = _dated(F.col("tribunal_codigo"), F.coalesce("numero_resolucion", F.lit("")), F.format_string("(%s)", F.col("fecha").cast("string")))
    parts = [head, F.nullif("resumen", F.lit("")), _labelled("Ratio: ", F.col("ratio_decidendi")), F.concat(F.lit("Fallo: "), F.col("fallo_texto"))]
    return _chunk(rows, "sentencia", F.col("ecli"), parts, ecli=F.col("ecli"), organo=F.col("organo"), fecha=F.col("fecha"), tier=court_tier(F.col("organo")), doctrine_weight=F.col("weight"))


def tax_office_chunks(rulings: DataFrame) -> DataFrame:
    """Binding rulings: the question, and the criterion or else the start of the answer."""
    head = _dated(F.lit("DGT"), F.col("numero"), F.format_string("(%s)", F.col("fecha_salida").cast("string")), F.lit("—"), F.col("asunto"))
    question = F.concat(F.lit("Cuestión: "), F.left("cuestion_planteada", F.lit(HEAD_CHARS)))
    answer = F.coalesce(_labelled("Criterio: ", F.col("criterio")), F.concat(F.lit("Contestación: "), F.left("contestacion_completa", F.lit(HEAD_CHARS))))
    return _chunk(rulings, "consulta_dgt", F.col("numero"), [head, question, answer], numero=F.col("numero"), impuesto=F.col("impuesto"), fecha=F.col("fecha_salida"), tier=F.lit(BINDING_RULING_TIER), doctrine_weight=F.lit("isolated"))


def tribunal_chunks(resolutions: DataFrame) -> DataFrame:
    """Economic-administrative resolutions: heading and criterion."""
    rows = tribunal_weights(resolutions)
    head = _dated(F.upper("organo"), F.col("numero"), F.format_string("(%s, %s)", F.col("fecha").cast("string"), F.col("tipo")), F.lit("—"), F.col("asunto"))
    return _chunk(rows, "resolucion_teac", F.col("numero"), [head, _labelled("Criterio: ", F.col("criterio"))], numero=F.col("numero"), organo=F.col("organo"), impuesto=F.col("impuesto"), fecha=F.col("fecha"), tier=tribunal_tier(F.col("organo"), F.col("tipo")), doctrine_weight=F.col("weight"))


def manual_chunks(chunks: DataFrame) -> DataFrame:
    return _chunk(chunks, "manual", F.col("chunk_id"), [F.col("titulo"), F.col("contenido")], **{c: F.col(c) for c in ("fuente", "ejercicio", "capitulo", "seccion", "subseccion") if c in chunks.columns})


def corpus_chunks(*families: DataFrame) -> DataFrame:
    """All families together; a column that a family lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)


def index_chunks(existing: DataFrame, incoming: DataFrame, dim: int) -> DataFrame:
    """The vector table after an upsert by chunk_id; a vector of another length is an error."""
    checked = incoming.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("wrong dimension: "), F.col("chunk_id"))).cast("array<double>")))
    fresh = first_wins(checked, ["chunk_id"], ["text"])
    return existing.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh)


def delete_chunks(existing: DataFrame, idents: DataFrame) -> DataFrame:
    return existing.join(idents.select("chunk_id").distinct(), "chunk_id", "left_anti")


# Fixed value: the name space of URLs for name-based UUIDs (RFC 9562).
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def point_id(ident: Column) -> Column:
    """The name-based UUID (version 5) of a chunk's id: the id that vector stores take."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), F.encode(ident, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def count_by_source(chunks: DataFrame, families: list[str]) -> DataFrame:
    """(source_type, n), zero for a family without chunks."""
    return breakdown(chunks, "source_type", families)
