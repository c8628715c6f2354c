"""What an answer is built from: sources with a heading, lines of metadata, a body and a hint how to cite them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.operators.retrieval import hybrid, passes

#: Families of chunks and the columns their metadata may have; a table without one is read as if it were null.
FAMILIES = ("norma", "sentencia", "consulta_dgt", "resolucion_teac", "manual")
TEXTS = ("boe_id", "ecli", "numero", "articulo", "apartado", "organo", "tribunal_codigo", "tipo_resolucion", "sentido", "fallo_sentido", "fuente", "ejercicio", "page_inicio", "impuesto", "fecha", "effective_from", "effective_to")
MIN_TOP, MAX_TOP, TOP = 1, 25, 6


def with_metadata(chunks: DataFrame) -> DataFrame:
    """`chunks` with every column of metadata, as text, null where the table lacks it."""
    have = set(chunks.columns)
    lists = F.lit(None).cast("array<string>") if "jerarquia" not in have else F.col("jerarquia")
    rest = [c for c in chunks.columns if c not in TEXTS and c != "jerarquia"]
    return chunks.select(*rest, *((F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in TEXTS), lists.alias("jerarquia"))


def _by_family(**forms: Column) -> Column:
    return F.coalesce(*(F.when(F.col("source_type") == family, form) for family, form in forms.items()))


def _or(c: str, other: str = "?") -> Column:
    return F.coalesce(c, F.lit(other))


def _say(pattern: str, *parts: Column) -> Column:
    """A format_string that is null where a part is null."""
    known = F.lit(True)
    for p in parts:
        known = known & p.isNotNull()
    return F.when(known, F.format_string(pattern, *parts))


def source_header() -> Column:
    """One line that names the family and the source."""
    col = F.col
    organ, pin = F.upper(_or("organo", "")), F.coalesce(_say(", %s.%s", col("articulo"), col("apartado")), _say(", %s", col("articulo")), F.lit(""))
    return F.coalesce(_by_family(
        norma=F.concat(F.lit("Norma — "), _or("boe_id"), pin),
        sentencia=_say("Sentencia %s — %s (%s)", _or("tribunal_codigo"), _or("ecli"), _or("fecha")),
        consulta_dgt=_say("Consulta DGT %s (%s, %s)", _or("numero"), _or("fecha"), F.upper(_or("impuesto", ""))),
        resolucion_teac=F.coalesce(_say("%s — %s (%s, %s)", organ, _or("numero"), _or("fecha"), F.nullif("tipo_resolucion", F.lit(""))), _say("%s — %s (%s)", organ, _or("numero"), _or("fecha"))),
        manual=F.concat_ws(" ", F.concat(F.lit("Manual AEAT — "), _or("fuente", "manual")), col("ejercicio")),
    ), F.concat(F.lit("Fuente "), col("source_type")))


def metadata_lines() -> Column:
    """Lines for what is known: identifiers, pinpoint, validity, organ, kind, outcome, manual, headings, tax."""
    col = F.col
    clause = F.nullif("apartado", F.lit(""))
    pinpoint = F.coalesce(_say("Pinpoint: %s, apartado %s", col("articulo"), clause), _say("Pinpoint: %s", col("articulo")), _say("Pinpoint: apartado %s", clause))
    valid = F.coalesce(_say("Vigencia: desde %s hasta %s", col("effective_from"), col("effective_to")), _say("Vigencia: desde %s", col("effective_from")), _say("Vigencia: hasta %s", col("effective_to")))
    organ = F.coalesce(_say("Órgano: %s (%s)", F.upper("organo"), F.nullif("tribunal_codigo", F.lit(""))), _say("Órgano: %s", F.upper("organo")))
    headings = F.when(F.size("jerarquia") > 0, F.concat(F.lit("Jerarquía: "), F.array_join("jerarquia", " > ")))
    return F.array_compact(F.array(
        _say("BOE-ID: %s", col("boe_id")), _say("ECLI: %s", col("ecli")), _say("Número: %s", col("numero")), pinpoint, valid, organ, _say("Tipo: %s", col("tipo_resolucion")), _say("Sentido: %s", col("sentido")),
        _say("Fallo: %s", col("fallo_sentido")), F.when(col("boe_id").isNull(), _say("Fuente AEAT: %s", col("fuente"))), _say("Ejercicio: %s", col("ejercicio")), _say("Página: %s", col("page_inicio")),
        headings, _say("Impuesto: %s", F.upper("impuesto")),
    ))


def citation_hint() -> Column:
    """How an answer should cite the source, in its family's form; empty where nothing names it."""
    col = F.col
    pin = F.coalesce(F.concat_ws(".", F.nullif("articulo", F.lit("")), F.when(F.nullif("articulo", F.lit("")).isNotNull(), F.nullif("apartado", F.lit("")))), F.lit(""))
    pin = F.when(col("articulo").endswith("."), F.concat("articulo", _or("apartado", ""))).otherwise(pin)
    return F.coalesce(_by_family(
        norma=F.coalesce(_say("%s (%s)", F.nullif(pin, F.lit("")), col("boe_id")), col("boe_id"), pin),
        sentencia=F.coalesce(_say("%s %s", col("tribunal_codigo"), col("ecli")), col("ecli"), col("tribunal_codigo")),
        consulta_dgt=F.coalesce(_say("Consulta DGT %s (%s)", col("numero"), col("fecha")), _say("Consulta DGT %s", col("numero")), F.lit("Consulta DGT")),
        resolucion_teac=F.coalesce(_say("%s %s", F.upper("organo"), col("numero")), col("numero"), col("organo")),
        manual=F.coalesce(_say("Manual AEAT %s %s", col("fuente"), col("ejercicio")), _say("Manual AEAT %s", col("fuente")), F.lit("Manual AEAT")),
    ), F.lit(""))


def sources(ranked: DataFrame, max_sources: int = 12) -> DataFrame:
    """(query_id, place, chunk_id, source_type, header, metadata, body, rendered, hint) of the best `max_sources` of each query.

    ranked: query_id, rank, chunk_id, source_type, text and any metadata; null texts are empty bodies.
    """
    rows = with_metadata(ranked.where(F.col("rank") <= max_sources))
    rows = rows.select("query_id", F.col("rank").alias("place"), "chunk_id", "source_type", source_header().alias("header"), metadata_lines().alias("metadata"), F.coalesce("text", F.lit("")).alias("body"), citation_hint().alias("hint"), *(["score"] if "score" in ranked.columns else []))
    head = F.concat(F.lit("[FUENTE "), F.col("place").cast("string"), F.lit("] "), F.col("header"))
    return rows.withColumn("rendered", F.concat_ws("\n", head, F.nullif(F.array_join("metadata", "\n"), F.lit("")), "body"))


def check_arguments(top: int = TOP, families: list[str] | None = None, tax: str | None = None) -> None:
    if isinstance(top, bool) or not isinstance(top, int) or not MIN_TOP <= top <= MAX_TOP:
        raise ValueError(f"top must be an integer from {MIN_TOP} to {MAX_TOP}")
    if families is not None and (not families or any(f not in FAMILIES for f in families)):
        raise ValueError(f"families must be some of {FAMILIES}")
    if tax is not None and not tax.strip():
        raise ValueError("tax must be a name or absent")


def retrieve(chunks: DataFrame, queries: DataFrame, top: int = TOP, families: list[str] | None = None, tax: str | None = None, day: Column | None = None) -> DataFrame:
    """The sources of each query by hybrid search over the chunks that pass the filters; blank queries give none.

    chunks: chunk_id, source_type, text, embedding, impuesto, effective_from, effective_to and other metadata; queries:
    query_id, text, embedding. Wrong arguments are errors.
    """
    check_arguments(top, families, tax)
    asked = queries.where(F.trim("text") != "").withColumn("text", F.trim("text"))
    where = passes(families, tax.strip().lower() if tax else None, day) if families or tax or day is not None else None
    found = hybrid(chunks, asked, top, 0.0, where=where)
    return sources(found.join(chunks.drop("embedding"), "chunk_id"), top)
