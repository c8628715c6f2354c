"""Manuals: pages to a structure of headings, bodies and packed chunks; FAQ pages to questions and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foralia.functions.text import html_to_text
from foralia.operators.chunking import chunk_texts, hierarchy_context

HEADING = r"(?m)^[ \t]*((?:cap[íi]tulo|secci[óo]n|subsecci[óo]n)\s+[\dIVXLC]+[.:]?[^\n]*)$"


def pages(files: DataFrame, text: str = "value") -> DataFrame:
    """(path, page_number, text) from whole files with form feeds between pages; broken words are joined at line ends."""
    split = files.select("path", F.posexplode(F.split(text, "\f")).alias("page", "t"))
    clean = F.regexp_replace(F.regexp_replace(F.col("t"), r"(?U)(\w)-\n(\w)", "$1$2"), "[ \t]+", " ")
    return split.select("path", (F.col("page") + 1).alias("page_number"), F.btrim(clean, F.lit(" \n")).alias("text"))


def structure(paged: DataFrame) -> DataFrame:
    """(path, pos, page_number, kind, title, body, levels…) per heading; the text before the first one is kind preambulo.

    Pages of one manual are split where they lie; only headings, not pages, meet in the windows that follow.
    """
    marked = F.regexp_replace("text", "(?iu)" + HEADING, "\u0001$1\u0002")
    parts = paged.select("path", "page_number", F.posexplode(F.split(marked, "\u0001")).alias("part", "t"))
    has = F.contains("t", F.lit("\u0002"))
    title = F.when(has, F.trim(F.substring_index("t", "\u0002", 1)))
    body = F.btrim(F.when(has, F.substring_index("t", "\u0002", -1)).otherwise(F.col("t")), F.lit(" \n"))
    kind = F.when(title.isNull(), "texto").when(title.rlike("(?iu)^subsecc"), "subseccion").when(title.rlike("(?iu)^secc"), "seccion").otherwise("capitulo")
    rows = parts.select("path", "page_number", "part", title.alias("title"), body.alias("body"), kind.alias("kind")).where("title is not null or body <> ''")
    order = Window.partitionBy("path").orderBy("page_number", "part")
    rows = rows.withColumn("pos", F.row_number().over(order)).withColumn("section", F.count("title").over(order))
    merged = rows.groupBy("path", "section").agg(F.min("pos").alias("pos"), F.min("page_number").alias("page_number"), F.max("title").alias("title"), F.max(F.when(F.col("title").isNotNull(), F.col("kind"))).alias("kind"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda s: s["body"]), "\n\n").alias("body"))
    merged = merged.withColumn("kind", F.coalesce("kind", F.lit("preambulo"))).withColumn("body", F.btrim("body", F.lit(" \n")))
    return hierarchy_context(merged.drop("section"), doc="path")


def manual_chunks(paged: DataFrame) -> DataFrame:
    """(path, pos, part, content, content_hash, page_number, title, capitulo, seccion, subseccion) of every section's body."""
    parts = structure(paged)
    packed = chunk_texts(parts.where("body <> ''"), ["path", "pos"])
    return packed.join(parts.select("path", "pos", "page_number", "title", "capitulo", "seccion", "subseccion"), ["path", "pos"])


# The field labels of an FAQ block.
FIELDS = {"pregunta": "question", "respuesta": "answer", "normativa": "norms"}


def faqs(html: DataFrame, keys: list[str], column: str = "html") -> DataFrame:
    """(keys, pos, question, answer, norms) of each block that starts with `Pregunta:`."""
    blocks = F.filter(F.split(html_to_text(F.col(column), cells=False), r"(?im)(?=^\s*pregunta\s*:)"), lambda b: b.rlike(r"(?i)^\s*pregunta\s*:"))
    out = html.select(*keys, F.posexplode(blocks).alias("pos", "b"))
    field = lambda name: F.nullif(F.btrim(F.regexp_extract("b", rf"(?is)^\s*{name}\s*:(.*?)(?=^\s*(?:{'|'.join(FIELDS)})\s*:|\z)".replace("(?is)", "(?ism)"), 1), F.lit(" \n\t")), F.lit(""))
    norms = F.filter(F.transform(F.split(F.coalesce(field("normativa"), F.lit("")), "[;\n·]"), lambda x: F.trim(x)), lambda x: x != "")
    return out.select(*keys, "pos", field("pregunta").alias("question"), field("respuesta").alias("answer"), norms.alias("norms"))


def references(text: Column) -> Column:
    """References to laws in a text, white space collapsed, each once."""
    pattern = r"(?iu)\b(?:Ley|Ley\s+Orgánica|Real\s+Decreto(?:\s+Legislativo|-ley)?|Orden)\s+\d+/\d{2,4}"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(x, r"\s+", " ")))


def merged_references(declared: Column, body: Column) -> Column:
    """Declared references, then those found in the body; each once, case and white space aside."""
    from foralia.functions.text import collapse, dedupe_by

    every = F.filter(F.concat(F.coalesce(declared, F.expr("cast(array() as array<string>)")), references(F.coalesce(body, F.lit("")))), lambda x: F.trim(x) != "")
    return dedupe_by(F.transform(every, lambda x: F.trim(x)), lambda x: F.lower(collapse(x)))
