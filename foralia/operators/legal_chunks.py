"""Chunks of consolidated law: one per clause of each article in force, with the headings above it.

A norm's XML is read once, whatever the number of its versions: headings and articles come out of its blocks, and
versions of the norm meet them by an equi-join on its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.functions.text import collapse, fold_accents
from foralia.operators.chunking import LEVELS, clauses, hierarchy_context
from foralia.operators.legal_xml import blocks, version_at, version_text

#: Characters of a heading that are kept.
TITLE_CHARS = 200
# What block ids begin with before their number, and the words for each level, folded.
ID_LEVELS = {"l": "libro", "t": "titulo", "c": "capitulo", "s": "seccion", "ss": "subseccion"}
# Kinds of provisions by the first letters of their block id.
PROVISIONS = ("da", "dt", "df", "dd")
SUFFIXES = "bis|ter|quater|quinquies|sexies"


def structural_title(body: Column) -> Column:
    """A heading's text: its first version (or all) without tags, white space collapsed, cut to TITLE_CHARS."""
    first = F.nullif(F.regexp_extract(body, r"(?s)<version[^>]*>(.*?)</version>", 1), F.lit(""))
    return F.left(collapse(F.regexp_replace(F.coalesce(first, body), "<[^>]+>", " ")), F.lit(TITLE_CHARS))


def structural_kind(block_id: Column, title: Column) -> Column:
    """The level of a heading by its id (letters before a number), else by the title's first word, else `otro`."""
    letters = F.regexp_extract(F.lower(block_id), r"^(ss|s|c|t|l)\d", 1)
    by_id = F.coalesce(*(F.when(letters == p, F.lit(level)) for p, level in ID_LEVELS.items()))
    word = F.regexp_extract(fold_accents(title), rf"^({'|'.join(LEVELS)})", 1)
    return F.coalesce(by_id, F.nullif(word, F.lit("")), F.lit("otro"))


def article_label(block_id: Column) -> Column:
    """`a81bis` as `art. 81 bis`, `dadecimoctava` as `DA decimoctava`; any other id as it is."""
    low = F.lower(block_id)
    part = lambda k: F.nullif(F.regexp_extract(low, rf"^a(\d+)({SUFFIXES})?$", k), F.lit(""))
    provision = F.rtrim(F.concat(F.upper(F.left(low, F.lit(2))), F.lit(" "), F.substring(low, 3, 1 << 20)))
    return F.when(part(1).isNotNull(), F.concat_ws(" ", F.lit("art."), part(1), part(2))).when(F.left(low, F.lit(2)).isin(*PROVISIONS), provision).otherwise(block_id)


def chunk_id(boe_id: Column, block_id: Column, clause: Column, effective_from: Column) -> Column:
    """norma::<norm>::<block>[::ap<clause>]::v<date>; a clause goes without brackets and with _ for dots."""
    safe = F.translate(clause, ".)", "_")
    return F.concat_ws("::", F.lit("norma"), boe_id, block_id, F.when(clause.isNotNull(), F.concat(F.lit("ap"), safe)), F.concat(F.lit("v"), effective_from.cast("string")))


def precepts(texts: DataFrame, key: str = "boe_id", xml: str = "xml") -> DataFrame:
    """(key, pos, block_id, body, a column per level) of every article, with the headings in force where it stands."""
    found = blocks(texts, [key], xml)
    heading = F.col("kind") != "precepto"
    title = structural_title(F.col("body"))
    named = found.select(key, "pos", "block_id", "body", F.when(heading, structural_kind(F.col("block_id"), title)).alias("kind"), F.when(heading, title).alias("title"))
    return hierarchy_context(named, key).where("kind is null").drop("kind", "title")


def legal_chunks(normas: DataFrame, versions: DataFrame, texts: DataFrame, day: Column | None = None) -> DataFrame:
    """Chunks of every version in force (`vigente`) of state norms (BOE-A-) that have a consolidated text.

    The article's wording is the one in force on `day`, by default the day on which the norm's version begins; articles
    without one or with an empty one give no chunk. normas: boe_id, kind; versions: norma_boe_id, effective_from,
    effective_to, status; texts: boe_id, xml, one row a norm.
    """
    live = versions.where("status = 'vigente'").select(F.col("norma_boe_id").alias("boe_id"), "effective_from", "effective_to")
    state = normas.where(F.col("boe_id").startswith("BOE-A-")).select("boe_id", F.col("kind").alias("norm_kind"))
    rows = precepts(texts).join(state, "boe_id").join(live, "boe_id")
    rows = rows.withColumn("version", version_at(F.col("body"), F.col("effective_from") if day is None else day)).drop("body").where("version is not null")
    rows = rows.withColumn("article", version_text(F.col("version"))).drop("version").where("article <> ''")
    rows = rows.withColumn("articulo", article_label(F.col("block_id"))).withColumn("jerarquia", F.array_compact(F.array(*LEVELS)))
    cut = rows.select("*", F.inline(F.filter(clauses(F.col("article")), lambda c: F.trim(c["text"]) != "")))
    label = F.concat_ws(", apartado ", "articulo", "number")
    text = F.concat_ws("\n\n", F.nullif(F.array_join("jerarquia", " > "), F.lit("")), label, "text")
    return cut.select(
        chunk_id(F.col("boe_id"), F.col("block_id"), F.col("number"), F.col("effective_from")).alias("chunk_id"), F.lit("norma").alias("source_type"), text.alias("text"),
        "boe_id", F.col("norm_kind").alias("kind"), "articulo", "block_id", F.col("number").alias("apartado"), "jerarquia", *LEVELS, "effective_from", "effective_to",
    )
