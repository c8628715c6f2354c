"""Consolidated law: blocks, versions and timelines out of XML texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foralia.functions.text import collapse, decode_entities, once
from foralia.runtime import spread

# The class of the editor's notes, and the short names by which they cite a norm.
FOOTNOTE = r"nota_pie(?:_\d+)?"
SHORT_CITATION = r"(?iu)\b(?:Ley|Real\s+Decreto-?[Ll]ey|Real\s+Decreto|RDL|RDLeg|RD)\s+\d+\s*/\s*\d{4}\b"


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf'\b{name}="([^"]*)"', 1), F.lit(""))


def blocks(texts: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """(keys, pos, block_id, kind, title, body) of every <bloque>."""
    found = spread(texts, 4).select(*keys, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?s)<bloque\b[^>]*>.*?</bloque>"), F.lit(0))).alias("pos", "b"))
    head = F.regexp_extract("b", r"^<bloque\b[^>]*>", 0)
    return found.select(*keys, "pos", _attribute(head, "id").alias("block_id"), _attribute(head, "tipo").alias("kind"), _attribute(head, "titulo").alias("title"), F.regexp_extract("b", r"(?s)^<bloque\b[^>]*>(.*)</bloque>$", 1).alias("body"))


def version_text(version: Column) -> Column:
    """Its paragraphs but footnotes, without tags, white space collapsed, one a line."""
    ps = F.filter(F.regexp_extract_all(version, F.lit(r"(?s)<p\b[^>]*>.*?</p>"), F.lit(0)), lambda p: ~p.rlike(rf'^<p\b[^>]*class="{FOOTNOTE}"'))
    plain = F.transform(ps, lambda p: collapse(F.regexp_replace(p, "<[^>]+>", "")))
    return decode_entities(F.array_join(F.filter(plain, lambda p: p != ""), "\n"))


def version_at(body: Column, day: Column) -> Column:
    """A block's <version> in force on `day`, the one with the latest start if several are; null if none is."""
    tag = lambda v: F.regexp_extract(v, r"^<version\b[^>]*>", 0)
    target = F.date_format(day, "yyyyMMdd")
    dated = F.transform(F.regexp_extract_all(body, F.lit(r"(?s)<version\b[^>]*>.*?</version>"), F.lit(0)), lambda v: F.struct(_attribute(tag(v), "fecha_vigencia").alias("start"), _attribute(tag(v), "fecha_vigencia_fin").alias("end"), v.alias("v")))
    live = F.filter(dated, lambda x: (x["start"] <= target) & (x["end"].isNull() | (x["end"] >= target)))
    return F.aggregate(live, F.lit(None).cast("struct<start:string,end:string,v:string>"), lambda best, x: F.when(best["start"].isNull() | (x["start"] > best["start"]), x).otherwise(best), lambda best: best["v"])


def modified_by(version: Column) -> Column:
    """The norm that made a version: the first id in its footnotes, else `law:` and the first short citation there, else null."""
    first = lambda notes, pattern: F.try_element_at(F.filter(F.transform(notes, lambda n: F.regexp_extract(n, pattern, 0)), lambda x: x != ""), F.lit(1))
    notes = F.regexp_extract_all(version, F.lit(rf'(?s)<p\s+class="{FOOTNOTE}"[^>]*>(.*?)</p>'), F.lit(1))
    return once(notes, lambda n: F.coalesce(first(n, r"\bBOE-A-\d{4}-\d{1,7}\b"), F.concat(F.lit("law:"), F.trim(first(n, SHORT_CITATION)))))


def article_versions(texts: DataFrame, keys: list[str], xml: str = "xml") -> DataFrame:
    """The full timeline: (keys, article_id, effective_from, effective_to, text, text_hash, modified_by).

    Versions without a start or text are left out; a missing end is the day before the next version's start.
    """
    day = lambda tag, name: F.try_to_timestamp(_attribute(tag, name), F.lit("yyyyMMdd")).cast("date")
    every = blocks(texts, keys, xml).where("kind = 'precepto'").select(*keys, "block_id", F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<version\b[^>]*>.*?</version>"), F.lit(0))).alias("v"))
    head = F.regexp_extract("v", r"^<version\b[^>]*>", 0)
    own = F.struct(day(head, "fecha_vigencia").alias("effective_from"), day(head, "fecha_vigencia_fin").alias("stated_end"), version_text(F.col("v")).alias("text"), modified_by(F.col("v")).alias("modified_by"))
    # Exploded, or the filter on what was read is pushed below the reading and repeats it.
    own = every.select(*keys, F.col("block_id").alias("article_id"), F.explode(F.array(own)).alias("r")).select(*keys, "article_id", "r.*").where("effective_from is not null and text <> ''")
    following = F.lead("effective_from").over(Window.partitionBy(*keys, "article_id").orderBy("effective_from"))
    return own.withColumn("effective_to", F.coalesce("stated_end", F.date_sub(following, 1))).drop("stated_end").withColumn("text_hash", F.sha2("text", 256))


def block_hashes(versions: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """(keys, block_id, hash) of the version in force on `day` with the latest start; blocks not in force are absent."""
    live = versions.where((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") >= day)))
    return live.groupBy(*keys, F.col("article_id").alias("block_id")).agg(F.max_by("text_hash", "effective_from").alias("hash"))


def hash_block_at(texts: DataFrame, keys: list[str], day: Column, xml: str = "xml") -> DataFrame:
    """(keys, block_id, hash, active) of every article; one without a version in force on `day` is not active and has the hash of ''."""
    every = blocks(texts, keys, xml).where("kind = 'precepto'").withColumn("_v", version_at(F.col("body"), day))
    return every.select(*keys, "block_id", F.sha2(F.coalesce(version_text(F.col("_v")), F.lit("")), 256).alias("hash"), F.col("_v").isNotNull().alias("active"))
