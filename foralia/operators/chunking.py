"""Chunks of manuals and consolidated law."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foralia.functions.text import paragraphs

TARGET_WORDS, MAX_WORDS = 400, 800
#: From the outermost: entering a level clears those below it.
LEVELS = ("libro", "titulo", "capitulo", "seccion", "subseccion")


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def greedy_pack(parts: Column, target: int = TARGET_WORDS, most: int = MAX_WORDS) -> Column:
    """Paragraphs joined until `target` words; one that would go over `most` starts anew; a larger one stands alone."""
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.expr("cast(array() as array<string>)").alias("open"), F.lit(0).alias("n"))
    state = lambda done, pending, n: F.struct(done.alias("done"), pending.alias("open"), n.cast("int").alias("n"))
    joined = lambda xs: F.array_join(xs, "\n\n")
    none = F.expr("cast(array() as array<string>)")

    def step(acc: Column, p: Column) -> Column:
        n = count_words(p)
        busy = F.size(acc["open"]) > 0
        grown = F.array_append(acc["open"], p)
        return (
            F.when(~busy & (n > most), state(F.array_append(acc["done"], p), acc["open"], acc["n"]))
            .when(busy & (acc["n"] + n > most), state(F.array_append(acc["done"], joined(acc["open"])), F.array(p), n))
            .when(acc["n"] + n >= target, state(F.array_append(acc["done"], joined(grown)), none, F.lit(0)))
            .otherwise(state(acc["done"], grown, acc["n"] + n))
        )

    return F.aggregate(parts, empty, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.array_append(acc["done"], joined(acc["open"]))).otherwise(acc["done"]))


def chunk_texts(leaves: DataFrame, keys: list[str], text: str = "body") -> DataFrame:
    """(keys, part, content, content_hash) of each leaf's packed paragraphs."""
    packed = leaves.select(*keys, F.posexplode(greedy_pack(paragraphs(F.col(text)))).alias("part", "content"))
    return packed.select(*keys, (F.col("part") + 1).alias("part"), "content", F.sha2("content", 256).alias("content_hash"))


def hierarchy_context(blocks: DataFrame, doc: str = "doc_id", pos: str = "pos", kind: str = "kind", title: str = "title") -> DataFrame:
    """`blocks` with the title of each level in force: the last one entered since any level above it was entered."""
    order = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = blocks
    for k, level in enumerate(LEVELS):
        above = F.max(F.when(F.col(kind).isin(*LEVELS[:k]), F.col(pos))).over(order) if k else F.lit(None)
        last = F.max(F.when(F.col(kind) == level, F.struct(F.col(pos).alias("p"), F.col(title).alias("t")))).over(order)
        value = last["t"] if k == 0 else F.when(above.isNull() | (last["p"] > above), last["t"])
        out = out.withColumn(level, value)
    return out


def clauses(article: Column) -> Column:
    """array<struct<number, text>> of an article: by `1.`, `2.` at a line's start, then by `a)`, `b)`; an opening goes first.

    Markers that follow a sentence or colon on the same line count as line starts.
    """
    broken = F.regexp_replace(article, r"(?<=[:;.])[ \t]+(?=(?:[a-zñ]\)|\d{1,2}\.)\s)", "\n\n")
    parts = F.filter(F.transform(F.split(broken, r"(?m)(?=^\s*\d{1,2}\.\s)"), lambda p: F.btrim(p, F.lit(" \n\t"))), lambda p: p != "")

    def letters(p: Column) -> Column:
        number = F.nullif(F.regexp_extract(p, r"^(\d{1,2})\.\s", 1), F.lit(""))
        pieces = F.filter(F.transform(F.split(p, r"(?m)(?=^\s*[a-zñ]\)\s)"), lambda x: F.btrim(x, F.lit(" \n\t"))), lambda x: x != "")
        letter = lambda x: F.nullif(F.regexp_extract(x, r"^([a-zñ]\))\s", 1), F.lit(""))
        label = lambda x: F.nullif(F.concat_ws(".", number, letter(x)), F.lit(""))
        return F.transform(pieces, lambda x: F.struct(label(x).alias("number"), x.alias("text")))

    return F.flatten(F.transform(parts, letters))
