"""Manuals as trees: chapters and numbered headings found page by page, their bodies, leaves and the pages they lie on.

A manual's text is its pages joined by two line breaks. Pages stay rows: each knows where it starts in that text (a running
sum of lengths) and finds the headings whose number lies on it, reading on to the next page's first line as a heading may
be cut off from its title by the page's end. Only headings, lengths and the pieces of one body ever meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foralia.functions.text import paragraphs
from foralia.operators.asof_merge import page_at
from foralia.operators.chunking import greedy_pack

GAP = "\n\n"
# The two forms of headings. Groups: what stands before the number, the number, what follows it, the title.
CHAPTER = r"(?iUmd)(^\s*Cap[íi]tulo\s+)(\d{1,3}|[IVXLCDM]+)([.\s—:-]+)(.+?)\s*$"
NUMBERED = r"(?Umd)(^\s*)(\d{1,3}(?:\.\d{1,3}){1,4})(\.?\s*[-—]?\s*)([A-ZÁÉÍÓÚÜÑ][^\n]{2,150})\s*$"
RANK = {"capitulo": 1, "seccion": 2, "subseccion": 3}
HEADING = "array<struct<at:int,rank:int,numbering:string,title:string,stop:int>>"


def page_index(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page_number, page_start, following): where each page starts in its manual's text, and the next page's first line."""
    line = F.regexp_extract("text", r"^(\s*[^\n]*)", 1)
    light = pages.select(*keys, "page_number", (F.char_length(F.coalesce("text", F.lit(""))) + len(GAP)).cast("long").alias("n"), line.alias("line"))
    order = Window.partitionBy(keys).orderBy("page_number")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return light.withColumn("page_start", before).withColumn("following", F.concat(F.lit(GAP), F.lead("line").over(order))).drop("n", "line")


def _headings(text: Column, pattern: str, chapter: bool) -> Column:
    """Matches of one form in order: where the number starts, rank, number and title."""
    groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, 1, 2, 4)]
    between = F.split(text, pattern, -1)
    match = F.arrays_zip(*(g.alias(name) for g, name in zip((between, *groups), ("gap", "all", "lead", "num", "title"), strict=True)))
    empty = F.expr(f"cast(array() as {HEADING})")
    dots = lambda num: F.char_length(num) - F.char_length(F.replace(num, F.lit("."), F.lit("")))

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + F.char_length(m["gap"])
        rank = F.lit(1) if chapter else F.when(dots(m["num"]) == 1, 2).otherwise(3)
        title = F.btrim(m["title"], F.lit(" \t\r\n\f\u000b ")).alias("title")
        stop = (at + F.char_length(m["all"])).cast("int")
        found = F.struct((at + F.char_length(m["lead"])).cast("int").alias("at"), rank.cast("int").alias("rank"), m["num"].alias("numbering"), title, stop.alias("stop"))
        return F.when(m["all"].isNull(), acc).otherwise(F.struct(stop.alias("at"), F.array_append(acc["found"], found).cast(HEADING).alias("found")))

    return F.aggregate(match, F.struct(F.lit(0).cast("int").alias("at"), empty.alias("found")), step, lambda acc: acc["found"])


def elements(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, kind, numbering, title, page_start, body_start, body): each heading of each manual with the text up to the next.

    `start` is the offset of its number in the manual's text; as ever the body begins a title's length after that and ends at
    the next number. Text before the first heading belongs to none. A manual without headings is one element of kind root with
    its whole text. Null texts are empty pages; manuals of empty pages only have an empty root. pages: keys, page_number, text.
    """
    known = pages.select(*keys, "page_number", F.coalesce("text", F.lit("")).alias("text"))
    placed = known.join(page_index(known, keys), [*keys, "page_number"])
    seen = F.concat("text", F.coalesce("following", F.lit("")))
    every = F.concat(_headings(seen, CHAPTER, True), _headings(seen, NUMBERED, False))
    placed = placed.select(*keys, "page_number", "text", "page_start", F.sort_array(F.filter(every, lambda h: h["at"] < F.char_length("text"))).alias("own"))
    # A title that is this page's first line for the page before is no heading of the same form here.
    over = lambda chapter: F.array_max(F.transform(F.filter("own", lambda h: (h["rank"] == 1) == chapter), lambda h: h["stop"])) - F.char_length("text") - len(GAP)
    order = Window.partitionBy(keys).orderBy("page_number")
    placed = placed.withColumns({"_over_c": F.lag(over(True)).over(order), "_over_n": F.lag(over(False)).over(order)})
    free = F.filter("own", lambda h: h["at"] >= F.coalesce(F.when(h["rank"] == 1, F.col("_over_c")).otherwise(F.col("_over_n")), F.lit(0)))
    placed = placed.withColumn("own", free).drop("_over_c", "_over_n")
    last = F.try_element_at("own", F.lit(-1))
    earlier = Window.partitionBy(keys).orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.when(F.size("own") > 0, F.struct((F.col("page_start") + last["at"]).alias("start"), last["rank"].alias("rank"), (F.col("page_start") + last["at"] + F.char_length(last["title"])).alias("body_at")))
    placed = placed.withColumn("_c", F.last(carried, ignorenulls=True).over(earlier))
    cut = lambda begin, stop: F.substring(F.col("text"), begin + 1, F.greatest(stop - begin, F.lit(0)))
    size = F.char_length("text")
    opening = F.struct(
        F.col("_c.start").alias("start"), F.col("_c.rank").alias("rank"), F.lit(None).cast("string").alias("numbering"), F.lit(None).cast("string").alias("title"),
        cut(F.greatest(F.lit(0), F.col("_c.body_at") - F.col("page_start")).cast("int"), F.coalesce(F.get("own", F.lit(0))["at"], size)).alias("piece"),
    )
    bare = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("numbering"), F.lit(None).cast("string").alias("title"), F.col("text").alias("piece"))
    pieces = F.transform("own", lambda h, i: F.struct(
        (F.col("page_start") + h["at"]).alias("start"), h["rank"].alias("rank"), h["numbering"].alias("numbering"), h["title"].alias("title"),
        cut(h["at"] + F.char_length(h["title"]), F.coalesce(F.get("own", i + 1)["at"], size)).alias("piece"),
    ))
    first = F.when(F.col("_c").isNotNull(), F.array(opening)).otherwise(F.array(bare))
    rows = placed.select(*keys, "page_number", F.inline(F.concat(first, pieces)))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", "piece"))), lambda p: p["piece"]), GAP)
    whole = rows.groupBy(*keys, "start", "rank").agg(F.max("numbering").alias("numbering"), F.max("title").alias("title"), F.min("page_number").alias("page_start"), joined.alias("body"))
    whole = whole.withColumn("_n", F.count("*").over(Window.partitionBy(keys)))
    kind = F.when(F.col("rank") == 0, "root").when(F.col("rank") == 1, "capitulo").when(F.col("rank") == 2, "seccion").otherwise("subseccion")
    kept = whole.where("rank > 0 or _n = 1").withColumn("kind", kind)
    title = F.when(F.col("kind") == "root", F.lit("(sin estructura jerárquica detectada)")).otherwise(F.col("title"))
    opening = F.char_length(F.regexp_extract("body", r"(?U)\A\s*", 0))
    begin = F.when(F.col("kind") == "root", F.lit(0).cast("long")).otherwise(F.col("start") + F.char_length("title"))
    return kept.select(
        *keys, "start", "kind", F.coalesce("numbering", F.lit("")).alias("numbering"), title.alias("title"), "page_start", (begin + opening).alias("body_start"),
        F.regexp_replace("body", r"(?U)\A\s+|\s+\z", "").alias("body"),
    )


def leaves(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, leaf, start, kind, numbering, title, page_start, body_start, body, capitulo, seccion, subseccion): what a tree's chunks are made of.

    A leaf is an element without children, or the own text of one that has some; `leaf` numbers them from 0. The last three
    are the (numbering, title) of its ancestors: the last element of that kind, unless one above that kind came after it.
    """
    rank = F.when(F.col("kind") == "root", 0).when(F.col("kind") == "capitulo", 1).when(F.col("kind") == "seccion", 2).otherwise(3)
    order = Window.partitionBy(keys).orderBy("start", "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = found.withColumn("_rank", rank).withColumn("_parent", F.coalesce(F.lead("_rank").over(order) > F.col("_rank"), F.lit(False)) & (F.col("_rank") > 0))
    at = F.struct("start", "_rank")
    for kind, r in RANK.items():
        last = F.max(F.when(F.col("kind") == kind, F.struct(at.alias("at"), F.struct("numbering", "title").alias("e")))).over(before)
        above = F.max(F.when((F.col("_rank") < r) & (F.col("_rank") > 0), at)).over(before)
        here = (F.col("_rank") > r) & (above.isNull() | (last["at"] > above))
        out = out.withColumn(kind, F.when(here, last["e"]))
    kept = out.where("(not _parent and (kind <> 'root' or body <> '')) or (_parent and body <> '')")
    title = F.when(F.col("_parent"), F.concat("title", F.lit(" (preámbulo)"))).otherwise(F.col("title"))
    return kept.withColumn("title", title).withColumn("leaf", F.row_number().over(order) - 1).drop("_rank", "_parent")


def parts(leaf_rows: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves cut into chunks by paragraphs: adds part, content, content_hash, and `page_number`, the page on which the part begins.

    index: page_index of the same manuals. A part is looked up where its first paragraph stands in the body, after the part before it.
    """
    packed = greedy_pack(paragraphs(F.col("body")))
    empty = F.struct(F.lit(1).alias("from"), F.expr("cast(array() as array<struct<at:int,content:string>>)").alias("found"))

    def step(acc: Column, content: Column) -> Column:
        at = F.greatest(F.position(F.substring_index(content, GAP, 1), F.col("body"), acc["from"]), F.lit(1))
        return F.struct((at + F.char_length(content)).alias("from"), F.array_append(acc["found"], F.struct((at - 1).alias("at"), content.alias("content"))).alias("found"))

    cut = leaf_rows.select("*", F.posexplode(F.aggregate(packed, empty, step, lambda acc: acc["found"])).alias("_i", "_c"))
    placed = cut.select(*leaf_rows.columns, (F.col("_i") + 1).alias("part"), F.col("_c.content").alias("content"), F.sha2("_c.content", 256).alias("content_hash"), (F.col("body_start") + F.col("_c.at")).alias("_at"))
    return page_at(placed, index.select(*keys, "page_start", "page_number"), keys, "_at").drop("_at")
