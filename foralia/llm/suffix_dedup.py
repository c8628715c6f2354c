"""Removal of repeated byte strings by distributed prefix doubling.

Round 32. Ranks start as hashes of 32-byte prefixes, doubled up inside each text from single bytes. Of the 69 prefixes
inside a 100-byte string, the smallest rank is its home, so equal strings have equal homes and a run of strings that
share a home travels as one row. Spark sorts (rank of the home, rank of the run) pairs: homes that occur once are unique
and drop out; a run whose bytes have all occurred before is settled at once; the first runs of homes with several runs
are opened into positions. 100 bytes around a home reach 34 bytes or more beyond it on one side, so they also hold the
home's pair with the rank 32 bytes before it or 32 bytes after it: only positions go on whose pair recurs.

Round 64. Spark sorts the positions' rank pairs at offset 32; equal pairs get one new rank, the place of the first of
them in that order, and unique positions drop out.

Round 100. The new rank of a position and that of the position 36 bytes on cover 100 bytes. Spark sorts these pairs; 100
is past the threshold, so what still shares a pair is a repeat, and all but the first of it go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foralia.runtime import drop_scratch, materialize, table

LENGTH = 100
PREFIX = 32
#: Bytes of text that are ranked together; a longer text is cut into blocks that overlap by LENGTH - 1.
BLOCK = 1 << 18
PLACE_BITS = 24
#: A string that starts so far before its home holds the PREFIX bytes before it; one that starts later, those after it.
BEFORE = (LENGTH - PREFIX) // 2
#: Two prefixes of twice PREFIX bytes that start so far apart cover LENGTH bytes.
OFFSET = LENGTH - 2 * PREFIX
#: One text in HOT_SAMPLE is read ahead for homes that HOT_SHARE of its runs have, or HOT_MOST of them whatever their share, so
#: that no task sorts more than some 6 million rows of a home at any size: their rows are aggregated and joined, where Spark can
#: split them, instead of sorted in one task. Results do not depend on it.
HOT_SAMPLE, HOT_SHARE, HOT_LEAST, HOT_MOST = 64, 0.01, 64, 100_000
NO_ID = (1 << 63) - 1


def _table() -> np.ndarray:
    """256 pseudo-random odd values, from splitmix64."""
    with np.errstate(over="ignore"):
        x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) | np.uint64(1)


OF_BYTE = _table()
BASE = 0x9E3779B97F4A7C15


def prefix_ranks(block: np.ndarray) -> np.ndarray:
    """Rank of the PREFIX bytes at each position, from ranks of half the length at two offsets."""
    ranks, length, factor = OF_BYTE[block], 1, BASE
    with np.errstate(over="ignore"):
        while length < PREFIX:
            ranks = ranks[:-length] * np.uint64(factor) + ranks[length:]
            length *= 2
            factor = factor * factor % (1 << 64)
        ranks = (ranks ^ (ranks >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ranks ^ (ranks >> np.uint64(32))


def homes(ranks: np.ndarray) -> np.ndarray:
    """For each start of LENGTH bytes, the position of the smallest rank within, the leftmost of equal ones."""
    reach = LENGTH - PREFIX + 1
    least = (ranks >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(len(ranks), dtype=np.uint64)
    size = 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[: size - reach], least[reach - size :])
    return (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def _blocks(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of about BLOCK bytes with, per piece: index of its text, place in the block, place in the text."""
    parts, meta, size = [], [], 0
    for k, data in enumerate(texts):
        for at in range(0, max(1, len(data) - LENGTH + 1), BLOCK):
            piece = data[at : at + BLOCK + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            parts.append(piece)
            meta.append((k, size, at))
            size += len(piece)
            if size >= BLOCK:
                yield b"".join(parts), *np.array(meta, np.int64).T
                parts, meta, size = [], [], 0
    if parts:
        yield b"".join(parts), *np.array(meta, np.int64).T


def runs_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (text, start, count, home rank, run rank, sides): strings start .. start + count - 1 of a text share a home.

    sides packs how far the home lies after start, and 28 bits each of the ranks PREFIX bytes before and after the home.
    """
    for block, owner, place, offset in _blocks(texts):
        ranks = prefix_ranks(np.frombuffer(block, np.uint8))
        home = homes(ranks)
        starts = np.arange(len(home))
        piece = np.searchsorted(place, starts, side="right") - 1
        ends = np.append(place[1:], len(block))
        inside = starts + LENGTH <= ends[piece]
        fresh = np.ones(len(home), bool)
        fresh[1:] = (home[1:] != home[:-1]) | (piece[1:] != piece[:-1])
        first = np.nonzero(fresh & inside)[0]
        stop = np.minimum(np.append(np.nonzero(fresh)[0], len(home))[np.searchsorted(np.nonzero(fresh)[0], first, side="right")], ends[piece[first]] - LENGTH + 1)
        count = stop - first
        lead = home[first] - first
        digest = xxhash.xxh3_64_intdigest
        run = np.array([digest(block[a:b], seed) for a, b, seed in zip(first.tolist(), (stop + LENGTH - 1).tolist(), lead.tolist(), strict=True)], np.uint64)
        of = piece[first]
        middle = home[first]
        before, after = (ranks[np.clip(middle + by, 0, len(ranks) - 1)] & np.uint64((1 << 28) - 1) for by in (-PREFIX, PREFIX))
        sides = lead.astype(np.uint64) << np.uint64(56) | before << np.uint64(28) | after
        yield owner[of], first - place[of] + offset[of], count, ranks[middle].view(np.int64), run.view(np.int64), sides.view(np.int64)


ANCHORS = "home long, run long, doc long, place long, sides long"


def anchors(docs: DataFrame) -> DataFrame:
    """(home, run, doc, place, sides) for each run; place packs start, count and a mark of the text so that starts sort first."""

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc"].to_numpy(np.int64)
            texts = [x.encode() for x in batch["text"]]
            marks = batch["mark"].to_numpy(np.int64)
            for owner, start, count, home, run, sides in runs_of(texts):
                yield pd.DataFrame({"home": home, "run": run, "doc": ids[owner], "place": start << 23 | count << 16 | marks[owner], "sides": sides})

    return docs.select("doc", "mark", "text").mapInPandas(ranked, ANCHORS)


def _span(start: Column, count: Column) -> Column:
    """start and byte length (under 256) in one long."""
    return F.shiftleft(start, 8).bitwiseOR(count + (LENGTH - 1))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc and mark tell documents apart: mark is 16 bits of the text's hash, for rows that repeat a doc_id."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFF)).alias("mark"), text.alias("text"))


def hot_homes(docs: DataFrame) -> list[int]:
    """Homes common enough to be worth a way of their own."""
    counts = anchors(docs.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0)).groupBy("home").agg(F.count("*").alias("n"))
    counts = materialize(counts, "homes")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = [r["home"] for r in counts.where(F.col("n") >= min(HOT_MOST, max(HOT_LEAST, HOT_SHARE * total))).select("home").collect()]
    drop_scratch(counts)
    return hot


#: Of a run: what the sorts need to know about it.
RUN = ["home", "doc", "mark", "start", "count", "again", "lead", "both_before", "both_after"]


def _parts(rows: DataFrame) -> DataFrame:
    """Unpacks place and sides."""
    mark, start, count = F.col("place").bitwiseAND(F.lit(0xFFFF)), F.shiftright("place", 23), F.shiftright("place", 16).bitwiseAND(F.lit(127))
    lead, before, after = F.shiftrightunsigned("sides", 56), F.shiftright("sides", 28) % (1 << 28), F.col("sides") % (1 << 28)
    return rows.select("*", mark.alias("mark"), start.alias("start"), count.alias("count"), lead.alias("lead"), before.alias("before"), after.alias("after"))


def _sorted_runs(rows: DataFrame) -> DataFrame:
    """Runs that a sort by home and run leaves in question; both_before and both_after: whether the home's pair on that side recurs."""
    here = F.struct("doc", "place")
    every = Window.partitionBy("home")
    ranked = rows.withColumn("again", here != F.first(here).over(Window.partitionBy("home", "run").orderBy("doc", "place")))
    ranked = _parts(ranked.withColumn("alone", F.min("run").over(every) == F.max("run").over(every)).where("again or not alone"))
    recurs = lambda side: F.sum(F.when(~F.col("again"), 1)).over(Window.partitionBy("home", side)) > 1
    return ranked.withColumn("both_before", recurs("before")).withColumn("both_after", recurs("after")).select(RUN)


def _joined_runs(rows: DataFrame) -> DataFrame:
    """The same for a few homes with very many runs, by partial aggregates and joins."""
    first = rows.groupBy("home", "run").agg(F.min(F.struct("doc", "place", "sides")).alias("first")).select("home", "run", "first.*")
    first = materialize(first, "first-runs")
    several = F.broadcast(first.groupBy("home").agg(F.count("*").alias("runs")).where("runs > 1").select("home"))
    pending = _parts(first.join(several, "home"))
    for side in ("before", "after"):
        twice = pending.groupBy("home", side).agg((F.count("*") > 1).alias(f"both_{side}"))
        pending = pending.join(twice, ["home", side])
    known = first.select("home", "run", F.col("doc").alias("_doc"), F.col("place").alias("_place"))
    again = _parts(rows.join(known, ["home", "run"]).where("doc <> _doc or place <> _place"))
    again = again.withColumn("both_before", F.lit(False)).withColumn("both_after", F.lit(False))
    return pending.withColumn("again", F.lit(False)).select(RUN).unionByName(again.withColumn("again", F.lit(True)).select(RUN))


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, mark, spans array<long>) of the documents that hold a repeat; docs: (doc, mark, text), doc not null."""
    hot = hot_homes(docs)
    if hot:
        common = materialize(anchors(docs).where(F.col("home").isin(hot)), "hot-runs")
        left = _sorted_runs(anchors(docs).where(~F.col("home").isin(hot))).unionByName(_joined_runs(common))
    else:
        left = _sorted_runs(anchors(docs))
    reach = F.greatest(F.lit(0), F.col("lead") - BEFORE + 1)
    early = F.when(~F.col("again") & F.col("both_before"), F.least("count", reach)).otherwise(F.lit(0))
    late = F.when(~F.col("again") & F.col("both_after"), F.least("count", F.greatest(F.lit(0), F.col("count") - reach))).otherwise(F.lit(0))
    left = left.withColumn("early", early).withColumn("late", late)
    first = F.when(F.col("again") | (F.col("early") > 0), F.col("start")).otherwise(F.col("start") + F.col("count") - F.col("late"))
    left = left.select("doc", "mark", first.alias("start"), F.when(F.col("again"), F.col("count")).otherwise(F.col("early") + F.col("late")).alias("count"), "again").where("count > 0")
    left = materialize(left.sortWithinPartitions("doc", "start"), "ranked")
    if hot:
        drop_scratch(common)
    settled = left.where("again").select("doc", "mark", _span(F.col("start"), F.col("count")).alias("span"))
    pending = left.where("not again").groupBy("doc", "mark").agg(F.collect_list(F.shiftleft("start", 7).bitwiseOR(F.col("count"))).alias("pending"))
    opened = docs.join(pending, ["doc", "mark"]).select("doc", "text", "mark", "pending").mapInPandas(positions, POSITION)
    named = materialize(doubled(opened), "ranks")
    found = materialize(repeated_starts(named).sortWithinPartitions("doc", "span"), "repeated")
    drop_scratch(named)
    spans = materialize(settled.unionByName(found).groupBy("doc", "mark").agg(F.collect_list("span").alias("spans")), "spans")
    drop_scratch(left)
    drop_scratch(found)
    return spans


POSITION = "r1 long, r2 long, doc long, place long"


def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(r1, r2, doc, place): the rank pair at offset PREFIX of each pending start and of the position OFFSET after it.

    place packs the position, whether it is a pending start itself, and the mark of the text.
    """
    for batch in batches:
        for doc, text, mark, packed in zip(batch["doc"], batch["text"], batch["mark"], batch["pending"], strict=True):
            packed = np.asarray(packed, np.int64)
            counts = packed & 127
            starts = np.unique(np.repeat(packed >> 7, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
            at = np.union1d(starts, starts + OFFSET)
            pending = np.isin(at, starts, assume_unique=True).astype(np.int64)
            data = np.frombuffer(text.encode(), np.uint8)
            for k in range(0, len(at), BLOCK):
                some = at[k : k + BLOCK]
                ranks = prefix_ranks(data[some[0] : some[-1] + 2 * PREFIX]).view(np.int64)
                yield pd.DataFrame({"r1": ranks[some - some[0]], "r2": ranks[some - some[0] + PREFIX], "doc": doc, "place": some << 17 | pending[k : k + BLOCK] << 16 | mark})


def doubled(opened: DataFrame) -> DataFrame:
    """(doc, place, rank): positions whose pair another position has too, with the pair's place in sorted order as their rank."""
    ordered = opened.repartition("r1", "r2").sortWithinPartitions("r1", "r2", "doc", "place").withColumn("at", F.monotonically_increasing_id())
    same = Window.partitionBy("r1", "r2").orderBy("doc", "place")
    ranked = ordered.select("doc", "place", F.first("at").over(same).alias("rank"), F.lag("at").over(same).alias("before"), F.lead("at").over(same).alias("after"))
    return ranked.where("before is not null or after is not null").select("doc", "place", "rank")


def repeated_starts(named: DataFrame) -> DataFrame:
    """(doc, mark, span) of the pending starts whose pair at OFFSET is not the first of its kind."""
    mark, at = F.col("place").bitwiseAND(F.lit(0xFFFF)), F.shiftright("place", 17)
    whole = named.select("doc", mark.alias("mark"), at.alias("at"), F.shiftright("place", 16).bitwiseAND(F.lit(1)).alias("pending"), "rank")
    further = Window.partitionBy("doc", "mark").orderBy("at").rangeBetween(OFFSET, OFFSET)
    pairs = whole.withColumn("next", F.first("rank").over(further)).where("pending = 1 and next is not null")
    here = F.struct("doc", "at", "mark")
    same = Window.partitionBy("rank", "next").orderBy("doc", "at", "mark")
    late = pairs.withColumn("late", here != F.first(here).over(same)).where("late")
    return late.select("doc", "mark", _span(F.col("at"), F.lit(1)).alias("span"))


KEPT = "n_removed long, n_spans long, kept binary"


def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """What is left of each text without its spans."""
    rows = []
    for text, packed in zip(texts, spans, strict=True):
        data = text.encode()
        packed = np.zeros(0, np.int64) if packed is None else np.asarray(packed, np.int64)
        edges = np.bincount(packed >> 8, minlength=len(data) + 1) - np.bincount((packed >> 8) + (packed & 255), minlength=len(data) + 1)
        gone = np.cumsum(edges)[:-1] > 0
        rows.append((int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()))
    return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) for each row of `docs`.

    A byte goes if a string of LENGTH bytes over it also starts earlier: in a smaller doc_id, or before in the same
    document. Null text is empty; a null doc_id comes after all ids; rows with the same doc_id and text are one
    document and lose the same bytes; rows with the same doc_id and other texts come in order of place, then of text
    hash; texts under LENGTH bytes lose nothing; other columns are ignored; no rows give none.
    """
    keyed = _keyed(docs)
    spans = repeats(keyed)
    apply = F.pandas_udf(cut, KEPT)
    whole = keyed.join(spans, ["doc", "mark"], "left").withColumn("c", apply("text", "spans"))
    return whole.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "c.*")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All `documents` without their repeated 100-byte strings; see remove_repeats for edge cases."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
