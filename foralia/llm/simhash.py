"""SimHash near-dedup with pigeonring filtering.

Two fingerprints at distance t or less, cut into t + 1 segments in a ring, always have a start from which the first l
segments differ in at most l * t / (t + 1) bits, for every l. So the first segment of such a chain is equal and the
second differs in one bit at most: those two make the join key, longer chains prune inside the join, and only what is
left pays for the full Hamming check. Equal fingerprints are one class throughout, whatever their number.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foralia.llm.graph import components
from foralia.runtime import drop_scratch, free_driver, materialize, shuffled, table

BITS = 64
WIDTH = 4
MAX_BITS = 4
SEED = 42


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """Unsigned XXH64 of each shingle of the lower-cased (A-Z) words, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """Bytes, highest first, of the bits set in over half of `hashes` (rows of big-endian bytes)."""
    n = len(hashes)
    total = np.zeros(hashes.shape[1] * 8, np.int64)
    for at in range(0, n, 255):
        total += np.add.reduce(np.unpackbits(hashes[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > n)


def fingerprint(text: str, width: int = WIDTH) -> int:
    """64-bit SimHash as a signed long; zero for a text without words."""
    hashes = shingle_hashes(text, width)
    return int.from_bytes(majority_bits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)).tobytes(), "big", signed=True) if len(hashes) else 0


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) for each row of `docs`; only texts go to Python, so ids of any size and nulls stay as they are."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, width) for x in texts], dtype="int64")

    return docs.select(F.col("doc_id").cast("long"), run(F.coalesce("text", F.lit(""))).alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of different values of `prints.fp` that differ in `max_bits` (1 or more) bits at most, each once.

    Exact. `prints` holds distinct values; a value yields max_bits + 1 index rows and, by way of a parity rule that
    lets only one side of a one-bit difference probe, about half a segment's bits as probe rows for each.
    """
    m = max_bits + 1
    at = [BITS * k // m for k in range(m + 1)]
    widths = [b - a for a, b in zip(at, at[1:], strict=False)]
    part = lambda k: F.shiftrightunsigned("fp", at[k % m]).bitwiseAND(F.lit((1 << widths[k % m]) - 1))
    key = lambda k, second: F.shiftleft(F.shiftleft(part(k), widths[(k + 1) % m]).bitwiseOR(second), 4).bitwiseOR(F.lit(k).cast("long"))
    index = F.array(*(F.struct(F.lit(k).alias("k"), key(k, part(k + 1)).alias("key")) for k in range(m)))

    def probes(k: int) -> Column:
        second, width = part(k + 1), widths[(k + 1) % m]
        flips = F.array(*(F.struct(key(k, second.bitwiseXOR(F.lit(1 << j))).alias("key"), F.lit(True).alias("flip")) for j in range(width)))
        same = F.array(F.struct(key(k, second).alias("key"), F.lit(False).alias("flip")))
        return F.when(F.bit_count(second) % 2 == 0, F.concat(same, flips)).otherwise(same)

    left = prints.select(F.col("fp").alias("a"), F.inline(F.concat(*(probes(k) for k in range(m)))))
    right = prints.select(F.col("fp").alias("b"), F.inline(index))

    def chain(k: int, length: int) -> int:
        return _signed(sum(((1 << widths[j % m]) - 1) << at[j % m] for j in range(k, k + length)))

    differ = F.col("a").bitwiseXOR(F.col("b"))
    viable = F.lit(True)
    for length in range(3, m):
        masks = F.array(*(F.lit(chain(k, length)).cast("long") for k in range(m)))
        viable = viable & (F.bit_count(differ.bitwiseAND(F.get(masks, F.col("k")))) <= length * max_bits // m)
    close = viable & (F.bit_count(differ) <= max_bits)
    found = left.join(right, "key").where((F.col("flip") | (F.col("a") < F.col("b"))) & close)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) per row: component_id is the smallest doc_id reachable over links, own included.

    Texts without words (null, empty, white space) have fingerprint zero and link like any other. Rows that repeat a
    doc_id count as documents of their own; a null doc_id is larger than all others and null only in a component
    without any id; other columns are ignored; no rows give none.
    """
    prints = materialize(fingerprints(docs, width), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = materialize(components(links(classes.select("fp"), max_bits)), "components")
    member = linked.join(classes, linked["node"] == classes["fp"])
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = linked.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    whole = classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(whole, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all `documents`: four-word shingles, four bits; see near_duplicates for edge cases."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# A similarity of 0.8 is far apart for 64 bits: about ten of them differ. The wide form takes more fingerprints at once.
WIDE_WIDTH = 5
PLANES = 63
WIDE_BITS = PLANES * BITS
SIMILARITY = 0.8
#: Jaccard 0.8 is an angle at which 0.148 to 0.152 of the bits differ: 597 to 611 of 4032, with a deviation of 23. Pairs six
#: deviations closer are similar and pairs six further apart are not; between them the shingles decide.
SURE_BITS = 460
WIDE_MAX_BITS = 750
#: Bits of a segment that must be equal for two signatures to meet: 168 segments of 24 bits.
SEGMENT_BITS = 24
SEGMENTS = WIDE_BITS // SEGMENT_BITS
#: Chains that follow an equal segment in the ring: after one plane and after two at most so many bits may differ. At
#: similarity 0.8 some 10 of 64 and 19 of 128 do; these budgets are seven deviations more.
CHAIN_BITS = (30, 48)
#: Texts of so many distinct shingles at most meet by their shingles instead, exactly.
FEW = 64
#: Shingles held as rows of bits at a time.
CHUNK = 2048
#: Rows of a key that one block of its pairs takes on one side.
BLOCK = 1000


def _planes(hashes: np.ndarray) -> np.ndarray:
    """PLANES independent 64-bit hashes of each hash, as rows of big-endian bytes."""
    with np.errstate(over="ignore"):
        planes = np.arange(1, PLANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (hashes[:, None] ^ planes) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
    return mixed.astype(">u8").view(np.uint8).reshape(len(hashes), -1)


def wide_signature(hashes: np.ndarray) -> np.ndarray:
    """PLANES fingerprints (signed longs) of distinct shingle hashes; zeros where there are none. Memory is bounded by CHUNK."""
    total = np.zeros(WIDE_BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        rows = _planes(hashes[at : at + CHUNK])
        for k in range(0, len(rows), 255):
            total += np.add.reduce(np.unpackbits(rows[k : k + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes)).view(">i8").astype(np.int64)


def signatures(docs: DataFrame, width: int = WIDE_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, mark, n, words, few) for each row: text hash, number of distinct shingles, signature, and the shingles themselves of a short text."""
    none = np.zeros(0, np.int64)

    @F.pandas_udf("n int, words array<long>, few array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = [np.unique(shingle_hashes(x, width)) for x in texts]
        return pd.DataFrame({"n": np.array([len(x) for x in own], np.int32), "words": [wide_signature(x) for x in own], "few": [x.view(np.int64) if len(x) <= FEW / similarity else none for x in own]})

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("mark"), run(text).alias("s")).select("doc_id", "mark", "s.*")


def bits_apart(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def similar(left: str, right: str, width: int, similarity: float) -> bool:
    """Whether the distinct shingles of both texts have this Jaccard similarity or more; texts without words have none."""
    a, b = (np.unique(shingle_hashes(x, width)) for x in (left, right))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and common >= similarity * (len(a) + len(b) - common) - 1e-9


def rare_shingles(classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(shingle, cls, next_1, next_2): of each short text the shingles fewest other short texts hold, of which two similar texts share one.

    A text of n shingles shares ceil(similarity * n) with any similar one, so of its shingles in one common order all
    but that many and one more suffice. In order of frequency a passage that many texts hold comes last.
    """
    short = classes.select("cls", "n", F.element_at("words", 1).alias("next_1"), F.element_at("words", 2).alias("next_2"), F.explode("few").alias("shingle"))
    counts = short.groupBy("shingle").agg(F.count("*").alias("held"))
    ordered = short.join(counts, "shingle").groupBy("cls", "n", "next_1", "next_2").agg(F.sort_array(F.collect_list(F.struct("held", "shingle"))).alias("ordered"))
    first = F.slice("ordered", F.lit(1), (F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1).cast("int"))
    chosen = ordered.select("cls", "next_1", "next_2", F.inline(first)).where("held > 1")
    return chosen.select("shingle", "cls", "next_1", "next_2")


def _ring(k: Column) -> Column:
    return F.element_at("words", (F.pmod(k, F.lit(PLANES)) + 1).cast("int"))


def _members(classes: DataFrame, similarity: float) -> DataFrame:
    """(key, cls): a row per segment of a long text and per rare shingle of a short one."""
    at, offset = F.floor(F.col("segment") * SEGMENT_BITS / BITS), F.col("segment") * SEGMENT_BITS % BITS
    spread = classes.where(F.col("n") > FEW).select("cls", "words", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("segment"))
    spread = spread.select("cls", "segment", _ring(at).alias("w"), _ring(at + 1).alias("after"), offset.alias("o"))
    inside = F.expr(f"shiftrightunsigned(w, {BITS - SEGMENT_BITS} - o)")
    across = F.expr(f"shiftleft(w, o - {BITS - SEGMENT_BITS}) | shiftrightunsigned(after, {2 * BITS - SEGMENT_BITS} - o)")
    value = F.when(F.col("o") <= BITS - SEGMENT_BITS, inside).otherwise(across).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    long = spread.select(F.shiftleft(F.col("segment").cast("long"), SEGMENT_BITS).bitwiseOR(value).alias("key"), "cls")
    short = rare_shingles(classes, similarity).select(F.col("shingle").bitwiseOR(F.lit(-(1 << 63))).alias("key"), "cls")
    return long.unionByName(short)


def _met_keys(classes: DataFrame, similarity: float) -> DataFrame:
    """(key, cls, next_1, next_2) of the members whose key another one has, with the planes that follow in the ring.

    All members are shuffled once and as two numbers, whatever the share that meets; the planes are looked up for that share.
    """
    n = F.count("*").over(Window.partitionBy("key"))
    met = materialize(_members(classes, similarity).withColumn("n", n).where("n > 1").select("key", "cls"), "shared")
    at = F.floor(F.shiftright("key", SEGMENT_BITS) * SEGMENT_BITS / BITS)
    following = [F.when(F.col("key") < 0, F.element_at("words", k)).otherwise(_ring(at + k)).alias(f"next_{k}") for k in (1, 2)]
    near = materialize(met.join(classes.select("cls", "words"), "cls").select("key", "cls", *following), "near")
    drop_scratch(met)
    return near


def _viable(left: Callable[[int], Column], right: Callable[[int], Column]) -> Column:
    """Whether both chains after the place where two members meet stay within their budgets."""
    apart = [F.bit_count(left(k).bitwiseXOR(right(k))) for k in (1, 2)]
    return (apart[0] <= CHAIN_BITS[0]) & (apart[0] + apart[1] <= CHAIN_BITS[1])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes that are similar: long texts by their signatures where these leave no doubt, all others by their shingles."""

    @F.pandas_udf(T.BooleanType())
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similar(a, b, width, similarity) for a, b in zip(left, right, strict=True)], dtype=bool)

    of = classes.select("cls", "words", "mark", "n")
    both = pairs.distinct().join(of.toDF("a", "left", "mark_a", "n_a"), "a").join(of.toDF("b", "right", "mark_b", "n_b"), "b")
    both = both.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6)
    short = F.least("n_a", "n_b") <= FEW
    met = both.withColumn("bits", bits_apart(F.col("left"), F.col("right"))).where(short | (F.col("bits") <= WIDE_MAX_BITS))
    met = materialize(met.select("a", "b", "mark_a", "mark_b", (~short & (F.col("bits") <= SURE_BITS)).alias("sure")), "met")
    doubtful = met.where("not sure")
    wanted = doubtful.select(F.explode(F.array("mark_a", "mark_b")).alias("mark")).distinct()
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("mark"), text.alias("text")).join(wanted, "mark", "left_semi").dropDuplicates(["mark"])
    texts = materialize(texts, "texts")
    read = doubtful.join(texts.toDF("mark_a", "text_a"), "mark_a").join(texts.toDF("mark_b", "text_b"), "mark_b")
    found = materialize(met.where("sure").select("a", "b").unionByName(read.where(alike("text_a", "text_b")).select("a", "b")), "verified")
    drop_scratch(met)
    drop_scratch(texts)
    return found


def _across(crowded: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) of one key in different groups with viable chains, without the leads, which met all.

    Members outside the largest group of their key meet all members in salted blocks of BLOCK rows, so a large group
    never meets itself; at most twice the pairs that have to be decided are looked at.
    """
    chain = ["next_1", "next_2"]
    rest = crowded.where("cls <> lead.cls").join(shuffled(groups), F.col("cls") == F.col("node"), "left")
    rest = rest.select("key", F.coalesce("root", "cls").alias("group"), "cls", *chain)
    sizes = rest.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key")
    sizes = sizes.agg(F.max(F.struct("n", "group")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("groups")).where("groups > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mixed = materialize(rest.join(shuffled(sizes.select("key", F.col("most.group").alias("most"), blocks.alias("blocks"))), "key"), "mixed")
    of = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("group", "cls", *chain)]
    right = mixed.select("key", F.pmod("cls", F.col("blocks")).alias("block"), *of("b"))
    left = mixed.where("group <> most").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", F.col("block").cast("long"), "most", *of("a"))
    once = (F.col("group_b") == F.col("most")) | (F.col("cls_a") < F.col("cls_b"))
    met = left.join(shuffled(right), ["key", "block"]).where((F.col("group_a") != F.col("group_b")) & once)
    met = met.where(_viable(lambda k: F.col(f"next_{k}_a"), lambda k: F.col(f"next_{k}_b")))
    return met.select(F.least("cls_a", "cls_b").alias("a"), F.greatest("cls_a", "cls_b").alias("b"))


def similar_groups(docs: DataFrame, width: int = WIDE_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, mark, component_id) per row: texts whose shingle sets have a similarity of 0.8 or more, transitively.

    Signatures of texts with more than FEW shingles meet where a segment is equal and the chain that follows it in the
    ring stays within its budgets: a pair at similarity 0.8 does so in 96 of 100 cases, at 0.85 in 99.8. Texts with
    fewer meet by their rarest shingles, which misses none. Members of a key first meet its smallest one, so a
    group of copies costs a row for each, not for each pair; then all members of groups that are still different meet.
    Texts without words are one group; other edge cases are those of near_duplicates.
    """
    rows = materialize(signatures(docs, width, similarity).withColumn("cls", F.xxhash64("words", "n")), "signatures")
    classes = rows.groupBy("cls").agg(F.first("words").alias("words"), F.first("few").alias("few"), F.first("n").alias("n"), F.min("mark").alias("mark"), F.min("doc_id").alias("first"))
    classes = materialize(classes, "classes")
    named = materialize(rows.select("doc_id", "mark", "cls"), "named")
    drop_scratch(rows)
    near = _met_keys(classes, similarity)
    lead = near.groupBy("key").agg(F.min(F.struct("cls", "next_1", "next_2")).alias("lead"))
    crowded = materialize(near.join(shuffled(lead), "key"), "crowded")
    drop_scratch(near)
    free_driver(docs.sparkSession)
    met = crowded.where("cls <> lead.cls").where(_viable(lambda k: F.col(f"next_{k}"), lambda k: F.col(f"lead.next_{k}")))
    links = _verified(met.select(F.least("cls", "lead.cls").alias("a"), F.greatest("cls", "lead.cls").alias("b")), classes, docs, width, similarity)
    groups = materialize(components(links), "groups")
    more = _verified(_across(crowded, groups), classes, docs, width, similarity)
    free_driver(docs.sparkSession)
    linked = materialize(components(links.unionByName(more)), "components")
    drop_scratch(crowded)
    first = classes.select("cls", "first")
    least = shuffled(linked).join(first, linked["node"] == first["cls"]).groupBy("root").agg(F.min("first").alias("component_id"))
    moved = linked.join(shuffled(least), "root").select(F.col("node").alias("cls"), "component_id")
    whole = first.join(shuffled(moved), "cls", "left").select("cls", F.coalesce("component_id", "first").alias("component_id"))
    found = materialize(named.join(shuffled(whole), "cls").select("doc_id", "mark", "component_id"), "grouped")
    for scratch in (classes, named, links, groups, more, linked):
        drop_scratch(scratch)
    return found


def keep_one(docs: DataFrame, width: int = WIDE_WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that are not near-duplicates of a smaller doc_id; rows that repeat a kept one stay with it.

    A null doc_id is larger than all others and stays only where its group has no id; null texts count as empty; all
    columns pass through, whatever their names; no rows give none.
    """
    groups = similar_groups(docs, width, similarity)
    gone = materialize(groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct(), "gone")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["_mark"])
    return docs.join(gone, same, "left_anti")
