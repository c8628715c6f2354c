"""Packing token sequences: best-fit decreasing over a segment tree of remaining capacities.

Texts are tokenized where they are read and only piece descriptions travel: (document, start, length, checksum).
Overlong documents are cut into full windows first; the remainders are packed in groups of a bounded number of
pieces, each group by one task, so no task grows with the corpus.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foralia.runtime import materialize, table

WINDOW = 2048
END_ID = 1
#: Pieces packed together by one task: a bound on memory; each group leaves at most a few windows half full.
GROUP_PIECES = 4096
#: Entries of a worker's cache of parts; the later half goes when it is full, as frequent parts come early. A bound on memory, not on results.
CACHE_PARTS = 400_000


class WordEncoder:
    """Ids of a text, equal to encoding it at once, because the tokenizer drops white space and cuts by one pattern.

    A text of Latin letters, digits, punctuation and ASCII white space is lower-cased and cut into parts by the pattern
    that the tokenizer file states, and each part goes through the tokenizer's model once. In any other text, words
    of other characters go through the tokenizer whole. Parts already seen are looked up.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        pattern = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        latin = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]) if c != "\u0130"]  # its lower case is two characters
        of = lambda kind: re.escape("".join(c for c in latin if unicodedata.category(c)[0] == kind))
        self.split = re.compile(pattern.replace(r"\p{L}", of("L")).replace(r"\p{N}", of("N"))).findall
        plain = re.escape("".join(latin))
        self.plain_text, self.plain_word = re.compile(f"[\t-\r {plain}]*").fullmatch, re.compile(f"[{plain}]+").fullmatch
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(printable))
        self.shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.parts: dict[str, bytes] = {}

    def _learn(self, part: str) -> None:
        shown = part if part.isascii() else "".join(map(self.shown.__getitem__, part.encode()))
        self.parts[part] = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], "<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        parts = self.split(text.lower())
        try:
            return b"".join(map(self.parts.__getitem__, parts))
        except KeyError:
            if len(self.parts) > CACHE_PARTS:
                self.parts = dict(islice(self.parts.items(), CACHE_PARTS // 2))
            for part in set(parts).difference(self.parts):
                self._learn(part)
            return b"".join(map(self.parts.__getitem__, parts))

    def _other(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "<|" not in text and self.plain_text(text):
            return self._plain(text)
        words = (w.decode() for w in text.encode().split())
        return b"".join(self._plain(w) if self.plain_word(w) and "<|" not in w else self._other(w) for w in words)


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> WordEncoder:
    """One encoder a worker process: its caches outlive a task."""
    return WordEncoder(path)


PART = "array<struct<start:long,length:long,ids_crc32:long>>"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Every document's ids, cut into full windows and one remainder; null text counts as empty. `row` numbers the input's rows."""
    end = np.array([end_id], "<u4").tobytes()

    @F.pandas_udf(PART)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = shared_encoder(tokenizer)
        for texts in batches:
            rows = []
            for text in texts:
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                rows.append([{"start": a, "length": min(window, n - a), "ids_crc32": zlib.crc32(ids[4 * a : 4 * (a + window)])} for a in range(0, n, window)])
            yield pd.Series(rows, dtype=object)

    # Called nondeterministic, or Spark may infer a filter from inline and tokenize every text twice.
    whole = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), cut.asNondeterministic()(F.coalesce("text", F.lit(""))).alias("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"])
    return whole.select("doc_id", "row", total.alias("doc_tokens"), F.inline("parts")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row")


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities finds the tightest that still fits."""

    def __init__(self, window: int) -> None:
        self.width = 1 << window.bit_length()
        self.filled = bytearray(2 * self.width)
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, ident: int) -> None:
        self.by_room[room].append(ident)
        node = room + self.width
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, window) with the least room of `size` or more; it is closed until added again."""
        node = size + self.width
        while not self.filled[node]:
            while node & 1:
                node >>= 1
                if not node:
                    return None
            node += 1
            if node & (node - 1) == 0:
                return None
        while node < self.width:
            node = 2 * node if self.filled[2 * node] else 2 * node + 1
        room = node - self.width
        ident = self.by_room[room].pop()
        if not self.by_room[room]:
            self.filled[node] = 0
            while (node := node >> 1) and not (self.filled[2 * node] or self.filled[2 * node + 1]):
                self.filled[node] = 0
        return room, ident


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset for each piece; `lengths` come in decreasing order and none exceeds `window`."""
    open_windows, used, where, offsets = OpenWindows(window), 0, [], []
    for size in lengths:
        found = open_windows.take(size) if size < window else None
        if found is None:
            room, ident = window, used
            used += 1
        else:
            room, ident = found
        where.append(ident)
        offsets.append(window - room)
        if room > size:
            open_windows.add(room - size, ident)
    return where, offsets


def pack(cut: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces and drops `row`; `cut` should be materialized, its rows are counted first.

    Rows spread over the groups by their number too, so a document that comes many times fills no group of its own.
    """
    groups = max(1, -(-cut.count() // group_pieces))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32", "row"], ascending=[False, True, True, True, True], kind="stable", na_position="last")
        where, offsets = best_fit_decreasing(frame["length"].tolist(), window)
        frame["sequence_id"] = (frame["part"].to_numpy(np.int64) << 32) + np.array(where, np.int64)
        frame["offset"] = np.array(offsets, np.int64)
        return frame.drop(columns=["part", "row"])

    kept = [F.col("doc_id").cast("string").alias("doc_id"), *cut.columns[1:]]
    part = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "row"), F.lit(groups))
    form = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return cut.select(*kept, part.alias("part")).groupBy("part").applyInPandas(fit, form).withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of `docs` (columns doc_id, text; others ignored) with the window and offset each was given.

    Null text is one end id; a null doc_id stays null; repeated rows are packed once each; no rows give none. Which
    sequence a piece comes to depends on the partitioning of `docs`; ids, cuts and checksums do not.
    """
    return pack(materialize(pieces(docs, tokenizer, window, end_id), "pieces"), window)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All of `documents` in windows of 2048 ids; see pack_documents for edge cases."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
