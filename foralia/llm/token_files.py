"""Token files: ids of documents in independent zstandard frames with a trailing seek table and per-frame checksums.

One file follows the public seekable layout of zstandard, so any zstandard reader can decompress it whole:

    frame 0 ... frame k-1    ids, little-endian unsigned, `width` bytes each; every frame is complete in itself and ends
                             with zstandard's own content checksum
    document index           a skippable frame: zstandard of width, document ids and counts of ids, with checksum
    seek table               a skippable frame: sizes and checksum of each frame, then the number of frames

A reader takes the seek table from the end of the file, the index before it, and then only the frames that hold the
documents it was asked for. Frames hold whole documents up to FRAME_BYTES; longer documents are cut over frames.

In Spark the files are a data source (`format("token_frames")`): each task writes one file and the driver commits a
manifest of the files that count, in the order of their partitions. A task that is lost and run again writes another file,
which alone is named in the manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from foralia.runtime import scratch_dir, table, text_batches

END_ID = 0
#: Bytes of ids in a frame at most: what a reader decompresses for one short document.
FRAME_BYTES = 1 << 18
LEVEL = 3
#: Fixed values of the public seekable zstandard layout.
SKIPPABLE, SEEK_TABLE, SEEK_FOOTER, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of ids in a record batch that a reader hands on.
BATCH_BYTES = 8 << 20
#: Entries of a worker's caches; the later half goes when one is full, as frequent words come early. A bound on memory only.
CACHE_WORDS = 500_000
#: Marks that often end a word; neither letters, numbers nor white space, and no apostrophe, which may begin a part of its own.
MARKS = ".,;:!?"


class FrameWriter:
    """Writes documents' ids to an open binary file."""

    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> None:
        self.out, self.width, self.frame_bytes = out, width, frame_bytes // width * width
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.waiting: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._frame()
        for at in range(0, len(ids), self.frame_bytes):
            self.waiting.append(ids[at : at + self.frame_bytes])
            self.size += len(self.waiting[-1])
            if self.size >= self.frame_bytes:
                self._frame()
        self.docs.append(doc_id)
        self.counts.append(len(ids) // self.width)

    def _frame(self) -> None:
        raw = b"".join(self.waiting)
        packed = self.zstd.compress(raw)
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        """Writes the last frame, the index and the seek table; the file stays open."""
        if self.size:
            self._frame()
        known = np.array([d is not None for d in self.docs], np.uint8)
        numbers = np.array([d or 0 for d in self.docs], "<i8")
        index = self.zstd.compress(struct.pack("<IQ", self.width, len(self.docs)) + known.tobytes() + numbers.tobytes() + np.array(self.counts, "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        self.table.append((8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self.out.write(struct.pack("<II", SEEK_TABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEK_FOOTER))


class FrameReader:
    """Reads documents' ids from an open, seekable binary file; `frames_read` counts the frames decompressed.

    A file that is cut short or altered raises ValueError.
    """

    def __init__(self, file, size: int) -> None:
        self.file, self.zstd, self.frames_read = file, zstandard.ZstdDecompressor(), 0
        if size < 17:
            raise ValueError("not a token file: too short")
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        length = 17 + 12 * n
        if magic != SEEK_FOOTER or flags != WITH_CHECKSUMS or not 1 <= n or length > size:
            raise ValueError("not a token file: no seek table at its end")
        file.seek(size - length)
        head = file.read(length - 9)
        if struct.unpack("<II", head[:8]) != (SEEK_TABLE, length - 8):
            raise ValueError("damaged seek table")
        table = np.frombuffer(head[8:], "<u4").reshape(n, 3).astype(np.int64)
        self.places = np.concatenate(([0], np.cumsum(table[:, 0])))
        if self.places[-1] != size - length:
            raise ValueError("damaged seek table")
        self.places, index_at, (self.sizes, self.sums) = self.places[:-1], int(self.places[-2]), table[:-1, 1:].T
        self.packed = table[:-1, 0]
        file.seek(index_at)
        index = file.read(int(table[-1, 0]))
        if struct.unpack("<II", index[:8]) != (SKIPPABLE, len(index) - 8):
            raise ValueError("damaged document index")
        index = self._open(index[8:])
        self.width, docs = struct.unpack("<IQ", index[:12])
        self.known = np.frombuffer(index, np.uint8, docs, 12).astype(bool)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 12 + docs)
        self.counts = np.frombuffer(index, "<i8", docs, 12 + 9 * docs)
        self.starts = np.cumsum(self.counts) - self.counts
        self.frame_ends = np.cumsum(self.sizes)
        self.last: tuple[int, bytes] = (-1, b"")

    def _open(self, packed: bytes) -> bytes:
        try:
            return self.zstd.decompress(packed)
        except zstandard.ZstdError as problem:
            raise ValueError(f"damaged frame: {problem}") from problem

    def _frame(self, k: int) -> bytes:
        if self.last[0] != k:
            self.file.seek(int(self.places[k]))
            raw = self._open(self.file.read(int(self.packed[k])))
            if len(raw) != self.sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"checksum of frame {k} differs")
            self.last, self.frames_read = (k, raw), self.frames_read + 1
        return self.last[1]

    def find(self, doc_ids: set[int]) -> list[int]:
        """Rows of the index that hold these documents."""
        return np.flatnonzero(np.isin(self.doc_ids, np.array(sorted(doc_ids), np.int64)) & self.known).tolist()

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document in one row of the index, as unsigned 32-bit integers."""
        at, end = int(self.starts[row]) * self.width, int(self.starts[row] + self.counts[row]) * self.width
        parts = []
        k = int(np.searchsorted(self.frame_ends, at, "right"))
        while at < end:
            base = int(self.frame_ends[k] - self.sizes[k])
            raw = self._frame(k)[at - base : end - base]
            parts.append(raw)
            at, k = at + len(raw), k + 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype("<u4")


MANIFEST = "_manifest.json"


class _Files(WriterCommitMessage):
    def __init__(self, name: str, part: int, docs: int, ids: int) -> None:
        self.name, self.part, self.docs, self.ids = name, part, docs, ids


class TokenFrames(DataSource):
    """`format("token_frames")`: rows (doc_id long, ids binary) are written in the order and partitions they come in.

    Options: path, a folder that driver and executors reach, by any scheme that Arrow's file systems know; width (bytes of
    an id, 2 or 4). Written ids are little-endian unsigned of that width; read ids have 32 bits. `start` counts the ids of
    all documents before. Filters on doc_id (equal, in) reach the frames where the session lets them through.
    """

    @classmethod
    def name(cls) -> str:
        return "token_frames"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FrameSink(self.options["path"], int(self.options.get("width", "4")))

    def reader(self, schema) -> DataSourceReader:
        return _FrameSource(self.options["path"])


class _FrameSink(DataSourceArrowWriter):
    def __init__(self, path: str, width: int) -> None:
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tokens.zst"
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            frames = FrameWriter(out, self.width)
            for batch in iterator:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                    frames.add(doc_id, ids)
            frames.close()
        return _Files(name, part, len(frames.docs), sum(frames.counts))

    def commit(self, messages: list) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(root)
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        text = json.dumps([{"file": m.name, "documents": m.docs, "ids": m.ids} for m in done])
        with files.open_output_stream(f"{root}/{MANIFEST}.new", compression=None) as out:
            out.write(text.encode())
        files.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{root}/{m.name}")


class _FrameSource(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.wanted: set[int] | None = None

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("doc_id",):
                ids = {v for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
                self.wanted = ids if self.wanted is None else self.wanted & ids
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        with files.open_input_stream(f"{root}/{MANIFEST}", compression=None) as f:
            known = json.loads(f.read())
        starts = np.cumsum([0, *(k["ids"] for k in known)]).tolist()
        return [InputPartition((k["file"], start)) for k, start in zip(known, starts, strict=False) if k["documents"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, base = partition.value
        files, root = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(f"{root}/{name}") as f:
            frames = FrameReader(f, f.size())
            rows = range(len(frames.doc_ids)) if self.wanted is None else frames.find(self.wanted)
            taken, ids, held = [], [], 0
            for row in rows:
                taken.append(row)
                ids.append(frames.ids(row).tobytes())
                held += len(ids[-1])
                if held >= BATCH_BYTES:
                    yield self._batch(frames, base, taken, ids)
                    taken, ids, held = [], [], 0
            if taken:
                yield self._batch(frames, base, taken, ids)

    def _batch(self, frames: FrameReader, base: int, rows: list[int], ids: list[bytes]) -> pa.RecordBatch:
        doc_id = pa.array(frames.doc_ids[rows], pa.int64(), mask=~frames.known[rows])
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array(frames.starts[rows] + base, pa.int64()), pa.array(frames.counts[rows], pa.int64()), pa.array(ids, pa.binary())],
            names=["doc_id", "start", "n_tokens", "ids"],
        )


class _Memo(dict):
    """A bounded cache filled by `make` on a miss; what `make` raises is not kept."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) >= CACHE_WORDS:
            early = list(islice(self.items(), CACHE_WORDS // 2))
            self.clear()
            self.update(early)
        self[key] = value
        return value


class _Irregular(Exception):
    """A word that does not stand between two single spaces."""


class ByteEncoder:
    """Ids of a text by a byte-level tokenizer file, equal to encoding it at once.

    The tokenizer's pattern always cuts before a single space between two characters that are no white space, and what
    it makes of a word with that space does not depend on the words around it. So texts are split at spaces and known
    words are looked up. New words of Latin letters are cut by the pattern and each part goes through the tokenizer's
    model once; other new words go through the tokenizer. Files with another pattern encode every text at once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(self.tokenizer.to_str())
        cuts = stated["pre_tokenizer"] or {}
        self.by_words = cuts.get("type") == "ByteLevel" and cuts.get("use_regex") and not cuts["add_prefix_space"] and stated["normalizer"] is None
        self.special = [t["content"] for t in stated["added_tokens"]]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        latin = [*map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)])]
        of = lambda kind: re.escape("".join(c for c in latin if unicodedata.category(c)[0] == kind))
        letters, numbers = of("L"), of("N")
        self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+").findall
        self.latin = re.compile(f"[\t-\r {re.escape(''.join(latin))}]*").fullmatch
        self.between = re.compile(r"(?<=\S) (?=\S)").split
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(printable))
        shown = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.shown = "".join(shown[b] for b in range(256))
        self.pieces, self.pack = self.tokenizer.model.tokenize, {2: "<%dH", 4: "<%dI"}[self.width]
        self.words, self.parts = _Memo(self._regular), _Memo(self._part)

    def _part(self, part: str) -> bytes:
        ids = [t.id for t in self.pieces(part.encode().decode("latin-1").translate(self.shown))]
        return struct.pack(self.pack % len(ids), *ids)

    def _regular(self, word: str) -> bytes:
        """Ids of `word` with the space before it; letters, and marks after them, are two parts that need no cutting."""
        stem = word.rstrip(MARKS)
        if stem.isalpha() and (stem.isascii() or self.latin(stem)):
            return self.parts[" " + stem] + self.parts[word[len(stem) :]] if len(stem) < len(word) else self.parts[" " + stem]
        if not word or word[0].isspace() or word[-1].isspace() or not word.isprintable() and re.search("[\x1c-\x1f]", word):
            raise _Irregular
        return self._run(" " + word)

    def _run(self, run: str) -> bytes:
        if self.latin(run):
            return b"".join(map(self.parts.__getitem__, self.cut(run)))
        return self._whole(run)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned ids of `width` bytes."""
        if not self.by_words or any(s in text for s in self.special):
            return self._whole(text)
        first, *words = text.split(" ")
        try:
            return (self._run(first) if first and first.isprintable() else self._irregular(first)) + b"".join(map(self.words.__getitem__, words))
        except _Irregular:
            return self._spaced(text)

    def _irregular(self, first: str) -> bytes:
        """A text's first word with white space in it, which may go on in the words after it."""
        if not first or first[-1].isspace() or re.search("[\x1c-\x1f]", first):
            raise _Irregular
        return self._run(first)

    def _spaced(self, text: str) -> bytes:
        """A text with other white space than single spaces between words."""
        if not text or re.search("[\x1c-\x1f]", text):  # white space to Python, not to the tokenizer
            return self._whole(text)
        first, *runs = self.between(text)
        return b"".join([self._run(first), *(self._run(" " + r) if len(r) > 64 or r[-1].isspace() else self.words[r] for r in runs)])


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> ByteEncoder:
    """One encoder a worker process: its caches outlive a task."""
    return ByteEncoder(path)


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): every text's ids and an end id, in the order and partitions of `docs`; null text counts as empty."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        end = np.array([end_id], encoder.kind).tobytes()
        for frame in frames:
            ids = [encoder.encode(text or "") + end for text in frame.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, ids binary")


def write_documents(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Token files of `docs` (columns doc_id, text; others ignored) in ascending doc_id order under `path`.

    Texts are dealt by ranges of doc_id, so each file follows on the one before and no task grows with the corpus. Null
    doc_ids come first, repeated ones in the order of their texts; null text is one end id; no rows give a manifest
    without documents.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFrames)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    width = ByteEncoder(tokenizer).width
    encode(ordered, tokenizer, end_id).write.format("token_frames").option("path", path).option("width", width).mode("append").save()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from token files; a filter on doc_id decompresses only the frames it needs."""
    spark.dataSource.register(TokenFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("token_frames").option("path", path).load()


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """All of `documents`, written and read back; see write_documents for edge cases."""
    import public_tokenizers

    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
