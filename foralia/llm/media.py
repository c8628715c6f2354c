"""Media columns: ISO base media containers, written and read without decoding payloads.

`write_container` stores bytes as an uncompressed 8-bit PCM track; `read_container` walks the nested boxes of any
ISO file, track by track, decodes sample tables and fragments and reports codec, duration and the byte ranges that
start at key samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = 64
TIMESCALE = 8000
KEY_EVERY = 16
#: Boxes whose payload is again a sequence of boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}
#: Boxes inside boxes inside a track: tables lie four deep.
MOST_DEPTH = 8


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, body: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), body)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return data + b"\0" * (-len(data) % UNIT if data else UNIT)


def write_container(payload: bytes) -> bytes:
    """An ISO file with one `raw ` audio track; a sample is UNIT 8-bit values, each KEY_EVERY-th one is a sync sample."""
    n = len(payload) // UNIT
    ticks = n * UNIT
    keys = range(1, n + 1, KEY_EVERY)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = _box(b"raw ", b"\0" * 6 + struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom")

    def moov(start: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1) + entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64", struct.pack(">IQ", 1, start)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1) + _full(b"url ", b"", 1)))
        minf = _box(b"minf", _full(b"smhd", b"\0" * 4), dinf, stbl)
        hdlr = _full(b"hdlr", b"\0" * 4 + b"soun" + b"\0" * 12 + b"text\0")
        mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks & 0xFFFFFFFF, 0x55C4, 0)), hdlr, minf)
        tkhd = _full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, ticks & 0xFFFFFFFF, 0, 0, 0, 0x100, 0) + matrix + b"\0" * 8, 7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIHH8x", 0, 0, TIMESCALE, ticks & 0xFFFFFFFF, 0x10000, 0x100, 0) + matrix + b"\0" * 24 + struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    start = len(ftyp) + len(moov(0)) + 16
    mdat = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    return b"".join((ftyp, moov(start), mdat, payload))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, payload start, payload end) of the boxes that lie side by side; stops at one that does not fit."""
    while start + 8 <= end:
        length, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if length == 1 and start + 16 <= end:
            length, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif length == 0:
            length = end - start
        if length < head or start + length > end:
            return
        yield kind, start + head, start + length
        start += length


def walk(data: memoryview, start: int, end: int, depth: int = MOST_DEPTH) -> dict[bytes, tuple[int, int]]:
    """kind -> payload span of all boxes under one box; of several of a kind the first counts, and depth is bounded."""
    found: dict[bytes, tuple[int, int]] = {}
    for kind, a, b in boxes(data, start, end):
        found.setdefault(kind, (a, b))
        if kind in NESTED and depth > 1:
            for k, span in walk(data, a, b, depth - 1).items():
                found.setdefault(k, span)
    return found


def _table(data: memoryview, span: tuple[int, int], form: str, columns: int = 1) -> np.ndarray:
    """The rows of a full box that holds a count and rows of equal numbers; a table longer than its box is an error."""
    n = struct.unpack_from(">I", data, span[0] + 4)[0]
    width = columns * np.dtype(form).itemsize
    if span[0] + 8 + n * width > span[1]:
        raise ValueError("table exceeds its box")
    return np.frombuffer(data, form, n * columns, span[0] + 8).astype(np.int64).reshape(n, columns) if n else np.zeros((0, columns), np.int64)


def _timing(data: memoryview, span: tuple[int, int]) -> tuple[int, int]:
    """(timescale, duration) of a media header, versions 0 and 1."""
    return _field(data, span, (">II", 12), (">IQ", 20))


def _field(data: memoryview, span: tuple[int, int], old: tuple[str, int], new: tuple[str, int]) -> tuple:
    """Numbers at a place of a full box that depends on its version; a box too short for them is an error."""
    form, at = new if span[0] < span[1] and data[span[0]] == 1 else old
    if span[0] + at + struct.calcsize(form) > span[1]:
        raise ValueError("header exceeds its box")
    return struct.unpack_from(form, data, span[0] + at)


def _samples(data: memoryview, at: dict[bytes, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, sizes, durations, key sample numbers) from a track's sample tables."""
    fixed, n = struct.unpack_from(">II", data, at[b"stsz"][0] + 4)
    if not fixed and at[b"stsz"][0] + 12 + 4 * n > at[b"stsz"][1]:
        raise ValueError("table exceeds its box")
    times = _table(data, at[b"stts"], ">u4", 2)
    if n > min(times[:, 0].sum(), len(data)):
        raise ValueError("more samples than times or bytes")
    sizes = np.full(n, fixed, np.int64) if fixed else np.frombuffer(data, ">u4", n, at[b"stsz"][0] + 12).astype(np.int64)
    chunks = _table(data, at[b"co64"], ">u8")[:, 0] if b"co64" in at else _table(data, at[b"stco"], ">u4")[:, 0]
    runs = _table(data, at[b"stsc"], ">u4", 3)
    lasts = np.diff(np.append(runs[:, 0], len(chunks) + 1)) if len(runs) else np.zeros(0, np.int64)
    if (lasts < 0).any() or (len(runs) and runs[0, 0] != 1) or (lasts * runs[:, 1]).sum() < n or (runs[:, 1] > max(n, 1)).any():
        raise ValueError("chunks do not cover the samples")
    chunk_of = np.repeat(np.arange(len(chunks)), np.repeat(runs[:, 1], lasts))[:n]
    before = np.cumsum(sizes) - sizes
    first = np.searchsorted(chunk_of, np.arange(len(chunks)))
    offsets = chunks[chunk_of] + before - before[np.minimum(first, max(n - 1, 0))][chunk_of] if n else np.zeros(0, np.int64)
    kept = np.minimum(times[:, 0], np.maximum(0, n - (np.cumsum(times[:, 0]) - times[:, 0])))
    keys = _table(data, at[b"stss"], ">u4")[:, 0] - 1 if b"stss" in at else np.arange(n)
    if len(keys) and (keys.min() < 0 or keys.max() >= n or (np.diff(keys) <= 0).any()):
        raise ValueError("key samples out of order")
    return offsets, sizes, np.repeat(times[:, 1], kept), keys


def _fragments(data: memoryview, tops: list[tuple[bytes, int, int]], defaults: dict[int, tuple[int, int, int]]) -> dict[int, list[tuple[int, int, int, bool]]]:
    """track -> (offset, size, duration, is key) of each sample in movie fragments."""
    found: dict[int, list[tuple[int, int, int, bool]]] = {}
    for kind, a, b in tops:
        if kind != b"moof":
            continue
        after = a - 8
        for inner, c, d in boxes(data, a, b):
            if inner != b"traf":
                continue
            parts = list(boxes(data, c, d))
            head = next((x for k, x, _ in parts if k == b"tfhd"), None)
            if head is None:
                continue
            flags, track = struct.unpack_from(">II", data, head)
            at, base = head + 8, a - 8
            length, size, state = defaults.get(track, (0, 0, 0))
            if flags & 1:
                base, at = struct.unpack_from(">Q", data, at)[0], at + 8
            elif not flags & 0x20000:
                base = after
            at += 4 if flags & 2 else 0
            for bit in (8, 0x10, 0x20):
                if flags & bit:
                    value, at = struct.unpack_from(">I", data, at)[0], at + 4
                    length, size, state = (value if bit == 8 else length), (value if bit == 0x10 else size), (value if bit == 0x20 else state)
            place = base
            for k, x, end in parts:
                if k != b"trun":
                    continue
                own, n = struct.unpack_from(">II", data, x)
                own &= 0xFFFFFF
                x += 8
                if own & 1:
                    place, x = base + struct.unpack_from(">i", data, x)[0], x + 4
                first = None
                if own & 4:
                    first, x = struct.unpack_from(">I", data, x)[0], x + 4
                each = [bit for bit in (0x100, 0x200, 0x400, 0x800) if own & bit]
                if x + 4 * len(each) * n > end or n > len(data):
                    raise ValueError("run exceeds its box")
                for j in range(n):
                    row = dict(zip(each, struct.unpack_from(f">{len(each)}I", data, x), strict=True))
                    x += 4 * len(each)
                    shown = row.get(0x400, first if j == 0 and first is not None else state)
                    found.setdefault(track, []).append((place, row.get(0x200, size), row.get(0x100, length), not shown & 0x10000))
                    place += row.get(0x200, size)
            after = place
    return found


def read_tracks(data: bytes) -> list[dict]:
    """Codec, timing and sample layout of each track of an ISO file, fragments included; `ranges` holds, per key sample, the bytes from it to the next.

    Tracks whose boxes or tables are missing, contradict each other or point outside the file are left out; bytes that
    are no ISO file have no tracks.
    """
    view = memoryview(data)
    tops = list(boxes(view, 0, len(data)))
    tracks, defaults = [], {}
    for kind, a, b in tops:
        if kind == b"moov":
            inside = list(boxes(view, a, b))
            for more, c, d in (x for k, s, e in inside if k == b"mvex" for x in boxes(view, s, e)):
                if more == b"trex" and d - c >= 24:
                    track, _, length, size, state = struct.unpack_from(">5I", view, c + 4)
                    defaults[track] = (length, size, state)
            tracks += [walk(view, c, d) for k, c, d in inside if k == b"trak"]
    try:
        fragments = _fragments(view, tops, defaults)
    except (struct.error, ValueError):
        fragments = {}
    found = []
    for at in tracks:
        try:
            timescale, duration = _timing(view, at[b"mdhd"])
            codec = bytes(view[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
            handler = bytes(view[at[b"hdlr"][0] + 8 : at[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in at else ""
            offsets, sizes, lengths, keys = _samples(view, at)
            ident = _field(view, at[b"tkhd"], (">I", 12), (">I", 20))[0] if b"tkhd" in at else 0
            if more := fragments.get(ident):
                extra = np.array(more, np.int64).reshape(-1, 4)
                keys = np.concatenate([keys, len(sizes) + np.nonzero(extra[:, 3])[0]])
                offsets, sizes, lengths = (np.concatenate([x, extra[:, k]]) for k, x in enumerate((offsets, sizes, lengths)))
                duration = max(duration, int(lengths.sum()))
            if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
                continue
        except (KeyError, IndexError, ValueError, struct.error):
            continue
        ends = np.append(keys[1:], len(sizes)) - 1
        ranges = np.stack([offsets[keys], offsets[ends] + sizes[ends] - offsets[keys]], axis=1) if len(keys) else np.zeros((0, 2), np.int64)
        found.append({"codec": codec, "handler": handler, "timescale": timescale, "duration": duration, "ticks": int(lengths.sum()), "offsets": offsets, "sizes": sizes, "ranges": ranges})
    return found


def read_container(data: bytes) -> dict:
    """The first video track of read_tracks, else its first track; {} where there is none."""
    tracks = read_tracks(data)
    return next((t for t in tracks if t["handler"] == "vide"), tracks[0] if tracks else {})


def stored_payload(data: bytes, info: dict) -> bytes:
    """The samples' bytes in order, read back from where the sample tables say they lie."""
    a, b = info["offsets"], info["sizes"]
    if len(a) and (a[1:] == a[:-1] + b[:-1]).all():
        return data[int(a[0]) : int(a[-1] + b[-1])]
    return b"".join(data[int(x) : int(x + n)] for x, n in zip(a, b, strict=True))


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds binary column `media`: the whole text (null: empty) as UTF-8, zero-padded, in an ISO container."""

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: write_container(pad((x or "").encode())))

    return docs.withColumn(media, encode(F.coalesce(F.col(text), F.lit(""))))


INFO = "codec string, duration_s double, n_samples long, key_ranges array<struct<offset:long,length:long>>, n_tracks int"


def media_info(docs: DataFrame, media: str = "media", info: str = "media_info") -> DataFrame:
    """Adds struct `info` from the headers alone, of the main track (see read_container).

    Fields are null where the bytes are null, no ISO file, or hold no track whose tables agree; duration_s is null
    where the file states no time scale.
    """

    @F.pandas_udf(INFO)
    def read(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in blobs:
            tracks = read_tracks(blob) if blob is not None else []
            if not tracks:
                rows.append((None, None, None, None, None))
                continue
            x = next((t for t in tracks if t["handler"] == "vide"), tracks[0])
            seconds = x["duration"] / x["timescale"] if x["timescale"] else None
            rows.append((x["codec"], seconds, len(x["sizes"]), [{"offset": int(a), "length": int(b)} for a, b in x["ranges"]], len(tracks)))
        return pd.DataFrame(rows, columns=["codec", "duration_s", "n_samples", "key_ranges", "n_tracks"]).astype({"n_samples": "Int64", "n_tracks": "Int32"})

    return docs.withColumn(info, read(F.col(media)))


DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(media: pd.Series) -> pd.DataFrame:
    rows = []
    for blob in media:
        x = read_container(blob)
        back = stored_payload(blob, x)
        keys = x["ranges"]
        feature = f"{x['codec'].strip()};rate={x['timescale']};ticks={x['duration']};samples={len(x['sizes'])};keys={len(keys)};first={keys[0][0]}+{keys[0][1]};last={keys[-1][0]}+{keys[-1][1]};ranges={zlib.crc32(keys.astype('<i8').tobytes()):08x}"
        rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
    return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def op3_media(spark, sf_dir: str) -> DataFrame:
    """Every text of `documents` through a container and back: one row per document row, repeated rows included.

    Null and empty texts give the 64-byte zero payload; other columns of the input are ignored.
    """
    from foralia.runtime import table

    digest = F.pandas_udf(media_digest, DIGEST)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    stored = with_media(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), digest("media").alias("d"))
    return stored.select("doc_id", "n_bytes", "d.*")
