import hashlib
import struct
import zlib

from foralia.llm import media


def test_round_trip_and_digest(docs, rows):
    digest = media.F.pandas_udf(media.media_digest, media.DIGEST)
    got = media.with_media(docs.select("doc_id", "text")).select("doc_id", "media", digest("media").alias("d")).collect()
    texts = sorted(media.pad((r[1] or "").encode()) for r in rows)
    back = []
    for r in got:
        payload = media.stored_payload(r["media"], media.read_container(r["media"]))
        assert r["d"]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["d"]["tail_crc32"] == zlib.crc32(payload[-64:]) and r["d"]["payload_bytes"] == len(payload) > 0
        back.append(payload)
    assert sorted(back) == texts


def test_ranges_start_at_keys_and_cover_the_payload():
    data = media.write_container(media.pad(bytes(range(256)) * 20))
    info = media.read_container(data)
    assert info["codec"] == "raw " and info["ticks"] == info["duration"] == 5120
    assert info["ranges"][:, 1].sum() == 5120 and (info["ranges"][1:, 0] == info["ranges"][:-1].sum(axis=1)).all()


def test_foreign_layouts():
    def box(kind, body):
        return struct.pack(">I4s", 8 + len(body), kind) + body

    full = lambda kind, body: box(kind, b"\0" * 4 + body)
    payload, head = b"abcdefghij", box(b"ftyp", b"isom")
    base = len(head) + 8
    stbl = full(b"stsd", struct.pack(">I", 1) + box(b"avc1", b"\0" * 8)) + full(b"stts", struct.pack(">IIIII", 2, 2, 5, 1, 7))
    stbl += full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)) + full(b"stsz", struct.pack(">IIIII", 0, 3, 2, 3, 4)) + full(b"stco", struct.pack(">III", 2, base, base + 6))
    mdia = full(b"mdhd", struct.pack(">IIII", 0, 0, 10, 17)) + box(b"minf", box(b"stbl", stbl))
    data = head + box(b"mdat", payload) + box(b"moov", box(b"trak", box(b"mdia", mdia)))
    info = media.read_container(data)
    assert info["codec"] == "avc1" and info["ticks"] == 17 and media.stored_payload(data, info) == b"abcdeghij"
    assert info["ranges"].tolist() == [[base, 2], [base + 2, 3], [base + 6, 4]]
    assert media.read_container(b"") == media.read_container(b"\0" * 40) == media.read_container(payload) == {}


def box(kind, body=b""):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, body, version=0, flags=0):
    return box(kind, bytes([version]) + flags.to_bytes(3, "big") + body)


def track(ident, handler, codec, sizes, chunk, keys=None, version=0, scale=10):
    header = struct.pack(">QQIQ", 0, 0, scale, 5 * len(sizes)) if version else struct.pack(">IIII", 0, 0, scale, 5 * len(sizes))
    stbl = full(b"stsd", struct.pack(">I", 1) + box(codec, b"\0" * 8)) + full(b"stts", struct.pack(">III", 1, len(sizes), 5))
    stbl += full(b"stsc", struct.pack(">IIII", 1, 1, max(len(sizes), 1), 1)) + full(b"stsz", struct.pack(f">II{len(sizes)}I", 0, len(sizes), *sizes)) + full(b"stco", struct.pack(">II", 1, chunk))
    if keys is not None:
        stbl += full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys))
    mdia = full(b"mdhd", header, version) + full(b"hdlr", b"\0" * 4 + handler + b"\0" * 12) + box(b"minf", box(b"stbl", stbl))
    return box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, ident)) + box(b"mdia", mdia))


def test_tracks_do_not_mix():
    """Audio without key samples before video with one, and a header of version 1."""
    head = box(b"ftyp", b"isom")
    base = len(head) + 8
    movie = box(b"moov", track(1, b"soun", b"mp4a", [2, 3], base) + track(2, b"vide", b"avc1", [4, 5, 6], base + 5, [1, 3], version=1, scale=25))
    audio, video = media.read_tracks(head + box(b"mdat", bytes(range(20))) + movie)
    assert audio["ranges"].tolist() == [[base, 2], [base + 2, 3]] and audio["timescale"] == 10
    assert video["ranges"].tolist() == [[base + 5, 9], [base + 14, 6]] and (video["timescale"], video["duration"]) == (25, 15)
    assert media.read_container(head + box(b"mdat", bytes(range(20))) + movie)["codec"] == "avc1"


def test_fragments():
    head, movie = box(b"ftyp", b"isom"), box(b"moov", track(7, b"vide", b"avc1", [], 0) + box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 3, 4, 0x10000))))
    run = lambda at: full(b"trun", struct.pack(">IiI", 3, at, 0) + struct.pack(">3I", 5, 6, 7), flags=0x205)
    fragment = lambda at: box(b"moof", full(b"mfhd", b"\0" * 4) + box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000) + run(at)))
    size = len(fragment(0))
    data = head + movie + (fragment(size + 8) + box(b"mdat", bytes(18))) * 2
    first = len(head) + len(movie) + size + 8
    (info,) = media.read_tracks(data)
    assert info["sizes"].tolist() == [5, 6, 7] * 2 and info["ticks"] == info["duration"] == 18
    assert info["ranges"].tolist() == [[first, 18], [first + size + 8 + 18, 18]]


def test_malformed_files_have_no_tracks(spark):
    good = media.write_container(media.pad(b"x" * 500))
    deep = b""
    for _ in range(2000):
        deep = box(b"trak", deep)
    odd = [good.replace(b"co64", b"cx64"), good.replace(b"stsz", b"stsx"), box(b"moov", deep), good[: len(good) - 100], box(b"moov", box(b"trak"))]
    odd.append(good.replace(struct.pack(">III", 1, 8, 64), struct.pack(">III", 0xFFFFFFFF, 8, 64)))
    assert all(media.read_tracks(x) == [] for x in odd)
    for k in range(0, len(good), 7):
        media.read_tracks(good[:k] + b"\xff" + good[k + 1 :])
    timeless = good.replace(struct.pack(">IIIIHH", 0, 0, 8000, 512, 0x55C4, 0), struct.pack(">IIIIHH", 0, 0, 0, 512, 0x55C4, 0))
    assert timeless != good
    got = media.media_info(spark.createDataFrame([(timeless,), (odd[0],)], "media binary").coalesce(1)).collect()
    assert sorted((str(r["media_info"]["codec"]), r["media_info"]["duration_s"]) for r in got) == [("None", None), ("raw ", None)]


def test_info_of_odd_bytes(spark):
    rows = [(1, media.write_container(media.pad(b"x"))), (2, b"junk"), (3, None)]
    got = {r["id"]: r["media_info"] for r in media.media_info(spark.createDataFrame(rows, "id int, media binary")).collect()}
    assert got[1]["codec"] == "raw " and got[1]["n_samples"] == 1 and len(got[1]["key_ranges"]) == 1
    assert all(got[k] is None or got[k]["codec"] is None for k in (2, 3))


def test_empty(none):
    assert media.with_media(none).collect() == []


def test_headers_cut_short_give_no_track():
    whole = media.write_container(media.pad(b"x" * 100))
    for kind in (b"mdhd", b"tkhd"):
        at = whole.find(kind)
        if at < 0:
            continue
        for keep in range(0, 24, 4):
            short = whole[: at - 4] + struct.pack(">I", 8 + keep) + whole[at : at + 4 + keep]
            media.read_container(short)
            assert media.read_container(whole[: at - 4] + struct.pack(">I", 8) + whole[at : at + 4]).get("codec") in (None, "raw ")
