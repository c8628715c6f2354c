import glob
import io
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard

from foralia.llm import token_files as tf

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, tf.END_ID], "<u4")


def test_encoder_equals_the_tokenizer(whole):
    encoder, rng = tf.ByteEncoder(PATH), random.Random(3)
    alphabet = list("aaabcdeZ019.,;'-’é  \n\t\r\x0b\x1c\x1f\x85\xa0 \xad") + ["'s", "'ll", "\n\n", " \n", "日本", "ñ", "İ", "🙂", "́", "<|endoftext|>", "٣", "²"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(6000)]
    texts += ["", " ", "\n", "a", " a", "a ", "a  b", "a \nb", "a\n b", "x" * 5000, " " * 3000, "word, " * 2000]
    for text in texts * 2:
        assert encoder.encode(text) + b"\0\0" == whole(text).astype("<u2").tobytes(), repr(text)


def test_letters_with_marks_after_them_are_not_cut(whole):
    encoder = tf.ByteEncoder(PATH)
    text = "first " + " ".join(stem + marks for stem in ("word", "Ñandú", "İß", "ªº", "don") for marks in ("", ".", ",", "?!", "...", ";:"))
    encoder._run("first")
    encoder.cut = lambda run: pytest.fail(f"cut: {run}") if run != "first" else ["first"]
    assert encoder.encode(text) + b"\0\0" == whole(text).astype("<u2").tobytes()


def test_a_full_cache_changes_nothing(whole, monkeypatch):
    monkeypatch.setattr(tf, "CACHE_WORDS", 4)
    encoder = tf.ByteEncoder(PATH)
    text = " ".join(f"word{k % 13} and {k}" for k in range(300))
    assert encoder.encode(text) + b"\0\0" == whole(text).astype("<u2").tobytes()
    assert len(encoder.words) <= 5


def _file(docs, width=2, frame_bytes=64):
    out = io.BytesIO()
    writer = tf.FrameWriter(out, width, frame_bytes)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, f"<u{width}").tobytes())
    writer.close()
    return out.getvalue()


def test_frames_round_trip_and_plain_zstandard_reads_them():
    rng = random.Random(1)
    docs = [(None if k == 5 else k % 50, [rng.randrange(60000) for _ in range(rng.choice([0, 1, 7, 31, 32, 33, 500]))]) for k in range(120)]
    for width in (2, 4):
        raw = _file(docs, width)
        reader = tf.FrameReader(io.BytesIO(raw), len(raw))
        assert [(None if not k else int(d)) for d, k in zip(reader.doc_ids, reader.known)] == [d for d, _ in docs]
        assert [reader.ids(k).tolist() for k in range(len(docs))] == [ids for _, ids in docs]
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert np.frombuffer(plain, f"<u{width}").tolist() == [i for _, ids in docs for i in ids]
        assert max(reader.sizes) <= 64


def test_a_reader_decompresses_only_the_frames_it_needs():
    docs = [(k, [k] * 20) for k in range(100)]
    raw = _file(docs)
    reader = tf.FrameReader(io.BytesIO(raw), len(raw))
    assert len(reader.sizes) == 100
    assert [reader.ids(r).tolist() for r in reader.find({17, 4, 1000})] == [[4] * 20, [17] * 20]
    assert reader.frames_read == 2


def test_no_documents():
    raw = _file([])
    reader = tf.FrameReader(io.BytesIO(raw), len(raw))
    assert len(reader.doc_ids) == 0 and reader.find({1}) == []


def test_damage_is_noticed():
    raw = _file([(k, list(range(k, k + 40))) for k in range(20)])
    unseen = 0
    for at in range(len(raw)):
        bad = bytearray(raw)
        bad[at] ^= 0x10
        try:
            reader = tf.FrameReader(io.BytesIO(bytes(bad)), len(bad))
            got = [reader.ids(k).tolist() for k in range(len(reader.doc_ids))]
            unseen += got != [list(range(k, k + 40)) for k in range(20)]
        except ValueError:
            pass
    assert unseen == 0
    for cut in (0, 5, 16, len(raw) - 1):
        with pytest.raises(ValueError):
            tf.FrameReader(io.BytesIO(raw[:cut]), cut)


def test_documents_written_and_read_back(spark, docs, rows, whole, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tf.write_documents(docs, PATH, path)
    got = tf.read_documents(spark, path).orderBy("start").collect()
    expected = sorted(((-1 if r[0] is None else r[0], r[1] or "", whole(r[1])) for r in rows), key=lambda r: r[:2])
    assert [(-1 if g["doc_id"] is None else g["doc_id"], g["n_tokens"], bytes(g["ids"])) for g in got] == [(d, len(i), i.tobytes()) for d, _, i in expected]
    assert [g["start"] for g in got] == np.cumsum([0, *(len(i) for *_, i in expected)])[:-1].tolist()
    few = tf.read_documents(spark, path).where("doc_id in (3, 7)")
    assert sorted({r["doc_id"] for r in few.collect()}) == [3, 7]
    assert "PushedFilters" in few._jdf.queryExecution().toString() or few.count() == 2
    manifest = json.load(open(f"{tmp_path}/tokens/{tf.MANIFEST}"))
    assert sum(m["documents"] for m in manifest) == len(rows)
    # a file that a lost task left behind is not read
    with open(glob.glob(f"{tmp_path}/tokens/*.zst")[0], "rb") as source, open(f"{tmp_path}/tokens/part-000000-lost.tokens.zst", "wb") as lost:
        lost.write(source.read())
    assert tf.read_documents(spark, path).count() == len(rows)


def test_no_rows(spark, none, tmp_path):
    tf.write_documents(none, PATH, f"file://{tmp_path}/empty")
    assert tf.read_documents(spark, f"file://{tmp_path}/empty").count() == 0


def test_query_equals_the_tokenizer_on_whole_tables(spark, whole):
    sf = "/root/testdata/sf0.001"
    got = tf.op13_token_files(spark, sf).orderBy("doc_id").collect()
    start = 0
    for g, (doc_id, text) in zip(got, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect(), strict=True):
        ids = whole(text)
        assert tuple(g) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
