import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foralia.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = "It's ÉCOLE İstanbul ΣΑΣ ß <|endoftext|> x<|endoftext|>y 日本語 a b éa \x1c \x85 don't 123 ½ ǅ ſ ́x tab\tq ﻿hi 'S 🙂"


def reference(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_equal_the_tokenizer(rows):
    encoder = packing.WordEncoder(PATH)
    for text in [ODD, *(r[1] or "" for r in rows)]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference(text)[:-1]


def test_full_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_PARTS", 4)
    encoder = packing.WordEncoder(PATH)
    for text in (ODD, "one two three four five six seven", ODD):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference(text)[:-1]


def check(rows, got, window):
    ids = {(r[0], r[1]): reference(r[1]) for r in rows}
    want = Counter()
    for r in rows:
        x = ids[r[0], r[1]]
        want.update((r[0], a, min(window, len(x) - a), zlib.crc32(np.array(x[a : a + window], "<u4").tobytes()), len(x)) for a in range(0, len(x), window))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return by


def test_pieces_cover_documents_and_windows_are_gapless(docs, rows):
    check(rows, packing.pack_documents(docs, PATH, window=64).collect(), 64)
    got = packing.pack(packing.pieces(docs, PATH), group_pieces=10).collect()
    check(rows, got, 2048)


def test_best_fit_decreasing_finds_the_tightest_window():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 100) for _ in range(500)), reverse=True)
    where, offsets = packing.best_fit_decreasing(sizes, 100)
    room: list[int] = []
    for size, w, o in zip(sizes, where, offsets, strict=True):
        fits = [r for r in room if r >= size]
        if fits:
            assert w < len(room) and room[w] == min(fits) and o == 100 - room[w]
            room[w] -= size
        else:
            assert w == len(room) and o == 0
            room.append(100 - size)
    assert sum(room) / (100 * len(room)) < 0.02


def test_empty(none):
    assert packing.pack_documents(none, PATH).collect() == []


def test_large_ids_beside_nulls_and_many_equal_rows(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a b"), (None, "c")] + [(7, "same text")] * 60, "doc_id long, text string").coalesce(1)
    got = packing.pack(packing.pieces(df, PATH).cache(), group_pieces=16).collect()
    assert Counter(r["doc_id"] for r in got) == {big: 1, None: 1, 7: 60}
    assert max(Counter(r["sequence_id"] >> 32 for r in got).values()) < 40


def test_ids_equal_the_tokenizer_on_random_strings():
    rng = random.Random(9)
    encoder, tokenizer = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    letters = "abcdeABCDE éÉßñÑ'’.,;:!?-_()[]{}<>|/\\@#$%^&*+=~`\"0123456789\t\n\r\x0b\x0c\x1c\x85\u00a0\u200b日本ΣςǅİıſКж🙂\u0301\ufeff"
    for _ in range(6000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 40)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
