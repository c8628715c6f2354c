import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foralia.llm import importance as im

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SMALL = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(docs, targets, percent, least, buckets, max_run):
    def features(text):
        ws = WORD.findall((text or "").translate(SMALL))
        return [zlib.crc32(" ".join(ws[k : k + n]).encode()) % buckets for n in range(1, max_run + 1) for k in range(len(ws) - n + 1)], len(ws)

    have = [(d, *features(t)) for d, t in docs]
    s, t = Counter(b for _, f, _ in have for b in f), Counter(b for x in targets for b in features(x)[0])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for d, f, n in have:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("percent,least,buckets,max_run", [(10, 20, 10_000, 1), (60, 3, 13, 2), (100, 0, 50, 3), (0, 1, 10, 1)])
def test_equals_a_plain_loop(spark, docs, rows, percent, least, buckets, max_run):
    targets = ["Tax law of the year, TAX ñandú", None, "", "rent rent child"]
    target = spark.createDataFrame([(t, 1) for t in targets], "text string, weight int")
    got = [tuple(r) for r in im.resample(docs, target, percent, least, buckets, max_run).collect()]
    expected = [tuple(r) for r in plain([(r[0], r[1]) for r in rows], targets, percent, least, buckets, max_run)]
    free = lambda rs: sorted((r[:5] for r in rs), key=str)
    assert free(got) == free(expected)
    ranks = lambda rs: sorted((r[5], r[4], str(r[0])) for r in rs if r[5] is not None)  # noqa: E731  repeated rows share a score
    assert ranks(got) == ranks(expected)


def test_no_documents_or_no_target(spark, none, docs, rows):
    target = spark.createDataFrame([("tax law",)], "text string")
    assert im.resample(none, target).count() == 0
    empty = target.where("false")
    assert np.array_equal(im.bucket_counts(empty), np.zeros(im.BUCKETS))
    assert im.resample(docs, empty).count() == len(rows)


def test_words_of_bytes():
    assert im.words_of("ÑandÚ's  A-Z_09 日本語\x00x".encode()) == ["ÑandÚ".encode(), b"s", b"a", b"z", b"09", "日本語".encode(), b"x"]
    assert im.words_of(None) == im.words_of(b"") == []
