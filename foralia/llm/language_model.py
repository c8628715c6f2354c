"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, history). Features are hashes of the preceding word, the pair
of preceding words, and the second and third word back (skips). The most frequent words fill classes of a softmax of
their own; every other word belongs to a class by its last letters, and within it follows a path of digits of its hash: each
digit is a softmax after the preceding word, whose bias is the exact count of what lies behind the digit; words at the end of
one path have their shares by count. Paths grow with the vocabulary without bound. Tasks train on
their partition by sparse gradient steps, starting from shared weights; the weighted mean of their weights starts the
next round. Counts of all words stay in a table: only a bounded head of it is ever sent to the tasks.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.runtime import materialize, table

END = ""
HEAD_CLASSES = 16
CLASS_WORDS = 32
TAIL_CLASSES = 16
CLASSES = HEAD_CLASSES + TAIL_CLASSES
#: Most frequent words whose counts every task holds; counts of the others are joined.
HEAD_WORDS = 100_000
#: Characters of text that a task holds as tokens at a time.
SLICE = 1 << 20
#: Distinct words after which a task hands on its partial counts.
FLUSH = 300_000
#: Hashed feature tables have a row of single words for so many distinct words, within bounds: what is sent to every task
#: and what every task hands on stays under 10 MB however large the corpus is. Tables of 32,768 rows made 19 MB of weights a task.
WORDS_A_ROW, LEAST_ROWS, MOST_ROWS = 256, 1 << 12, 1 << 13
#: Bits of a digit of a path, and what each weight's squared gradients start from there: rows of paths are shared by many words.
DIGIT, PATH_SQUARES = 5, 8.0
ROUNDS = 2
#: Tokens of a gradient step: a task begins with small steps and doubles them, so that small partitions learn too.
FIRST_BATCH, BATCH = 128, 16384
#: Step width, and what each weight's squared gradients start from: rare features move little on their first tokens.
RATE, SQUARES = 0.8, 4.0
#: A corpus with fewer training tokens is read again, up to MOST_PASSES times, until so many have been seen.
LEAST_TOKENS, MOST_PASSES = 100_000, 4
PIECES = 32
FAN_IN = 64
HELD_OUT = 2


def tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()


def held_out(doc_id: str | Column) -> Column:
    """crc32 of doc_id as text, modulo 7, is 2; never for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == HELD_OUT, F.lit(False))


def tail_class(word: bytes) -> int:
    """By the last three bytes: endings tell languages and parts of speech apart."""
    return HEAD_CLASSES + zlib.crc32(word[-3:]) % TAIL_CLASSES


def _counted(found: Counter) -> pd.DataFrame:
    return pd.DataFrame({"token": np.array([w.decode() for w in found], object), "n": np.array(list(found.values()), np.int64)})


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over whole texts; the end of each text counts as token ''."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(tokens(text or ""))
            found[b""] += len(batch)
            if len(found) > FLUSH:
                yield _counted(found)
                found.clear()
        yield _counted(found)

    return docs.select("text").mapInPandas(partial, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Rows:
    """Rows of the hashed tables: of one preceding word, of pairs, of words within a class and of paths; digits of a path. They follow the vocabulary."""

    short: int = LEAST_ROWS
    pair: int = 2 * LEAST_ROWS
    inner: int = 2 * LEAST_ROWS
    path: int = 2 * LEAST_ROWS
    digits: int = 1

    @staticmethod
    def of(n_words: int) -> Rows:
        """A row per WORDS_A_ROW distinct words, in powers of two, from LEAST_ROWS, and but for paths to MOST_ROWS.

        Paths are as long as their ends have WORDS_A_ROW / TAIL_CLASSES words or more each.
        """
        bits = max(0, n_words // WORDS_A_ROW).bit_length()
        short = min(MOST_ROWS, max(LEAST_ROWS, 1 << bits))
        return Rows(short, 2 * short, 2 * short, max(2 * LEAST_ROWS, 1 << bits), min(32 // DIGIT, max(1, (bits - 1) // DIGIT)))


@dataclass
class Vocabulary:
    """Head counts (bounded), the places of the softmax words, and each tail class's tokens and words."""

    counts: dict[bytes, int]
    places: dict[bytes, int]
    tail: np.ndarray
    #: Rows of the feature tables.
    rows: Rows
    #: Each tail class's counts and words, added, by where paths end.
    ends: np.ndarray
    #: Tells fits apart: workers keep what they derive from a vocabulary under this name.
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def denominators(self) -> np.ndarray:
        return self.tail.sum(axis=1) + 1.0


@dataclass
class Weights:
    outer: np.ndarray
    inner: np.ndarray
    outer_bias: np.ndarray
    inner_bias: np.ndarray
    path: np.ndarray

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.outer, self.inner, self.outer_bias, self.inner_bias, self.path)])

    @staticmethod
    def unpack(flat: np.ndarray, rows: Rows) -> Weights:
        shapes = [(3 * rows.short + rows.pair, CLASSES), (2 * rows.inner, CLASS_WORDS), (CLASSES,), (HEAD_CLASSES, CLASS_WORDS), (rows.path, 1 << DIGIT)]
        at = np.cumsum([0, *map(math.prod, shapes)])
        return Weights(*(flat[a:b].reshape(s).copy() for a, b, s in zip(at, at[1:], shapes, strict=False)))


class Lookup:
    """Arrays (class, place in class, feature hash, log10(count + 1) or nan) of a text's words: the head's by a table, others computed."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        words = [b"\n", *vocabulary.counts]
        self.rows = {w: k for k, w in enumerate(words)}
        places = np.array([vocabulary.places.get(w, -1) for w in words])
        self.cls = np.array([tail_class(w) if p < 0 else p // CLASS_WORDS for w, p in zip(words, places.tolist(), strict=True)], np.int16)
        self.place = np.where(places < 0, -1, places % CLASS_WORDS).astype(np.int16)
        self.hash = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.log_count = np.array([math.nan, *(math.log10(n + 1) for n in vocabulary.counts.values())])
        masses = [vocabulary.ends.reshape(-1, 1 << DIGIT, (1 << DIGIT) ** k).sum(axis=2) for k in reversed(range(vocabulary.rows.digits))]
        #: By the digit's place: bias of each digit after those before it.
        self.path_bias = [np.where(m > 0, np.log(np.maximum(m, 1)), -1e4).astype(np.float32) for m in masses]
        #: log10 of a known word's class by itself, and of where its path ends.
        self.log_class, self.log_end = (np.log10(np.maximum(x, 1)) for x in (vocabulary.ends.sum(axis=1), vocabulary.ends))

    def path(self, hashes: np.ndarray, at: np.ndarray, cls: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bias, row of the path weights, digit) of the tail words at `at`, digit by digit."""
        rows = self.vocabulary.rows
        code, one = hashes[at] >> np.uint32(32 - DIGIT * rows.digits), hashes[at - 1]
        node = cls.astype(np.uint32) - np.uint32(HEAD_CLASSES)
        for k in range(rows.digits):
            digit = code >> np.uint32(DIGIT * (rows.digits - 1 - k)) & np.uint32((1 << DIGIT) - 1)
            row = ((one + (node * np.uint32(8) + np.uint32(k)) * np.uint32(40503)) * np.uint32(2654435761) >> np.uint32(9)) & np.uint32(rows.path - 1)
            yield self.path_bias[k][node], row.astype(np.int64)[:, None], digit.astype(np.int64)
            node = node * np.uint32(1 << DIGIT) + digit

    def end(self, hashes: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a known word's class less that of its path's end: with the path's probabilities it makes shares of the class into shares of the end."""
        c = cls.astype(np.int64) - HEAD_CLASSES
        return self.log_class[c] - self.log_end[c, hashes >> np.uint32(32 - DIGIT * self.vocabulary.rows.digits)]

    def encode(self, texts) -> tuple:
        """(class, place, hash, log count, where real tokens are, text sizes, words, rare): all texts in a row, each led by
        three start marks and closed by its end; rare holds the numbers of the tokens that the head lacks."""
        words: list[bytes] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = tokens(text or "")
            words += (b"\n", b"\n", b"\n", *own, b"")
            sizes[k] = len(own) + 1
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        cls, place, hashes, logs = self.cls[rows], self.place[rows], self.hash[rows], self.log_count[rows]
        rare = np.nonzero(rows < 0)[0]
        found = [words[k] for k in rare.tolist()]
        cls[rare], place[rare], logs[rare] = [tail_class(w) for w in found], -1, math.nan
        hashes[rare] = [zlib.crc32(w) for w in found]
        at = np.repeat(np.cumsum(sizes + 3) - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        return cls, place, hashes, logs, at, sizes, words, rare


def features(hashes: np.ndarray, at: np.ndarray, cls: np.ndarray, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the outer and inner weights that are on, for the tokens at `at`; tables have powers of two of rows."""
    short, pairs, inner_rows = (np.uint32(n - 1) for n in (rows.short, rows.pair, rows.inner))
    one, two, three = hashes[at - 1], hashes[at - 2], hashes[at - 3]
    pair = (one * np.uint32(2654435761) + two * np.uint32(2246822519)) >> np.uint32(9)
    outer = np.stack([one & short, (two & short) + np.uint32(rows.short), (three & short) + np.uint32(2 * rows.short), (pair & pairs) + np.uint32(3 * rows.short)], axis=1)
    salt = cls.astype(np.uint32) * np.uint32(40503)
    near = ((one + salt) * np.uint32(2654435761) >> np.uint32(9)) & inner_rows
    far = ((two + salt) * np.uint32(2246822519) >> np.uint32(9)) & inner_rows
    return outer.astype(np.int64), np.stack([near, far + np.uint32(rows.inner)], axis=1).astype(np.int64)


def probabilities(weights: np.ndarray, bias: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Softmax rows of the summed weights; exponents are kept under float32's limit instead of shifted by their maximum."""
    logits = np.take(weights, on[:, 0], axis=0)
    logits += bias
    for k in range(1, on.shape[1]):
        logits += np.take(weights, on[:, k], axis=0)
    np.exp(np.minimum(logits, 80, out=logits), out=logits)
    logits /= (logits @ np.ones((logits.shape[1], 1), np.float32)) + np.float32(1e-30)
    return logits


def row_sums(rows: np.ndarray, error: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct `rows` (under n_rows) in order and the sum of each one's lines of `error`, an even number of float32.

    Row numbers of 16 bits are sorted by radix, and lines are added as complex numbers: two floats at a time.
    """
    order = np.argsort(rows.astype(np.uint16) if n_rows <= 1 << 16 else rows, kind="stable")
    rows = rows[order]
    first = np.concatenate([[0], np.nonzero(np.diff(rows))[0] + 1])
    return rows[first], np.add.reduceat(np.take(error, order, axis=0).view(np.complex64), first, axis=0).view(np.float32)


class Trainer:
    """Sparse Adagrad steps on one softmax level."""

    def __init__(self, weights: np.ndarray, squares: float = SQUARES) -> None:
        self.weights, self.squares = weights, np.full(weights.shape, squares, np.float32)

    def step(self, bias: np.ndarray, on: np.ndarray, truth: np.ndarray) -> None:
        error = probabilities(self.weights, bias, on)
        error[np.arange(len(truth)), truth] -= 1
        for k in range(on.shape[1]):
            rows, gradient = row_sums(on[:, k], error, len(self.weights))
            squares = np.take(self.squares, rows, axis=0)
            squares += gradient * gradient
            self.squares[rows] = squares
            gradient *= np.float32(RATE)
            gradient /= np.sqrt(squares, out=squares)
            self.weights[rows] -= gradient


def small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about SLICE characters of text, whatever the size of Arrow's batches."""
    for batch in batches:
        turn = (batch["text"].str.len().fillna(0).cumsum() // SLICE).to_numpy()
        for k in np.unique(turn):
            yield batch[turn == k]


def train_task(batches: Iterator[pd.DataFrame], start: Weights, lookup: Lookup) -> Iterator[pd.DataFrame]:
    """The task's weights after one pass, in PIECES rows (piece, part, n, weights)."""
    rows = lookup.vocabulary.rows
    weights = Weights.unpack(start.pack(), rows)
    outer, inner, path = Trainer(weights.outer), Trainer(weights.inner), Trainer(weights.path, PATH_SQUARES)
    seen, steps, size = 0, 0, FIRST_BATCH
    for batch in small(batches):
        cls, place, hashes, _, at, _, _, _ = lookup.encode(batch["text"])
        seen += len(at)
        a = 0
        while a < len(at):
            here = at[a : a + size]
            a, size = a + size, min(BATCH, 2 * size if steps % 4 == 3 else size)
            steps += 1
            on, on_inner = features(hashes, here, cls[here], rows)
            outer.step(weights.outer_bias, on, cls[here])
            head = place[here] >= 0
            if head.any():
                c = cls[here][head]
                inner.step(weights.inner_bias[c], on_inner[head], place[here][head])
            tail = here[~head]
            if len(tail):
                for bias, on, digit in lookup.path(hashes, tail, cls[tail]):
                    path.step(bias, on, digit)
    if seen:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield pd.DataFrame({"piece": range(PIECES), "part": part, "n": seen, "weights": [x.astype("<f2").tobytes() for x in np.array_split(weights.pack(), PIECES)]})


STATE = "piece int, part int, n long, weights binary"


def mean_weights(frame: pd.DataFrame) -> pd.DataFrame:
    total = frame["n"].sum()
    mean = sum(np.frombuffer(w, "<f2").astype(np.float32) * (n / total) for w, n in zip(frame["weights"], frame["n"], strict=True))
    return pd.DataFrame({"piece": [frame["piece"].iloc[0]], "part": [frame["part"].min() // FAN_IN], "n": [total], "weights": [mean.astype("<f2").tobytes()]})


def train(docs: DataFrame, vocabulary: Vocabulary, start: Weights, n_tokens: int, rounds: int = ROUNDS) -> Weights:
    """Every training text once a pass: round r takes those whose crc32 / 7 leaves r modulo `rounds`."""
    spark = docs.sparkSession
    turn = F.coalesce(F.pmod(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 7), F.lit(rounds)), F.lit(0))
    weights = start
    passes = max(1, min(MOST_PASSES, math.ceil(LEAST_TOKENS / max(n_tokens, 1))))
    for r in [*range(rounds)] * passes:
        shared = spark.sparkContext.broadcast((vocabulary, weights))
        trained = materialize(docs.where(turn == r).select("text").mapInPandas(lambda it, s=shared: train_task(it, s.value[1], shared_lookup(s)), STATE), "weights")
        parts = (trained.agg(F.max("part")).first()[0] or 0) + 1
        while True:
            trained = trained.groupBy("piece", F.floor(F.col("part") / FAN_IN)).applyInPandas(mean_weights, STATE)
            if parts <= FAN_IN:
                break
            trained, parts = materialize(trained, "weights"), -(-parts // FAN_IN)
        state = trained.collect()
        if state:
            weights = Weights.unpack(np.concatenate([np.frombuffer(x["weights"], "<f2").astype(np.float32) for x in sorted(state, key=lambda x: x["piece"])]), vocabulary.rows)
    return weights


_lookups: dict = {}


def shared_lookup(shared) -> Lookup:
    """One lookup a worker process and fit: a worker that is used again by another fit drops the old one."""
    key = shared.value[0].name
    if key not in _lookups:
        _lookups.clear()
        _lookups[key] = Lookup(shared.value[0])
    return _lookups[key]


def vocabulary_of(counts: DataFrame, head_words: int = HEAD_WORDS) -> tuple[Vocabulary, Weights]:
    """The bounded head of `counts` and the untrained model: log frequencies of classes and of words in their class."""
    v, least = counts.count(), 0
    if v > head_words:  # else each task would send its own head_words rows to the driver
        least = counts.agg(F.percentile_approx("n", 1 - head_words / v, 100_000)).first()[0]
    often = counts.where((F.col("n") > least) | (F.col("token") == END))
    top = often.orderBy(F.col("token") != END, F.desc("n"), "token").limit(head_words).collect()
    inside = top[: HEAD_CLASSES * CLASS_WORDS]
    places = {r["token"].encode(): k for k, r in enumerate(inside)}
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(r["token"],) for r in inside], "token string")), "token", "left_anti")
    rows = Rows.of(v)
    by_class = F.crc32(F.expr("substring(encode(token, 'UTF-8'), -3, 3)")) % TAIL_CLASSES
    end = F.shiftrightunsigned(F.crc32(F.encode("token", "UTF-8")), 32 - DIGIT * rows.digits)
    found = rest.groupBy(by_class.alias("c"), end.alias("end")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()
    c, at, n, words = (found.column(x).to_numpy() for x in ("c", "end", "n", "v"))
    ends = np.zeros((TAIL_CLASSES, 1 << DIGIT * rows.digits))
    ends[c, at] = n + words
    tail = np.stack([np.bincount(c, x, TAIL_CLASSES) for x in (n, words)], axis=1)
    head = np.zeros(HEAD_CLASSES * CLASS_WORDS)
    head[: len(inside)] = [r["n"] for r in inside]
    head = head.reshape(HEAD_CLASSES, CLASS_WORDS)
    mass = np.concatenate([head.sum(axis=1), tail[:, 0]])
    never = np.concatenate([head.sum(axis=1) == 0, np.zeros(TAIL_CLASSES, bool)])
    outer_bias = np.where(never, -1e4, np.log((mass + 1) / (mass.sum() + CLASSES))).astype(np.float32)
    inner_bias = np.where(head > 0, np.log(np.maximum(head, 1) / np.maximum(head.sum(axis=1, keepdims=True), 1)), -1e4).astype(np.float32)
    zeros = [np.zeros(shape, np.float32) for shape in ((3 * rows.short + rows.pair, CLASSES), (2 * rows.inner, CLASS_WORDS), (rows.path, 1 << DIGIT))]
    start = Weights(zeros[0], zeros[1], outer_bias, inner_bias, zeros[2])
    return Vocabulary({r["token"].encode(): r["n"] for r in top}, places, tail, rows, ends), start


SCORED = "row long, doc_id string, held_out boolean, n_tokens long, n_known long, head_sum double, model_sum double, tail array<struct<token string, gain double>>"


def score_task(batches: Iterator[pd.DataFrame], weights: Weights, lookup: Lookup) -> Iterator[pd.DataFrame]:
    """Per text: sums that need no counts beyond the head, and the words whose counts are still to be joined, with what the model adds where they are known."""
    part, done = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0
    denominators = np.log10(lookup.vocabulary.denominators())
    for batch in small(batches):
        cls, place, hashes, logs, at, sizes, words, rare = lookup.encode(batch["text"])
        logs = logs[at]
        value, gain = np.zeros(len(at)), np.zeros(len(at))
        for a in range(0, len(at), BATCH):
            here = at[a : a + BATCH]
            on, on_inner = features(hashes, here, cls[here], lookup.vocabulary.rows)
            c, w = cls[here], place[here]
            p = np.log10(np.maximum(probabilities(weights.outer, weights.outer_bias, on)[np.arange(len(here)), c], 1e-30)).astype(np.float64)
            head = w >= 0
            if head.any():
                p[head] += np.log10(np.maximum(probabilities(weights.inner, weights.inner_bias[c[head]], on_inner[head])[np.arange(head.sum()), w[head]], 1e-30))
            p[~head] -= denominators[c[~head] - HEAD_CLASSES]
            value[a : a + BATCH] = p
            tail = here[~head]
            if len(tail):
                gains = lookup.end(hashes[tail], cls[tail])
                for bias, on, digit in lookup.path(hashes, tail, cls[tail]):
                    gains += np.log10(np.maximum(probabilities(weights.path, bias, on)[np.arange(len(tail)), digit], 1e-30))
                gain[a : a + BATCH][~head] = gains
        known = ~np.isnan(logs)
        logs = np.where(known, logs, 0.0)
        value += np.where(place[at] < 0, logs, 0.0) + np.where(known, gain, 0.0)
        starts = np.cumsum(sizes) - sizes
        total = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
        cuts = np.searchsorted(rare, np.cumsum(sizes + 3)[:-1])
        rare_gain = gain[np.searchsorted(at, rare)]
        missing = [[{"token": words[k].decode(), "gain": g} for k, g in zip(own.tolist(), its.tolist(), strict=True)] for own, its in zip(np.split(rare, cuts), np.split(rare_gain, cuts), strict=True)] if len(sizes) else []
        yield pd.DataFrame({
            "row": part + done + np.arange(len(sizes)), "doc_id": batch["doc_id"].array, "held_out": batch["held_out"].array, "n_tokens": sizes,
            "n_known": total((known & (logs > 0)).astype(np.int64)).astype(np.int64), "head_sum": total(logs), "model_sum": total(value), "tail": missing,
        })
        done += len(sizes)


def score_documents(docs: DataFrame, head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of `docs` (doc_id, text).

    Null text is empty: its end alone is scored. Rows that repeat are trained on and scored each; a null doc_id is in
    training; without training text every token has count zero; other columns are ignored. Scores are log10
    probabilities of the whole text. Tasks train on their partition, so another partitioning changes the fourth decimal.
    Ids travel through Python as text, so those of any size and nulls stay as they are.
    """
    spark = docs.sparkSession
    marked = docs.select(F.col("doc_id").cast("long").cast("string"), F.coalesce("text", F.lit("")).alias("text"), held_out("doc_id").alias("held_out"))
    training = marked.where(~F.col("held_out"))
    counts = materialize(word_counts(training), "counts").where("n > 0")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    vocabulary, start = vocabulary_of(counts, head_words)
    weights = train(training, vocabulary, start, totals["n"])
    shared = spark.sparkContext.broadcast((vocabulary, weights))
    scored = materialize(marked.mapInPandas(lambda it: score_task(it, shared.value[1], shared_lookup(shared)), SCORED), "scored")
    missing = scored.select("row", F.inline("tail")).join(counts, "token")
    missing = missing.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("tail_sum"), F.sum("gain").alias("tail_gain"), F.count("*").alias("tail_known"))
    whole = scored.drop("tail").join(missing, "row", "left")
    tail_sum = F.coalesce("tail_sum", F.lit(0.0))
    base = F.col("head_sum") + tail_sum - F.col("n_tokens") * math.log10(totals["n"] + totals["v"] + 1)
    return whole.select(
        F.col("doc_id").cast("long"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(totals["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model_sum") + tail_sum + F.coalesce("tail_gain", F.lit(0.0))).alias("score"),
    )


def op2_language_model(spark, sf_dir: str) -> DataFrame:
    """Scores of all `documents`; see score_documents for edge cases."""
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
