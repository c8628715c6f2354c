"""Quality rules whose cutoffs are certified on labelled documents.

Each stratum gets a path of steps, each of which tightens one rule to one of its cutoffs; the path is drawn from the
labels of all other strata. The stratum's own labels are the holdout: step after step the exact binomial bound has to
say that all rules together, at their cutoffs so far, reject at most `risk` of its good documents. The error level is
divided by the strata, and testing in fixed order needs no more correction, so every stratum's cutoffs hold together
with probability 1 - level. Exact and near copies count as one trial.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.llm.graph import components
from foralia.llm.simhash import fingerprint, links
from foralia.runtime import materialize, table

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Rule -> cutoffs from loosest to strictest; a document is rejected above the cutoff.
RULES: dict[str, list[float]] = {
    "symbol_rate": [3.0, 2.0, 1.5, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "repeat_rate": [0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "dup_line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "shout_rate": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "bang_rate": [2.0, 1.5, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1],
    "word_length": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0],
}
#: Share of the good documents of a stratum that all rules together may reject, and the level at which all bounds hold.
RISK = 0.02
LEVEL = 0.05
#: Bad documents that a path must reject for each good one.
GAIN = 10
#: Strata are languages and the like: their paths go through the driver.
MAX_STRATA = 10_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURED = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, " + ", ".join(f"{r} double" for r in RULES) + ", print long"


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v < 1 << 20:
        codes = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        codes = pairs[:-1].astype(np.int64) * v + ids[2:]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def measure(text: str) -> tuple:
    """The counts and rates of one whole text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = len(SYMBOLS.findall(text))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dups = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    shouts = sum(map(str.isupper, (w for w in text.split() if len(w) > 2)))
    per = max(n, 1)
    failed = n < 50 or 100 * repeats > 50 * n
    return n, chars, symbols, dups, repeats, failed, symbols / per, repeats / per, dups / max(len(lines), 1), shouts / per, text.count("!") / per, chars / per


def _measured(texts: pd.Series) -> pd.DataFrame:
    rows = [measure(x) for x in texts]
    prints = [0 if row[len(COUNTS)] else fingerprint(x) for row, x in zip(rows, texts, strict=True)]
    return pd.DataFrame([(*row, p) for row, p in zip(rows, prints, strict=True)], columns=[*COUNTS, "base_failed", *RULES, "print"])


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """`docs` with _stratum (null: '') and the struct _m of counts, rates and SimHash fingerprint; only texts go to Python."""
    return docs.select("*", F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"), F.pandas_udf(_measured, MEASURED)(F.coalesce("text", F.lit(""))).alias("_m"))


def at_most(k: int, n: int, p: float) -> float:
    """Exact P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 1.0
    i = np.arange(1, k + 1)
    steps = np.log((n - i + 1) / i) + math.log(p / (1 - p))
    return float(min(1.0, np.exp(np.concatenate([[0.0], np.cumsum(steps)]) + n * math.log1p(-p)).sum()))


def draw_path(good: dict[str, np.ndarray], bad: dict[str, np.ndarray]) -> list[tuple[str, int]]:
    """Steps (rule, cutoff number), most gain first, from the documents above each cutoff; a step that loses more than it gains is no step.

    A rule's later cutoffs may gain what its next one does not, so each step goes to the best of all its stricter ones.
    """
    at, path = dict.fromkeys(RULES, -1), []
    while True:
        best, gain = None, 0.0
        for rule, grid in RULES.items():
            g0, b0 = (good[rule][at[rule]], bad[rule][at[rule]]) if at[rule] >= 0 else (0, 0)
            for k in range(at[rule] + 1, len(grid)):
                more = bad[rule][k] - b0 - GAIN * (good[rule][k] - g0)
                if more > 0 and more / (1 + good[rule][k] - g0) > gain:
                    best, gain = (rule, k), more / (1 + good[rule][k] - g0)
        if best is None:
            return path
        path.append(best)
        at[best[0]] = best[1]


def certify(good: list[int], bad: list[int], n_good: int, risk: float, level: float) -> int:
    """Number of steps to take, 0 for none. good, bad: the holdout's documents that each further step rejects.

    The bound of Clopper and Pearson lies at or under `risk` just if P(X <= rejected | risk) is at most `level`; the
    first step without that proof ends the test. Of the certified steps those up to the best gain are taken.
    """
    best, gain, g, b = 0, 0, 0, 0
    for k, (more_good, more_bad) in enumerate(zip(good, bad, strict=True)):
        g, b = g + more_good, b + more_bad
        if at_most(g, n_good, risk) > level:
            break
        if b - GAIN * g > gain:
            best, gain = k + 1, b - GAIN * g
    return best


def trials(measured: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, good, fold, a number per rule) of one labelled document per group of copies that passes the base rules.

    The number says how many of the rule's cutoffs, loosest first, the document passes. Texts whose SimHash fingerprints
    are linked by near_duplicates' rule are copies. Labels with a null doc_id or quality are left out; of several
    labels for a document the best counts. Copies with different labels are one good and one bad trial.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(F.max("quality").alias("_quality"))
    passed = lambda r: F.size(F.filter(F.array(*map(F.lit, RULES[r])), lambda c: F.col(f"_m.{r}") <= c)).alias(r)
    own = measured.where("not _m.base_failed").select("_stratum", F.col("doc_id").cast("long").alias("_doc"), F.col("_m.print").alias("_print"), *map(passed, RULES))
    known = materialize(own.join(marked, "_doc").withColumn("_good", F.col("_quality") > 0), "labelled")
    groups = components(links(known.select(F.col("_print").alias("fp")).distinct()))
    known = known.join(groups, known["_print"] == groups["node"], "left").withColumn("_group", F.coalesce("root", "_print"))
    first = F.min_by(F.struct(*RULES), F.struct(F.xxhash64("_doc"), "_doc", *RULES))
    one = known.groupBy("_stratum", "_group", "_good").agg(first.alias("x"))
    return materialize(one.select(F.col("_stratum").alias("stratum"), F.col("_good").alias("good"), F.pmod(F.xxhash64("_group"), F.lit(2)).alias("fold"), "x.*"), "trials")


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, a cutoff per rule; null where none is certified) from all labelled documents.

    Only counts by stratum and cutoff, and by stratum and step, come to the driver. A single stratum has no others to
    draw its path from: its labels are halved by hash, one half for the path, the other as holdout. See trials for edge cases.
    """
    spark = measured.sparkSession
    known = trials(measured, labels)
    strata = sorted(r["stratum"] for r in known.select("stratum").distinct().limit(MAX_STRATA + 1).collect())
    if len(strata) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    single = len(strata) == 1
    design, holdout = (known.where(f"fold = {k}") if single else known for k in (0, 1))
    above = [F.count_if(F.col(r) <= k).alias(f"{r}_{k}") for r, grid in RULES.items() for k in range(len(grid))]
    rows = design.groupBy("stratum", "good").agg(*above).collect()
    counts = lambda of: {r: np.sum([[x[f"{r}_{k}"] for k in range(len(grid))] for x in of] or [[0] * len(grid)], axis=0) for r, grid in RULES.items()}
    path_of = lambda s: draw_path(*(counts([x for x in rows if x["good"] == good and (single or x["stratum"] != s)]) for good in (True, False)))
    paths = {s: path_of(s) for s in strata}
    steps = [(s, [[_first_step(paths[s], r, n) for n in range(len(grid) + 1)] for r, grid in RULES.items()]) for s in strata]
    form = "stratum string, " + ", ".join(f"{r}_max double" for r in RULES)
    if not steps:
        return spark.createDataFrame([], form)
    table_ = spark.createDataFrame(steps, "stratum string, steps array<array<int>>")
    at = F.least(*(F.get(F.get("steps", F.lit(k)), F.col(r)) for k, r in enumerate(RULES)))
    by_step = holdout.join(table_, "stratum").groupBy("stratum", "good", at.alias("step")).agg(F.count("*").alias("n")).collect()
    found = []
    for s in strata:
        n_good = sum(x["n"] for x in by_step if x["stratum"] == s and x["good"])
        rejected = {good: [0] * len(paths[s]) for good in (True, False)}
        for x in by_step:
            if x["stratum"] == s and x["step"] < len(paths[s]):
                rejected[x["good"]][x["step"]] = x["n"]
        taken = certify(rejected[True], rejected[False], n_good, risk, level / len(strata))
        last = dict(paths[s][:taken])
        found.append((s, *(float(RULES[r][last[r]]) if r in last else None for r in RULES)))
    return spark.createDataFrame(found, form)


def _first_step(path: list[tuple[str, int]], rule: str, passed: int) -> int:
    """Number of the first step that rejects a document which passes only the `passed` loosest cutoffs of a rule; past the end for none."""
    return next((n for n, (r, k) in enumerate(path) if r == rule and k >= passed), len(path))


def _kept(limits: DataFrame) -> Column:
    passed = ~F.col("_m.base_failed")
    for r in RULES:
        passed = passed & F.coalesce(F.col(f"_m.{r}") <= limits[f"{r}_max"], F.lit(True))
    return passed


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(doc_id, counts, base_failed, kept, stratum) for each row of `docs`; a stratum without enough labels rejects by the base rules alone.

    Null and empty texts have no words and fail the base rules; a null stratum is one of its own; rows that repeat are
    judged alike; other columns are ignored, whatever their names; no rows give none.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(stratum).alias("_lang"))
    measured = materialize(features(own, "_lang").drop("text"), "quality")
    limits = cutoffs(measured, labels, risk, level)
    joined = measured.join(limits, measured["_stratum"] == limits["stratum"], "left")
    return joined.select("doc_id", *(F.col(f"_m.{c}").alias(c) for c in (*COUNTS, "base_failed")), _kept(limits).alias("kept"), F.col("_stratum").alias("stratum"))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """The rows of `docs` that judge keeps, with all their columns: measured once and written with their measures, never shuffled."""
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), "text", F.col(stratum).alias("_lang"))
    measured = materialize(features(whole, "_lang").drop("text", "_lang"), "quality")
    limits = cutoffs(measured.drop("_row"), labels, risk, level)
    joined = measured.join(limits, measured["_stratum"] == limits["stratum"], "left").where(_kept(limits))
    return joined.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """One verdict per row of `documents`, calibrated on `labels`; see judge for edge cases."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
