"""Manual trees against a loop over each manual's whole text, and as-of lookups by merging against the folded ones."""

import bisect
import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from foralia.operators import asof_merge, manual_tree, temporal

CHAPTER = re.compile(r"^\s*Cap[íi]tulo\s+(\d{1,3}|[IVXLCDM]+)[.\s—:-]+(.+?)\s*$", re.I | re.M)
NUMBERED = re.compile(r"^\s*(\d{1,3}(?:\.\d{1,3}){1,4})\.?\s*[-—]?\s*([A-ZÁÉÍÓÚÜÑ][^\n]{2,150})\s*$", re.M)
LINES = ["Capítulo 1. RENTAS", "CAPÍTULO IV — Ahorro", "capitulo 3: x", "1.1. Concepto", "1.2 Base", "2.1.1.- Reglas", "1.2.3.4. Detalle fino", "1. No", "3.1 minúscula", "Texto normal de la página.", "", "  ", "Otra línea con 1.1 dentro.", "Capítulo 7.", "TÍTULO SUELTO", "A", "ñandú é"]


def plain(pages):
    text, starts, numbers = "", [], []
    for number, page in sorted(pages):
        starts.append(len(text))
        numbers.append(number)
        text += (page or "") + "\n\n"
    page_of = lambda at: numbers[max(0, bisect.bisect_right(starts, at) - 1)]
    found = [(m.start(1), 1, m[1], m[2].strip()) for m in CHAPTER.finditer(text)]
    found = sorted(found + [(m.start(1), 2 if m[1].count(".") == 1 else 3, m[1], m[2].strip()) for m in NUMBERED.finditer(text)], key=lambda f: f[:2])
    if not found:
        return [(-1, "root", "", "(sin estructura jerárquica detectada)", numbers[0], text.strip())], page_of
    ends = [f[0] for f in found[1:]] + [len(text)]
    return [(s, {1: "capitulo", 2: "seccion", 3: "subseccion"}[r], n, t, page_of(s), text[s + len(t) : e].strip()) for (s, r, n, t), e in zip(found, ends)], page_of


def plain_leaves(elements):
    rank = {"root": 0, "capitulo": 1, "seccion": 2, "subseccion": 3}
    out, stack = [], []
    for k, e in enumerate(elements):
        while stack and rank[stack[-1][1]] >= rank[e[1]]:
            stack.pop()
        parent = k + 1 < len(elements) and rank[elements[k + 1][1]] > rank[e[1]] > 0
        over = {s[1]: (s[2], s[3]) for s in stack}
        if e[5] or not parent and e[1] != "root":
            out.append((e[0], e[3] + " (preámbulo)" * parent, e[5], over.get("capitulo"), over.get("seccion"), over.get("subseccion")))
        stack.append(e)
    return out


def manuals(rng, n):
    out = {}
    for k in range(n):
        pages = ["\n".join(rng.choices(LINES, k=rng.randint(0, 6))) for _ in range(rng.randint(1, 6))]
        out[k] = [(3 * p + 1, None if rng.random() < 0.05 else t) for p, t in enumerate(pages)]
    return out


def broken(pages):
    """What page-wise reading does not see: a heading cut off from its title by an empty page or by one of a single line."""
    texts = [p or "" for _, p in sorted(pages)]
    return any(len(t.strip().split("\n")) < 2 for t in texts)


def test_trees_and_leaves_equal_reading_the_whole_text(spark):
    made = {k: v for k, v in manuals(random.Random(6), 150).items() if not broken(v)} | {1000: [(1, "Sólo texto."), (2, "Más.")], 1001: [(1, "Capítulo 1.\n"), (2, "\nSEGUNDA\nTexto")]}
    rows = [(k, n, t) for k, pages in made.items() for n, t in pages]
    frame = spark.createDataFrame(rows, "manual int, page_number int, text string").repartition(5)
    found = manual_tree.elements(frame, ["manual"])
    got = {}
    for r in found.orderBy("manual", "start", F.expr("array_position(array('root', 'capitulo', 'seccion', 'subseccion'), kind)")).collect():
        got.setdefault(r["manual"], []).append((r["start"], r["kind"], r["numbering"], r["title"], r["page_start"], r["body"]))
    for k, pages in made.items():
        want = plain(pages)[0]
        assert got[k] == want, repr([(pages, a, b) for a, b in zip(got[k], want) if a != b][:1])
    assert set(got) == set(made)
    tops = {}
    for r in manual_tree.leaves(found, ["manual"]).orderBy("manual", "leaf").collect():
        tops.setdefault(r["manual"], []).append((r["start"], r["title"], r["body"], *(tuple(r[c]) if r[c] else None for c in manual_tree.RANK)))
    assert tops == {k: e for k, pages in made.items() if (e := plain_leaves(plain(pages)[0]))}


def test_parts_know_the_page_they_begin_on(spark):
    word = lambda n, tag: " ".join([tag] * n)
    pages = [(1, "Capítulo 1. A\n\n" + word(500, "uno") + "\n\n" + word(450, "dos")), (2, word(420, "tres") + "\n\n" + word(450, "dos")), (3, "1.1. Fin corto\n\nfin")]
    frame = spark.createDataFrame([(7, n, t) for n, t in pages], "manual int, page_number int, text string")
    tree = manual_tree.leaves(manual_tree.elements(frame, ["manual"]), ["manual"])
    got = [(r["content"].split()[-1], r["page_number"]) for r in manual_tree.parts(tree, manual_tree.page_index(frame, ["manual"]), ["manual"]).orderBy("leaf", "part").collect()]
    assert got == [("uno", 1), ("dos", 1), ("tres", 2), ("dos", 2), ("fin", 3)] or got[:4] == [("uno", 1), ("dos", 1), ("tres", 2), ("1.1.", 2)], got


def test_no_pages(spark):
    none = spark.createDataFrame([], "manual int, page_number int, text string")
    assert manual_tree.elements(none, ["manual"]).count() == 0


def day(n):
    return date(2020, 1, 1) + timedelta(days=n)


def test_merging_equals_folding(spark):
    rng = random.Random(1)
    versions = []
    for key in (1, 2, None):
        at = 0
        for _ in range(30):
            start = at + rng.randint(0, 5)
            end = start + rng.randint(0, 5)
            versions.append((key, day(start), None if rng.random() < 0.1 else day(end), f"v{start}"))
            at = (end if versions[-1][2] else end) + 1
    last_open = {}
    versions = [v for v in versions if v[2] is not None or not last_open.setdefault(v[0], False)]
    versions = [(k, s, e or s, n) for k, s, e, n in versions] + [(3, None, day(4), "open start"), (3, day(9), None, "open end")]
    facts = [(rng.choice([1, 2, 3, 4, None]), rng.choice([None, *map(day, range(-3, 200))]), k, "clash") for k in range(400)] + [(1, day(7), 5, "clash")] * 3
    v = spark.createDataFrame(versions, "key int, effective_from date, effective_to date, status string").repartition(3)
    f = spark.createDataFrame(facts, "key int, day date, n int, status string").repartition(4)
    rows = lambda df: sorted(map(str, df.select("key", "day", "n", "status", "version.effective_from", F.col("version.status").alias("s")).collect()))
    assert rows(asof_merge.as_of_merge(f, v, ["key"], "day")) == rows(temporal.as_of_join(f, v, ["key"], "day"))
    assert asof_merge.as_of_merge(f, v.where("false"), ["key"], "day").where("version is null").count() == len(facts)
    assert asof_merge.as_of_merge(f.where("false"), v, ["key"], "day").count() == 0


def test_one_key_with_a_million_versions(spark):
    n = 1_000_000
    versions = spark.range(n).select(F.lit("hot").alias("key"), (F.col("id") * 2).alias("start"), (F.col("id") * 2).alias("stop"), F.col("id").alias("version_no"))
    facts = spark.range(0, 2 * n, 7).select(F.lit("hot").alias("key"), F.col("id").alias("at"))
    got = asof_merge.as_of_merge(facts, versions, ["key"], "at", "start", "stop")
    wrong = got.where(~F.col("version.version_no").eqNullSafe(F.when(F.col("at") % 2 == 0, F.floor(F.col("at") / 2))))
    assert got.count() == len(range(0, 2 * n, 7)) and wrong.isEmpty()
