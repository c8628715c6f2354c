"""Text as column expressions: folding, tokens, HTML to text, headers, sections and paragraphs."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented letters of the Latin scripts in use here and what they fold to.
ACCENTED = "áàäâãåéèëêíìïîóòöôõúùüûñçÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"
# The named entities that rulings use.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with `value` computed once a row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_accents(text: Column) -> Column:
    """Lower case without accents for Latin letters, inside the JVM."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


@F.pandas_udf(T.StringType())
def fold_any(texts: pd.Series) -> pd.Series:
    """fold_accents for every script: decomposes and drops all marks."""
    strip = lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn").lower()
    return pd.Series([None if x is None else strip(x) for x in texts], dtype=object)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column) -> Column:
    """Folded, with white space collapsed: the form in which phrases are compared."""
    return collapse(fold_accents(text))


def tokenize(text: Column) -> Column:
    """Lower-case runs of Unicode letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def word_in(text: Column, word: str) -> Column:
    return text.rlike(rf"(?U)\b\Q{word}\E\b")


def _decimal_entities(text: Column) -> Column:
    """`&#N;` as the character N; numbers that are no character stay."""
    number = lambda part: F.regexp_extract(part, r"^&#(\d{1,7});", 1).cast("int")
    character = lambda n: F.decode(F.unhex(F.format_string("%08X", n)), "UTF-32")
    valid = lambda n: (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    decoded = lambda part: F.when(part.rlike(r"^&#\d{1,7};"), F.when(valid(number(part)), F.concat(character(number(part)), F.regexp_replace(part, r"^&#\d{1,7};", ""))).otherwise(part)).otherwise(part)
    return F.array_join(F.transform(F.split(text, r"(?=&#\d{1,7};)"), decoded), "")


def decode_entities(text: Column) -> Column:
    """Named entities of ENTITIES and decimal ones; others stay."""
    out = once(text, lambda t: F.when(t.rlike(r"&#\d{1,7};"), _decimal_entities(t)).otherwise(t))
    for name, value in ENTITIES.items():
        out = F.regexp_replace(out, f"(?i)&{name};", value.replace("$", r"\$"))
    return out


def html_to_text(html: Column, rows: bool = True, cells: bool = True) -> Column:
    """Plain text of a ruling: breaks and closed blocks end lines, a cell after a cell reads `label: value`."""
    blocks = "p|div|li|h[1-6]" + ("|tr" if rows else "")
    steps = [(r"(?i)<\s*br\s*/?\s*>", "\n"), (rf"(?i)</\s*(?:{blocks})\s*>", "\n")]
    if cells:
        steps += [(r"(?i)</\s*td\s*>\s*<\s*td[^>]*>", ": "), (r"(?i)</\s*td\s*>", " ")]
    out = html
    for pattern, value in [*steps, ("<[^>]+>", "")]:
        out = F.regexp_replace(out, pattern, value)
    out = decode_entities(out)
    for pattern, value in [("[ \t \r]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")]:
        out = F.regexp_replace(out, pattern, value)
    return F.btrim(out, F.lit(" \n"))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n+"), lambda p: F.btrim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def first_line(text: Column, min_chars: int = 1) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.try_element_at(F.filter(lines, lambda x: F.length(x) >= min_chars), F.lit(1))


def max_chars(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut at the last space, with a mark of the cut."""
    def cut(whole: Column) -> Column:
        head = F.left(whole, F.lit(limit))
        words = F.regexp_extract(head, r"(?s)^(.+) ", 1)
        return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.when(words == "", head).otherwise(words), F.lit(" […]")))

    return once(text, cut)


def header_fields(text: Column, labels: dict[str, str], lines: int = 80) -> Column:
    """map<canonical label, value> from `label: value` lines among the first non-blank ones; the last of a label wins.

    labels: accepted spelling, folded and without punctuation -> canonical label.
    """
    first = F.slice(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), 1, lines)
    pattern = r"^\s*([\p{L}.\s]{3,40}?)\s*:\s*(.+?)\s*$"
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    folded = lambda x: collapse(F.regexp_replace(fold_accents(F.regexp_extract(x, pattern, 1)), "[.,]", " "))
    entry = lambda x: F.struct(F.try_element_at(known, folded(x)).alias("key"), F.regexp_extract(x, pattern, 2).alias("value"))
    every = F.filter(F.transform(F.filter(first, lambda x: F.contains(x, F.lit(":"))), entry), lambda e: e["key"].isNotNull())
    # A lambda that names the entries themselves would read all lines again for every entry.
    latest = lambda found: F.filter(found, lambda e, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(once(every, latest))


def split_sections(text: Column, headings: dict[str, str]) -> Column:
    """map<name, text from its heading to the next>; headings: name -> pattern at a line's start. The first of a name wins."""
    marked = text
    for name, pattern in headings.items():
        marked = F.regexp_replace(marked, rf"(?imu)^[ \t]*(?={pattern})", f"\u0001{name}\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: F.contains(p, F.lit("\u0002")))
    entries = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\u0002", 1).alias("key"), F.btrim(F.substring_index(p, "\u0002", -1), F.lit(" \t\r\n")).alias("value")))
    first = lambda found: F.filter(found, lambda e, i: ~F.exists(F.slice(found, 1, i), lambda before: before["key"] == e["key"]) | (i == 0))
    return F.map_from_entries(once(entries, first))


def last_with_marker(parts: Column, markers: str, min_chars: int = 50) -> Column:
    """The last paragraph that matches `markers`, else the last one over `min_chars`, else the one before it."""
    hit = lambda ps: F.try_element_at(F.filter(ps, lambda p: p.rlike(markers)), F.lit(-1))
    long = lambda ps, at: F.filter(F.array(F.try_element_at(ps, F.lit(at))), lambda p: F.length(p) > min_chars)
    return once(parts, lambda ps: F.coalesce(hit(ps), F.try_element_at(long(ps, -1), F.lit(1)), F.try_element_at(long(ps, -2), F.lit(1))))


def first_by_marker(parts: Column, markers: list[str]) -> Column:
    """The first paragraph with the first marker that any paragraph has."""
    def first(ps: Column, marker: str) -> Column:
        return F.try_element_at(F.filter(ps, lambda p: p.rlike(marker)), F.lit(1))

    return once(parts, lambda ps: F.coalesce(*(first(ps, m) for m in markers)))


def dedupe_by(values: Column, key) -> Column:
    """Values whose key has not come before, in order."""
    empty = lambda vs: F.struct(F.slice(vs, 1, 0).alias("kept"), F.slice(F.transform(vs, key), 1, 0).alias("seen"))
    step = lambda acc, v: F.when(F.array_contains(acc["seen"], key(v)), acc).otherwise(F.struct(F.array_append(acc["kept"], v).alias("kept"), F.array_append(acc["seen"], key(v)).alias("seen")))
    return once(values, lambda vs: F.aggregate(vs, empty(vs), step, lambda acc: acc["kept"]))


def subject_key(text: Column) -> Column:
    """The first twelve lower-case words: rulings that share it are taken to treat one matter."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-záéíóúñ0-9]+"), F.lit(0))
    return F.array_join(F.slice(words, 1, 12), " ")
