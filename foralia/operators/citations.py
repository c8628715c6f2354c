"""Citations in texts: found with their places, tied to norms, and checked against catalogues.

Only the search runs in Python, in Arrow batches, because regular expressions in SQL return no places; each text's
citations are an array, and all that follows is array expressions and equi-joins.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foralia.functions.ids import article_key
from foralia.functions.text import once
from foralia.operators.temporal import timelines
from foralia.runtime import spread

# Short names of laws and their gazette ids.
ALIASES = {
    "lirpf": "BOE-A-2006-20764", "ley 35/2006": "BOE-A-2006-20764", "lis": "BOE-A-2014-12328", "ley 27/2014": "BOE-A-2014-12328",
    "liva": "BOE-A-1992-28740", "ley 37/1992": "BOE-A-1992-28740", "lgt": "BOE-A-2003-23186", "ley 58/2003": "BOE-A-2003-23186",
    "lisd": "BOE-A-1987-28141", "ley 29/1987": "BOE-A-1987-28141", "lip": "BOE-A-1991-14392", "ley 19/1991": "BOE-A-1991-14392", "ley 49/2002": "BOE-A-2002-25039",
}
# Prefixes of regional gazettes.
REGIONAL = ("BOCM", "DOGC", "DOCV", "BOJA", "BOPV", "BOB", "BOG", "BOTHA", "BON", "DOG", "BOC", "BORM", "BOIB", "BOCYL", "DOCM", "BOPA", "DOE", "BOR", "BOA")
#: A norm within so many characters of an article is the article's norm; a bare court name so near an identifier is dropped.
WINDOW = 80
FIRST_YEAR = 1960

_I = re.IGNORECASE
# The forms searched for, in order; (kind, family, pattern, whether later forms may not overlap it, what a text without it cannot hold).
FORMS = (
    ("boe_state", None, re.compile(r"\bBOE-A-\d{4}-\d+\b"), True, "BOE-A-"),
    ("boe_regional", None, re.compile(rf"\b(?:{'|'.join(REGIONAL)})-\d{{4}}-\d+\b"), True, "-"),
    ("alias", None, re.compile(rf"\b({'|'.join(sorted(map(re.escape, ALIASES), key=len, reverse=True))})\b", _I), True, ""),
    ("law_reference", None, re.compile(r"\b(Ley|Real\s+Decreto-?Ley|Real\s+Decreto|RDL|RDLeg|RD)\s+(\d+)\s*/\s*(\d{4})\b", _I), True, "/"),
    ("article", None, re.compile(r"\bart(?:[íi]culo|\.|\s)\s*(\d+)\s*(bis|ter|quater|quinquies|sexies)?\s*(?:\.\s*(\d+))?", _I), False, ""),
    ("jurisprudence", "ECLI", re.compile(r"\bECLI:ES:[A-Z]+[A-Z0-9]*:\d{4}:[A-Z0-9.]+(?:[:.][A-Z0-9]+)?\b", _I), True, ":"),
    ("jurisprudence", "DGT", re.compile(r"(?<![A-Za-z])V\d{1,5}-\d{2,4}\b"), True, "V"),
    ("jurisprudence", "TEAC", re.compile(r"\bR\.?\s*G\.?[\.:/\s]+\d{1,7}\s*/\s*\d{2,4}\b", _I), True, "/"),
    ("jurisprudence", "TEAC", re.compile(r"\b\d{1,2}/\d{1,7}/\d{4}(?:/\d{1,3})?(?:/\d{1,3})?\b"), True, "/"),
    ("jurisprudence", None, re.compile(r"\b(STS|STC|SAN|STSJ|TEAC|DGT|TJUE|consulta\s+DGT)\b(?:\s+(V?\d+(?:[\-/]\d{2,4})?))?", _I), False, ""),
)

CITATION = T.StructType([T.StructField(n, T.IntegerType() if n in ("start", "stop") else T.StringType()) for n in ("kind", "raw", "start", "stop", "boe_id", "article", "suffix", "paragraph", "label", "family", "ref", "canonical")])


def _canonical(family: str | None, raw: str) -> str | None:
    digits = [int(x) for x in re.findall(r"\d+", raw)]
    match family:
        case "ECLI":
            return raw.upper()
        case "DGT":
            return f"V{digits[0]:04d}-{digits[1] % 100:02d}"
        case "TEAC":
            head = digits if raw[:1].isdigit() else [0, *digits]
            year = head[2] if head[2] >= 100 else 2000 + head[2]
            return "/".join([f"{head[0]:02d}/{head[1]:05d}/{year:04d}", *raw.split("/")[3:]])
    return None


def find(text: str, dates_as_claims: bool = True) -> list[tuple]:
    """All citations of a text by place; see FORMS. With dates_as_claims=False a plain date is no claim number.

    A court named without a number within WINDOW characters of a ruling's identifier says nothing more and is dropped.
    """
    out, taken = [], []
    for kind, family, pattern, covers, needed in FORMS:
        for m in pattern.finditer(text) if needed in text else ():
            a, b = m.span()
            if any(x <= a and b <= y for x, y in taken):
                continue
            raw, boe, article, suffix, paragraph, label, ref = m[0], None, None, None, None, None, None
            own = family
            if not dates_as_claims and family == "TEAC" and re.fullmatch(r"(0?[1-9]|[12]\d|3[01])/(0?[1-9]|1[0-2])/(19|20)\d\d", raw):
                continue
            if kind in ("boe_state", "boe_regional"):
                boe = raw
            elif kind == "alias":
                label, boe = m[1], ALIASES[" ".join(m[1].lower().split())] if " ".join(m[1].lower().split()) in ALIASES else None
            elif kind == "law_reference":
                label, boe = f"{m[1]} {m[2]}/{m[3]}", ALIASES.get(f"ley {m[2]}/{m[3]}")
            elif kind == "article":
                article, suffix, paragraph = m[1], m[2] and m[2].lower(), m[3]
            elif family:
                ref = raw
            else:
                own, ref = m[1].upper().replace(" ", "_"), m[2]
            out.append((kind, raw, a, b, boe, article, suffix, paragraph, label, own, ref, _canonical(family, raw)))
            if covers:
                taken.append((a, b))
    if len(out) < 2:
        return out
    named = [(c[2], c[3]) for c in out if c[11] is not None]
    near = lambda a, b: any(max(a, x) - min(b, y) <= WINDOW for x, y in named)
    bare = lambda c: c[0] == "jurisprudence" and c[11] is None and c[10] is None
    return sorted((c for c in out if not (bare(c) and near(c[2], c[3]))), key=lambda c: c[2])


def extract(texts: DataFrame, text: str = "text", dates_as_claims: bool = True) -> DataFrame:
    """Adds `citations`, an array in order of place; null text has none. Bare court names near an identifier are dropped."""

    @F.arrow_udf(T.ArrayType(CITATION))
    def search(values: pa.Array) -> pa.Array:
        found = [find(v, dates_as_claims) for v in values.to_pylist()]
        offsets = [0]
        for its in found:
            offsets.append(offsets[-1] + len(its))
        columns = list(zip(*chain.from_iterable(found), strict=True)) or [()] * len(CITATION)
        fields = [pa.array(x, pa.int32() if f.dataType == T.IntegerType() else pa.string()) for x, f in zip(columns, CITATION, strict=True)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, CITATION.names))

    # Called nondeterministic, or Spark infers a filter from a later explode and searches every text twice.
    return spread(texts).withColumn("citations", search.asNondeterministic()(F.coalesce(text, F.lit(""))))


def associate(found: DataFrame) -> DataFrame:
    """Gives each article the gazette id of the nearest norm by distance of centres, the earlier one on a tie."""
    carries = lambda c: c["boe_id"].isNotNull() & c["kind"].isin("boe_state", "boe_regional", "alias", "law_reference")
    centre = lambda c: F.floor((c["start"] + c["stop"]) / 2)

    def tie(c: Column, carriers: Column) -> Column:
        distance = lambda n: F.abs(centre(c) - centre(n))
        near = F.transform(F.filter(carriers, lambda n: distance(n) <= WINDOW), lambda n: F.struct(distance(n).alias("distance"), n["start"].alias("at"), n["boe_id"].alias("boe_id"), n["label"].alias("label")))
        tied = lambda best: F.when(best.isNull(), c).otherwise(c.withField("boe_id", F.coalesce(c["boe_id"], best["boe_id"])).withField("label", F.coalesce(c["label"], best["label"])))
        return F.when(c["kind"] == "article", once(F.array_min(near), tied)).otherwise(c)

    tied = once(F.filter("citations", carries), lambda carriers: F.transform("citations", lambda c: tie(c, carriers)))
    return found.withColumn("citations", F.when(F.exists("citations", lambda c: c["kind"] == "article"), tied).otherwise(F.col("citations")))


def documented(sources: DataFrame) -> DataFrame:
    """Distinct (boe_id, number, suffix) of sources (boe_id, article): the pinpoints that catalogues document."""
    key = article_key(F.col("article"))
    return sources.select("boe_id", key.alias("k")).where("boe_id is not null and k is not null").select("boe_id", F.col("k.number").alias("number"), F.coalesce("k.suffix", F.lit("")).alias("suffix")).distinct()


#: Catalogues of so many rows at most are sent to every task instead of shuffling all citations by a few norms' ids.
MAX_SENT = 50_000


def _sent(catalogue: DataFrame) -> DataFrame:
    """`catalogue` to be broadcast where it has MAX_SENT rows at most, else as it is."""
    return F.broadcast(catalogue) if catalogue.limit(MAX_SENT + 1).count() <= MAX_SENT else catalogue


def verify(texts: DataFrame, ident: str, day: Column, normas: DataFrame, versions: DataFrame, pinpoints: DataFrame, rulings: DataFrame | None = None, this_year: int | Column | None = None, text: str = "text", dates_as_claims: bool = True) -> DataFrame:
    """One row per citation: (ident, place, kind, raw, boe_id, level, code); level is null where nothing is wrong.

    Blocking: unknown norms, repealed or annulled ones, ids with impossible years, articles no catalogue documents,
    rulings not in the registry. Warnings: suspended norms, no version on the day, articles tied to no norm, rulings
    named without a number. A year is impossible before FIRST_YEAR or more than one after this_year, by default the
    year in which the query runs.
    """
    latest = (F.year(F.current_date()) if this_year is None else F.lit(this_year) if isinstance(this_year, int) else this_year) + 1
    found = associate(extract(texts, text, dates_as_claims)).select(ident, day.alias("_day"), F.posexplode("citations").alias("place", "c"))
    cited = found.select(ident, "_day", "place", "c.*")
    known = normas.select("boe_id").distinct().withColumn("_known", F.lit(True))
    time = timelines(versions.select(F.col("norma_boe_id").alias("boe_id"), "effective_from", "effective_to", "status"), ["boe_id"], "effective_from")
    pins = pinpoints.withColumn("_pin", F.lit(True))
    covered = pinpoints.select("boe_id").distinct().withColumn("_indexed", F.lit(True))
    cited = cited.withColumn("number", F.col("article")).withColumn("_suffix", F.coalesce("suffix", F.lit("")))
    norms = known.join(time, "boe_id", "full").join(covered, "boe_id", "full")
    joined = cited.join(_sent(norms), "boe_id", "left").join(_sent(pins.withColumnRenamed("suffix", "_suffix")), ["boe_id", "number", "_suffix"], "left")
    if rulings is not None:
        joined = joined.join(_sent(rulings.select("canonical").distinct().withColumn("_ruled", F.lit(True))), "canonical", "left")
    live = F.try_element_at(F.filter("timeline", lambda v: (F.col("_day") >= v["effective_from"]) & (v["effective_to"].isNull() | (F.col("_day") <= v["effective_to"]))), F.lit(1))
    year = F.regexp_extract("boe_id", r"^BOE-A-(\d{4})-", 1).cast("int")
    norm = F.col("kind").isin("boe_state", "boe_regional", "alias", "law_reference")
    state, article, ruling = F.col("boe_id").startswith("BOE-A-"), F.col("kind") == "article", F.col("kind") == "jurisprudence"
    ladder = [
        (norm & F.col("boe_id").isNull(), "warning", "UNRESOLVED_LAW"),
        (norm & state & ~year.between(F.lit(FIRST_YEAR), latest), "blocking", "SUSPICIOUS_YEAR"),
        (norm & F.col("_known").isNull(), "blocking", "UNKNOWN_NORM"),
        (norm & live.isNull(), "warning", "NO_VERSION"),
        (norm & live["status"].isin("derogada", "inconstitucional"), "blocking", "NOT_IN_FORCE"),
        (norm & (live["status"] == "suspendida"), "warning", "SUSPENDED"),
        (article & F.col("boe_id").isNull(), "warning", "ORPHAN_ARTICLE"),
        (article & F.col("_indexed").isNotNull() & F.col("_pin").isNull(), "blocking", "ARTICLE_NOT_IN_CORPUS"),
        (article & F.col("_indexed").isNull(), "warning", "NORM_NOT_INDEXED"),
        (ruling & F.col("canonical").isNull(), "warning", "AMBIGUOUS_REFERENCE"),
    ]
    if rulings is not None:
        ladder.append((ruling & F.col("_ruled").isNull(), "blocking", "RULING_NOT_IN_CORPUS"))
    issue = F.lit(None).cast("struct<level:string,code:string>")
    for test, level, code in reversed(ladder):
        issue = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))).otherwise(issue)
    return joined.select(ident, "place", "kind", "raw", "boe_id", "canonical", issue.alias("i")).select(ident, "place", "kind", "raw", "boe_id", "canonical", "i.level", "i.code")


def verdicts(issues: DataFrame, ident: str, texts: DataFrame) -> DataFrame:
    """(ident, verdict): block with any blocking issue, warn with any other, else safe, also for texts without citations."""
    found = issues.select(ident, _weight(F.col("level")).alias("w"), F.lit(False).alias("_text"))
    every = texts.select(ident, F.lit(0).alias("w"), F.lit(True).alias("_text")).unionByName(found)
    worst = every.groupBy(ident).agg(F.max("w").alias("w"), F.max("_text").alias("_text"))
    return worst.where("_text").select(ident, _verdict(F.col("w")).alias("verdict"))


def _weight(level: Column) -> Column:
    return F.when(level == "blocking", 2).when(level == "warning", 1).otherwise(0)


def _verdict(weight: Column) -> Column:
    return F.when(weight == 2, "block").when(weight == 1, "warn").otherwise("safe")


def ground(answers: DataFrame, contexts: DataFrame, ident: str, text: str = "answer", bodies: str = "bodies", metadata: str | None = None) -> DataFrame:
    """(ident, place, raw, grounded): whether each citation of an answer stands in one of its context's sources, case aside.

    A citation stands there as it is written or by the gazette id it resolves to, in a body or in a source's metadata lines.
    contexts: one row an answer with arrays of texts; null entries hold nothing. An answer without a context grounds nothing.
    """
    given = F.col(bodies) if metadata is None else F.concat(F.coalesce(bodies, F.array()), F.coalesce(metadata, F.array()))
    cited = associate(extract(answers.select(ident, F.col(text).alias("text")))).select(ident, "citations")
    joined = cited.join(contexts.select(ident, F.transform(given, lambda b: F.lower(b)).alias("_given")), ident, "left").select(ident, "_given", F.posexplode("citations").alias("place", "c"))
    needle = lambda x: F.nullif(F.lower(F.trim(x)), F.lit(""))
    raw, norm = needle(F.col("c.raw")), needle(F.col("c.boe_id"))
    held = F.exists("_given", lambda b: F.coalesce(F.contains(b, raw), F.lit(False)) | F.coalesce(F.contains(b, norm), F.lit(False)))
    return joined.select(ident, "place", F.col("c.raw").alias("raw"), F.coalesce(held, F.lit(False)).alias("grounded"))


# Fixed value: how an answer refers to the sources it was given.
SOURCE_REFERENCE = r"(?i)\[FUENTE\s+(\d{1,3})\]"


def source_references(answers: DataFrame, contexts: DataFrame, ident: str, text: str = "answer", index: str = "index") -> DataFrame:
    """(ident, number, given): each source number an answer refers to, once, and whether it was given a source of that number.

    contexts: (ident, index), one row for each source that an answer was given.
    """
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(SOURCE_REFERENCE), F.lit(1)), lambda n: n.cast("int")))
    asked = answers.select(ident, F.explode(numbers).alias("number")).distinct()
    known = contexts.select(ident, F.col(index).cast("int").alias("number")).distinct().withColumn("_given", F.lit(True))
    return asked.join(known, [ident, "number"], "left").select(ident, "number", F.coalesce("_given", F.lit(False)).alias("given"))


def grounding(issues: DataFrame, ident: str, contexts: DataFrame, grounded: DataFrame, rejected: DataFrame | None = None, references: DataFrame | None = None) -> DataFrame:
    """(ident, verdict, problems) of each answer, by what its context shows.

    grounded: ground's rows. A citation that stands in no source warns, or blocks where verify blocks it (issues: ident, place,
    raw, level; of several issues of one wording the last counts); a citation that stands in a source is no problem whatever
    verify says. A reference to a source that was not given (references: source_references' rows) blocks, and so does a source
    that the temporal filter had rejected (rejected: chunk_id; contexts: ident, chunk_id of every source an answer was given).
    Problems are codes with the place, number or chunk they concern, sorted. Answers without any problem are safe.
    """
    wording = lambda df: df.withColumn("_w", F.lower("raw"))
    judged = wording(issues.where("level is not null")).groupBy(ident, "_w").agg(F.max_by("level", "place").alias("_level"))
    blocked, absent = F.coalesce(F.col("_level") == "blocking", F.lit(False)), ~F.col("grounded")
    problem = lambda level, text: (level.alias("level"), text.alias("problem"))
    # Rows without a level stand for answers that have no problem there: all is read once.
    cited = wording(grounded).join(judged, [ident, "_w"], "left")
    found = [cited.select(ident, *problem(F.when(absent, F.when(blocked, "blocking").otherwise("warning")), F.when(absent, F.concat_ws(" ", F.when(blocked, "BLOCKED_NOT_IN_CONTEXT").otherwise("NOT_IN_CONTEXT"), "place"))))]
    out = F.lit(False) if rejected is None else F.coalesce(F.col("_out"), F.lit(False))
    given = contexts if rejected is None else contexts.join(rejected.select("chunk_id").distinct().withColumn("_out", F.lit(True)), "chunk_id", "left")
    found.append(given.select(ident, *problem(F.when(out, "blocking"), F.when(out, F.concat(F.lit("REJECTED_SOURCE "), F.col("chunk_id").cast("string"))))))
    if references is not None:
        found.append(references.where("not given").select(ident, *problem(F.lit("blocking"), F.concat_ws(" ", F.lit("SOURCE_NOT_GIVEN"), "number"))))
    every = reduce(lambda a, b: a.unionByName(b), found).groupBy(ident)
    listed = every.agg(F.max(_weight(F.col("level"))).alias("w"), F.array_sort(F.collect_set("problem")).alias("problems"))
    return listed.select(ident, _verdict(F.col("w")).alias("verdict"), "problems")
