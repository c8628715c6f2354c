"""Line dedup with levelled sorted runs of line hashes, in DataFrame operations only.

Runs hold (hash, owner, number of documents) with disjoint keys, sorted and bucketed by hash. A batch is sorted once and
merges with every run where it lies: the keys that no run knows become the batch's own run, and what it says about keys
that a run knows becomes a delta of that run (owner, further documents), in the same pass. Runs are never rewritten for a
batch: every `fanout` deltas of a level become one of the next level, and so do every `fanout` runs, which take their deltas
in. What is written for a batch is thus the batch, besides compactions, which meet a key once a level.

An index that is given a name is a folder: its manifests, of which the newest counts, name the runs. A job's batches
count at once, when its manifest takes its place; a job that died before left nothing that counts.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foralia.runtime import materialize, scratch_dir, table
from foralia.sources.store import _delete, _files, _rename, exists

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 2
HASH = ["h1", "h2"]
MANIFESTS = "manifests"


class LineRuns:
    """Sorted, bucketed runs (h1, h2, owner, n_docs) with disjoint keys, by level, each with its deltas.

    A named index lies in the folder of its name in the scratch folder and is found there by any session; its number of
    buckets is kept with it, whatever the session's shuffle partitions are. One writer opens it at a time: opening deletes
    what no manifest names. A document may be added once, but for batches of a named job, which count once however often
    they come.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, index: str | None = None) -> None:
        self.spark, self.fanout, self.named = spark, fanout, index is not None
        self.index = index or f"line_runs_{uuid.uuid4().hex}"
        self.root = f"{scratch_dir(spark)}/{self.index}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.schema = 0, ""
        self.jobs: list[str] = []
        self.runs: list[dict] = []
        self.committed: set[str] = set()
        if self.named and exists(spark, f"{self.root}/{MANIFESTS}"):
            self._load()

    def _load(self) -> None:
        found = [name for name in self._list(MANIFESTS) if name.isdigit()]
        if found:
            self.version = int(max(found))
            kept = json.loads(self.spark.read.text(f"{self.root}/{MANIFESTS}/{max(found)}", wholetext=True).first()[0])
            self.buckets, self.schema, self.jobs, self.runs = kept["buckets"], kept["schema"], kept["jobs"], kept["runs"]
        self.committed = self._folders()
        for name in self._list(""):
            if name != MANIFESTS and not any(f.split("/")[0] == name for f in self.committed):
                _delete(self.spark, f"{self.root}/{name}")
        for run in self.runs:
            self._show(run)

    def _list(self, folder: str) -> list[str]:
        target, files = _files(self.spark, f"{self.root}/{folder}" if folder else self.root)
        return sorted(s.getPath().getName() for s in files.listStatus(target))

    def _folders(self) -> set[str]:
        return {part["folder"] for run in self.runs for part in (run, *run["deltas"])}

    def commit(self, job: str | None = None) -> None:
        """What was added so far counts from here on; an index without a name has nothing to commit."""
        if not self.named:
            return
        jobs = self.jobs + ([job] if job is not None else [])
        state = json.dumps({"buckets": self.buckets, "schema": self.schema, "jobs": jobs, "runs": self.runs})
        staged, final = f"{self.root}/{MANIFESTS}/staged-{uuid.uuid4().hex}", f"{self.root}/{MANIFESTS}/{self.version + 1:012d}"
        target, files = _files(self.spark, staged)
        out = files.create(target, True)
        out.writeBytes(state)
        out.close()
        _rename(self.spark, staged, final)
        self.version, self.jobs = self.version + 1, jobs
        old, self.committed = self.committed, self._folders()
        for folder in old - self.committed:
            self._forget(folder)
        for name in self._list(MANIFESTS):
            if name != f"{self.version:012d}":
                _delete(self.spark, f"{self.root}/{MANIFESTS}/{name}")

    def _write(self, df: DataFrame, *by: str) -> str:
        """Sorted buckets of `df` in a new folder; a task holds whole buckets, so each is one file."""
        folder = uuid.uuid4().hex
        writer = df.write.option("path", f"{self.root}/{folder}").bucketBy(self.buckets, *HASH).sortBy(*HASH)
        (writer.partitionBy(*by) if by else writer).saveAsTable(f"{self.index}_{folder}")
        self.spark.sql(f"DROP TABLE {self.index}_{folder}")
        return folder

    def _name(self, folder: str) -> str:
        return f"{self.index}_{folder}".replace("/of=", "_").replace("-", "m")

    def _open(self, folder: str) -> DataFrame:
        buckets = f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(folder)} ({self.schema}) USING parquet {buckets} LOCATION '{self.root}/{folder}'")
        return self.spark.table(self._name(folder))

    def _forget(self, folder: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self._name(folder)}")
        _delete(self.spark, f"{self.root}/{folder}")

    def _replaced(self, parts: list[dict]) -> None:
        """Folders that the last manifest names stay until the next one takes its place."""
        for part in parts:
            if part["folder"] not in self.committed:
                self._forget(part["folder"])

    def _view(self, run: dict) -> str:
        return f"{self.index}__{run['level']}_{self._name(run['folder'])}"

    def _show(self, run: dict) -> None:
        self._whole(run).createOrReplaceTempView(self._view(run))

    def _whole(self, run: dict) -> DataFrame:
        """A run with its deltas, merged where they lie."""
        rows = self._open(run["folder"])
        for delta in run["deltas"]:
            more = self._open(delta["folder"]).select(*HASH, F.col("owner").alias("_owner"), F.col("n_docs").alias("_n")).hint("merge")
            rows = rows.join(more, HASH, "left").select(*HASH, F.greatest("owner", "_owner").alias("owner"), (F.col("n_docs") + F.coalesce("_n", F.lit(0))).alias("n_docs"))
        return rows

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        more = b.select(*HASH, F.col("owner").alias("_owner"), F.col("n_docs").alias("_n")).hint("merge")
        n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("_n", F.lit(0))
        return a.join(more, HASH, "full").select(*HASH, F.greatest("owner", "_owner").alias("owner"), n_docs.alias("n_docs"))

    @property
    def levels(self) -> list[list[str]]:
        """Views of the whole runs of each level."""
        most = max((run["level"] for run in self.runs), default=0)
        return [[self._view(run) for run in self.runs if run["level"] == level] for level in range(most + 1)]

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, keys: DataFrame, commit: bool = True) -> None:
        """Takes a batch's distinct keys (h1, h2, owner, n_docs); without `commit` they count with the next one that has it."""
        keys = keys.select(*HASH, "owner", "n_docs")
        self.schema = self.schema or ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema)
        batch = self._write(keys.repartition(self.buckets, *HASH))
        if self.runs:
            tagged, of = self._open(batch), []
            for k, run in enumerate(self.runs):
                tagged = tagged.join(self._open(run["folder"]).select(*HASH, F.lit(k).alias(f"_{k}")).hint("merge"), HASH, "left")
                of.append(F.col(f"_{k}"))
            parts = self._write(tagged.select(*HASH, "owner", "n_docs", F.coalesce(*of, F.lit(-1)).alias("of")), "of")
            self._forget(batch)
            for name in self._list(parts):
                if name.startswith("of=") and name != "of=-1":
                    run = self.runs[int(name.removeprefix("of="))]
                    run["deltas"] = self._compact([*run["deltas"], {"level": 0, "folder": f"{parts}/{name}"}], lambda d: self._open(d["folder"]))
                    self._show(run)
            fresh = [f"{parts}/of=-1"] if "of=-1" in self._list(parts) else []
        else:
            fresh = [batch]
        for folder in fresh:
            self.runs.append({"level": 0, "folder": folder, "deltas": []})
            self._show(self.runs[-1])
        self.runs = self._compact(self.runs, self._whole)
        if commit:
            self.commit()

    def _compact(self, parts: list[dict], read) -> list[dict]:
        """`parts` with every `fanout` of a level merged into one of the next level."""
        level = 0
        while level <= max((p["level"] for p in parts), default=-1):
            old = [p for p in parts if p["level"] == level]
            if len(old) >= self.fanout:
                merged = {"level": level + 1, "folder": self._write(reduce(self._merged, map(read, old)))}
                parts = [p for p in parts if p["level"] != level] + [merged]
                if "deltas" in old[0]:
                    merged["deltas"] = []
                    self._show(merged)
                    for run in old:
                        self.spark.catalog.dropTempView(self._view(run))
                        self._replaced(run["deltas"])
                self._replaced(old)
            level += 1
        return parts

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, owner) of the keys that `min_docs` documents or more hold, over everything added so far: read off the runs."""
        parts = [self.spark.table(name) for name in self.names()]
        return reduce(DataFrame.unionByName, parts).where(F.col("n_docs") >= min_docs).select(*HASH, "owner")

    def drop(self) -> None:
        for name in self.names():
            self.spark.catalog.dropTempView(name)
        for folder in self._folders():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(folder)}")
        _delete(self.spark, self.root)
        self.runs, self.jobs, self.committed, self.version = [], [], set(), 0


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("*", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_mark", F.xxhash64("_text"))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, _mark, pos, h1, h2) of each line whose key has `min_chars` code points or more; _mark tells apart texts under one doc_id."""
    lines = docs.select("doc_id", "_mark", F.posexplode(F.split(F.translate("_text", UPPER, LOWER), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "_mark", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "_mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def repeated_lines(lines: DataFrame, min_docs: int, batches: int, fanout: int, index: str | None = None, job: str | None = None) -> DataFrame:
    """(h1, h2, owner) of the keys in `min_docs` documents or more, found batch by batch through the runs.

    With a name for the index its runs stay, and what earlier calls added to it counts; otherwise they go. All batches of a
    call count at once; a call under the name of a `job` that the index has seen adds nothing.
    """
    runs = LineRuns(lines.sparkSession, fanout, index)
    try:
        if job is None or job not in runs.jobs:
            cuts = lines.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]).alias("q")).first()["q"] or []
            edges = sorted(set(cuts), reverse=True)
            for k in range(len(edges) + 1):
                part = lines
                if k:
                    part = part.where(F.coalesce(F.col("doc_id") <= edges[k - 1], F.lit(True)))
                if k < len(edges):
                    part = part.where(F.col("doc_id") > edges[k])
                once = part.select(*HASH, "doc_id").distinct()
                runs.add(once.groupBy(HASH).agg(F.max("doc_id").alias("owner"), F.count("*").alias("n_docs")), commit=False)
            runs.commit(job)
        return materialize(runs.repeated(min_docs), "lines-repeated")
    finally:
        if index is None:
            runs.drop()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, index: str | None = None, job: str | None = None) -> DataFrame:
    """`docs` with the kept text in `text`, plus n_lines and n_dropped.

    A key is a line stripped of ASCII white space with A-Z in lower case. Keys in `min_docs` distinct doc_ids or more
    lose all their lines but those of the largest doc_id. Null text is one empty line; a null doc_id counts as one
    document below all others; rows that repeat a doc_id are one document; other columns pass through, but n_lines and n_dropped are
    replaced; no rows give none. With a name for the index, lines of documents added to it before count too;
    with a name for the job, a call that is repeated adds its documents once.
    """
    docs = docs.drop("n_lines", "n_dropped")
    marked = _text(docs)
    lines = materialize(line_keys(marked, min_chars), "lines")
    hot = repeated_lines(lines, min_docs, batches, fanout, index, job)
    gone = lines.join(hot, HASH).where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    gone = gone.groupBy(F.col("doc_id").alias("_doc"), F.col("_mark").alias("_of")).agg(F.collect_set("pos").alias("_gone"))
    left = marked.drop("text").withColumn("_text", F.split("_text", "\n"))
    both = left.join(gone, left["doc_id"].eqNullSafe(gone["_doc"]) & (left["_mark"] == gone["_of"]), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_text") - 1), F.col("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.array_join("_text", "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("_text"), i)), "\n"))
    out = both.select("*", kept.alias("text"), F.size("_text").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(*docs.columns, "n_lines", "n_dropped")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Line dedup of all `documents`; see dedup_lines for edge cases."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), hot AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), flagged AS (
  SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AND h.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""
