"""Snapshot and timeline comparison, freshness, and what a change touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _outer(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    a = previous.select(*keys, F.struct(*(c for c in previous.columns if c not in keys)).alias("previous"))
    b = current.select(*keys, F.struct(*(c for c in current.columns if c not in keys)).alias("current"))
    return a.join(b, keys, "full_outer")


def snapshot_drift(previous: DataFrame, current: DataFrame, keys: list[str], digest: str = "hash") -> DataFrame:
    """(keys, kind, previous_hash, current_hash) of keys added, removed or modified; both sides have one row per key."""
    both = _outer(previous.select(*keys, digest), current.select(*keys, digest), keys)
    old, new = F.col(f"previous.{digest}"), F.col(f"current.{digest}")
    kind = F.when(F.col("previous").isNull(), "added").when(F.col("current").isNull(), "removed").when(~old.eqNullSafe(new), "modified")
    return both.select(*keys, kind.alias("kind"), old.alias("previous_hash"), new.alias("current_hash")).where("kind is not null")


def timeline_drift(previous: DataFrame, current: DataFrame, article: str = "article_id") -> DataFrame:
    """(article, effective_from, kind): added, removed, rewritten (other text) or shifted (same text, other end)."""
    keys = [article, "effective_from"]
    both = _outer(previous.select(*keys, "text_hash", "effective_to"), current.select(*keys, "text_hash", "effective_to"), keys)
    same = lambda c: F.col(f"previous.{c}").eqNullSafe(F.col(f"current.{c}"))
    kind = F.when(F.col("previous").isNull(), "added").when(F.col("current").isNull(), "removed").when(~same("text_hash"), "rewritten").when(~same("effective_to"), "shifted")
    return both.select(*keys, kind.alias("kind")).where("kind is not null")


def bootstrap_or_drift(previous: DataFrame, current: DataFrame, owner: str, keys: list[str], digest: str = "hash") -> DataFrame:
    """snapshot_drift per owner; owners without any previous row are a first run, not a change, and give no rows."""
    known = previous.select(owner).distinct()
    return snapshot_drift(previous, current.join(known, owner, "left_semi"), [owner, *keys], digest)


def impact_index(carriers: DataFrame, ident: str = "id", sources: str = "sources") -> DataFrame:
    """(boe_id, article, carriers): which rules or scales cite each article, folded to its number and suffix."""
    from foralia.functions.ids import article_key

    cited = carriers.select(ident, F.explode(sources).alias("s")).select(ident, F.col("s.boe_id").alias("boe_id"), article_key(F.col("s.article")).alias("article"))
    return cited.where("boe_id is not null and article is not null").groupBy("boe_id", "article").agg(F.array_sort(F.collect_set(ident)).alias("carriers"))


def analyze_impact(drift: DataFrame, index: DataFrame) -> DataFrame:
    """Each changed (boe_id, article) with the carriers it touches, an empty list where nothing cites it."""
    hit = drift.join(index, ["boe_id", "article"], "left")
    return hit.withColumn("carriers", F.coalesce("carriers", F.expr("cast(array() as array<string>)")))


def freshness(rows: DataFrame, day: str, ident: str, today: Column, max_age_days: int, name: str) -> DataFrame:
    """One row (check, latest, latest_id, age_days, ok): the newest date, the smallest id of it, and whether it is young enough."""
    newest = rows.where(F.col(day).isNotNull()).agg(F.min_by(F.struct(F.col(day).alias("day"), F.col(ident).alias("id")), F.struct(-F.unix_date(day), F.col(ident))).alias("m"))
    age = F.datediff(today, F.col("m.day"))
    return newest.select(F.lit(name).alias("check"), F.col("m.day").alias("latest"), F.col("m.id").cast("string").alias("latest_id"), age.alias("age_days"), F.coalesce(age <= max_age_days, F.lit(False)).alias("ok"))


def families_freshness(spark: SparkSession, families: dict[str, DataFrame | None], day: str, ident: str, today: Column, max_age_days: int, name: str) -> DataFrame:
    """freshness of several families of texts as one check, plus `skipped`.

    A family is None where it was never set up; with none set up the check is skipped and ok, as these texts are not required.
    Families that are set up and hold no dates are not fresh. Of equal dates the first family's, then the smallest id as text
    is named. Only each family's newest row meets the others.
    """
    newest = []
    for k, rows in enumerate(families.values()):
        if rows is not None:
            best = F.min(F.struct((-F.unix_date(day)).alias("before"), F.lit(k).alias("family"), F.col(ident).cast("string").alias("id"), F.col(day).alias("day")))
            newest.append(rows.where(F.col(day).isNotNull()).agg(best.alias("m")))
    if not newest:
        nothing = {"check": F.lit(name), "latest": F.lit(None).cast("date"), "latest_id": F.lit(None).cast("string"), "age_days": F.lit(None).cast("int"), "ok": F.lit(True), "skipped": F.lit(True)}
        return spark.range(1).select(*(c.alias(n) for n, c in nothing.items()))
    found = reduce(DataFrame.unionByName, newest).agg(F.min("m").alias("m"))
    age = F.datediff(today, F.col("m.day"))
    return found.select(F.lit(name).alias("check"), F.col("m.day").alias("latest"), F.col("m.id").alias("latest_id"), age.alias("age_days"), F.coalesce(age <= max_age_days, F.lit(False)).alias("ok"), F.lit(False).alias("skipped"))


def all_fresh(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One SHA-256 for a table, whatever its row order: each row's hash is cut into four numbers, and their sums are hashed."""
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)), 256)
    parts = [F.sum(F.conv(F.substring("d", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(4)]
    total = rows.select(digest.alias("d")).agg(F.concat_ws("-", F.count("*").cast("string"), *parts).alias("t"))
    return total.select(F.sha2("t", 256).alias("fingerprint"))


def corpus_meta(rules: DataFrame, normas: DataFrame, columns: list[str]) -> DataFrame:
    """One row about a catalogue: count, last_reviewed_at, normas_registered (some source's norm is known), fingerprint_sha256.

    rules: last_reviewed_at date, sources array<struct<boe_id, ...>>; `columns` make up the fingerprint. No rules give a
    count of 0, no day and false.
    """
    cited = rules.select(F.explode("sources.boe_id").alias("boe_id"))
    known = cited.join(normas.select("boe_id"), "boe_id", "left_semi").agg((F.count("*") > 0).alias("known"))
    about = rules.agg(F.count("*").alias("count"), F.max("last_reviewed_at").alias("last_reviewed_at"))
    return about.select("*", known.scalar().alias("normas_registered"), fingerprint(rules, columns).scalar().alias("fingerprint_sha256"))
