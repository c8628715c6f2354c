"""Valid-time operators: both ends of an interval are inclusive, a null end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAR = "9999-12-31"


def covers(day: Column, start: Column, end: Column) -> Column:
    """True where `day` lies in [start, end]; null bounds do not bind."""
    return F.coalesce(day >= start, F.lit(True)) & F.coalesce(day <= end, F.lit(True)) & day.isNotNull()


def timelines(versions: DataFrame, keys: list[str], start: str, order: str | None = None) -> DataFrame:
    """One row per key with `timeline`, its versions as an array in order of start (or of `order`)."""
    rest = [c for c in versions.columns if c not in keys]
    lead = [order or start] + [c for c in rest if c != (order or start)]
    return versions.groupBy(keys).agg(F.array_sort(F.collect_list(F.struct(*lead))).alias("timeline"))


def as_of_join(facts: DataFrame, versions: DataFrame, keys: list[str], day: str, start: str = "effective_from", end: str = "effective_to", pick: str = "first", order: str | None = None, into: str = "version") -> DataFrame:
    """`facts` plus struct `into`: the version of the same keys in force on `day`, null if none.

    Versions are folded into one timeline per key first, so the join is a plain equi-join that never multiplies
    facts; where several versions cover the day the first or last in order of start (or `order`) is picked.
    """
    known = timelines(versions, keys, start, order)
    hit = F.filter("timeline", lambda v: covers(F.col(day), v[start], v[end]))
    chosen = F.try_element_at(hit, F.lit(1 if pick == "first" else -1))
    return facts.join(known, keys, "left").withColumn(into, chosen).drop("timeline")


def overlap_violations(versions: DataFrame, keys: list[str], start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Versions whose interval reaches the next one's start: (keys, start, end, next_start)."""
    following = F.lead(start).over(Window.partitionBy(keys).orderBy(start, F.col(end).asc_nulls_last()))
    found = versions.select(*keys, start, end, following.alias("next_start"))
    return found.where(F.col("next_start") <= F.coalesce(F.col(end), F.lit(FAR).cast("date")))


def orphans(versions: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Versions whose key has no owner."""
    return versions.join(owners.select(key).distinct(), key, "left_anti")


def temporal_filter(chunks: DataFrame, day: Column, mode: str = "strict", start: str = "effective_from", end: str = "effective_to") -> DataFrame:
    """Adds verdict (accepted, rejected, disclaimer) and reason by validity on `day`.

    What is not in force on the day is rejected in every mode: not yet, or no longer where its start is known. A chunk without
    a start is rejected in strict, kept with a disclaimer in warn and accepted in off, whatever its end; so is every chunk where
    the day is null (see required_day).
    """
    if mode not in ("strict", "warn", "off"):
        raise ValueError(f"unknown mode {mode}")
    unknown = F.when(day.isNull(), "no_date").when(F.col(start).isNull(), "no_start")
    out = F.when(F.col(start) > day, "not_yet_in_force").when(F.col(end) < day, "no_longer_in_force")
    kept = F.lit({"strict": "rejected", "warn": "disclaimer", "off": "accepted"}[mode])
    verdict = F.when(unknown.isNotNull(), kept).when(out.isNotNull(), "rejected").otherwise("accepted")
    reason = F.when(unknown.isNotNull(), F.lit(None).cast("string") if mode == "off" else unknown).otherwise(out)
    return chunks.withColumns({"reason": reason, "verdict": verdict})


def required_day(queries: DataFrame, day: str = "devengo_date", mode: str = "strict", today: Column | None = None) -> DataFrame:
    """`queries` with `day` filled in and `explicit`, whether it was stated.

    strict: a query without a day is an error when its row is read; warn and off: it takes `today`, by default the current date.
    """
    if mode not in ("strict", "warn", "off"):
        raise ValueError(f"unknown mode {mode}")
    missing = F.raise_error(F.lit(f"{day} is required in strict mode")).cast("date") if mode == "strict" else F.coalesce(today, F.current_date()) if today is not None else F.current_date()
    return queries.withColumn("explicit", F.col(day).isNotNull()).withColumn(day, F.coalesce(F.col(day), missing))


def filter_warnings(verdicts: DataFrame, by: list[str], ident: str = "chunk_id", shown: int = 5) -> DataFrame:
    """(by, n, shown) of what temporal_filter kept with a disclaimer: how many, and the `shown` smallest ids."""
    kept = verdicts.where("verdict = 'disclaimer'").groupBy(by)
    few = F.slice(F.array_sort(F.collect_set(ident)), 1, shown)
    return kept.agg(F.count_distinct(ident).alias("n"), few.alias("shown"))


def applicable_versions(rules: DataFrame, versions: DataFrame, day: str, ident: str = "id", sources: str = "sources") -> DataFrame:
    """(ident, boe_id, version) of each norm that a rule's sources name, once, where a version is in force on `day`, in order of first mention (`place`)."""
    cited = rules.select(ident, day, F.posexplode(F.transform(sources, lambda s: s["boe_id"])).alias("place", "boe_id")).where("boe_id is not null")
    cited = cited.groupBy(ident, day, "boe_id").agg(F.min("place").alias("place"))
    live = as_of_join(cited, versions.withColumnRenamed("norma_boe_id", "boe_id"), ["boe_id"], day)
    return live.where("version is not null").select(ident, "place", "boe_id", "version")
