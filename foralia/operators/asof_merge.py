"""As-of lookups by a sort-merge, for keys whose timelines fit no array: union, range partitions, running last.

Facts and versions are dealt together by ranges of (key, day), so a key that holds any share of the rows is spread over
as many partitions as its rows need. Within a partition the last version seen so far is a running value; what a partition
has not seen yet comes from the last version before it, one row for each partition that a key spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foralia.operators.temporal import covers
from foralia.runtime import materialize


def as_of_merge(facts: DataFrame, versions: DataFrame, keys: list[str], day: str, start: str = "effective_from", end: str | None = "effective_to", into: str = "version") -> DataFrame:
    """`facts` plus struct `into`: the version of the same keys with the latest start up to `day`, null where it has ended by then.

    Equal to temporal.as_of_join where no version of a key overlaps the next (see overlap_violations); of versions with one
    start the greatest row counts. A null start is open, and so is a null end, or every end where `end` is None. Facts with a null
    key or day have no version; repeated facts stay repeated; facts may have columns of the versions' names.
    """
    version = F.struct(*(c for c in versions.columns if c not in keys))
    fact = F.struct(*(F.col(c) for c in facts.columns))
    of = lambda df, at, row, v, f: df.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), at.alias("_at"), F.lit(row).alias("_row"), v.alias("_v"), f.alias("_f"))
    names = [f"_k{n}" for n in range(len(keys))]
    null_fact, null_version = F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType), F.lit(None).cast(versions.select(version.alias("v")).schema["v"].dataType)
    both = of(versions, F.col(start), 0, version, null_fact).unionByName(of(facts, F.col(day), 1, null_version, fact))
    dealt = materialize(both.repartitionByRange(*names, "_at", "_row").withColumn("_p", F.spark_partition_id()), "as-of")
    so_far = Window.partitionBy("_p", *names).orderBy("_at", "_row", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = dealt.withColumn("_v", F.last("_v", ignorenulls=True).over(so_far)).where("_row = 1")
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("_row") == 0, F.struct("_at", "_v"))).alias("_last")
    carried = dealt.groupBy("_p", *names).agg(latest).withColumn("_carried", F.last("_last", ignorenulls=True).over(before)["_v"]).drop("_last")
    found = seen.join(carried, ["_p", *names], "left").withColumn("_v", F.coalesce("_v", "_carried"))
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    holds = covers(F.col("_at"), F.col(f"_v.{start}"), F.col(f"_v.{end}") if end else F.lit(None))
    return found.select("_f.*", F.when(known & F.col("_v").isNotNull() & F.coalesce(holds, F.lit(False)), F.col("_v")).alias(into))


def page_at(places: DataFrame, index: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """`places` with `page_number`: the page of `index` (keys, page_start, page_number) that `offset` lies on, the first for earlier ones."""
    first = index.groupBy(keys).agg(F.min_by("page_number", "page_start").alias("_first"))
    found = as_of_merge(places, index.select(*keys, "page_start", "page_number"), keys, offset, "page_start", None, "_page")
    number: Column = F.coalesce("_page.page_number", "_first")
    return found.join(first, keys, "left").withColumn("page_number", number).drop("_page", "_first")
