"""VAT: lookup of operations and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.functions.scales import round_half_up
from foralia.functions.text import normalize


def lookup(operations: DataFrame, query: Column) -> DataFrame:
    """Operations whose description and keywords contain every word of the query, accents aside."""
    hay = normalize(F.concat_ws(" ", "description", F.array_join(F.coalesce("keywords", F.expr("cast(array() as array<string>)")), " ")))
    words = F.filter(F.split(normalize(query), " "), lambda w: w != "")
    return operations.where(F.forall(words, lambda w: F.contains(hay, w)) & (F.size(words) > 0))


def vat_quota(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """`rows` (code, base) with rate and quota; exempt codes have a null rate and quota; a negative base is an error."""
    joined = rows.join(rates.select("code", "rate"), "code", "left")
    base = F.when(F.col("base") < 0, F.raise_error(F.lit("a VAT base is not negative")).cast("double")).otherwise(F.col("base"))
    return joined.withColumn("quota", round_half_up(base * F.col("rate")))
