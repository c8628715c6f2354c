"""Searches of the rule and norm catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 25


def rule_catalog(rules: DataFrame, tax_year: int | None = None, region: str | None = None, scope: str | None = None, category: str | None = None) -> DataFrame:
    """Rules that fit every filter given; a region lets state rules through."""
    test = F.lit(True)
    if tax_year is not None:
        test = test & (F.col("tax_year") == tax_year)
    if region:
        test = test & ((F.lower(F.coalesce("region", F.lit(""))) == region.lower()) | (F.col("scope") == "estatal"))
    if scope:
        test = test & (F.col("scope") == scope)
    if category:
        test = test & (F.col("category") == category)
    return rules.where(test)


def _holds(column: str | Column, query: str) -> Column:
    return F.coalesce(F.contains(F.lower(column), F.lit(query.strip().lower())), F.lit(False))


def search_rules(rules: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    """Up to `limit` rules with the query in id, name, description or a source's title, with `truncated`."""
    titles = F.exists("sources", lambda s: _holds(s["title"], query))
    found = rules.where(_holds("id", query) | _holds("name", query) | _holds("description", query) | F.coalesce(titles, F.lit(False)))
    return _limited(found, "id", limit)


def search_norms(normas: DataFrame, query: str, limit: int = LIMIT) -> DataFrame:
    return _limited(normas.where(_holds("boe_id", query) | _holds("title", query)), "boe_id", limit)


def _limited(found: DataFrame, by: str, limit: int) -> DataFrame:
    more = found.limit(limit + 1).agg((F.count("*") > limit).alias("truncated"))
    return found.orderBy(by).limit(limit).crossJoin(F.broadcast(more))


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "alta").when(confidence >= 0.5, "media").otherwise("baja")


def anchor(article: Column) -> Column:
    """The place of an article in a consolidated text: #a57, #a81bis."""
    from foralia.functions.ids import article_key

    key = article_key(article)
    return F.concat(F.lit("#a"), key["number"], F.coalesce(key["suffix"], F.lit("")))
