"""Typed values out of VARIANT profiles: absent, null, number, text, flag or list are told apart."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def typed(value: Column) -> Column:
    """Struct (found, is_null, num, txt, flag, raw) of a VARIANT; found is false where the path was absent."""
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
    return F.struct(
        value.isNotNull().alias("found"),
        F.coalesce(F.is_variant_null(value), F.lit(False)).alias("is_null"),
        F.when(number, F.try_variant_get(value, "$", "double")).alias("num"),
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).alias("txt"),
        F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).alias("flag"),
        value.alias("raw"),
    )


def fact_map(profile: Column, paths: Iterable[str]) -> Column:
    """map<dotted path, typed value>. `paths` come from a rule catalogue, not from data."""
    paths = sorted(set(paths))
    entries = [x for p in paths for x in (F.lit(p), typed(F.try_variant_get(profile, "$." + p, "variant")))]
    return F.create_map(*entries) if entries else F.expr("cast(map() as map<string,struct<found:boolean,is_null:boolean,num:double,txt:string,flag:boolean,raw:variant>>)")


def equal(a: Column, b: Column) -> Column:
    """Equality without coercion, but true = 1 and false = 0 as numbers."""
    num = lambda x: F.coalesce(x["num"], x["flag"].cast("int").cast("double"))
    both_null = a["is_null"] & b["is_null"]
    as_number = num(a).isNotNull() & num(b).isNotNull() & (num(a) == num(b))
    as_text = a["txt"].isNotNull() & b["txt"].isNotNull() & (a["txt"] == b["txt"])
    scalar = lambda x: x["is_null"] | num(x).isNotNull() | x["txt"].isNotNull()
    nested = ~scalar(a) & ~scalar(b) & (F.to_json(a["raw"]) == F.to_json(b["raw"]))
    return F.coalesce(both_null | as_number | as_text | nested, F.lit(False))


def compare(value: Column, operator: Column, expected: Column) -> Column:
    """One of ==, !=, >, >=, <, <=, in, exists, not_exists; orderings need numbers on both sides, else false."""
    order = lambda test: F.coalesce(test(value["num"], expected["num"]), F.lit(False))
    members = F.try_variant_get(expected["raw"], "$", "array<variant>")
    member = F.coalesce(F.exists(members, lambda m: equal(value, typed(m))), F.lit(False))
    return (
        F.when(operator == "exists", ~value["is_null"])
        .when(operator == "not_exists", value["is_null"])
        .when(operator == "==", equal(value, expected))
        .when(operator == "!=", ~equal(value, expected))
        .when(operator == "in", member)
        .when(operator == ">", order(lambda a, b: a > b))
        .when(operator == ">=", order(lambda a, b: a >= b))
        .when(operator == "<", order(lambda a, b: a < b))
        .when(operator == "<=", order(lambda a, b: a <= b))
        .otherwise(F.lit(False))
    )
