"""Ranks and weights of rulings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foralia.functions.text import subject_key

# Rank of each court and of each kind of administrative doctrine, smaller is stronger.
COURT_TIERS = {"TC": 10, "TS": 20, "AN": 30, "TSJ": 40, "AP": 61}
TRIBUNAL_TIERS = {"unifica_criterio": 21, "extiende_efectos": 31}
ORDINARY_TIER, BINDING_RULING_TIER, REGIONAL_TIER = 41, 50, 60


def court_tier(court: Column) -> Column:
    """Unknown courts rank with the regional ones."""
    ranks = F.create_map(*(F.lit(x) for pair in COURT_TIERS.items() for x in pair))
    return F.coalesce(F.try_element_at(ranks, court), F.lit(COURT_TIERS["TSJ"]))


def tribunal_tier(organ: Column, kind: Column) -> Column:
    """Only the central tribunal's resolutions rank by kind."""
    ranks = F.create_map(*(F.lit(x) for pair in TRIBUNAL_TIERS.items() for x in pair))
    return F.when(organ == "teac", F.coalesce(F.try_element_at(ranks, kind), F.lit(ORDINARY_TIER))).otherwise(F.lit(REGIONAL_TIER))


def _size(*keys: Column) -> Column:
    return F.count("*").over(Window.partitionBy(*keys))


def ruling_weights(rulings: DataFrame) -> DataFrame:
    """Adds `weight`: binding for TC, consolidated where two rulings of a court and chamber agree on a matter, else isolated."""
    alike = _size(F.col("organo"), F.lower(F.coalesce("sala", F.lit(""))), F.col("fallo_sentido"), subject_key(F.col("resumen")))
    return rulings.withColumn("weight", F.when(F.col("organo") == "TC", "binding").when(alike >= 2, "consolidated").otherwise("isolated"))


def tribunal_weights(resolutions: DataFrame) -> DataFrame:
    """Adds `weight`: only the central tribunal binds or consolidates, though resolutions of all count towards agreement."""
    alike = _size(F.col("impuesto"), F.col("sentido"), subject_key(F.col("asunto")))
    central = F.col("organo") == "teac"
    binding = central & F.col("tipo").isin("unifica_criterio", "extiende_efectos")
    return resolutions.withColumn("weight", F.when(binding, "binding").when(central & (alike >= 2), "consolidated").otherwise("isolated"))
