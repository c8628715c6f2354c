"""Canonical identifiers and dates of gazettes and rulings; what has no valid form becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names in dates written out.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")

ECLI = r"(?i)^\s*(ECLI:ES:[A-Z]+[A-Z0-9]*:\d{4}:[A-Z0-9.]+?)(?:[:.][A-Z0-9]+)?\s*$"
# Numbers of any length that a long holds: registries outgrow the digits they began with.
BINDING = r"(?i)^\s*V\s*0*(\d{1,18})\s*-\s*(\d{4}|\d{2})\s*$"
CLAIM = r"^\s*(\d{1,2})/(\d{1,18})/(\d{4}|\d{2})(?:/(\d{1,3}))?(?:/(\d{1,3}))?\s*$"
SHORT_CLAIM = r"(?i)^\s*R\.?\s*G\.?[.:/\s]+(\d{1,18})\s*/\s*(\d{4}|\d{2})\s*$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _pad(digits: Column, width: int) -> Column:
    """Leading zeros up to `width`; longer numbers stay whole."""
    number = digits.cast("long")
    return F.when(number.isNotNull(), F.format_string(f"%0{width}d", number))


def full_year(digits: Column) -> Column:
    year = digits.cast("int")
    return F.when(year < 100, year + 2000).otherwise(year)


def ecli(text: Column) -> Column:
    """Upper-case identifier without suffixes."""
    return F.upper(_part(text, ECLI, 1))


def ruling_number(text: Column) -> Column:
    """V0123-24; two-digit years are of this century, non-binding numbers (C…) are null."""
    return F.concat(F.lit("V"), _pad(_part(text, BINDING, 1), 4), F.lit("-"), _pad(full_year(_part(text, BINDING, 2)) % 100, 2))


def claim_number(text: Column) -> Column:
    """DD/NNNNN/YYYY with the suffixes given; the short R.G. form belongs to the central tribunal, 00."""
    year = lambda pattern, group: full_year(_part(text, pattern, group)).cast("string")
    long = F.concat(_pad(_part(text, CLAIM, 1), 2), F.lit("/"), _pad(_part(text, CLAIM, 2), 5), F.lit("/"), year(CLAIM, 3))
    tail = [F.coalesce(F.concat(F.lit("/"), _pad(_part(text, CLAIM, g), 2)), F.lit("")) for g in (4, 5)]
    short = F.concat(F.lit("00/"), _pad(_part(text, SHORT_CLAIM, 1), 5), F.lit("/"), year(SHORT_CLAIM, 2))
    return F.coalesce(F.concat(long, *tail), short)


def gazette_date(text: Column) -> Column:
    """YYYYMMDD or DD/MM/YYYY."""
    day = F.try_to_timestamp
    return F.coalesce(day(text, F.lit("yyyyMMdd")), day(text, F.lit("dd/MM/yyyy"))).cast("date")


def written_date(text: Column) -> Column:
    """DD/MM/YYYY or `D de mes de YYYY`."""
    pattern = rf"(?i)(\d{{1,2}})\s+de\s+({'|'.join(MONTHS)})\s+de\s+(\d{{4}})"
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(text, pattern, 2)))
    iso = F.concat_ws("-", _part(text, pattern, 3), _pad(F.nullif(month, F.lit(0)), 2), _pad(_part(text, pattern, 1), 2))
    return F.coalesce(F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1), F.lit("d/M/yyyy")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd"))).cast("date")


def article_key(article: Column) -> Column:
    """struct(number, suffix) of `art. 81 bis 2`, `artículo 7`, `a57`; null for anchors without a number."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(article)), r"^(?:art[íi]culo|art\.?|a(?=\d))", ""))
    number = _part(bare, r"^(\d+)", 1)
    return F.when(number.isNotNull(), F.struct(number.alias("number"), _part(bare, r"^\d+\s*(bis|ter|quater|quinquies|sexies)", 1).alias("suffix")))
