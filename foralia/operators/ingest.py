"""Ingestion: gazette summaries to rows, relevance, idempotent upserts and zero-filled breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foralia.functions.text import normalize, once

# Prefixes of a heading and the kind of norm they announce, in the order in which they are tried.
KINDS = (
    ("ley organica", "ley_organica"),
    ("real decreto legislativo", "real_decreto_legislativo"),
    ("real decreto-ley", "real_decreto_ley"),
    ("real decreto ley", "real_decreto_ley"),
    ("real decreto", "real_decreto"),
    ("orden", "orden_ministerial"),
    ("resolucion", "resolucion"),
    ("ley", "ley"),
)
# Departments that write tax law, and those that do so at times.
TAX_DEPARTMENTS = (
    "ministerio de hacienda",
    "ministerio de economia y hacienda",
    "ministerio de economia, hacienda y empresa",
)
OTHER_DEPARTMENTS = (
    "jefatura del estado",
    "ministerio para la transicion ecologica",
    "ministerio de industria",
    "ministerio de asuntos economicos",
    "ministerio de inclusion, seguridad social y migraciones",
    "presidencia del gobierno",
)
# Phrases that make a title fiscal, words that count only whole, and phrases that rule a title out.
PHRASES = (
    "tributari", "fiscal", "impuesto", "impuestos", "gravamen", "tasa fiscal", "tasas fiscales", "hacienda publica", "haciendas locales", "agencia tributaria",
    "direccion general de tributos", "renta de las personas fisicas", "valor añadido", "valor anadido", "sucesiones y donaciones", "transmisiones patrimoniales",
    "actos juridicos documentados", "renta de no residentes", "impuestos especiales", "primas de seguros", "actividades economicas", "bienes inmuebles",
    "vehiculos de traccion mecanica", "construcciones, instalaciones y obras", "incremento de valor de los terrenos", "plusvalia municipal", "autoliquidacion",
    "declaracion tributaria", "ingreso a cuenta", "pagos a cuenta", "obligaciones formales", "modelo 100", "modelo 200", "modelo 303", "modelo 347", "modelo 349",
    "modelo 390", "modelo 720", "modelo 721", "modelo 714", "modelo 650", "modelo 651", "modelo 232", "censo de obligados", "numero de identificacion fiscal",
    "infraccion tributaria", "sancion tributaria", "recaudacion tributaria", "inspeccion tributaria", "procedimiento tributario", "comprobacion limitada",
    "gestion tributaria", "rendimientos del trabajo", "rendimientos de actividades economicas", "rendimientos del capital", "ganancias y perdidas patrimoniales",
    "minimo personal y familiar", "deduccion por maternidad", "deduccion por inversion", "monedas virtuales", "criptoactivos", "criptomonedas",
)
WHOLE_WORDS = ("irpf", "iva", "isd", "iibtnu", "ibi", "ivtm", "icio", "iae", "irnr", "aeat", "lgt", "lirpf", "lis", "liva", "lisd", "lip", "retencion", "retenciones", "sociedades", "patrimonio")
EXCLUDED = ("ministerio fiscal", "carrera fiscal", "fiscal general del estado", "fiscalia")


def contains_any(text: Column, phrases: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for p in phrases:
        test = test | F.contains(text, F.lit(p))
    return test


def norm_kind(heading: Column) -> Column:
    """Kind by the first prefix that fits; null for headings that are no norms."""

    def ladder(folded: Column) -> Column:
        out = F.lit(None).cast("string")
        for prefix, kind in reversed(KINDS):
            out = F.when(folded.startswith(prefix), F.lit(kind)).otherwise(out)
        return out

    return once(normalize(heading), ladder)


def keywords(title: Column, phrases: tuple[str, ...] = PHRASES, words: tuple[str, ...] = WHOLE_WORDS) -> Column:
    """Phrases contained, then words held whole, in the order of their lists."""
    listed = lambda values: F.array(*map(F.lit, values))
    whole = lambda w: F.concat(F.lit(r"(?U)\b\Q"), w, F.lit(r"\E\b"))

    def held(folded: Column) -> Column:
        parts = F.filter(listed(phrases), lambda p: F.contains(folded, p))
        return F.concat(parts, F.filter(listed(words), lambda w: F.contains(folded, w) & F.rlike(folded, whole(w))))

    return once(normalize(title), held)


def classify(items: DataFrame) -> DataFrame:
    """Adds kind, matched and relevance (fiscal, probable, no_fiscal) from departamento, epigrafe and titulo."""
    any_of = lambda c, phrases: once(normalize(F.coalesce(c, F.lit(""))), lambda x: contains_any(x, phrases))
    out = items.withColumn("kind", norm_kind(F.coalesce("epigrafe", F.lit("")))).withColumn("matched", keywords(F.coalesce("titulo", F.lit(""))))
    refused = F.col("kind").isNull() | any_of("titulo", EXCLUDED)
    relevance = F.when(refused, "no_fiscal").when(any_of("departamento", TAX_DEPARTMENTS), "fiscal").when(any_of("departamento", OTHER_DEPARTMENTS) & (F.size("matched") > 0), "probable")
    out = out.withColumn("relevance", F.coalesce(relevance, F.lit("no_fiscal")))
    return out.withColumn("matched", F.when(refused, F.expr("cast(array() as array<string>)")).otherwise(F.col("matched")))


def as_list(value: Column) -> Column:
    """A VARIANT array's elements; a single object is a list of one, null or absent an empty list."""
    many = F.try_variant_get(value, "$", "array<variant>")
    return F.coalesce(many, F.when(value.isNotNull() & ~F.is_variant_null(value), F.array(value)), F.expr("cast(array() as array<variant>)"))


def text_of(value: Column, *names: str) -> Column:
    """The first of the named members that is text, or the text of a member {texto: …}."""
    tries = [F.try_variant_get(value, path, "string") for n in names for path in (f"$.{n}.texto", f"$.{n}")]
    return F.coalesce(*tries)


def flatten_gazette(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row per announced item of JSON summaries (VARIANT): day, section, department, heading, id, title, link.

    The summary stands under `data` or at the root, and its day has one of three names. Every level may be one object instead
    of a list. Items hang under a department only where it has no headings; beside headings they are passed over.
    """
    get = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant")
    keep = [c for c in payloads.columns if c != column]
    root = F.coalesce(F.try_variant_get(F.col(column), "$.data.sumario", "variant"), get(F.col(column), "sumario"))
    day = F.coalesce(*(F.nullif(text_of(get(root, "metadatos"), name), F.lit("")) for name in ("fecha_publicacion", "fechaInv", "fecha")))
    level = payloads.select(*keep, day.alias("fecha"), F.explode(as_list(get(root, "diario"))).alias("d"))
    level = level.select(*keep, "fecha", F.explode(as_list(get(F.col("d"), "seccion"))).alias("s"))
    level = level.select(*keep, "fecha", text_of(F.col("s"), "nombre").alias("seccion"), F.explode(as_list(get(F.col("s"), "departamento"))).alias("p"))
    level = level.select(*keep, "fecha", "seccion", text_of(F.col("p"), "nombre").alias("departamento"), "p", as_list(get(F.col("p"), "epigrafe")).alias("headings"))
    level = level.withColumn("bare", F.coalesce(F.size("headings"), F.lit(0)) <= 0)
    level = level.select(*keep, "fecha", "seccion", "departamento", "bare", F.explode(F.when(F.col("bare"), F.array("p")).otherwise(F.col("headings"))).alias("e"))
    level = level.select(*keep, "fecha", "seccion", "departamento", F.when(~F.col("bare"), text_of(F.col("e"), "nombre")).alias("epigrafe"), F.explode(as_list(get(F.col("e"), "item"))).alias("i"))
    return level.select(*keep, "fecha", "seccion", "departamento", "epigrafe", text_of(F.col("i"), "identificador").alias("identificador"), text_of(F.col("i"), "titulo").alias("titulo"), text_of(F.col("i"), "url_pdf").alias("url_pdf"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(keys).orderBy(order))).where("_n = 1").drop("_n")


def classify_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], digest: str = "hash", order: list[str] | None = None) -> DataFrame:
    """`incoming` (first row of a key) with outcome: added, duplicate (same hash stored) or conflict (another)."""
    fresh = first_wins(incoming, keys, order or [digest])
    known = existing.select(*keys, F.col(digest).alias("_stored"), F.lit(True).alias("_known"))
    outcome = F.when(F.col("_known").isNull(), "added").when(F.col("_stored").eqNullSafe(F.col(digest)), "duplicate").otherwise("conflict")
    return fresh.join(known, keys, "left").withColumn("outcome", outcome).drop("_stored", "_known")


def idempotent_upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], digest: str = "hash", order: list[str] | None = None, overwrite: bool = True) -> DataFrame:
    """The table after the upsert; a conflict replaces the stored row only with `overwrite`. Running it again changes nothing."""
    judged = classify_upsert(existing, incoming, keys, digest, order)
    taken = judged.where(F.col("outcome").isin(["added", "conflict"] if overwrite else ["added"])).drop("outcome")
    stay = existing.join(taken.select(keys), keys, "left_anti")
    return stay.unionByName(taken.select(existing.columns))


def breakdown(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(value, n) for every value of a closed list, zero where no row has it."""
    every = rows.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return every.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
