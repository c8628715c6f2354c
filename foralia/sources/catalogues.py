"""Catalogues in JSON: rules, scales and norms, with rows that break their constraints set apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foralia.operators.rules import RULE

SCALE = "id string, name string, tax_year int, scope string, component string, region string, brackets array<struct<up_to:double,rate:double>>, effective_from date, effective_to date, validation_status string"
NORM = "boe_id string, kind string, title string, enacted_at date"
VERSION = "norma_boe_id string, effective_from date, effective_to date, status string, content_hash string, modified_by_boe_id string, notes string"


def read_json(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """Entries of `member` (or of a bare list) of every JSON file under `path`, with their file and place in load order."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    many = F.coalesce(F.try_variant_get("v", f"$.{member}", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    rows = raw.select("file", F.posexplode_outer(many).alias("pos", "e"))
    return rows.select("file", "pos", F.from_json(F.to_json("e"), schema).alias("r")).select("file", "pos", "r.*")


def broken_files(spark: SparkSession, path: str, member: str) -> DataFrame:
    """(file, problem) of the JSON files under `path` that read_json passes over: no JSON at all, or without a list to read."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    many = F.coalesce(F.try_variant_get("v", f"$.{member}", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    return raw.select("file", F.when(F.col("v").isNull(), "broken JSON").when(many.isNull(), f"no list {member}").alias("problem")).where("problem is not null")


def read_json_strict(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """read_json where a file that it would pass over is an error that names up to five of them."""
    wrong = [f"{r['file']}: {r['problem']}" for r in broken_files(spark, path, member).orderBy("file").limit(5).collect()]
    if wrong:
        raise ValueError("; ".join(wrong))
    return read_json(spark, path, member, schema)


def merge_normas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(norms, versions, refused) of all files under `path` in load order: by file name, then by place in the file.

    Permissive where load_normas is strict: of a norm that several files hold the first in load order counts, so do versions by norm
    and start; the others, versions of norms that no file holds, and broken files are refused with file, place and problem.
    """
    at = F.struct("file", "pos")
    norms = read_json(spark, path, "normas", NORM).where("boe_id is not null")
    versions = read_json(spark, path, "versions", VERSION).where("norma_boe_id is not null and effective_from is not null")
    first = lambda rows, keys: rows.groupBy(keys).agg(F.min(at).alias("_first"))
    kept = norms.join(first(norms, ["boe_id"]), "boe_id").withColumn("_kept", at == F.col("_first"))
    kept_versions = versions.join(first(versions, ["norma_boe_id", "effective_from"]), ["norma_boe_id", "effective_from"]).withColumn("_kept", at == F.col("_first"))
    known = norms.select(F.col("boe_id").alias("norma_boe_id")).distinct().withColumn("_known", F.lit(True))
    kept_versions = kept_versions.join(known, "norma_boe_id", "left")
    again = lambda rows, what, test: rows.where(test).select("file", "pos", F.lit(what).alias("problem"))
    refused = again(kept, "norm known before", ~F.col("_kept")).unionByName(again(kept_versions, "version known before", ~F.col("_kept")))
    refused = refused.unionByName(again(kept_versions, "unknown norm", F.col("_kept") & F.col("_known").isNull()))
    # A file may hold norms or versions alone; it is broken where it holds neither.
    lists = broken_files(spark, path, "normas").join(broken_files(spark, path, "versions").select("file"), "file", "left_semi")
    refused = refused.unionByName(lists.select("file", F.lit(None).cast("int").alias("pos"), "problem"))
    return kept.where("_kept").drop("_kept", "_first"), kept_versions.where("_kept and _known").drop("_kept", "_first", "_known"), refused


def quarantine(rows: DataFrame, checks: dict) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with `problems`): checks maps a problem's name to the test that shows it."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in checks.items())))
    marked = rows.withColumn("problems", found)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows`, or an error that names a key found twice."""
    twice = duplicates(rows, keys).limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {keys}: {[twice[0][k] for k in keys]}")
    return rows


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = read_json(spark, path, "deductions", RULE.replace("\n", " "))
    tiers = F.col("calculation.tiers")
    checks = {
        "no id": F.coalesce(F.trim("id"), F.lit("")) == "",
        "tax year": F.col("tax_year").isNull() | (F.col("tax_year") < 2000),
        "interval": F.col("effective_to") < F.col("effective_from"),
        "no source": F.size("sources") < 1,
        "tier rates": F.exists(tiers, lambda t: ~t["percentage"].between(0, 1)),
        "open tier not last": F.exists(F.slice(tiers, 1, F.greatest(F.size(tiers) - 1, F.lit(0))), lambda t: t["up_to"].isNull()),
    }
    good, bad = quarantine(rows, checks)
    return require_unique(good, ["id"]), bad


def load_scales(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Scales with `ordinal`, their place in load order."""
    rows = read_json(spark, path, "scales", SCALE)
    rows = rows.withColumn("ordinal", F.concat_ws("#", "file", F.format_string("%06d", "pos")))
    before = lambda i: F.get(F.col("brackets"), i - 1)["up_to"]
    checks = {
        "no brackets": F.coalesce(F.size("brackets"), F.lit(0)) < 1,
        "rates": F.exists("brackets", lambda b: ~b["rate"].between(0, 1)),
        "not increasing": F.size(F.filter("brackets", lambda b, i: (i > 0) & (before(i).isNull() | (b["up_to"] <= before(i))))) > 0,
        "interval": F.col("effective_to") < F.col("effective_from"),
        "no region": (F.col("scope") == "autonomico") & F.col("region").isNull(),
    }
    good, bad = quarantine(rows, checks)
    return require_unique(good, ["id"]), bad


def load_normas(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(norms, versions); versions of unknown norms and overlapping versions are errors."""
    from foralia.operators.temporal import orphans, overlap_violations

    norms = require_unique(read_json(spark, path, "normas", NORM).where("boe_id is not null"), ["boe_id"])
    versions = read_json(spark, path, "versions", VERSION).where("norma_boe_id is not null and effective_from is not null")
    lost = orphans(versions, norms.select(F.col("boe_id").alias("norma_boe_id")), "norma_boe_id").limit(1).collect()
    clash = overlap_violations(versions, ["norma_boe_id"]).limit(1).collect()
    if lost or clash:
        raise ValueError(f"versions of an unknown norm: {lost}; overlapping versions: {clash}")
    return norms, versions


# The members of a ruling's file, and the one that names it, by family.
RULINGS = {
    "sentencia": ("ecli", "ecli string, organo string, tribunal_codigo string, sala string, seccion string, fecha date, numero_resolucion string, fallo_sentido string, fallo_texto string, ratio_decidendi string, resumen string, content_hash string"),
    "consulta_dgt": ("numero", "numero string, organo string, fecha_salida date, impuesto string, asunto string, cuestion_planteada string, contestacion_completa string, criterio string, normativa array<string>, content_hash string"),
    "resolucion_teac": ("numero", "numero string, organo string, sede string, fecha date, tipo string, impuesto string, asunto string, criterio string, sentido string, normativa array<string>, content_hash string"),
}


def load_rulings(spark: SparkSession, path: str, family: str) -> tuple[DataFrame, DataFrame]:
    """(rulings, refused rows) of one family: every JSON file under `path` is one ruling; files that hold no object are skipped.

    Refused: without its name, or broken JSON. Two files with one name are an error.
    """
    key, schema = RULINGS[family]
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    rows = raw.where(F.col("v").isNull() | F.schema_of_variant("v").startswith("OBJECT")).select("file", F.from_json(F.to_json("v"), schema).alias("r")).select("file", "r.*")
    good, bad = quarantine(rows, {f"no {key}": F.coalesce(F.trim(key), F.lit("")) == ""})
    return require_unique(good, [key]), bad
