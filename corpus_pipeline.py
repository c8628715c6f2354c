"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, applied in turn to `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foralia.llm import line_dedup, mixing, packing, quality, simhash
from foralia.runtime import materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and all certified cutoffs."""
    return quality.keep_good(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in the largest doc_id alone."""
    return _documents(line_dedup.dedup_lines(docs.select(COLUMNS)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return simhash.keep_one(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that training takes, in the order of the curriculum; the last copy of a source may be cut."""
    mixed = mixing.mix(docs.select(*COLUMNS, mixing.word_count("text").alias("size")))
    copies = mixed.select("*", F.inline("copies")).drop("copies")
    placed = mixing.cut_to_words(copies).repartitionByRange("position", "doc_id")
    return _documents(placed.sortWithinPartitions("position", "doc_id", "copy"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all copies in windows of 2048 ids."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("dedup_lines", dedup_lines),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Certified cutoffs and similarity groups have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
