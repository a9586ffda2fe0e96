"""The corpus pipeline: five stages over the documents table, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackdensity.llm import decontaminate, language_id, line_dedup, near_dedup, pieces
from trackdensity.llm.shared import table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told (no letters, or no trained language is likely)."""
    return language_id.keep_accepted(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of three-line passages; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    cut = F.col(out.columns[-1]) > 0
    n_chars = F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[(n_chars.alias(c) if c == "n_chars" else F.col(c)) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_documents(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or an edited copy of one."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, checked by decoding them."""
    import public_tokenizers

    return pieces.round_trip(docs, pieces.Pieces.load(public_tokenizers.path("piece_bpe_32k.model")), with_ids=True)


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("decontaminate", benchmark_stage), ("sentencepiece", piece_stage)]

#: Similarity groups, alignment and the piece lattice have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
