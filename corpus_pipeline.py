"""From raw documents to packed sequences: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.line_dedup import without_repeated_lines
from marginalia.llm.near_dedup import one_of_each
from marginalia.llm.pii import with_surrogates
from marginalia.llm.quality import of_quality
from marginalia.llm.queries import PII_KEY, documents_table, pack_documents
from marginalia.session import materialise


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and are no outliers of their language and source."""
    return of_quality(docs)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand in a document of larger id."""
    return _sized(without_repeated_lines(docs))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates, of similarity 0.8 or more."""
    return one_of_each(docs, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates."""
    return _sized(with_surrogates(docs, PII_KEY))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", lines_stage),
    ("near_dedup", near_duplicates_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# SQL can express neither the robust estimates nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = documents_table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
