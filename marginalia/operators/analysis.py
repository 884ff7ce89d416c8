"""The analysis frame: reviews, their metadata and derived columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.functions.classes import author_class, parse_date, period_class
from marginalia.functions.text import join_key, remove_entities, snippet, text_hash
from marginalia.operators.relational import drop_incomplete, join_keys, keep_first


@dataclass(frozen=True)
class AnalysisParams:
    author_needle: str = fv.AUTHOR_NEEDLE
    author_label: str = fv.AUTHOR_LABEL
    other_label: str = fv.OTHER_LABEL
    split_date: str = fv.SPLIT_DATE
    before_label: str = fv.BEFORE_LABEL
    after_label: str = fv.AFTER_LABEL
    date_formats: Sequence[str] = fv.DATE_FORMATS
    entities: Sequence[str] = fv.ENTITIES
    snippet_chars: int = fv.SNIPPET_CHARS


def first_metadata(summary: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """First author per join key in source order, null if the first is null."""
    keyed = summary.select(join_key("book_name").alias("join_key"), "author", ordinal)
    return keep_first(keyed, ["join_key"], [ordinal]).select("join_key", "author")


def with_metadata(reviews: DataFrame, summary: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Reviews with the author of their book, incomplete rows dropped.

    The metadata side has one row per key; see ``join_keys`` for a book with
    very many reviews.
    """
    keyed = reviews.withColumn("join_key", join_key("book_name"))
    joined = join_keys(keyed, first_metadata(summary, ordinal), "join_key", "left")
    return drop_incomplete(joined, fv.REQUIRED_REVIEW_COLUMNS).drop("join_key")


def with_classes(df: DataFrame, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """Author class, parsed date and period; rows without a readable date go."""
    dated = df.withColumns(
        {
            "author_class": author_class(
                "author", params.author_needle, params.author_label, params.other_label
            ),
            "date": parse_date("date", params.date_formats),
        }
    )
    return drop_incomplete(dated, ["date"]).withColumn(
        "period",
        period_class("date", params.split_date, params.before_label, params.after_label),
    )


def analysis_columns(df: DataFrame, params: AnalysisParams = AnalysisParams()) -> DataFrame:
    """All derived columns; the text hash is the key of the vector jobs."""
    return (
        with_classes(df, params)
        .withColumns(
            {
                "context_cleaned": remove_entities("context", params.entities),
                "context_short": snippet("context", params.snippet_chars),
            }
        )
        .withColumn("text_hash", text_hash("context_cleaned"))
    )


def class_period_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("author_class", "period").agg(F.count(F.lit(1)).alias("n"))
