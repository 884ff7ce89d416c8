"""Repair of bad book names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.urls import is_bad_name, repair_name
from marginalia.operators.relational import join_keys


def bad_names(df: DataFrame, column: str = "book_name") -> DataFrame:
    return df.select(F.col(column)).filter(is_bad_name(column)).distinct()


def name_map(df: DataFrame, column: str = "book_name") -> DataFrame:
    """Each distinct bad name with its repair."""
    return bad_names(df, column).withColumn("fixed", repair_name(column))


def apply_name_map(df: DataFrame, names: DataFrame, column: str = "book_name") -> DataFrame:
    """Replace whole values found in the map; other values stay.

    The map grows with the data, so its size is checked before it is broadcast.
    """
    return (
        join_keys(df, names, column, "left")
        .withColumn(column, F.coalesce("fixed", column))
        .select(*df.columns)
    )


def fix_names(df: DataFrame, column: str = "book_name") -> DataFrame:
    """Same result as mapping the distinct bad names, as an expression: no shuffle."""
    return df.withColumn(column, F.when(is_bad_name(column), repair_name(column)).otherwise(F.col(column)))


def repair_counts(df: DataFrame, column: str = "book_name") -> DataFrame:
    """Rows and distinct values that look bad, repaired or not."""
    return (
        df.filter(is_bad_name(column))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("names"),
        )
    )
