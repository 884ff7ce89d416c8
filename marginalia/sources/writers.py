"""Sinks: sorted lists, status ledger, CSV, embedding cache, map points."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import fixed_values as fv


def write_sorted_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line; files in order, lines in order inside each file.

    The sort is a range partitioning, so no task holds the whole list.
    """
    df.select(F.col(column).alias("value")).orderBy("value").write.text(path)


def append_by_status(df: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Add results to the ledger, one folder per batch and status.

    Writing the same batch again replaces it, so a retried batch is not
    counted twice.
    """
    batch = batch_id or uuid.uuid4().hex
    (
        df.select("url", "error_type", F.lit(batch).alias("batch_id"), "status")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", "status")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.option("header", True)
        .option("quoteAll", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_csv_if_any(df: DataFrame, path: str) -> bool:
    """Write unless there are no rows; tells whether it wrote."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


def append_embeddings(df: DataFrame, path: str) -> None:
    """Add ``(text_hash, embedding, encoder)`` rows to the cache."""
    df.select("text_hash", "embedding", "encoder").write.mode("append").partitionBy(
        "encoder"
    ).parquet(path)


def write_map_points(df: DataFrame, path: str) -> None:
    """Positions, both classes and the hover columns."""
    df.select("x", "y", "author_class", *fv.HOVER_COLUMNS).write.parquet(path)
