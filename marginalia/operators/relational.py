"""Row-level building blocks shared by the jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import materialise


# Keys that may be sent to every task: a few hundred bytes each at most.
BROADCAST_ROWS = 500_000


def fits_broadcast(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` has few enough rows to be sent to every task.

    Counts, and stops counting beyond the limit; for key tables that are cheap
    to compute or already written.
    """
    limit = BROADCAST_ROWS if limit is None else limit
    return df.limit(limit + 1).count() <= limit


def join_keys(df: DataFrame, keys: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a large table with a table of distinct keys.

    The key table is written once. Then its size is known: a small one is sent
    to every task. A large one is joined by shuffle, as a plain scan, because the
    adaptive skew join can split a hot key only where no aggregation stands
    between shuffle and join.
    """
    keys = materialise(keys, "keys")
    return df.join(F.broadcast(keys) if fits_broadcast(keys) else keys, on, how)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop rows with a null in any of the columns; sentinels are values.

    Plain predicates reach the scan and turn outer joins into inner ones, which
    ``dropna`` does not.
    """
    kept = F.lit(True)
    for name in columns:
        kept = kept & F.col(name).isNotNull()
        if df.schema[name].dataType.typeName() in ("float", "double"):
            kept = kept & ~F.isnan(name)
    return df.filter(kept)


def drop_cols(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def first_n(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows per key in the given (total) order.

    Spark applies the row limit per task before the shuffle as well, so a key
    that holds a large share of the rows sends at most ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def keep_first(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column]) -> DataFrame:
    """The first row per key; nulls in other columns are kept as they are."""
    return first_n(df, keys, order, 1)


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Number rows in source order, to be taken right after the source.

    Tasks take files by size, so rows of files are ordered by path first; a table
    that comes from no file, in scan order.
    """
    row = F.monotonically_increasing_id()
    if not df.inputFiles():
        return df.withColumn(name, row)
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), row.alias("row")))


def sort_urls(df: DataFrame, column: str = "url") -> DataFrame:
    return df.orderBy(column)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.subtract(b)


def collect_results(*dfs: DataFrame) -> DataFrame:
    """Rows of all inputs, matched by column name, duplicates kept."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def row_counts(df: DataFrame, *distinct_columns: str) -> DataFrame:
    """Rows, and distinct values of the named columns."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_distinct(F.col(c)).alias(f"distinct_{c}") for c in distinct_columns],
    )
