"""Expressions that the text operators share.

Documents are rows with ``doc_id`` and ``text``; other columns are not read
unless an operator names them. A null text counts as empty. A row without an id
counts as one document whose id is below all others, and comes back without id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII white space, as in [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
NO_ID = -(2**63)


def documents(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """``doc_id`` and ``text`` without nulls, and the named columns as they are."""
    return docs.select(
        *columns,
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )


def rest_of_row(docs: DataFrame) -> Column:
    """All other columns as one, so that their names cannot clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return (F.struct(*others) if others else F.struct(F.lit(None).alias("none"))).alias("rest")


def as_before(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order, from ``doc_id``, ``text`` and ``rest``."""
    own = {"doc_id": real_id("doc_id"), "text": F.col("text")}
    return df.select(*[own.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns])


def real_id(c: Column | str) -> Column:
    """The id as it came in: null where there was none."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(NO_ID))


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    ``lower`` agrees on pure ASCII and is many times faster than ``translate``.
    """
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def digest(c: Column) -> Column:
    """128 bits of the content."""
    return F.unhex(F.md5(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def large(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: shuffled at every size, never broadcast."""
    return df.hint("merge")
