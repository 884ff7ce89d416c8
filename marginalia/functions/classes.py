"""Class labels, dates and typed views of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.functions.text import _col


def author_class(
    author: Column | str,
    needle: str = fv.AUTHOR_NEEDLE,
    label: str = fv.AUTHOR_LABEL,
    other: str = fv.OTHER_LABEL,
) -> Column:
    """``label`` if the author text (joint authors included) holds the needle."""
    hit = F.contains(F.lower(_col(author)), F.lit(needle.lower()))
    return F.when(hit, F.lit(label)).otherwise(F.lit(other))


def parse_date(c: Column | str, formats: Sequence[str] = fv.DATE_FORMATS) -> Column:
    """First format that reads the text; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in formats])


def period_class(
    date: Column | str,
    split: str = fv.SPLIT_DATE,
    before: str = fv.BEFORE_LABEL,
    after: str = fv.AFTER_LABEL,
) -> Column:
    """Before the split date, or from it on (a missing date counts as after)."""
    return F.when(_col(date) < F.lit(split).cast("timestamp"), F.lit(before)).otherwise(F.lit(after))


def class_mask(c: Column | str, label: str) -> Column:
    return F.coalesce(_col(c) == F.lit(label), F.lit(False))


def typed_summary(df: DataFrame) -> DataFrame:
    """Numbers and lists for the text columns; sentinels become null."""
    def listed(name: str) -> Column:
        known = F.nullif(F.col(name), F.lit(fv.NOT_FOUND))
        return F.when(known == "", F.array().cast("array<string>")).otherwise(
            F.split(known, r" \| ")
        )

    return df.withColumns(
        {
            "avg_rating": F.col("avg_rating").try_cast("double"),
            "total_reviews": F.col("total_reviews").try_cast("bigint"),
            "author": listed("author"),
            "genres": listed("genres"),
        }
    )


def typed_stars(stars: Column | str) -> Column:
    return _col(stars).try_cast("int")
