"""Extraction: verified URLs and page tables to the two CSV tables, and their repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.functions.urls import book_name_any, book_url, reviews_url
from marginalia.operators.names import fix_names, repair_counts
from marginalia.operators.relational import fits_broadcast
from marginalia.operators.reviews import (
    accepted_reviews,
    book_metadata,
    one_per_book,
    relevant_books,
    relevant_metadata,
    review_columns,
    summary_columns,
)
from marginalia.session import materialise
from marginalia.sources.readers import read_reviews_csv, read_summary_csv
from marginalia.sources.writers import write_csv, write_csv_if_any


def extract(
    urls: DataFrame,
    pages: DataFrame,
    keyword: str = fv.KEYWORD,
    max_words: int = fv.MAX_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Keyword reviews and summary of the books that have both.

    ``pages`` holds review and book pages under their own URLs. Metadata is read
    only for books with accepted reviews.
    """
    wanted = urls.select(
        F.col("url").alias("book"), reviews_url("url").alias("reviews"), book_url("url").alias("main")
    ).distinct()
    few = fits_broadcast(wanted)

    def of_books(rows: DataFrame, column: str, books: DataFrame, sent: bool) -> DataFrame:
        """Rows of the pages of these books, under the URL of the book."""
        keys = books.select("book", F.col(column).alias("url"))
        keyed = rows.join(F.broadcast(keys) if sent else keys, "url")
        return keyed.withColumn("url", F.col("book")).drop("book")

    # HTML is never shuffled: few URLs are looked up at the scan; for very many,
    # all pages are parsed and the short results are joined.
    if few:
        reviews = accepted_reviews(of_books(pages, "reviews", wanted, few), keyword, max_words)
    else:
        reviews = of_books(accepted_reviews(pages, keyword, max_words), "reviews", wanted, few)
    reviews = materialise(reviews, "reviews")
    # Of a long list, few books may have accepted reviews; only their pages are parsed.
    reviewed = reviews.select(F.col("url").alias("book")).distinct()
    found = materialise(wanted.join(reviewed, "book", "left_semi"), "reviewed")
    if fits_broadcast(found):
        metadata = relevant_metadata(of_books(pages, "main", found, True), reviews)
    else:
        metadata = of_books(book_metadata(pages), "main", found, False)
    # The name goes by the listed URL on either path. Copies of a page give one row.
    named = metadata.withColumn("book_name", book_name_any(book_url("url")))
    return relevant_books(reviews, materialise(one_per_book(named), "metadata"))


def extract_to_csv(
    urls: DataFrame, pages: DataFrame, reviews_out: str, summary_out: str, **options
) -> tuple[bool, bool]:
    reviews, summary = extract(urls, pages, **options)
    return (
        write_csv_if_any(review_columns(reviews), reviews_out),
        write_csv_if_any(summary_columns(summary), summary_out),
    )


def repair_csv(spark: SparkSession, path: str, out: str, kind: str) -> int:
    """Repair the names of one table; writes only if a row looked bad.

    The count reads the name column alone. A missing table counts nothing.
    """
    read = {"reviews": read_reviews_csv, "summary": read_summary_csv}[kind]
    table = read(spark, path)
    rows = repair_counts(table).first()["rows"]
    if rows:
        write_csv(fix_names(table), out)
    return rows
