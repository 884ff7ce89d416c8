"""Page snapshots to links, review cards, metadata and match status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.functions import markup
from marginalia.functions.text import keyword_context, keyword_paragraph
from marginalia.functions.urls import absolute_url, book_name_any, book_url
from marginalia.operators.relational import fits_broadcast, keep_first


def harvest_links(pages: DataFrame, css_class: str | None = None, absolute: bool = True) -> DataFrame:
    """``page_id, pos, href`` of all anchors, or of those with the class.

    With ``absolute`` the target is resolved against the page's ``url``.
    """
    hrefs = pages.select(
        "page_id", "url", F.posexplode(markup.link_hrefs("html", css_class)).alias("pos", "href")
    )
    target = absolute_url("href", "url") if absolute else F.col("href")
    return hrefs.select("page_id", "pos", target.alias("href"))


def crawl_coverage(list_pages: DataFrame) -> DataFrame:
    """Per list: pages read, and whether the last page was reached."""
    has_next = markup.has_next_page("html")
    return (
        list_pages.select("list_no", "page_no", has_next.alias("has_next"))
        .groupBy("list_no")
        .agg(
            F.max("page_no").alias("pages"),
            F.bool_or(~F.col("has_next")).alias("complete"),
        )
    )


def review_cards(pages: DataFrame) -> DataFrame:
    """One row per card that has a review link and a text.

    ``url, page_id, pos, review_id, date, stars, body``. Wide HTML stays on
    this side of every shuffle.
    """
    def fields(card: Column, pos: Column) -> Column:
        return F.struct(
            pos.alias("pos"),
            markup.review_id(card).alias("review_id"),
            markup.review_date(card).alias("date"),
            markup.stars(card).alias("stars"),
            markup.review_body(card).alias("body"),
        )

    # Dropped inside the array: a filter on the rows would be pushed below the
    # projection and extract every field twice.
    whole = F.filter(
        F.transform(markup.card_htmls("html"), fields),
        lambda c: c["review_id"].isNotNull() & c["body"].isNotNull(),
    )
    return pages.select("url", "page_id", F.inline(whole))


def with_context(
    cards: DataFrame, keyword: str = fv.KEYWORD, max_words: int = fv.MAX_WORDS
) -> DataFrame:
    """The body replaced by its keyword context; cards without one are dropped."""
    context = F.array_compact(F.array(keyword_context("body", keyword, max_words)))
    return cards.select("*", F.explode(context).alias("context")).drop("body")


def keep_first_review(accepted: DataFrame) -> DataFrame:
    """First card per review of a book, in page order.

    Takes cards that already have a context: a card without the keyword does
    not use up its id. Keyed by book and review, so one book with a large share
    of all reviews is still spread over many tasks.
    """
    return keep_first(accepted, ["url", "review_id"], ["page_id", "pos"])


def accepted_reviews(
    pages: DataFrame, keyword: str = fv.KEYWORD, max_words: int = fv.MAX_WORDS
) -> DataFrame:
    """Cards to keyword reviews: ``url, review_id, book_name, stars, date, context``."""
    return keep_first_review(with_context(review_cards(pages), keyword, max_words)).select(
        "url",
        "review_id",
        book_name_any(book_url("url")).alias("book_name"),
        "stars",
        "date",
        "context",
    )


def keyword_review_count(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("url").agg(F.count(F.lit(1)).alias("keyword_review_count"))


def book_metadata(pages: DataFrame) -> DataFrame:
    """Metadata columns of book pages; a page without its main content gives no row."""
    return pages.filter(markup.is_book_page("html")).select(
        "url",
        book_name_any(book_url("url")).alias("book_name"),
        markup.authors("html").alias("author"),
        markup.avg_rating("html").alias("avg_rating"),
        markup.total_reviews("html").alias("total_reviews"),
        markup.release_date("html").alias("release_date"),
        markup.genres("html").alias("genres"),
    )


def one_per_book(metadata: DataFrame) -> DataFrame:
    """One row per URL: of several snapshots, the first by its columns in order."""
    return keep_first(metadata, ["url"], [c for c in metadata.columns if c != "url"])


def relevant_books(reviews: DataFrame, metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews and summary of the books that have both.

    The count per book is the pre-aggregated side of the summary join; reviews
    are only filtered by existence of metadata.
    """
    kept = reviews.join(metadata.select("url"), "url", "left_semi")
    summary = metadata.join(keyword_review_count(reviews), "url")
    return kept, summary


def relevant_metadata(pages: DataFrame, reviews: DataFrame) -> DataFrame:
    """Metadata of the pages of books with accepted reviews.

    HTML is never shuffled. Few books are looked up at the scan, so only their
    pages are parsed; for very many, all pages are parsed and the short results
    are joined.
    """
    urls = reviews.select("url").distinct()
    if fits_broadcast(urls):
        return book_metadata(pages.join(F.broadcast(urls), "url", "left_semi"))
    return book_metadata(pages).join(urls, "url", "left_semi")


def review_columns(reviews: DataFrame) -> DataFrame:
    return reviews.select(*fv.REVIEW_COLUMNS)


def summary_columns(summary: DataFrame) -> DataFrame:
    return summary.select(*fv.SUMMARY_COLUMNS)


def match_status(pages: DataFrame, keyword: str = fv.KEYWORD) -> DataFrame:
    """``url, status, error_type`` of checked pages.

    A page that could not be read (an ``error_type``, or no HTML) fails; a page
    with a review that holds the keyword matches; any other does not.
    """
    error = F.col("error_type") if "error_type" in pages.columns else F.lit(None).cast("string")
    bodies = F.transform(markup.card_htmls("html"), lambda card: markup.review_body(card))
    found = F.exists(bodies, lambda b: keyword_paragraph(b, keyword).isNotNull())
    failed = error.isNotNull() | F.col("html").isNull()
    return pages.select(
        "url",
        F.when(failed, fv.FAILURE)
        .when(F.coalesce(found, F.lit(False)), fv.VALID_MATCH)
        .otherwise(fv.NO_MATCH)
        .alias("status"),
        F.when(failed, F.coalesce(error, F.lit(fv.MISSING_PAGE))).alias("error_type"),
    )
