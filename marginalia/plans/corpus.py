"""Corpus funnel: discovery, de-duplication, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.functions.urls import reviews_url
from marginalia.operators.corpus import backlog, backlog_counts, next_batch, settled_urls, unique_works
from marginalia.operators.relational import fits_broadcast
from marginalia.operators.reviews import harvest_links, match_status
from marginalia.session import materialise
from marginalia.sources.readers import read_ledger, read_url_list
from marginalia.sources.writers import append_by_status, write_sorted_lines


def discover(list_pages: DataFrame, out: str, css_class: str = fv.BOOK_LINK_CLASS) -> None:
    """Book links of list pages (``page_id, url, html``) to a sorted list."""
    links = harvest_links(list_pages, css_class).select(F.col("href").alias("url")).distinct()
    write_sorted_lines(links, "url", out)


def deduplicate(attempts: DataFrame, fallback: DataFrame | None, out: str) -> None:
    """Attempt log to a sorted list of one URL per work."""
    settled = materialise(settled_urls(attempts), "settled")
    write_sorted_lines(unique_works(settled, fallback), "canonical_url", out)


def verify_batch(
    spark: SparkSession,
    urls_path: str,
    pages: DataFrame,
    ledger_path: str,
    n: int = fv.BATCH_SIZE,
    seed: int = 0,
    keyword: str = fv.KEYWORD,
) -> DataFrame:
    """Check the next batch against the page table and extend the ledger.

    Returns the counts before and after. A URL without a page fails.
    """
    urls, ledger = read_url_list(spark, urls_path), read_ledger(spark, ledger_path)
    counts = materialise(backlog_counts(urls, ledger, n), "backlog-counts")
    batch = next_batch(backlog(urls, ledger), n, seed)
    batch = materialise(batch.withColumn("page_url", reviews_url("url")), "batch")
    keys = batch.select(F.col("page_url").alias("url")).distinct()
    found = pages.select("url", "html")
    # Pages are matched where they are read; only their status meets the batch.
    if fits_broadcast(keys):
        checked = match_status(found.join(F.broadcast(keys), "url", "left_semi"), keyword)
    else:
        checked = match_status(found, keyword).join(keys, "url", "left_semi")
    checked = checked.withColumnRenamed("url", "page_url")
    missing = {"status": F.coalesce("status", F.lit(fv.FAILURE)), "error_type": F.when(F.col("status").isNull(), fv.MISSING_PAGE).otherwise(F.col("error_type"))}
    results = batch.join(checked, "page_url", "left").withColumns(missing)
    # Several snapshots of a page: a match in any of them counts.
    best = F.min(
        F.struct(
            F.when(F.col("status") == fv.VALID_MATCH, 0).when(F.col("status") == fv.NO_MATCH, 1).otherwise(2).alias("o"),
            "status",
            "error_type",
        )
    )
    results = results.groupBy("url").agg(best.alias("b")).select("url", "b.status", "b.error_type")
    append_by_status(results, ledger_path)
    return counts
