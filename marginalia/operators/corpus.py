"""Corpus bookkeeping: retry rounds, unique works, ledger, backlog, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.functions.urls import work_id


def first_seen(links: DataFrame) -> DataFrame:
    """Links found and newly seen per list page.

    ``links`` has ``list_no, page_no, url``, in crawl order by list and page. A
    link is new on the first page that shows it, once.
    """
    # One shuffle of the links; both branches below start from its result. The
    # count rides along in the ordering struct so that both need equal columns.
    per_page = links.groupBy("list_no", "page_no", "url").agg(F.count(F.lit(1)).alias("n"))
    firsts = (
        per_page.groupBy("url")
        .agg(F.min(F.struct("list_no", "page_no", "n")).alias("first"))
        .select("first.list_no", "first.page_no", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("new"))
    )
    seen = per_page.select("list_no", "page_no", "n", F.lit(0).alias("new"))
    return (
        seen.unionByName(firsts)
        .groupBy("list_no", "page_no")
        .agg(F.sum("n").alias("found"), F.sum("new").alias("new"))
    )


def settled_urls(attempts: DataFrame, max_passes: int = fv.MAX_PASSES) -> DataFrame:
    """Per URL its first attempt that led to a work: ``url, attempt, work_id, canonical_url``.

    All but the URL is null if it never got there. The jobs below take the log
    or this table. Several of them over one log, or one that needs it often, are
    best given ``materialise(settled_urls(log))``: the log is then read once.
    """
    if "work_id" in attempts.columns:
        return attempts
    hit = F.when(
        work_id("canonical_url").isNotNull() & (F.col("attempt") <= max_passes),
        F.struct("attempt", "canonical_url"),
    )
    return (
        attempts.groupBy("url")
        .agg(F.min(hit).alias("hit"))
        .select(
            "url",
            "hit.attempt",
            work_id("hit.canonical_url").alias("work_id"),
            "hit.canonical_url",
        )
    )


def retry_rounds(attempts: DataFrame, max_passes: int = fv.MAX_PASSES) -> DataFrame:
    """``attempt, pending, new_works`` of the passes that were worth running.

    A URL settles at its first attempt with a work id; a known work settles it
    too but adds nothing. Passes end when nothing is pending, after the first
    later pass without a new work, or at ``max_passes``.
    """
    settled = settled_urls(attempts, max_passes)
    per_pass = settled.groupBy("attempt").agg(F.count(F.lit(1)).alias("urls"))
    new_works = (
        settled.filter(F.col("work_id").isNotNull())
        .groupBy("work_id")
        .agg(F.min("attempt").alias("attempt"))
        .groupBy("attempt")
        .agg(F.count(F.lit(1)).alias("works"))
    )
    passes = attempts.sparkSession.range(1, max_passes + 1).select(
        F.col("id").cast("int").alias("attempt")
    )
    # At most max_passes rows from here on, so one-partition windows are fine.
    before = Window.orderBy(F.col("attempt").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    never = per_pass.filter(F.col("attempt").isNull()).agg(F.sum("urls"))
    table = (
        passes.join(per_pass, "attempt", "left")
        .join(new_works, "attempt", "left")
        .select(
            "attempt",
            (F.coalesce(F.sum("urls").over(before), F.lit(0)) + F.coalesce(never.scalar(), F.lit(0))).alias("pending"),
            F.coalesce("works", F.lit(0)).alias("new_works"),
        )
    )
    stalled = F.when((F.col("attempt") > 1) & (F.col("new_works") == 0), F.col("attempt"))
    return (
        table.withColumn("stop", F.coalesce(F.min(stalled).over(everything), F.lit(max_passes)))
        .filter((F.col("attempt") <= F.col("stop")) & (F.col("pending") > 0))
        .drop("stop")
    )


def _last_pass(attempts: DataFrame, max_passes: int):
    """The number of the last pass, as a one-value subquery."""
    return retry_rounds(attempts, max_passes).agg(F.coalesce(F.max("attempt"), F.lit(0))).scalar()


def pending_after_rounds(attempts: DataFrame, max_passes: int = fv.MAX_PASSES) -> DataFrame:
    """URLs left for the fallback pass."""
    done = F.coalesce(F.col("attempt") <= _last_pass(attempts, max_passes), F.lit(False))
    return settled_urls(attempts, max_passes).filter(~done).select("url")


def fallback_pass(pending: DataFrame, fallback: DataFrame) -> DataFrame:
    """Pending URLs the fallback resolved: ``url, canonical_url, work_id``.

    Any canonical URL settles here, with or without a work id.
    """
    resolved = (
        fallback.filter(F.nullif("canonical_url", F.lit("")).isNotNull())
        .groupBy("url")
        .agg(F.min("canonical_url").alias("canonical_url"))
    )
    return pending.join(resolved, "url").withColumn("work_id", work_id("canonical_url"))


def still_pending(pending: DataFrame, fallback: DataFrame) -> DataFrame:
    resolved = fallback.filter(F.nullif("canonical_url", F.lit("")).isNotNull()).select("url")
    return pending.join(resolved.distinct(), "url", "left_anti")


def unique_works(
    attempts: DataFrame, fallback: DataFrame | None = None, max_passes: int = fv.MAX_PASSES
) -> DataFrame:
    """One canonical URL per work id.

    The earliest pass wins, the fallback comes last; inside a pass the smallest
    URL is taken. A URL counts only at the attempt it settled with.
    """
    found = (
        settled_urls(attempts, max_passes)
        .filter(F.col("attempt") <= _last_pass(attempts, max_passes))
        .select("attempt", "canonical_url")
    )
    if fallback is not None:
        late = fallback_pass(pending_after_rounds(attempts, max_passes), fallback)
        found = found.unionByName(
            late.select(F.lit(max_passes + 1).alias("attempt"), "canonical_url")
        )
    return canonical_works(found)


def canonical_works(found: DataFrame) -> DataFrame:
    """``work_id, canonical_url`` from rows of ``attempt, canonical_url``."""
    # Dropped inside the array: a filter on the rows would be pushed below a join
    # and read the page again for every mention of the URL.
    with_id = F.filter(
        F.transform(F.array("canonical_url"), lambda url: F.struct(work_id(url).alias("work_id"), url.alias("canonical_url"))),
        lambda work: work["work_id"].isNotNull(),
    )
    return (
        found.select("attempt", F.inline(with_id))
        .groupBy("work_id")
        .agg(F.min(F.struct("attempt", "canonical_url")).alias("first"))
        .select("work_id", "first.canonical_url")
    )


def funnel(
    urls: DataFrame,
    attempts: DataFrame,
    fallback: DataFrame | None = None,
    max_passes: int = fv.MAX_PASSES,
) -> DataFrame:
    """One row: input URLs, unique works, URLs that could not be processed."""
    left = pending_after_rounds(attempts, max_passes)
    if fallback is not None:
        left = still_pending(left, fallback)
    one = F.count(F.lit(1))
    return urls.agg(F.count_distinct("url").alias("input_urls")).select(
        "input_urls",
        unique_works(attempts, fallback, max_passes).agg(one).scalar().alias("unique_works"),
        left.agg(one).scalar().alias("unprocessed"),
    )


def processed_urls(ledger: DataFrame) -> DataFrame:
    """Every URL with any status, once."""
    return ledger.select("url").distinct()


def backlog(urls: DataFrame, ledger: DataFrame) -> DataFrame:
    """Distinct URLs without a status yet."""
    return urls.select("url").distinct().join(processed_urls(ledger), "url", "left_anti")


def next_batch(backlog_urls: DataFrame, n: int = fv.BATCH_SIZE, seed: int = 0) -> DataFrame:
    """A random batch; the same seed gives the same batch.

    Each task keeps its ``n`` smallest, so there is no full sort.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("url")))
    return backlog_urls.select("url").orderBy(order, "url").limit(n)


def status_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def backlog_counts(urls: DataFrame, ledger: DataFrame, n: int = fv.BATCH_SIZE) -> DataFrame:
    """One row: URLs remaining now, in the next batch, and after it."""
    before = F.count(F.lit(1))
    return backlog(urls, ledger).agg(before.alias("remaining")).select(
        "remaining",
        F.least(F.col("remaining"), F.lit(n)).alias("in_batch"),
        F.greatest(F.col("remaining") - n, F.lit(0)).alias("remaining_after"),
    )
