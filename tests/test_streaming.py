"""Streams give what the batch operators give."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import registry
from marginalia.operators import corpus, reviews
from marginalia.session import scratch_path
from marginalia.sources import readers, writers
from marginalia.streaming import jobs
from tests.test_reviews import card


@pytest.fixture(scope="module")
def folder(spark):
    path = scratch_path(spark, "arrivals")
    write_pages(spark, path, [("a", card(1, "key")), ("b", card(2, "no")), ("c", None)])
    write_pages(spark, path, [("d", card(1, "a key<br>b") + card(3, "KEY"))])
    return path


def write_pages(spark, path, rows):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], readers.PAGES_SCHEMA)
    df.coalesce(1).write.mode("append").parquet(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def finish(query):
    query.awaitTermination()


def test_routing_resumes_and_counts_once(spark, folder):
    ledger, checkpoint = scratch_path(spark, "ledger"), scratch_path(spark, "cp")
    finish(jobs.route_status(jobs.page_stream(spark, folder, max_files=1), ledger, checkpoint, "key"))
    batch = reviews.match_status(readers.read_pages(spark, folder), "key")
    first = readers.read_ledger(spark, ledger)
    assert rows(first.select("url", "status", "error_type")) == rows(batch)
    assert first.select("batch_id").distinct().count() == 2
    # Started again: only the new page is checked.
    late = scratch_path(spark, "late")
    finish(jobs.route_status(jobs.page_stream(spark, folder), ledger, checkpoint, "key"))
    assert readers.read_ledger(spark, ledger).count() == 4
    # Another run over all pages and a new one, told what is settled.
    write_pages(spark, late, [("a", card(1, "key")), ("e", card(9, "key"))])
    fresh = jobs.resume_stream(jobs.page_stream(spark, late), readers.read_ledger(spark, ledger))
    finish(jobs.route_status(fresh, ledger, scratch_path(spark, "cp"), "key"))
    assert {r.url: r.status for r in readers.read_ledger(spark, ledger).collect()}["e"] == "VALID_MATCH"
    assert readers.read_ledger(spark, ledger).count() == 5


def test_contexts(spark, folder):
    out = scratch_path(spark, "contexts")
    stream = jobs.context_stream(jobs.page_stream(spark, folder, max_files=1), "key")
    finish(jobs.to_parquet(stream, out, scratch_path(spark, "cp")))
    batch = reviews.with_context(reviews.review_cards(readers.read_pages(spark, folder)), "key")
    assert rows(spark.read.parquet(out)) == rows(batch)


def test_counts(spark, folder):
    out = scratch_path(spark, "counts")
    counts = jobs.running_counts(reviews.match_status(jobs.page_stream(spark, folder, max_files=1), "key"))
    finish(jobs.counts_to_parquet(counts, out, scratch_path(spark, "cp")))
    batch = corpus.status_counts(reviews.match_status(readers.read_pages(spark, folder), "key"))
    assert rows(jobs.latest_counts(spark, out)) == rows(batch)


def test_readers_of_counts_see_one_version(spark):
    """A table read before a batch stays as it was; a batch cut off before its commit does not count."""
    path, out, checkpoint = scratch_path(spark, "arrivals"), scratch_path(spark, "counts"), scratch_path(spark, "cp")

    def arrive(number):
        write_pages(spark, path, [(f"u{number}", card(number, "key"))])
        finish(jobs.counts_to_parquet(jobs.running_counts(reviews.match_status(jobs.page_stream(spark, path), "key")), out, checkpoint))

    with pytest.raises(FileNotFoundError):
        jobs.latest_counts(spark, out)
    arrive(0)
    first = jobs.latest_counts(spark, out)
    arrive(1)
    assert [r.n for r in first.collect()] == [1] and [r.n for r in jobs.latest_counts(spark, out).collect()] == [2]
    # Written in part: no commit mark.
    spark.createDataFrame([("VALID_MATCH", 99)], "status string, n long").write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false"
    ).parquet(f"{out}/version=77")
    assert [r.n for r in jobs.latest_counts(spark, out).collect()] == [2]
    for number in (2, 3, 4):
        arrive(number)
    assert [r.n for r in jobs.latest_counts(spark, out).collect()] == [5]
    assert len(jobs._versions(spark, out)) == jobs.KEPT_VERSIONS


def test_counts_where_jobs_leave_no_marks(spark, folder):
    out, setting = scratch_path(spark, "counts"), "mapreduce.fileoutputcommitter.marksuccessfuljobs"
    spark.conf.set(setting, "false")
    try:
        counts = jobs.running_counts(reviews.match_status(jobs.page_stream(spark, folder, max_files=1), "key"))
        finish(jobs.counts_to_parquet(counts, out, scratch_path(spark, "cp")))
    finally:
        spark.conf.unset(setting)
    batch = corpus.status_counts(reviews.match_status(readers.read_pages(spark, folder), "key"))
    assert rows(jobs.latest_counts(spark, out)) == rows(batch)


def test_keep_first_over_batches(spark):
    path, out = scratch_path(spark, "seen"), scratch_path(spark, "first")
    schema = "url string, review_id string, seen_at timestamp_ntz, body string"
    for minute, body in ((0, "first"), (5, "copy")):
        df = spark.createDataFrame([("u", "1", body), ("u", f"only-{minute}", body)], "url string, review_id string, body string")
        at = F.lit(f"2024-01-01 00:0{minute}:00").cast("timestamp_ntz")
        df.select("url", "review_id", at.alias("seen_at"), "body").coalesce(1).write.mode("append").parquet(path)
    stream = jobs.page_stream(spark, path, max_files=1, schema=schema)
    finish(jobs.to_parquet(jobs.keep_first_stream(stream), out, scratch_path(spark, "cp")))
    assert sorted(r.review_id for r in spark.read.parquet(out).collect()) == ["1", "only-0", "only-5"]


def test_batch_append_next_to_stream(spark, folder):
    ledger = scratch_path(spark, "ledger")
    finish(jobs.route_status(jobs.page_stream(spark, folder), ledger, scratch_path(spark, "cp"), "key"))
    writers.append_by_status(
        spark.createDataFrame([("z", "FAILURE", "Timeout")], "url string, status string, error_type string"), ledger
    )
    assert readers.read_ledger(spark, ledger).count() == 5


@pytest.mark.parametrize("files", [1, 3])
def test_table_in_one_file_or_a_folder(spark, files):
    """The given tables come in both forms; a stream over a folder read none of its files."""
    sf = scratch_path(spark, "tables")
    given_tables(spark, sf, files)
    got = registry.stream_context(spark, sf)
    assert sorted(r.review_id for r in got.collect()) == [f"/review/show/{n}" for n in (0, 2, 3, 4, 5)]
    assert {r.url: r.status for r in registry.stream_status(spark, sf).collect()}[f"{registry.fx.SITE}/doc/1"] == "NO_MATCH"


def given_tables(spark, sf, files):
    """Six documents, all but one with the keyword, and their orders; ``files`` files in a folder, or one file itself."""
    docs = spark.range(6).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") == 1, "nothing").otherwise("found with it").alias("text"), F.lit("en").alias("lang")
    )
    orders = spark.range(6).select(
        F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"),
        F.to_date(F.lit("1997-05-01")).alias("o_orderdate"),
    )
    for df, name in ((docs, "documents"), (orders, "orders")):
        if files == 1:
            Path(sf).mkdir(exist_ok=True)
            df.toPandas().to_parquet(f"{sf}/{name}.parquet")
        else:
            df.repartition(files).write.parquet(f"{sf}/{name}.parquet")


def test_counts_of_a_table_in_a_folder(spark):
    sf = scratch_path(spark, "tables")
    given_tables(spark, sf, 3)
    assert rows(registry.stream_counts(spark, sf)) == [("NO_MATCH", 1), ("VALID_MATCH", 5)]
