"""What must hold of the physical plans whatever the data size."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import markup
from marginalia.operators import analysis, corpus, density, names, relational, reviews
from marginalia.session import scratch_path
from marginalia.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    """Parquet tables wider than any job needs."""
    def write(name, expressions):
        path = scratch_path(spark, name)
        spark.range(100).selectExpr(*expressions).write.parquet(path)
        return spark.read.parquet(path)

    return {
        "reviews": write("reviews", ["concat('n', id % 7) AS book_name", "'4' AS stars", "'May 1, 2020' AS date", "'text' AS context", "id AS extra"]),
        "summary": write("summary", ["concat('n', id) AS book_name", "'a' AS author", "'w' AS genres", "id AS ordinal"]),
        "log": write("log", ["concat('u', id % 9) AS url", "cast(id % 4 + 1 AS int) AS attempt", "'/book/show/1' AS canonical_url", "id AS extra"]),
        "pages": write("pages", ["id AS page_id", "concat('u', id) AS url", "'<a href=\"/x\">' AS html", "id AS extra"]),
        "cards": write("cards", ["concat('u', id % 3) AS url", "concat('r', id) AS review_id", "id AS page_id", "1 AS pos", "'t' AS context"]),
    }


def test_only_needed_columns_are_read(stored):
    assert "ReadSchema: struct<book_name:string>" in plan(names.repair_counts(stored["reviews"]))
    assert "ReadSchema: struct<url:string,attempt:int,canonical_url:string>" in plan(corpus.settled_urls(stored["log"]))
    read = plan(analysis.with_metadata(stored["reviews"].drop("extra"), stored["summary"]))
    first = plan(analysis.first_metadata(stored["summary"]))
    assert "struct<book_name:string,author:string,ordinal:bigint>" in first
    assert "BroadcastHashJoin" in read and "Exchange hashpartitioning" not in read
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in plan(reviews.harvest_links(stored["pages"]))


def test_incomplete_rows_are_dropped_at_the_scan(stored):
    read = plan(analysis.with_metadata(stored["reviews"], stored["summary"]))
    assert "IsNotNull(context)" in read and "IsNotNull(stars)" in read


def test_keep_first_cuts_before_the_shuffle(stored):
    p = plan(reviews.keep_first_review(stored["cards"]))
    before = p[p.index("Exchange"):]
    assert "WindowGroupLimit" in before and "Partial" in before
    assert plan(relational.keep_first(stored["cards"], ["url"], ["pos"])).count("Exchange") == 1


def test_counts_are_combined_before_the_shuffle(stored):
    for df in (
        reviews.keyword_review_count(stored["cards"]),
        corpus.settled_urls(stored["log"]),
        density.density(stored["log"].withColumn("v", F.rand(1)), "v", "url"),
    ):
        assert "partial_" in plan(df)


def test_narrow_jobs_do_not_shuffle(stored, spark):
    pages = stored["pages"]
    for df in (
        reviews.harvest_links(pages), reviews.review_cards(pages), reviews.with_context(reviews.review_cards(pages), "k"),
        reviews.match_status(pages, "k"), reviews.book_metadata(pages), names.fix_names(stored["reviews"]),
    ):
        assert "Exchange" not in plan(df)


def test_body_is_extracted_once(stored):
    text = plan(reviews.with_context(reviews.review_cards(stored["pages"]), "needle"))
    assert text.count("needle") <= 2 and "Filter" not in text.replace("PushedFilters", "").replace("DataFilters", "").replace("PartitionFilters", "")


def test_density_moves_no_rows(stored, spark):
    p = plan(density.density(stored["log"].withColumn("v", F.col("extra").cast("double")), "v", "url"))
    assert "BroadcastHashJoin" in p.split("partial_sum")[1] and "SortMergeJoin" not in p.split("partial_sum")[1]


def test_pages_are_not_shuffled_for_metadata(stored, monkeypatch):
    found = stored["cards"].select("url")
    for limit in (500_000, 1):
        monkeypatch.setattr(relational, "BROADCAST_ROWS", limit)
        p = plan(reviews.relevant_metadata(stored["pages"], found))
        for line in (x for x in p.splitlines() if "Exchange hashpartitioning" in x):
            below = p[p.index(line):].splitlines()[1]
            assert "html" not in below or "AS author" in below


def test_batch_is_a_bounded_top(stored):
    assert "TakeOrderedAndProject" in plan(corpus.next_batch(stored["log"].select("url"), 5))


def test_no_cross_joins(stored):
    ledger = stored["log"].selectExpr("url", "'NO_MATCH' AS status")
    for df in (
        corpus.first_seen(stored["log"].selectExpr("attempt AS list_no", "extra AS page_no", "url")),
        corpus.retry_rounds(stored["log"]), corpus.unique_works(stored["log"]), corpus.backlog(stored["log"], ledger),
        density.density(stored["log"].withColumn("v", F.rand(1)), "v", "url"),
    ):
        p = plan(df)
        assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_encoder_is_a_partition(spark):
    path = scratch_path(spark, "emb")
    rows = spark.createDataFrame([("h", [1.0], "e")], "text_hash string, embedding array<float>, encoder string")
    from marginalia.sources.writers import append_embeddings

    append_embeddings(rows, path)
    assert "PartitionFilters: [isnotnull(encoder" in plan(readers.read_embeddings(spark, path, "e"))


def mentions(df, tag):
    """How often a plan looks for a tag; one expression names it twice, to skip all others and to take it."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(rf"<{tag}\b") / 2


def test_a_page_is_read_once_for_its_canonical_url(spark):
    """Its work id once filtered the rows, and the filter read the page again, many times, below the join."""
    pages = spark.createDataFrame(
        [(1, '<meta property="og:url" content="/book/show/7.x">'), (2, '<meta property="og:url" content="/list/3">'), (3, "")],
        "page_id int, html string",
    )
    marked = pages.join(spark.range(1, 4).withColumnRenamed("id", "page_id"), "page_id").select(F.concat(F.lit("<p>"), "html").alias("html"))
    works = corpus.canonical_works(marked.select(F.lit(1).alias("attempt"), markup.canonical_url("html").alias("canonical_url")))
    assert mentions(works, "meta") == 1
    assert [tuple(r) for r in works.collect()] == [("7", "/book/show/7.x")]


def test_a_card_is_read_once_for_its_review_link_and_its_stars(spark):
    card = spark.createDataFrame([('<a href="/review/show/5&amp;6">May</a><span class="RatingStars" aria-label="4 of 5">',)], "card string")
    link, stars = card.select(markup.review_id("card").alias("x")), card.select(markup.stars("card").alias("x"))
    assert mentions(link, "a") == 1 and mentions(stars, "span") == 1
    assert link.first()[0] == "/review/show/5&6" and stars.first()[0] == "4"
