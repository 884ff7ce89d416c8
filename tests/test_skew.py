"""A key with a third of the rows: results whole, work split."""

import pytest
from pyspark.sql import functions as F

from marginalia.operators import analysis, corpus, names, relational, reviews
from marginalia.session import scratch_path

N = 60_000


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Joins by shuffle, and partitions that count as large early."""
    monkeypatch.setattr(relational, "BROADCAST_ROWS", 1)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(column, cold, share=3):
    return F.when(F.col("id") % share == 0, F.lit("hot")).otherwise(F.concat(F.lit(column), F.col("id") % cold))


@pytest.fixture(scope="module")
def rows(spark):
    path = scratch_path(spark, "hot")
    spark.range(N).repartition(8).select(
        hot("b", 500).alias("book_name"), F.lit("4").alias("stars"), F.lit("May 1, 2020").alias("date"),
        F.concat(F.lit("text "), F.col("id").cast("string"), F.lit(" word" * 5)).alias("context"), "id",
    ).write.parquet(path)
    return spark.read.parquet(path)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_metadata_join_splits_the_hot_book(spark, rows, no_broadcast):
    summary = rows.select("book_name").distinct().select("book_name", F.lit("A").alias("author"), F.lit(1).alias("ordinal"))
    joined = analysis.with_metadata(rows, summary).select("book_name", "id")
    p = final_plan(joined)
    assert "SortMergeJoin(skew=true)" in p
    assert joined.count() == N


def test_name_map_splits_the_hot_name(spark, rows, no_broadcast):
    bad = rows.select(F.concat(F.lit("/show/1."), "book_name").alias("book_name"), "id")
    fixed = names.apply_name_map(bad, names.name_map(bad))
    assert "skew=true" in final_plan(fixed)
    assert fixed.filter("book_name = 'hot'").count() == N // 3


def test_one_url_holds_a_third_of_all_links(spark, rows):
    links = rows.selectExpr("id % 50 AS list_no", "id % 7 AS page_no", "book_name AS url")
    out = corpus.first_seen(links).agg(F.sum("found"), F.sum("new")).first()
    assert tuple(out) == (N, rows.select("book_name").distinct().count())


def test_one_review_holds_a_third_of_all_cards(spark, rows):
    cards = rows.selectExpr("'u' AS url", "book_name AS review_id", "id AS page_id", "1 AS pos", "context")
    kept = reviews.keep_first_review(cards)
    assert kept.filter("review_id = 'hot'").select("page_id").collect() == [(0,)]
    assert kept.count() == rows.select("book_name").distinct().count()
    assert reviews.keyword_review_count(cards).collect() == [("u", N)]
