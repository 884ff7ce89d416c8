import pytest
from pyspark.sql import functions as F

from marginalia.operators import relational, reviews
from marginalia.plans import extraction
from marginalia.plans.corpus import deduplicate, discover, verify_batch
from marginalia.plans.extraction import extract, extract_to_csv, repair_csv
from marginalia.session import scratch_path
from marginalia.sources import readers

SHOW = "https://b/book/show/"


def card(i, body, date="May 5, 2021"):
    return f'<article class="ReviewCard"><a href="/review/show/{i}">{date}</a><span class="Formatted">{body}</span></article>'


def book(author="An Author"):
    return (
        '<div class="BookPage__mainContent"><div class="ContributorLinksList">'
        f'<span class="ContributorLink__name">{author}</span></div></div>'
    )


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], readers.PAGES_SCHEMA)


def test_keep_first_counts_accepted_cards_only(spark):
    df = pages(spark, [
        (SHOW + "1.A/reviews", card(1, "no hit") + card(2, "key one") + card(1, "late key")),
        (SHOW + "1.A/reviews", card(2, "key two") + card(3, "<br>x<br>the KEY")),
        (SHOW + "2-b/reviews", card(2, "key other book")),
    ])
    out = {(r.url, r.review_id): r.context for r in reviews.accepted_reviews(df, "key").collect()}
    assert out == {
        (SHOW + "1.A/reviews", "/review/show/1"): "late key",
        (SHOW + "1.A/reviews", "/review/show/2"): "key one",
        (SHOW + "1.A/reviews", "/review/show/3"): "the KEY",
        (SHOW + "2-b/reviews", "/review/show/2"): "key other book",
    }


def test_match_status(spark):
    df = spark.createDataFrame(
        [("a", card(1, "key"), None), ("b", card(1, "none") + "key", None), ("c", None, None), ("d", card(1, "key"), "Timeout"), ("e", "", None)],
        "url string, html string, error_type string",
    )
    out = {r.url: (r.status, r.error_type) for r in reviews.match_status(df, "key").collect()}
    assert out == {
        "a": ("VALID_MATCH", None), "b": ("NO_MATCH", None), "c": ("FAILURE", "MissingPage"),
        "d": ("FAILURE", "Timeout"), "e": ("NO_MATCH", None),
    }


def test_long_list_parses_pages_of_reviewed_books_only(spark, monkeypatch):
    """Five listed books are too many to send, the one with a review is not."""
    monkeypatch.setattr(relational, "BROADCAST_ROWS", 2)
    parsed = []
    whole = reviews.book_metadata
    for module in (reviews, extraction):
        monkeypatch.setattr(module, "book_metadata", lambda df: parsed.append(df.count()) or whole(df))
    urls = spark.createDataFrame([(SHOW + f"{i}.B",) for i in range(5)], "url string")
    df = pages(spark, [(SHOW + f"{i}.B", book()) for i in range(5)] + [(SHOW + "3.B/reviews", card(1, "key"))])
    found, summary = extract(urls, df, "key")
    assert [r.url for r in summary.collect()] == [SHOW + "3.B"] == [r.url for r in found.collect()]
    assert parsed == [1]


def test_page_without_the_name_of_the_class_has_no_cards(spark):
    df = pages(spark, [("a", "<div><b>none</b></div>"), ("b", None), ("c", card(1, "x").replace("ReviewCard", "reviewcard"))])
    assert [r.url for r in reviews.review_cards(df).collect()] == ["c"]


@pytest.mark.parametrize("limit", [500_000, 1])
def test_extract_keeps_books_with_both(spark, monkeypatch, limit):
    monkeypatch.setattr(relational, "BROADCAST_ROWS", limit)  # 1: the way for very many books
    urls = spark.createDataFrame([(SHOW + "1.Some_Name?x=1",), (SHOW + "2-b",), (SHOW + "3.C",), (SHOW + "4",)], "url string")
    df = pages(spark, [
        (SHOW + "1.Some_Name/reviews", card(1, "key") + card(2, "key key")), (SHOW + "1.Some_Name", book("Kafka, F.")),
        (SHOW + "2-b/reviews", card(3, "nothing")), (SHOW + "2-b", book()),
        (SHOW + "3.C/reviews", card(4, "key")), (SHOW + "3.C", "<p>broken page</p>"),
        (SHOW + "4/reviews", card(5, "key")), (SHOW + "4", book()),
    ])
    found, summary = extract(urls, df, "key")
    assert sorted((r.book_name, r.context) for r in found.collect()) == [
        ("Some Name", "key"), ("Some Name", "key key"), (f"URL_Parse_Error_For_{SHOW}4", "key"),
    ]
    assert sorted((r.author, r.keyword_review_count, r.genres) for r in summary.collect()) == [
        ("An Author", 1, "Not Found"), ("Kafka, F.", 2, "Not Found"),
    ]
    paths = [scratch_path(spark, n) for n in ("r", "s", "fixed")]
    assert extract_to_csv(urls, df, paths[0], paths[1], keyword="key") == (True, True)
    assert readers.read_summary_csv(spark, paths[1]).columns[4] == "keyword_review_count"
    assert repair_csv(spark, paths[0], paths[2], "reviews") == 1
    names = {r.book_name for r in readers.read_reviews_csv(spark, paths[2]).collect()}
    assert names == {"Some Name", "Book_ID_4"}
    assert repair_csv(spark, paths[2], scratch_path(spark, "none"), "reviews") == 1  # still holds "_"
    assert repair_csv(spark, scratch_path(spark, "absent"), scratch_path(spark, "none"), "summary") == 0


def test_nothing_found_writes_nothing(spark):
    urls = spark.createDataFrame([(SHOW + "1.A",)], "url string")
    df = pages(spark, [(SHOW + "1.A/reviews", card(1, "x")), (SHOW + "1.A", book())])
    out = [scratch_path(spark, n) for n in ("r", "s")]
    assert extract_to_csv(urls, df, *out, keyword="key") == (False, False)


def test_funnel_plan(spark):
    lists = pages(spark, [
        ("https://b/list/1", f'<a class="bookTitle" href="{SHOW}2.B">b</a><a class="bookTitle" href="/book/show/1.A">a</a>'),
        ("https://b/list/1?page=2", f'<a class="bookTitle" href="{SHOW}1.A">a</a>'),
    ])
    out, works, ledger = (scratch_path(spark, n) for n in ("urls", "works", "ledger"))
    discover(lists, out)
    assert [r.value for r in spark.read.text(out).collect()] == [SHOW + "1.A", SHOW + "2.B"]
    log = spark.createDataFrame([(SHOW + "1.A", 1, SHOW + "1.A"), (SHOW + "2.B", 1, SHOW + "1.A-x")], "url string, attempt int, canonical_url string")
    deduplicate(log, None, works)
    assert [r.value for r in spark.read.text(works).collect()] == [SHOW + "1.A"]
    df = pages(spark, [(SHOW + "1.A/reviews", card(1, "key"))])
    assert tuple(verify_batch(spark, out, df, ledger, n=1, keyword="key").first()) == (2, 1, 1)
    assert tuple(verify_batch(spark, out, df, ledger, n=5, keyword="key").first()) == (1, 1, 0)
    assert {r.url: r.status for r in readers.read_ledger(spark, ledger).collect()} == {
        SHOW + "1.A": "VALID_MATCH", SHOW + "2.B": "FAILURE",
    }
    assert tuple(verify_batch(spark, out, df, ledger, n=5, keyword="key").first()) == (0, 0, 0)


def test_crawl_coverage(spark):
    nxt = '<a class="next_page">n</a>'
    df = spark.createDataFrame([(1, 1, nxt), (1, 2, "end"), (2, 1, nxt)], "list_no int, page_no int, html string")
    assert sorted(tuple(r) for r in reviews.crawl_coverage(df).collect()) == [(1, 2, True), (2, 1, False)]


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y"), ("b", 1, "y")], "k string, o int, v string")
    kept = relational.keep_first(df, ["k"], ["o", "v"])
    assert sorted((r.k, r.v) for r in kept.collect()) == [("a", None), ("b", "y")]
    assert relational.distinct_rows(df).count() == 3
    assert relational.drop_incomplete(df, ["v"]).count() == 3
    assert relational.drop_cols(df, ["o", "v"]).columns == ["k"]
    assert relational.minus(df.select("k"), df.filter("k = 'a'").select("k")).collect() == [("b",)]
    both = relational.collect_results(df.select("k", "o"), df.select("o", "k"))
    assert both.count() == 8 and both.filter("k = 'b'").agg(F.max("o")).first()[0] == 1
    assert tuple(relational.row_counts(df, "k").first()) == (4, 2)
    assert [r.k for r in relational.sort_urls(df, "k").collect()] == ["a", "a", "b", "b"]
