from marginalia.__main__ import main
from marginalia.session import scratch_path
from marginalia.sources import readers, writers
from tests.test_reviews import SHOW, book, card


def test_verify_extract_repair(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("marginalia.__main__.build_session", lambda name: spark)
    urls = tmp_path / "urls.txt"
    urls.write_text(f"{SHOW}1-a-b\n\n{SHOW}2\n")
    pages, ledger, reviews, summary, fixed = (scratch_path(spark, n) for n in ("pages", "ledger", "r", "s", "fixed"))
    rows = [(1, SHOW + "1-a-b/reviews", card(1, "a key")), (2, SHOW + "1-a-b", book()), (3, SHOW + "2/reviews", card(2, "key")), (4, SHOW + "2", book())]
    spark.createDataFrame(rows, readers.PAGES_SCHEMA).write.parquet(pages)
    main(["verify", "--urls", str(urls), "--pages", pages, "--ledger", ledger, "--keyword", "key"])
    assert {r.status for r in readers.read_ledger(spark, ledger).collect()} == {"VALID_MATCH"}
    main(["extract", "--urls", str(urls), "--pages", pages, "--reviews-out", reviews, "--summary-out", summary, "--keyword", "key"])
    main(["repair", "--table", summary, "--out", fixed, "--kind", "summary"])
    assert {r.book_name for r in readers.read_summary_csv(spark, fixed).collect()} == {"a b", "Book_ID_2"}


def test_discover_and_deduplicate(spark, monkeypatch):
    monkeypatch.setattr("marginalia.__main__.build_session", lambda name: spark)
    pages, log, out, works = (scratch_path(spark, n) for n in ("pages", "log", "out", "works"))
    rows = [(1, "https://b/list/1", f'<a class="bookTitle" href="{SHOW}1.A">a</a>')]
    spark.createDataFrame(rows, readers.PAGES_SCHEMA).write.parquet(pages)
    main(["discover", "--pages", pages, "--out", out])
    assert [r.url for r in readers.read_url_list(spark, out).collect()] == [SHOW + "1.A"]
    spark.createDataFrame([("u", 1, SHOW + "1.A")], "url string, attempt int, canonical_url string").write.parquet(log)
    main(["deduplicate", "--attempts", log, "--out", works])
    assert [r.url for r in readers.read_url_list(spark, works).collect()] == [SHOW + "1.A"]


def test_contrast_command(spark, monkeypatch):
    monkeypatch.setattr("marginalia.__main__.build_session", lambda name: spark)
    reviews, summary, out = (scratch_path(spark, n) for n in ("r", "s", "out"))
    texts = [(f"B{i % 4}", "4", f"May {i + 1}, {2019 + i % 4}", f"w{i} w{i % 3} w{i % 5} common") for i in range(24)]
    writers.write_csv(spark.createDataFrame(texts, readers.REVIEWS_SCHEMA), reviews)
    books = [(f"B{i}", "Kafka" if i % 2 else "X", "4", "1", 1, "d", "g") for i in range(4)]
    writers.write_csv(spark.createDataFrame(books, readers.SUMMARY_SCHEMA), summary)
    main(["contrast", "--reviews", reviews, "--summary", summary, "--cache", scratch_path(spark, "c"), "--out", out, "--epochs", "1"])
    assert spark.read.parquet(f"{out}/map_points").count() == 24
    assert spark.read.parquet(f"{out}/period_scores").count() == 24
