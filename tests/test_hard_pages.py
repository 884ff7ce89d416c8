"""Pages as crawls find them: quotes, odd attributes, NUL, references, copies."""

import pytest
from pyspark.sql import functions as F

from marginalia.functions import markup, text
from marginalia.operators import relational
from marginalia.operators.analysis import first_metadata
from marginalia.plans import extraction
from marginalia.sources import readers, writers


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("""<a href="/book/show/1-o'brien">x</a>""", ["/book/show/1-o'brien"]),
        ("""<a href='/a"b'>x</a>""", ['/a"b']),
        ("<a class=x href=/plain>x</a><a href=/two/>y</a>", ["/plain", "/two/"]),
        ("""<a title="a > b" href="/gt">x</a>""", ["/gt"]),
        ("""<a data-href="/no" href="/yes">x</a>""", ["/yes"]),
        ("<a title=it's href=/q>x</a>", ["/q"]),
        ("<A\n HREF = '/up'>x</A>", ["/up"]),
        ("<a href=\"/a?b=1&amp;c=2\">x</a><abbr href='/no'>", ["/a?b=1&c=2"]),
        ("no link", []),
    ],
)
def test_links(one, html, want):
    assert one(F.array_join(markup.link_hrefs("x"), "|"), [html]) == ["|".join(want)]


def test_class_among_others(one):
    hits = ["<a class=next_page>", "<a class='b next_page'>", '<a id="x>y" class="next_page c">']
    misses = ["<a class=next_pages>", '<a data-class="next_page">', '<a title="class=next_page">', "<b class=next_page>"]
    assert one(markup.has_next_page("x"), hits + misses) == [True] * 3 + [False] * 4


@pytest.mark.parametrize(
    ("coded", "plain"),
    [
        ("Dvo&rcaron;&aacute;k &#233; &#x2019;", "Dvořák é ’"),
        ("&amp;lt; &unknown; & &#128512; &hellip;", "&lt; &unknown; & 😀 …"),
        ("&#0;&#xD800;&#99999999999;&#147;a&#148;", "���“a”"),
        ("plain", "plain"),
    ],
)
def test_references(one, coded, plain):
    assert one(markup.decode_entities(F.col("x")), [coded]) == [plain]


def test_nul_is_no_break(one):
    card = "<article class='ReviewCard'><a href='/review/show/1'>d</a><span class=Formatted>alpha \0 omega key</span></article>"
    assert one(F.array_join(text.paragraphs("x"), "|"), ["a\0b<br>c"]) == ["a�b|c"]
    assert one(markup.review_body(F.get(markup.card_htmls("x"), F.lit(0))), [card]) == ["alpha � omega key"]


BOOK = (
    '<div class="BookPage__mainContent"></div><div class="ContributorLinksList">'
    '<span class="ContributorLink__name" data-testid="name">{}</span></div>'
)
CARD = (
    '<article class="ReviewCard"><a href="/review/show/{}">May 1, 2020</a>'
    '<span class="Formatted">so kafkaesque</span></article>'
)


def test_one_summary_row_per_book_whatever_the_size(spark, monkeypatch):
    site = "https://b.example/book/show"
    pages = [
        (1, f"{site}/1.One/reviews", CARD.format(1)), (2, f"{site}/1.One", BOOK.format("B")), (3, f"{site}/1.One", BOOK.format("A")),
        (4, f"{site}/2/reviews?page=2", CARD.format(2)), (5, f"{site}/2?page=2", BOOK.format("C")),
    ]
    urls = spark.createDataFrame([(f"{site}/1.One",), (f"{site}/2/reviews?page=2",)], "url string")
    seen = []
    for limit in (0, 1000):
        monkeypatch.setattr(relational, "BROADCAST_ROWS", limit)
        found, summary = extraction.extract(urls, spark.createDataFrame(pages, "page_id long, url string, html string"))
        assert found.count() == 2
        seen.append(sorted((r.url, r.book_name, r.author, r.keyword_review_count) for r in summary.collect()))
    assert seen[0] == seen[1] and [r[2:] for r in seen[0]] == [("A", 1), ("C", 1)] and seen[0][0][1] == "One"


def test_first_row_over_several_files(spark, tmp_path):
    columns = "book_name, author, avg_rating, total_reviews, keyword_review_count, release_date, genres".split(", ")
    row = lambda author: ",".join(f'"{v}"' for v in ["Same", author, "1", "1", "1", "d", "g"])
    head = ",".join(columns)
    (tmp_path / "part-00000.csv").write_text(f"{head}\n{row('first')}\n")
    (tmp_path / "part-00001.csv").write_text(f"{head}\n" + f"{row('second')}\n" * 200)
    summary = relational.with_ordinal(readers.read_summary_csv(spark, str(tmp_path)))
    assert [r.author for r in first_metadata(summary).collect()] == ["first"]


def test_a_text_added_twice_has_one_vector(spark, tmp_path):
    rows = spark.createDataFrame([("h", [1.0, 0.0], "e"), ("g", [0.0, 1.0], "e")], "text_hash string, embedding array<float>, encoder string")
    for _ in range(2):
        writers.append_embeddings(rows, str(tmp_path / "cache"))
    assert readers.read_embeddings(spark, str(tmp_path / "cache"), "e").count() == 2
