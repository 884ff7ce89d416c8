"""No page may stop a task: every field over pages that are as long and odd as can be, in time that grows with their length."""

import time

import pytest
from pyspark.sql import functions as F

from marginalia.functions import markup
from marginalia.functions.text import paragraphs, strip_tags

M, N = 10**6, 10**5
HOSTILE = {
    "attributes": "<a " + "x=1 " * M + ">",
    "quoted attributes": "<div " + 'a="<a href=/no>" ' * (N // 10) + ">",
    "quotes": "<span " + '"' * M + ">",
    "single quotes": "<meta " + "'" * N,
    "equals": "<a " + "=" * N + ">",
    "blanks": "<a" + " " * N + "href" + " " * N + "=" + " " * N + ">",
    "open tags": "<a " * (N // 2),
    "open quotes": '<div x="' * (N // 5),
    "open classes": '<a class="' + "next_page " * (N // 10),
    "classes": '<span class="' + "Formatted " * (N // 10) + "'>",
    "less": "<" * M,
    "less and slash": "</" * (N // 2),
    "comments": "<!--" * (N // 4),
    "half comments": "<!--" + "-- " * (N // 3),
    "scripts": "<script>" * (N // 8),
    "nested": "<div>" * (N // 20) + "</div>" * (N // 20),
    "nested cards": '<article class="ReviewCard"><div class="RatingStatistics__rating">' * 300,
    "links": '<a href="/review/show/' + "/review/show/" * (N // 20) + ">",
    "closed links": "<a href=/review/show/1>" * (N // 50),
    "names": "<" + "a" * N,
    "references": "&#" * (N // 2) + "&a" * (N // 4),
    "digits": "&#" + "1" * N + ";",
}
FIELDS = {
    "canonical_url": markup.canonical_url, "link_hrefs": markup.link_hrefs, "has_next_page": markup.has_next_page,
    "cards": markup.card_htmls, "review_id": markup.review_id, "review_date": markup.review_date,
    "review_body": markup.review_body, "stars": markup.stars, "authors": markup.authors, "avg_rating": markup.avg_rating,
    "total_reviews": markup.total_reviews, "release_date": markup.release_date, "genres": markup.genres,
    "is_book_page": markup.is_book_page, "paragraphs": paragraphs, "strip_tags": strip_tags,
    "inner_text": lambda c: markup.inner_text(F.col(c)), "links by class": lambda c: markup.link_hrefs(c, "bookTitle"),
}
GOOD = (
    '<meta property="og:url" content="/book/show/1"><a class="next_page bookTitle" href="/n">n</a><div class="BookPage__mainContent"></div>'
    '<div class="ContributorLinksList"><span class="ContributorLink__name">A</span></div><div class="RatingStatistics__rating">4</div>'
    '<a href="#CommunityReviews">5 reviews</a><p data-testid="publicationInfo">May</p><div data-testid="genresList">'
    '<a class="Button--tag"><span class="Button__labelItem">G</span></a></div><article class="ReviewCard">'
    '<span class="RatingStars" aria-label="3 of 5"></span><a href="/review/show/7">d</a><span class="Formatted">body</span></article>'
)
WANT = {
    "canonical_url": "/book/show/1", "link_hrefs": ["/n", "#CommunityReviews", "/review/show/7"], "has_next_page": True,
    "review_id": "/review/show/7", "review_date": "d", "review_body": "body", "stars": "3", "authors": "A", "avg_rating": "4",
    "total_reviews": "5", "release_date": "May", "genres": "G", "is_book_page": True, "links by class": ["/n"],
}


@pytest.mark.parametrize("field", FIELDS)
def test_long_and_odd_pages(one, field):
    began = time.time()
    got = one(FIELDS[field]("x"), [html for html in HOSTILE.values()])
    assert len(got) == len(HOSTILE) and time.time() - began < 60
    if field in WANT:
        # What is closed does not hide what follows it.
        closed = [HOSTILE["attributes"], HOSTILE["quoted attributes"], HOSTILE["quotes"], HOSTILE["less"][:-1] + " ", HOSTILE["nested"]]
        assert one(FIELDS[field]("x"), [html + GOOD for html in closed]) == [WANT[field]] * len(closed)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<!-- <a href=/no> --><a href=/yes>", ["/yes"]),
        ("<!--><a href=/yes>", ["/yes"]),
        ("<!-- a -- b ---><a href=/yes>", ["/yes"]),
        ("<script>var t = '<a href=/no>';</script><a href=/yes>", ["/yes"]),
        ("<style>a{}</style><title>a <a href=/no></title><a href=/yes>", ["/yes"]),
        ("<scripted><a href=/yes></scripted>", ["/yes"]),
        ('<div title="<a href=/no>"><a href=/yes>', ["/yes"]),
        ("<!doctype html><?x <a?><a href=/yes>", ["/yes"]),
        ("1 < 2 <a href=/yes> </ a><a href='/too'>", ["/yes", "/too"]),
        ("<a href=/yes>x</a><a href=/cut", ["/yes"]),
        ("<a href=>x</a><a href=''><a name=x><a href=/yes>", ["", "", "/yes"]),
        ('<a class="b" class="c" href=/yes/>', ["/yes/"]),
        ('<a x="1"href="/yes">', ["/yes"]),
    ],
)
def test_tokens(one, html, want):
    assert one(markup.link_hrefs("x"), [html]) == [want]


def test_elements_close_where_their_own_tags_do(one):
    body = 'a<span title="</span>">b<!-- </span> --></span><spanner></spanner>c<SPAN\n>d</SPAN >e'
    html = f"<div><span class=Formatted>{body}</span>tail</span></div>"
    assert one(markup.review_body("x"), [html, "<span class=Formatted>open <span>x</span> end"]) == [body, "open <span>x</span> end"]


def test_names_are_arguments(one):
    html = '<ul class="people"><div class="by"><span class="who">A</span></div></ul><b class="score">1</b><div class="score">2</div>'
    assert one(markup.authors("x", "by", "who"), [html]) == ["A"]
    assert one(markup.avg_rating("x", "score"), [html]) == ["2"]
    assert one(markup.has_next_page("x", "more"), ["<a class='more'>", "<a class=next_page>"]) == [True, False]


def test_tags_go_and_the_rest_stays(one):
    rows = ["a <b>c</b> < d", "x < y\n> z", "<i\n>", "a<<b>c", ">a<b"]
    assert one(strip_tags("x"), rows) == ["a c < d", "x < y\n> z", "<i\n>", "ac", ">a<b"]
