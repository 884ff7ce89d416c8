import random

from pyspark.sql import functions as F

from marginalia.functions import markup

CARD = (
    '<article class="x ReviewCard y"><a class="u" href="/user/1">me</a>'
    '<a href="/review/show/9?a=1&amp;b=2"> May <b>5</b>,\n 2021 </a>'
    '<span aria-label="Rating 4 out of 5" class="RatingStars RatingStars__small"><i></i></span>'
    '<section><span class="Formatted">One <span>in <span>deep</span></span> two<br />three</span></section>'
    "<span>like</span></article>"
)


def test_canonical_url(one):
    rows = [
        '<meta property="og:url" content="https://b/book/show/1.A?x=1&amp;y"/>',
        "<meta content='https://b/2' property='og:url'>",
        '<meta property="og:title" content="t"><meta property="og:url" content="">',
        "<p>none</p>", None,
    ]
    assert one(markup.canonical_url("x"), rows) == ["https://b/book/show/1.A?x=1&y", "https://b/2", None, None, None]


def test_links_by_class(one):
    html = (
        '<a class="bookTitle" href="/b/1">t</a><A HREF=\'/b/2\' class="wide bookTitle">t</A>'
        '<a class="bookTitleX" href="/no">t</a><a data-href="/no" class="bookTitle">t</a><abbr href="/no">'
    )
    assert one(markup.link_hrefs("x", "bookTitle"), [html]) == [["/b/1", "/b/2"]]
    assert one(markup.link_hrefs("x"), [html]) == [["/b/1", "/b/2", "/no"]]


def test_next_page(one):
    assert one(markup.has_next_page("x"), ['<a rel="next" class="next_page" href="#">n</a>', '<span class="next_page">', None]) == [True, False, False]


def test_cards(spark):
    html = "<body>" + CARD + '<article class="Other">no</article>' + CARD.replace("show/9", "show/10") + "</body>tail</span>"
    card = F.explode(markup.card_htmls("x")).alias("c")
    rows = spark.createDataFrame([(html,)], "x string").repartition(1).select(card).select(
        markup.review_id("c"), markup.review_date("c"), markup.stars("c"), markup.review_body("c")
    ).collect()
    body = "One <span>in <span>deep</span></span> two<br />three"
    assert [tuple(r) for r in rows] == [
        ("/review/show/9?a=1&b=2", "May 5, 2021", "4", body), ("/review/show/10?a=1&b=2", "May 5, 2021", "4", body),
    ]


def test_stars(one):
    rows = ['<span class="RatingStars" aria-label="Rated 3">', '<span class="RatingStars" aria-label="none">', '<span class="RatingStars">', "<p>"]
    assert one(markup.stars("x"), rows) == ["3", "Not rated", "Not rated", "Not rated"]
    assert one(markup.stars_from_label("x"), ["Rating 12 of 5", "", None]) == ["12", "Not rated", "Not rated"]


def test_metadata_fields(one):
    name = '<span class="ContributorLink__name">{}</span>'.format
    lists = '<div class="ContributorLinksList">' + name("A &amp; B") + name("") + "</div><p></p>" + '<div class="ContributorLinksList">' + name(" C  D ") + "</div>"
    assert one(markup.authors("x"), [lists, name("outside"), '<div class="ContributorLinksList"></div>']) == ["A & B | C D", "Not Found", "Not Found"]
    assert one(markup.avg_rating("x"), ['<div class="RatingStatistics__rating">3.86</div>', '<div class="RatingStatistics__rating"></div>', ""]) == ["3.86", "", "Not Found"]
    link = '<a href="/book#CommunityReviews">{}</a>'.format
    assert one(markup.total_reviews("x"), [link("9 ratings<b>1,234&nbsp;reviews</b>"), link("12 ratings"), "1,234 reviews"]) == ["1234", "Not Found", "Not Found"]
    info = '<p class="q" data-testid="publicationInfo">{}</p>'.format
    assert one(markup.release_date("x"), [info("First published May 1, 1915"), info(""), "<p>"]) == ["May 1, 1915", "", "Not Found"]
    tag = '<span><a class="Button Button--tag"><span class="Button__labelItem">{}</span></a></span>'.format
    box = '<div data-testid="genresList"><div>{}</div></div>'.format
    outside = tag("Out")
    assert one(
        markup.genres("x"),
        [box(tag("Classics") + tag("") + tag("Fiction")) + outside, box(""), outside, box(tag("A") + '<a class="Button--tag">bare</a>')],
    ) == ["Classics | Fiction", "", "Not Found", "Not Found"]


def test_elements_read_in_one_pass_are_those_of_counted_tags(one):
    parts = ["<p class=a>", "<p class='b a'>", "<p>", "</p>", "</p >", "<P CLASS=a>", "x", "\0", "<!-- </p> -->", "<!-- <p class=a>", "<b title='</p>'>", "<script></p></script>", "<", "<p class=a"]
    draw = random.Random(8)
    html = ["".join(draw.choices(parts, [4, 2, 1, 6, 1, 1, 9, 1, 1, 0.2, 1, 1, 0.3, 0.2], k=draw.randrange(12))) for _ in range(1500)] + [None]
    condition = markup._has_class("a")
    want = one(markup._counted_inners("x", "p", markup._open_tag("p", condition)), html)
    assert one(markup.element_inners("x", "p", condition), html) == want
    assert one(markup.first_inner("x", "p", condition), html) == [x[0] if x else None for x in want]
    assert sum(len(x) > 1 for x in want[:-1]) > 200
    cases = ["<p class=a>1<p>2</p>3</p>4", "<p class=a></p><p class=a>x\0</p>", "<p class=a>x<!-- </p>"]
    assert one(markup.element_inners("x", "p", condition), cases) == [["1<p>2</p>3"], ["", "x\ufffd"], ["x<!-- </p>"]]
