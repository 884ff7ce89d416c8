from marginalia.functions import urls
from marginalia.operators import names

SHOW = "https://books.example/book/show/"


def test_work_id(one):
    rows = [SHOW + "12.A", SHOW + "7", "https://books.example/list/3", None]
    assert one(urls.work_id("x"), rows) == ["12", "7", None, None]


def test_reviews_and_book_url(one):
    rows = [SHOW + "1.A?x=1", SHOW + "1.A/reviews", SHOW + "1.A/reviews?page=2", SHOW + "1-a"]
    assert one(urls.reviews_url("x"), rows) == [SHOW + "1.A/reviews", rows[1], rows[2], SHOW + "1-a/reviews"]
    assert one(urls.book_url("x"), rows) == [SHOW + "1.A", SHOW + "1.A", SHOW + "1.A?page=2", SHOW + "1-a"]


def test_names_from_urls(one):
    rows = [SHOW + "1.A_b-c?q", SHOW + "1-a-b/reviews", SHOW + "9", SHOW + "3---x", "elsewhere"]
    assert one(urls.book_name_dot("x"), rows) == ["A b c", "URL_ID_1", "URL_ID_9", "URL_ID_3", "URL_ID_"]
    assert one(urls.book_name_any("x"), rows) == [
        "A b c", "a b", "URL_Parse_Error_For_" + rows[2], "  x", "URL_Parse_Error_For_elsewhere",
    ]


ROWS = [
    "Plain name", SHOW + "1.A_b", "URL_Parse_Error_For_" + SHOW + "22", "see " + SHOW + "5-x-y end", "Either/Or",
    "snake_case", "URL_ID_77", None, "/show/8.No_Scheme", "URL_Parse_Error_For_" + SHOW + "32---thanks",
]
FIXED = ["Plain name", "A b", "Book_ID_22", "x y", "Either/Or", "snake_case", "URL_ID_77", None, "No Scheme", "  thanks"]
BAD = [False, True, True, True, True, True, True, False, True, True]


def test_repair_and_predicate(one):
    assert one(urls.is_bad_name("x"), ROWS) == BAD
    assert one(urls.repair_name("x"), ROWS) == FIXED
    assert one(urls.repair_name("x"), FIXED)[:4] == FIXED[:4]


def test_map_and_expression_agree(spark):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(ROWS * 3)], "i int, book_name string")
    by_map = names.apply_name_map(df, names.name_map(df)).orderBy("i").collect()
    by_expression = names.fix_names(df).orderBy("i").collect()
    assert by_map == by_expression
    assert [r.book_name for r in by_map] == FIXED * 3
    counts = names.repair_counts(df).first()
    assert (counts["rows"], counts["names"]) == (3 * sum(BAD), sum(BAD))
    assert names.bad_names(df).count() == sum(BAD)
    assert tuple(names.repair_counts(df.filter("i = 0")).first()) == (0, 0)


def test_absolute_url(spark):
    base = "https://h.example/a/b?q=1#top"
    rows = ["https://o/x", "//o/x", "/x", "#s", "?p=2", "c/d", "mailto:me"]
    want = ["https://o/x", "https://o/x", "https://h.example/x", "https://h.example/a/b?q=1#s", "https://h.example/a/b?p=2", "https://h.example/a/c/d", "mailto:me"]
    df = spark.createDataFrame([(i, r, base) for i, r in enumerate(rows)], "i int, h string, b string")
    assert [r.u for r in df.select("i", urls.absolute_url("h", "b").alias("u")).orderBy("i").collect()] == want
