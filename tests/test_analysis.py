from marginalia.functions import classes
from marginalia.operators import analysis


def test_dates_and_periods(one):
    rows = ["January 5, 2021", "Jan 5, 2021", "2021-01-05", "foo", None, "May 5, 2020"]
    days = one(classes.parse_date("x").cast("date").cast("string"), rows)
    assert days == ["2021-01-05"] * 3 + [None, None, "2020-05-05"]
    cls = classes.period_class(classes.parse_date("x"))
    assert one(cls, ["December 31, 2020", "January 1, 2021"]) == ["Pre-2021", "2021+"]


def test_author_class_and_mask(one):
    rows = ["Franz Kafka", "Max Brod | FRANZ KAFKA", "Camus", None]
    assert one(classes.author_class("x"), rows) == ["Franz Kafka", "Franz Kafka", "Other", "Other"]
    assert one(classes.class_mask("x", "Camus"), rows) == [False, False, True, False]


def test_typed_views(spark):
    rows = [("Not Found", "3.86", "1234", "A | B"), ("A", "Not Found", "Not Found", ""), ("A | B", "", "1", "Not Found")]
    df = spark.createDataFrame(rows, "author string, avg_rating string, total_reviews string, genres string")
    assert [tuple(r) for r in classes.typed_summary(df).collect()] == [
        (None, 3.86, 1234, ["A", "B"]), (["A"], None, None, []), (["A", "B"], None, 1, None),
    ]
    assert spark.createDataFrame([("4",), ("Not rated",)], "s string").select(classes.typed_stars("s")).collect() == [(4,), (None,)]


def test_join_rules(spark):
    reviews = spark.createDataFrame(
        [("A ", "5", "May 5, 2021", "c1"), ("b", "Not rated", "x", "c2"), ("", "1", "May 5, 2020", "c3"), (None, "1", "May 5, 2020", "c4"),
         ("dup", "1", "May 5, 2020", "c5"), ("nowhere", "1", "May 5, 2020", "c6"), ("a", None, "May 5, 2020", "c7")],
        "book_name string, stars string, date string, context string",
    )
    summary = spark.createDataFrame(
        [("a", "first", 1), (" A", "second", 2), ("b", "Not Found", 3), (None, "nameless", 4), ("dup", None, 5), ("DUP", "late", 6)],
        "book_name string, author string, ordinal int",
    )
    out = {r.context: r.author for r in analysis.with_metadata(reviews, summary).collect()}
    # A blank name meets the nameless book; a null author that comes first stays and drops its rows.
    assert out == {"c1": "first", "c2": "Not Found", "c3": "nameless"}
    classed = analysis.with_classes(analysis.with_metadata(reviews, summary))
    assert {r.context: r.period for r in classed.collect()} == {"c1": "2021+", "c3": "Pre-2021"}
    frame = analysis.analysis_columns(analysis.with_metadata(reviews, summary))
    assert {r.context_short for r in frame.collect()} == {"c1...", "c3..."}
    assert sorted(tuple(r) for r in analysis.class_period_counts(frame).collect()) == [("Other", "2021+", 1), ("Other", "Pre-2021", 1)]
