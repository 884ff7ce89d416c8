"""The whole analysis on a small table."""

import inspect
import random

from marginalia.__main__ import parser
from marginalia.plans.contrast import contrast
from marginalia.session import scratch_path
from marginalia.sources import writers


def test_contrast(spark):
    rng = random.Random(9)
    dark, light = "dread law court maze night door".split(), "sun sea light hope bird song".split()
    reviews, authors = [], {}
    for i in range(120):
        kafka = i % 3 == 0
        name = f"Book {i % 30}"
        authors[name] = "Franz Kafka | A Translator" if (i % 30) % 3 == 0 else "Somebody"
        words = [rng.choice(dark if kafka else light) for _ in range(6)] + [rng.choice(dark + light) for _ in range(6)]
        text = "Gregor " + " ".join(words) if i >= 10 else "the trial dread dread"
        reviews.append((name.upper(), "4", f"May {1 + i % 28}, {2018 + i % 6}", text))
    reviews.append(("Unknown", "4", "May 1, 2020", "x"))
    reviews.append(("Book 1", "4", "no date", "x"))
    r = spark.createDataFrame(reviews, "book_name string, stars string, date string, context string")
    s = spark.createDataFrame([(n, a, i) for i, (n, a) in enumerate(authors.items())], "book_name string, author string, ordinal int")
    out = contrast(r, s, scratch_path(spark, "cache"), epochs=2)
    assert out.frame.count() == 120
    assert "gregor" not in {w for row in out.frame.collect() for w in row.context_cleaned.lower().split()}
    points = out.points.collect()
    assert len(points) == 120 and {p.author_class for p in points} == {"Franz Kafka", "Other"}
    same = {(p.x, p.y) for p in points if p.context_short.startswith("the trial dread")}
    assert len(same) == 1
    scores = out.author_scores.groupBy("author_class").avg("score").collect()
    mean = {x.author_class: x["avg(score)"] for x in scores}
    assert mean["Franz Kafka"] > mean["Other"] + 1
    assert {d.author_class for d in out.author_density.collect()} == {"Franz Kafka", "Other"}
    assert out.period_density.count() == 400
    path = scratch_path(spark, "points")
    writers.write_map_points(out.points, path)
    assert spark.read.parquet(path).columns == ["x", "y", "author_class", "book_name", "author", "stars", "period", "context_short"]


def test_contrast_with_latent_vectors_and_descent(spark):
    rng = random.Random(10)
    topics = "dread law court maze night door".split(), "sun sea light hope bird song".split()
    rows = [(f"Book {i % 8}", "4", f"May {1 + i % 28}, {2018 + i % 6}", " ".join(rng.choice(topics[i % 2]) for _ in range(9))) for i in range(60)]
    r = spark.createDataFrame(rows, "book_name string, stars string, date string, context string")
    books = [(f"Book {i}", "Kafka" if i % 2 else "X", i) for i in range(8)]
    s = spark.createDataFrame(books, "book_name string, author string, ordinal int")
    cache = scratch_path(spark, "cache")
    out = contrast(r, s, cache, epochs=1, approximate=True, latent=4)
    assert out.points.count() == 60
    mean = {x.author_class: x.m for x in out.author_scores.groupBy("author_class").agg({"score": "avg"}).toDF("author_class", "m").collect()}
    assert mean["Franz Kafka"] > mean["Other"] + 1
    assert [x.encoder[:9] for x in spark.read.parquet(cache).select("encoder").distinct().collect()] == ["latent-4-"]


def test_the_graph_is_exact_unless_asked_otherwise():
    args = parser().parse_args("contrast --reviews r --summary s --cache c --out o".split())
    assert (args.probes or None) is None and not args.approximate and not args.latent
    defaults = inspect.signature(contrast).parameters
    assert defaults["probes"].default is None and not defaults["approximate"].default and not defaults["latent"].default
