"""Connected components of a table of links, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import large
from marginalia.session import materialise


def _smallest(links: DataFrame) -> DataFrame:
    return materialise(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "smallest")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every id in a link; the component is the least id that can be reached.

    Alternates two steps: each node sends its larger neighbours to its smallest
    one, then its smaller neighbours. The links become stars around the least ids
    within about log2 of the largest distance rounds. Each round is two sums per
    node and two joins over the links, which are at most as many as before; the
    driver gets one boolean per round. Links may be repeated, in any direction.
    """
    ends = links.filter(F.col(a) != F.col(b))
    # u > v throughout
    stars = materialise(
        ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        wide = materialise(
            both.join(large(_smallest(both)), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u > v").distinct(),
            "links",
        )
        least = _smallest(wide)
        narrow = wide.join(large(least), "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        stars = materialise(narrow.unionByName(own).filter("u > v").distinct(), "links")
    roots = stars.select("v").distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def _are_stars(links: DataFrame) -> bool:
    """Every node has one smaller neighbour at most, and that has none."""
    twice = links.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    return twice and links.join(large(links.select(F.col("u").alias("v"))), "v", "left_semi").isEmpty()
