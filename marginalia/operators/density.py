"""Gaussian density curve per class."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.operators.relational import fits_broadcast
from marginalia.session import materialise


def density(df: DataFrame, x: str, cls: str, grid: int = fv.DENSITY_GRID) -> DataFrame:
    """``cls, x, density``: ``grid`` points per class, each class scaled alone.

    Bandwidth by Scott's rule, the grid from three bandwidths below the smallest
    to three above the largest value. A class of one row or without spread has
    no curve. Every row adds to every grid point; these are summed per task before
    the shuffle, which therefore carries at most ``grid`` rows per class and task. The rows themselves are not shuffled:
    the class table goes to them, unless there are very many classes.
    """
    rows = df.select(F.col(cls).alias("cls"), F.col(x).cast("double").alias("v")).dropna()
    stats = (
        rows.groupBy("cls")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.stddev_samp("v").alias("sd"),
            F.min("v").alias("low"),
            F.max("v").alias("high"),
        )
        .withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
        .filter(F.col("h") > 0)
        .withColumn("start", F.col("low") - 3 * F.col("h"))
        .withColumn("step", (F.col("high") + 3 * F.col("h") - F.col("start")) / (grid - 1))
        .select("cls", "n", "h", "start", "step")
    )
    stats = materialise(stats, "density-classes")
    small = F.broadcast(stats) if fits_broadcast(stats) else stats
    grid_points = F.sequence(F.lit(0), F.lit(grid - 1)).cast("array<bigint>")
    met = rows.join(small, "cls").select("cls", "v", "h", "start", "step", F.explode(grid_points).alias("point"))
    z = (F.col("start") + F.col("point") * F.col("step") - F.col("v")) / F.col("h")
    sums = met.groupBy("cls", "point").agg(F.sum(F.exp(-0.5 * z * z)).alias("mass"))
    return stats.join(sums, "cls").select(
        F.col("cls").alias(cls),
        (F.col("start") + F.col("point") * F.col("step")).alias("x"),
        (F.col("mass") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"),
    )
