"""Fuzzy neighbour weights and the two-dimensional map.

The map follows the published UMAP objective (McInnes, Healy, Melville 2018):
edges pull by their weight, random partners push. Each epoch moves all points
at once, as joins of the edges with the positions, by the mean force per point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.operators.spectral import HUB_EDGES as _HUB_EDGES
from marginalia.operators.spectral import by_number, grouped, numbered, spectral_positions, with_values
from marginalia.session import materialise, scratch_path

_BISECTIONS = 64
_PARTNERS = 5  # random partners per point and epoch
_HALVED = 5  # epochs until steps are half as long
# A map of few points is far from rest when steps have become short, so its steps fall at half that rate.
_FEW_POINTS = 10_000
_LOOK = 5  # epochs between two looks at the movement
SETTLED = 0.002  # mean movement of an epoch at which the map is done, as a share of its width
MAX_EPOCHS = 200


def _membership(dist: np.ndarray, valid: np.ndarray, n_neighbours: int) -> np.ndarray:
    """Weights per row of distances; padding is marked invalid."""
    positive = np.where(valid & (dist > 0), dist, np.inf).min(axis=1)
    rho = np.where(np.isfinite(positive), positive, 0.0)
    over = np.maximum(dist - rho[:, None], 0.0)
    target = np.log2(n_neighbours)
    lo, hi = np.zeros(len(dist)), np.full(len(dist), np.inf)
    sigma = np.ones(len(dist))
    for _ in range(_BISECTIONS):
        total = np.where(valid, np.exp(-over / sigma[:, None]), 0.0).sum(axis=1)
        above = total > target
        hi, lo = np.where(above, sigma, hi), np.where(above, lo, sigma)
        sigma = np.where(np.isinf(hi), sigma * 2.0, (lo + hi) / 2.0)
    # Floor of the published code: a thousandth of the mean distance, the point
    # itself counted in.
    floor = 1e-3 * np.where(valid, dist, 0.0).sum(axis=1) / (valid.sum(axis=1) + 1)
    sigma = np.maximum(sigma, np.maximum(floor, 1e-300))
    return np.exp(-over / sigma[:, None])


def fuzzy_edges(knn: DataFrame, n_neighbours: int = fv.MAP_NEIGHBOURS) -> DataFrame:
    """``src, dst, weight``, symmetric: either end's weight, or both (a + b - ab).

    ``n_neighbours`` counts the point itself, so the usual input is
    ``knn_graph(k=n_neighbours - 1)``.
    """
    lists = knn.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "dist"))).alias("nb"))
    lists = lists.select("src", F.col("nb.dst").alias("dst"), F.col("nb.dist").alias("dist"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sizes = np.diff(batch["dist"].offsets.to_numpy())
            valid = np.arange(sizes.max())[None, :] < sizes[:, None]
            dist = np.zeros(valid.shape)
            dist[valid] = batch["dist"].flatten().to_numpy()
            weights = _membership(dist, valid, n_neighbours)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch["src"].to_numpy(), sizes)),
                    batch["dst"].flatten(),
                    pa.array(weights[valid]),
                ],
                names=["src", "dst", "w"],
            )

    directed = lists.mapInArrow(run, "src bigint, dst bigint, w double")
    # Both directions in one aggregation instead of a self-join.
    ends = F.explode(
        F.array(
            F.struct(F.col("src").alias("s"), F.col("dst").alias("d"), F.col("w").alias("a"), F.lit(0.0).alias("b")),
            F.struct(F.col("dst").alias("s"), F.col("src").alias("d"), F.lit(0.0).alias("a"), F.col("w").alias("b")),
        )
    )
    a, b = F.sum("e.a"), F.sum("e.b")
    return (
        directed.select(ends.alias("e"))
        .groupBy(F.col("e.s").alias("src"), F.col("e.d").alias("dst"))
        .agg((a + b - a * b).alias("weight"))
    )


def curve_parameters(min_dist: float = fv.MAP_MIN_DIST, spread: float = 1.0) -> tuple[float, float]:
    """Least-squares ``a, b`` of ``1 / (1 + a d^2b)`` against the target curve."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(100):
        power = x ** (2 * p[1])
        f = 1 / (1 + p[0] * power)
        jac = np.stack([-(f**2) * power, -(f**2) * p[0] * power * 2 * np.log(x)], axis=1)
        p = p + np.linalg.lstsq(jac, y - f, rcond=None)[0]
    return float(p[0]), float(p[1])


def pca_positions(emb: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """First two principal components, scaled into a square of side 20.

    The point furthest out on an axis is on its positive side.
    """
    vectors = emb.select(F.col(id_col).cast("bigint").alias("id"), array_to_vector(F.col(vec_col)).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(vectors)
    xy = model.transform(vectors).select("id", vector_to_array("p").alias("p"))
    xy = xy.select("id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    far = {c: F.max_by(F.signum(c), F.struct(F.abs(c), "id")) for c in "xy"}
    reach = xy.agg(F.max(F.greatest(F.abs("x"), F.abs("y"))).alias("r"), *[far[c].alias(f"s{c}") for c in "xy"]).first()
    scale = 10.0 / max(reach.r or 0.0, 1e-12)
    return xy.select("id", (F.col("x") * (scale * (reach.sx or 1.0))).alias("x"), (F.col("y") * (scale * (reach.sy or 1.0))).alias("y"))


def map_2d(
    edges: DataFrame,
    emb: DataFrame,
    min_dist: float = fv.MAP_MIN_DIST,
    seed: int = fv.MAP_SEED,
    epochs: int = MAX_EPOCHS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    settled: float = SETTLED,
) -> DataFrame:
    """``id, x, y``. Positions are reproducible for a seed up to rounding.

    Points start at the leading eigenvectors of the graph. Steps get shorter from
    epoch to epoch, and the map is done when points move by less than ``settled`` of
    its width on average; ``epochs`` only bounds a map that does not come to rest.

    Positions are written to the shared folder after every epoch (two folders
    in turn), so plans stay short and a lost executor repeats one epoch at most.
    """
    a, b = curve_parameters(min_dist)
    edges = materialise(edges, "map-weights")
    first = materialise(pca_positions(emb, id_col, vec_col).dropDuplicates(["id"]), "map-first")
    start = spectral_positions(edges, first).select("id", "x", "y", F.lit(0).alias("epoch"), F.lit(0.0).alias("moved"))
    ordered, count = numbered(start)
    nodes = materialise(ordered, "map-start")
    pairs = by_number(edges, nodes.select("id", "no"), count).select("src_no", "dst_no", "weight")
    links = grouped(pairs, edges.count(), "map-edges", _HUB_EDGES)
    folders = [scratch_path(emb.sparkSession, f"map-epoch-{i}") for i in (0, 1)]
    for epoch in range(epochs):
        moved = _epoch(nodes, links, a, b, seed, count)
        moved.write.mode("overwrite").parquet(folders[epoch % 2])
        nodes = emb.sparkSession.read.schema(nodes.schema).parquet(folders[epoch % 2])
        if epoch % _LOOK == _LOOK - 1 and _movement(nodes) < settled:
            break
    return nodes.select("id", "x", "y")


def _movement(nodes: DataFrame) -> float:
    """Mean way of a point in the last epoch, as a share of the map's width."""
    row = nodes.agg(
        F.avg("moved").alias("way"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("width")
    ).first()
    return (row.way or 0.0) / max(row.width or 0.0, 1e-12)


def _epoch(nodes: DataFrame, links: DataFrame, a: float, b: float, seed: int, count: int) -> DataFrame:
    """All points moved once.

    The epoch number is a column, not a constant, so every epoch compiles to
    the same code.
    """
    ends = with_values(links, "dst_no", nodes, {"dst_x": "x", "dst_y": "y"}, count)
    ends = with_values(ends, "src_no", nodes, {"x": "x", "y": "y"}, count)
    pulls = ends.selectExpr("src_no AS no", "weight", "x - dst_x AS dx", "y - dst_y AS dy").selectExpr(
        "no", "weight", "dx", "dy",
        f"""if(dx = 0 AND dy = 0, 0D,
            {-2.0 * a * b}D * pow(dx * dx + dy * dy, {b - 1.0}D) / (1D + {a}D * pow(dx * dx + dy * dy, {b}D))) AS k""",
    )
    # Random partners, drawn from all points by their number.
    drawn = nodes.filter("id IS NOT NULL").selectExpr("id", "no", "x", "y", "epoch", f"explode(sequence(1, {_PARTNERS})) AS j").selectExpr(
        "no", "x", "y", f"pmod(xxhash64(id, epoch, j, {seed}), {max(count, 1)}L) AS other"
    )
    pushes = (
        with_values(drawn.filter("no != other"), "other", nodes, {"other_x": "x", "other_y": "y"}, count)
        .selectExpr("no", "x - other_x AS dx", "y - other_y AS dy", "pow(x - other_x, 2) + pow(y - other_y, 2) AS d2")
        .selectExpr("no", "dx", "dy", f"{2.0 * b}D / ((0.001D + d2) * (1D + {a}D * pow(d2, {b}D))) AS k")
    )
    # Points, pulls and pushes meet in one aggregation, combined per task before
    # the shuffle, instead of a shuffle for the sums and another for their join.
    zero = ["0D AS weight", "0D AS fx", "0D AS fy"]
    nothing = [f"NULL AS {c}" for c in ("x", "y", "epoch", "id")]
    still = nodes.selectExpr("no", "x", "y", "epoch", "id", "0D AS rx", "0D AS ry", *zero)
    pushed = pushes.selectExpr(
        "no", *nothing, "greatest(least(k * dx, 4D), -4D) AS rx", "greatest(least(k * dy, 4D), -4D) AS ry", *zero
    )
    moving = pulls.selectExpr(
        "no", *nothing, "0D AS rx", "0D AS ry", "weight",
        "weight * greatest(least(k * dx, 4D), -4D) AS fx",
        "weight * greatest(least(k * dy, 4D), -4D) AS fy",
    )
    kept = [F.max(c).alias(c) for c in ("x", "y", "epoch", "id")]
    sums = [F.sum(c).alias(c) for c in ("rx", "ry", "weight", "fx", "fy")]
    # Mean pull against half the summed push (every edge pulls from both ends);
    # the largest slope of the pull scales the step, so it cannot overshoot. Steps fall
    # with the epochs, slowly enough to reach any place, so that random pushes average out.
    halved = _HALVED if count > _FEW_POINTS else 2 * _HALVED
    step = f"1D / (1D + epoch / {halved}D) / {2.0 * a * b}D"
    shifted = still.unionByName(pushed).unionByName(moving).groupBy("no").agg(*kept, *sums).selectExpr(
        "id",
        "x",
        "y",
        f"{step} * (if(weight > 0, fx / weight, 0D) + 0.5D * rx) AS mx",
        f"{step} * (if(weight > 0, fy / weight, 0D) + 0.5D * ry) AS my",
        "epoch + 1 AS epoch",
        "no",
    )
    return shifted.selectExpr("id", "x + mx AS x", "y + my AS y", "epoch", "sqrt(mx * mx + my * my) AS moved", "no")


def map_points(frame: DataFrame, positions: DataFrame, key: str = "text_hash") -> DataFrame:
    """The frame's rows with positions, classes and hover columns."""
    return frame.join(positions, key).select("x", "y", "author_class", *fv.HOVER_COLUMNS)
