"""Starting positions from the graph: leading eigenvectors of the normalised weights, by block power iteration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialise

SMALL_NODES = 1_500_000  # two values each, as arrays of floats: 12 MB
BLOCK = 4096  # nodes whose values travel as one row
HUB_EDGES = 20_000  # edges of one task; a point with more goes to several
STEADY = 1e-3  # change of the eigenvalues below which the iteration ends: a start need not be exact
MAX_ROUNDS = 20
_PAIRS = [(a, b) for a in "uxy" for b in "uxy"]


def sent_if_small(nodes: DataFrame, count: int) -> DataFrame:
    """Rows of a few numbers per node go to every task up to a known count; beyond, both sides are shuffled."""
    return F.broadcast(nodes) if count <= SMALL_NODES else nodes


def numbered(df: DataFrame) -> tuple[DataFrame, int]:
    """Rows in the order of ``id`` with dense numbers ``no`` from 0, and how many there are.

    The driver gets one count per partition of the written table.
    """
    df = df.orderBy("id")
    df = materialise(df.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "numbered")
    counts = df.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low")).orderBy("part").collect()
    starts, at = [], 0
    for row in counts:
        starts.append((row.part, at - row.low))
        at += row.n
    shift = df.sparkSession.createDataFrame(starts or [(0, 0)], "part int, shift bigint")
    return df.join(F.broadcast(shift), "part").withColumn("no", F.col("place") + F.col("shift")).drop("part", "place", "shift"), at


def with_values(rows: DataFrame, number: str, nodes: DataFrame, values: dict[str, str], count: int) -> DataFrame:
    """``rows`` with values of the node that the column ``number`` names; ``values`` has their new names and their columns.

    Nodes travel as arrays of floats, a row per block of numbers, so a value takes four
    bytes and no key. Lookups of the same values in one plan share one sending.
    """
    held = nodes.groupBy(F.expr(f"no div {BLOCK}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("no", *[F.col(c).cast("float").alias(c) for c in values.values()]))).alias("held")
    )
    arrays = held.select(F.col("block").alias(f"{number}_block"), *[F.col("held")[c].alias(new) for new, c in values.items()])
    placed = rows.withColumn(f"{number}_block", F.expr(f"{number} div {BLOCK}"))
    found = placed.join(sent_if_small(arrays, count), f"{number}_block")
    return found.withColumns({new: F.get(new, F.expr(f"int({number} % {BLOCK})")).cast("double") for new in values}).drop(f"{number}_block")


def by_number(edges: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """Edges with the numbers of both ends; what a node has in ``nodes`` beside ``id`` and ``no`` is added for each end."""
    for end in ("src", "dst"):
        own = nodes.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in nodes.columns if c != "id"])
        edges = edges.join(sent_if_small(own, count), end)
    return edges.drop("src", "dst")


def _normalised(edges: DataFrame, roots: DataFrame, count: int, total: int) -> DataFrame:
    """``src_no, dst_no, share``: weights over the roots of both ends' degrees."""
    share = F.col("weight") / (F.col("src_root") * F.col("dst_root"))
    return grouped(by_number(edges, roots, count).select("src_no", "dst_no", share.alias("share")), total, "shares")


def grouped(links: DataFrame, total: int, name: str, most: int = HUB_EDGES) -> DataFrame:
    """Written with the edges of a node together, so that sums are nearly done before a shuffle.

    A node with very many edges is cut over several tasks.
    """
    tasks = max(-(-total // most), 1)
    return materialise(links.repartitionByRange(tasks, "src_no", "dst_no").sortWithinPartitions("src_no"), name)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """Columns that make ``x`` and ``y`` orthonormal and free of the known first vector, from the products of all three."""
    out: list[np.ndarray] = [np.array([1.0, 0.0, 0.0])]
    for k in (1, 2):
        v = np.eye(3)[k]
        for o in out:
            v = v - (o @ gram @ v) * o
        length = max(v @ gram @ v, 0.0) ** 0.5
        out.append(v / length if length > 1e-12 else np.zeros(3))
    return np.array(out[1:])


def _products(nodes: DataFrame, pairs: list[tuple[str, str]]) -> list[float]:
    return [v or 0.0 for v in nodes.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).first()]


def spectral_positions(edges: DataFrame, start: DataFrame, count: int | None = None, rounds: int = MAX_ROUNDS, side: float = 20.0) -> DataFrame:
    """``id, x, y`` of every row of ``start`` (``id, x, y``), scaled into a square.

    The second and third eigenvectors of the symmetric edge weights over the roots of
    the degrees, which keep strongly linked points together. Each round is one pass over
    the edges; the driver gets nine products per round and no vectors. Rounds end
    when the eigenvalues are steady. Points without edges keep their place in ``start``,
    scaled alike. Points that coincide are parted by a little keyed noise.
    """
    degrees = edges.groupBy("src").agg(F.sqrt(F.sum("weight")).alias("root"), F.count(F.lit(1)).alias("n"))
    place = start.select("id", "x", "y")
    linked, count = numbered(degrees.withColumnRenamed("src", "id").join(place, "id"))
    linked = materialise(linked, "roots")
    sums = linked.agg(F.sum(F.col("root") * F.col("root")).alias("weight"), F.sum("n").alias("edges")).first()
    shares = _normalised(edges, linked.select("id", "no", "root"), count, sums.edges or 0)
    nodes = materialise(linked.select("id", "no", (F.col("root") / F.lit((sums.weight or 1.0) ** 0.5)).alias("u"), "x", "y"), "spectral")
    found = _products(nodes, _PAIRS)
    values = np.zeros(2)
    for _ in range(rounds):
        basis = _orthonormal(np.array(found).reshape(3, 3))
        mixed = [" + ".join(f"({float(c)!r}D * {n})" for c, n in zip(row, "uxy")) for row in basis]
        clean = nodes.selectExpr("id", "no", "u", f"{mixed[0]} AS x", f"{mixed[1]} AS y")
        pulled = with_values(shares, "dst_no", clean, {"dx": "x", "dy": "y"}, count).selectExpr(
            "NULL AS id", "src_no AS no", "NULL AS u", "NULL AS x", "NULL AS y", "share * dx AS px", "share * dy AS py"
        )
        own = clean.selectExpr("id", "no", "u", "x", "y", "0D AS px", "0D AS py")
        summed = own.unionByName(pulled).groupBy("no").agg(
            *[F.max(c).alias(c) for c in ("id", "u")], F.max("x").alias("x0"), F.max("y").alias("y0"), F.sum("px").alias("px"), F.sum("py").alias("py")
        )
        # Half the step keeps negative eigenvalues from winning.
        nodes = materialise(summed.selectExpr("id", "no", "u", "x0", "y0", "(x0 + px) / 2 AS x", "(y0 + py) / 2 AS y"), "spectral")
        *found, x_value, y_value = _products(nodes, [*_PAIRS, ("x0", "x"), ("y0", "y")])
        steady = np.abs(np.array([x_value, y_value]) - values).max() < STEADY
        values = np.array([x_value, y_value])
        if steady:
            break
    return _scaled(nodes, place, side)


def _reach(df: DataFrame) -> float:
    found = df.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0]
    return found or 1.0


def _scaled(nodes: DataFrame, place: DataFrame, side: float) -> DataFrame:
    """Both kinds of points into one square."""
    inner, outer = _reach(nodes), _reach(place)
    alone = place.join(nodes.select("id"), "id", "left_anti")

    def fitted(df: DataFrame, reach: float) -> DataFrame:
        noise = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(2001)) - 1000) / F.lit(1e6)
        at = lambda c, salt: (F.col(c) * F.lit(side / 2 / reach) + noise(salt) * F.lit(side)).alias(c)
        return df.select("id", at("x", 1), at("y", 2))

    return fitted(nodes, inner).unionByName(fitted(alone, outer))


def preserved(graph: DataFrame, positions: DataFrame, k: int) -> DataFrame:
    """``edges, kept``: edges of the graph, and those whose ends are among each other's ``k`` nearest on the map too."""
    from marginalia.operators.neighbours import knn_graph

    flat = positions.select("id", F.array(F.col("x").cast("float"), F.col("y").cast("float")).alias("place"))
    near = knn_graph(flat, k, "id", "place").select("src", "dst", F.lit(1).alias("hit"))
    return graph.select("src", "dst").join(near, ["src", "dst"], "left").agg(F.count(F.lit(1)).alias("edges"), F.count("hit").alias("kept"))
