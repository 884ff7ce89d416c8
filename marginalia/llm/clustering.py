"""Centroid clustering by Lloyd's rounds, sharded by dimensions.

Vectors are cut into column blocks. A task holds one block of a chunk of vectors and
the same columns of the centroids, and computes exact partial distances; the parts of
a chunk are added and the nearest centroid taken; then each block's columns of the
centroids are computed from the block's own sums. So neither vectors nor centroids
need be whole anywhere, however many dimensions there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import large
from marginalia.llm.vectors import LARGEST, products, stacked, whole_vectors
from marginalia.session import materialise

CHUNK = 4096  # vectors
BLOCK = 16  # columns
_BLOCKS = "chunk bigint, block int, ids array<bigint>, data binary"
_PARTS = "chunk bigint, part binary"
_NEAREST = "chunk bigint, clusters binary, distances binary"
_SUMS = "block int, cluster int, n bigint, sums array<bigint>"
_ROWS = "vec_id bigint, cluster int, distance bigint"


def _cut(width: int, scale: int):
    """Vectors to blocks of columns; the first block of a chunk has its ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, vectors = whole_vectors(batch.column(1), scale, width)
            ids = batch.column(0).take(pa.array(rows))
            for lo in range(0, len(rows), CHUNK):
                matrix = stacked(vectors[lo : lo + CHUNK], width)
                data = [np.ascontiguousarray(matrix[:, k : k + BLOCK]).tobytes() for k in range(0, width, BLOCK)]
                own = ids[lo : lo + CHUNK].to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk] * len(data), pa.int64()),
                        pa.array(range(len(data)), pa.int32()),
                        pa.array([own, *[None] * (len(data) - 1)], pa.list_(pa.int64())),
                        pa.array(data, pa.binary()),
                    ],
                    ["chunk", "block", "ids", "data"],
                )
                chunk += 1

    return cut


def _matrix(data: pa.Scalar, columns: int) -> np.ndarray:
    return np.frombuffer(data.as_py(), np.int32).reshape(-1, columns)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Squared distances in the columns of a block: one row per vector, one column per centroid."""
    for batch in batches:
        parts = []
        for data, slices in zip(batch.column(1), batch.column(2), strict=True):
            c = np.array(slices.as_py(), np.int64)
            x = _matrix(data, c.shape[1])
            square = lambda m: (m.astype(np.int64) ** 2).sum(axis=1)
            parts.append((square(x)[:, None] - 2 * products(x, c) + square(c)[None, :]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.binary())], ["chunk", "part"])


def _nearest(k: int):
    """The parts of a chunk added; the nearest centroid of each vector, of the smallest number where several are."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, distances = [], []
            for parts in batch.column(1):
                total = sum(np.frombuffer(p.as_py(), np.int64).reshape(-1, k) for p in parts.values)
                best = total.argmin(axis=1)
                clusters.append(best.astype(np.int32).tobytes())
                distances.append(total[np.arange(len(best)), best].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(clusters, pa.binary()), pa.array(distances, pa.binary())],
                ["chunk", "clusters", "distances"],
            )

    return nearest


def _block_sums(k: int, width: int):
    """Per block and cluster: vectors and sums of the columns, one row per task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(k, np.int64))
        for batch in batches:
            for block, data, clusters in zip(*(batch.column(c) for c in range(3)), strict=True):
                b = block.as_py()
                x = _matrix(data, min(BLOCK, width - b * BLOCK))
                of = np.frombuffer(clusters.as_py(), np.int32)
                total = totals.setdefault(b, np.zeros((k, x.shape[1]), np.int64))
                np.add.at(total, of, x)
                counts[b] += np.bincount(of, minlength=k)
        rows = [(b, c, int(counts[b][c]), total[c].tolist()) for b, total in totals.items() for c in range(k) if counts[b][c]]
        columns = [list(x) for x in zip(*rows, strict=True)] or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], ["block", "cluster", "n", "sums"]
        )

    return sums


def _spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks back to one row per vector."""
    for batch in batches:
        for ids, clusters, distances in zip(*(batch.column(c) for c in range(3)), strict=True):
            yield pa.RecordBatch.from_arrays(
                [ids.values, pa.array(np.frombuffer(clusters.as_py(), np.int32)), pa.array(np.frombuffer(distances.as_py(), np.int64))],
                ["vec_id", "cluster", "distance"],
            )


def _whole(x: Column, scale: int) -> Column:
    bound = F.lit(float(LARGEST))
    return F.floor(F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), -bound), bound)).cast("bigint")


def starting_centroids(vectors: DataFrame, k: int, width: int, scale: int, seed: str) -> DataFrame:
    """``block, cluster, j, value`` of the ``k`` vectors whose ``sha256(seed:vec_id)`` is smallest.

    Ids are decimal; a row without an id comes last, rows that share an id are in the
    order of their components.
    """
    usable = (F.size("embedding") == width) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = (
        vectors.filter(F.col("embedding").isNotNull() & usable)
        .select(hashed.alias("h"), F.transform("embedding", lambda x: _whole(x, scale)).alias("v"))
        .orderBy(F.col("h").asc_nulls_last(), "v")
        .limit(k)
    )
    # At most k rows.
    numbered = first.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("h", F.lit("~")).alias("h"), "v"))).alias("all"))
    centroids = numbered.select(F.posexplode("all").alias("cluster", "x")).select("cluster", F.posexplode("x.v").alias("at", "value"))
    return centroids.select(
        F.expr(f"cast(at div {BLOCK} as int)").alias("block"), "cluster", (F.col("at") % BLOCK).alias("j"), "value"
    )


def _slices(centroids: DataFrame) -> DataFrame:
    """``block, slices``: a block's columns of all centroids, by number."""
    rows = centroids.groupBy("block", "cluster").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("c"))
    rows = rows.select("block", "cluster", F.transform("c", lambda x: x["value"]).alias("c"))
    by_block = rows.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("cluster", "c"))).alias("all"))
    return by_block.select("block", F.transform("all", lambda x: x["c"]).alias("slices"))


def _assigned(blocks: DataFrame, centroids: DataFrame, k: int) -> DataFrame:
    """``chunk, clusters, distances``."""
    # k times the dimensions is all that is sent to every task.
    parts = blocks.join(F.broadcast(_slices(centroids)), "block").select("chunk", "data", "slices").mapInArrow(_partial, _PARTS)
    return materialise(
        parts.groupBy("chunk").agg(F.collect_list("part").alias("parts")).mapInArrow(_nearest(k), _NEAREST), "nearest"
    )


def _moved(blocks: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int, width: int) -> DataFrame:
    """Each block's columns of the centroids: floors of the means; a centroid without vectors stays."""
    members = blocks.select("chunk", "block", "data").join(large(assigned.select("chunk", "clusters")), "chunk")
    sums = members.select("block", "data", "clusters").mapInArrow(_block_sums(k, width), _SUMS)
    sums = sums.select("block", "cluster", "n", F.posexplode("sums").alias("j", "s"))
    sums = sums.groupBy("block", "cluster", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    means = sums.select("block", "cluster", "j", F.expr("(s - pmod(s, n)) div n").alias("mean"))
    return materialise(
        centroids.join(means, ["block", "cluster", "j"], "left").select("block", "cluster", "j", F.coalesce("mean", "value").alias("value")),
        "centroids",
    )


def lloyd(
    vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1"
) -> tuple[DataFrame, DataFrame]:
    """``vec_id, cluster, distance`` of every vector that takes part, and ``cluster, centroid``.

    ``vectors`` has ``vec_id, embedding``; other columns are not read. Vectors with
    exactly ``width`` components, none null or non-finite, take part, as whole numbers
    ``floor(scale * x)`` (up to 2^26 either way). ``rounds`` times, every vector goes
    to its nearest centroid by squared distance (ties: the smaller number) and every
    centroid with vectors to the floor of their mean; then they are assigned once
    more. Fewer than ``k`` vectors are all centroids. Rows without an id take part and
    come back without one; rows that share an id or a vector are told apart. An empty
    table gives empty tables.
    """
    blocks = materialise(vectors.select("vec_id", "embedding").mapInArrow(_cut(width, scale), _BLOCKS), "blocks")
    centroids = materialise(starting_centroids(vectors, k, width, scale, seed), "centroids")
    started = centroids.agg(F.coalesce(F.max("cluster") + 1, F.lit(0))).first()[0]
    for _ in range(rounds):
        centroids = _moved(blocks, _assigned(blocks, centroids, started), centroids, started, width)
    last = _assigned(blocks, centroids, started)
    ids = blocks.filter("block = 0").select("chunk", "ids")
    rows = ids.join(large(last), "chunk").select("ids", "clusters", "distances").mapInArrow(_spread_out, _ROWS)
    whole = centroids.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("block", "j", "value"))).alias("c"))
    return rows, whole.select("cluster", F.transform("c", lambda x: x["value"]).alias("centroid"))


def clusters(vectors: DataFrame, **options) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part.

    Inertia is the sum of distances over the cluster or over all (2^63 - 1 if it is more).
    """
    rows, centroids = lloyd(vectors, **options)
    rows = materialise(rows, "clustered")
    capped = lambda c: F.least(c, F.lit(2**63 - 1).cast("decimal(38,0)")).cast("bigint")
    sums = materialise(rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("s")), "inertia")
    # One row per cluster.
    everything = F.sum("s").over(Window.partitionBy(F.lit(0)))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    known = sums.join(centroids, "cluster").select(
        "cluster", capped(F.col("s")).alias("cluster_inertia"), capped(everything).alias("inertia"), digest.alias("centroid_sha256")
    )
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
