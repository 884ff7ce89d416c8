"""Hard negatives by segment summary filtering.

A vector is stored with the mean and the deviation of each of its segments. For two
segments of ``w`` components, ``w`` times the product of the means, plus or minus ``w``
times the product of the deviations, bounds the inner product (Cauchy-Schwarz). Sums of
these bounds over one segment, then over four and sixteen, rule pairs out; only what is
left is scored exactly.

Anchors and vectors meet in blocks: each block of anchors with each chunk of vectors that
can matter to it, one pair of blocks at a time. A chunk has vectors of neighbouring labels,
so positives are looked for only where the label occurs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import large
from marginalia.llm.vectors import products, stacked, whole_vectors
from marginalia.session import materialise

LEVELS = (1, 4, 16)  # segments of a vector
ANCHORS = 4096  # of a block
CHUNK = 512, 65_536  # least and most vectors of a chunk
TILE = 512, 2048  # anchors and vectors that are compared at once
DENSE = 0.2  # share of open pairs from which on all are computed as one product
SLACK = 1e-5  # of a bound, for the rounding of summaries in single precision
_MEMBERS = "vec_id bigint, label bigint, vector binary"
_PACKED = "block bigint, labels array<bigint>, ids array<bigint>, classes binary, vectors binary, summaries binary"
_OWN = ("anchor_id", "positive_id", "positive_score")
_POSITIVES = "anchor_id bigint, positive_id bigint, positive_score bigint"
_NEGATIVES = "anchor_id bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"


def summaries(x: np.ndarray) -> np.ndarray:
    """Per row: for each level, the means and then the deviations of the segments, times the root of their width."""
    out = []
    for n in LEVELS:
        parts = x.reshape(len(x), n, x.shape[1] // n).astype(np.float64)
        root = parts.shape[2] ** 0.5
        out += [parts.mean(axis=2) * root, parts.std(axis=2) * root]
    return np.concatenate(out, axis=1).astype(np.float32)


def level_columns(level: int) -> tuple[slice, slice]:
    """Where the means and the deviations of a level stand in a summary."""
    first = 2 * sum(LEVELS[:level])
    middle = first + LEVELS[level]
    return slice(first, middle), slice(middle, middle + LEVELS[level])


class Tile:
    """Anchors against vectors: which pairs are still open, and exact scores of those that stay so."""

    def __init__(self, a: np.ndarray, sa: np.ndarray, v: np.ndarray, sv: np.ndarray, opened: np.ndarray):
        self.a, self.v, self.sa, self.sv = a, v, sa.astype(np.float64), sv.astype(np.float64)
        self.open = opened
        length = lambda s: np.sqrt((s[:, :2] ** 2).sum(axis=1))
        self.slack = SLACK * length(self.sa)[:, None] * length(self.sv)[None, :] + 1

    def _pairs(self, left: np.ndarray, right: np.ndarray, rows, columns) -> np.ndarray:
        return np.einsum("ij,ij->i", left[rows], right[columns])

    def narrow(self, lowest: np.ndarray, highest: np.ndarray) -> None:
        """Close pairs whose score must be below ``lowest`` or above ``highest`` of their anchor, level by level."""
        if not (np.isfinite(lowest).any() or np.isfinite(highest).any()):
            return
        for level in range(len(LEVELS)):
            means, deviations = level_columns(level)
            if self.open.mean() > DENSE:
                middle = self.sa[:, means] @ self.sv[:, means].T
                around = self.sa[:, deviations] @ self.sv[:, deviations].T + self.slack
                self.open &= (middle + around >= lowest[:, None]) & (middle - around <= highest[:, None])
            else:
                rows, columns = np.nonzero(self.open)
                middle = self._pairs(self.sa[:, means], self.sv[:, means], rows, columns)
                around = self._pairs(self.sa[:, deviations], self.sv[:, deviations], rows, columns) + self.slack[rows, columns]
                out = (middle + around < lowest[rows]) | (middle - around > highest[rows])
                self.open[rows[out], columns[out]] = False

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, vector and exact score of each open pair."""
        rows, columns = np.nonzero(self.open)
        if self.open.mean() > DENSE:
            return rows, columns, products(self.a, self.v)[rows, columns]
        out = np.empty(len(rows), np.int64)
        for k in range(0, len(rows), 100_000):
            part = slice(k, k + 100_000)
            out[part] = np.einsum("ij,ij->i", self.a[rows[part]].astype(np.int64), self.v[columns[part]].astype(np.int64))
        return rows, columns, out


def best(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -scores, groups))
    g = groups[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[place < n]


def _members(scale: int):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, vectors = whole_vectors(batch.column(2), scale)
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array([v.tobytes() for v in vectors], pa.binary())],
                ["vec_id", "label", "vector"],
            )

    return members


def _packed_row(number: int, ids: list, labels: list, vectors: list, width: int) -> pa.RecordBatch:
    x = stacked([np.frombuffer(v, np.int32) for v in vectors], width)
    blobs = [np.array(labels, np.int64), x, summaries(x)]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([sorted(set(labels))], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64()))]
        + [pa.array([b.tobytes()], pa.binary()) for b in blobs],
        ["block", "labels", "ids", "classes", "vectors", "summaries"],
    )


def _cut(width: int, size: int):
    """Sorted rows to chunks of up to ``size``; of rows that are equal in all, one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, last = TaskContext.get().partitionId() << 32, [], None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if row != last:
                    held.append(row)
                last = row
                if len(held) == size:
                    yield _packed_row(number, *map(list, zip(*held, strict=True)), width)
                    number, held = number + 1, []
        if held:
            yield _packed_row(number, *map(list, zip(*held, strict=True)), width)

    return cut


def _chunks(members: DataFrame, width: int, size: int) -> DataFrame:
    """Vectors in chunks of neighbouring labels; a label of many rows has several ranges."""
    partitions = max(1, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = members.repartitionByRange(partitions, "label", "vec_id").sortWithinPartitions("label", "vec_id", "vector")
    return materialise(ordered.mapInArrow(_cut(width, size), _PACKED), "chunks")


def _gathered(width: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns = (rows.values.field(c).to_pylist() for c in ("vec_id", "label", "vector"))
                yield _packed_row(block, *columns, width)

    return gather


def _anchor_blocks(anchors: DataFrame, width: int) -> tuple[DataFrame, int]:
    """One row per anchor id in numbered blocks of some ``ANCHORS``, and their number."""
    single = materialise(anchors.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")), "anchors")
    n = max(1, -(-single.count() // ANCHORS))
    dealt = single.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("block"), F.struct("vec_id", "x.label", "x.vector").alias("row"))
    packed = dealt.groupBy("block").agg(F.collect_list("row").alias("rows")).mapInArrow(_gathered(width), _PACKED)
    return materialise(packed, "anchor-blocks"), n


class _Block:
    """A packed row as arrays."""

    def __init__(self, table: pa.Table, prefix: str, width: int):
        get = lambda c, kind: np.frombuffer(table.column(prefix + c)[0].as_py(), kind)
        self.ids = table.column(prefix + "ids")[0].values.to_numpy(zero_copy_only=False)
        self.labels = get("classes", np.int64)
        self.vectors = get("vectors", np.int32).reshape(len(self.ids), width)
        self.summaries = get("summaries", np.float32).reshape(len(self.ids), -1)

    def part(self, lo: int, n: int):
        return tuple(x[lo : lo + n] for x in (self.ids, self.labels, self.vectors, self.summaries))


def _highest(scores: np.ndarray, groups: np.ndarray, n: int, count: int) -> np.ndarray:
    """The ``n``-th highest score of each of ``count`` groups, or the least number where there are fewer."""
    out = np.full(count, -np.inf)
    order = np.lexsort((-scores, groups))
    g = groups[order]
    first = np.searchsorted(g, np.arange(count))
    last = np.searchsorted(g, np.arange(count), side="right")
    enough = last - first >= n
    out[enough] = scores[order][first[enough] + n - 1]
    return out


def _positives(n: int, width: int):
    """The first ``n`` other vectors of the anchor's label, of one pair of blocks."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, others = _Block(left, "", width), _Block(right, "v_", width)
        found = []
        for lo in range(0, len(anchors.ids), TILE[0]):
            ids, labels, a, sa = anchors.part(lo, TILE[0])
            kept = (np.empty(0, np.int64),) * 3  # anchor, score, id
            for start in range(0, len(others.ids), TILE[1]):
                vids, vlabels, v, sv = others.part(start, TILE[1])
                opened = (labels[:, None] == vlabels[None, :]) & (ids[:, None] != vids[None, :])
                if not opened.any():
                    continue
                tile = Tile(a, sa, v, sv, opened)
                tile.narrow(_highest(kept[1], kept[0], n, len(ids)), np.full(len(ids), np.inf))
                rows, columns, scores = tile.scores()
                kept = tuple(np.r_[x, y] for x, y in zip(kept, (rows, scores, vids[columns]), strict=True))
                first = best(*kept, n)
                kept = tuple(x[first] for x in kept)
            found.append((ids[kept[0]], kept[2], kept[1]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table(dict(zip(("anchor_id", "positive_id", "positive_score"), map(pa.array, columns), strict=True)))

    return find


def band(score: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores ``x`` with ``low * score <= 100 * x <= high * score`` are from the first to the second, whole numbers."""
    return -((-low * score) // 100), (high * score) // 100


def _negatives(n: int, low: int, high: int, width: int):
    """The first ``n`` vectors of another label in the band of each positive, of one pair of blocks."""

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, others = _Block(left, "", width), _Block(right, "v_", width)
        own = left.column("own")[0].values
        of_anchor, of_positive, of_score = (own.field(c).to_numpy(zero_copy_only=False) for c in _OWN)
        lows, highs = band(of_score, low, high)
        found = []
        for lo in range(0, len(anchors.ids), TILE[0]):
            ids, labels, a, sa = anchors.part(lo, TILE[0])
            # Bands of these anchors; ids of anchors may be repeated.
            owner, which = np.nonzero(ids[:, None] == of_anchor[None, :])
            possible = lows[which] <= highs[which]
            owner, which = owner[possible], which[possible]
            if not len(owner):
                continue
            bands = len(owner)
            kept = (np.empty(0, np.int64),) * 3  # band, score, id
            for start in range(0, len(others.ids), TILE[1]):
                vids, vlabels, v, sv = others.part(start, TILE[1])
                lowest = np.maximum(lows[which], _highest(kept[1], kept[0], n, bands))
                least, most = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
                np.minimum.at(least, owner, lowest)
                np.maximum.at(most, owner, highs[which])
                opened = (labels[:, None] != vlabels[None, :]) & np.isfinite(least)[:, None]
                if not opened.any():
                    continue
                tile = Tile(a, sa, v, sv, opened)
                tile.narrow(least, most)
                rows, columns, scores = tile.scores()
                # Each score with the bands of its anchor.
                by = np.argsort(owner, kind="stable")
                first, count = np.searchsorted(owner[by], rows), np.bincount(owner, minlength=len(ids))[rows]
                at = np.repeat(np.arange(len(rows)), count)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                b = by[np.repeat(first, count) + nth]
                inside = (scores[at] >= lowest[b]) & (scores[at] <= highs[which[b]])
                new = (b[inside], scores[at[inside]], vids[columns[at[inside]]])
                kept = tuple(np.r_[x, y] for x, y in zip(kept, new, strict=True))
                top = best(*kept, n)
                kept = tuple(x[top] for x in kept)
            w = which[kept[0]]
            found.append((of_anchor[w], of_positive[w], kept[2], of_score[w], kept[1]))
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.empty(0, np.int64)] * len(names)
        return pa.table(dict(zip(names, (pa.array(c, pa.int64()) for c in columns), strict=True)))

    return find


def _met(anchors: DataFrame, chunks: DataFrame, pairs: DataFrame, find: Callable, schema: str, *more: str) -> DataFrame:
    """``find`` of each pair of blocks. A block is sent once for each partner."""
    blobs = ("ids", "classes", "vectors", "summaries")
    left = anchors.join(large(pairs), "block").select("block", "chunk", *blobs, *more)
    other = chunks.select(F.col("block").alias("chunk"), *[F.col(c).alias(f"v_{c}") for c in blobs])
    right = other.join(large(pairs), "chunk").select("block", "chunk", *[f"v_{c}" for c in blobs])
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(find, schema)


def _first(rows: DataFrame, keys: list[str], score: str, vec_id: str, n: int) -> DataFrame:
    """The first ``n`` rows per key with their rank; Spark cuts to ``n`` in each task before the shuffle as well."""
    by = Window.partitionBy(*keys).orderBy(F.col(score).desc(), vec_id)
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vectors`` and ``anchors`` have ``vec_id, label, embedding``; other columns are not
    read. Rows with a null id, label or vector, or a null or non-finite component, take
    no part. Components become ``floor(scale * x)`` (up to 2^26 either way); shorter
    vectors count as having zeros at the end. Scores are whole inner products, higher ones first,
    ties by smaller id. An anchor's positives are its first ``positives`` vectors of
    the same label and another id. For each, the first ``negatives`` vectors of other
    labels with ``low * positive <= 100 * negative <= high * positive`` are returned, all
    if there are fewer. Nothing is estimated or cut off. Rows that share an id count
    each, as anchors once. An empty table gives an empty table.
    """
    use = lambda df: (
        df.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
        .select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding")
        .mapInArrow(_members(scale), _MEMBERS)
    )
    members, asked = materialise(use(vectors), "members"), use(anchors)
    longest = members.select("vector").unionByName(asked.select("vector")).agg(F.max(F.length("vector"))).first()[0] or 0
    width = max(1, -(-longest // 4 // LEVELS[-1])) * LEVELS[-1]
    tasks = 4 * members.sparkSession.sparkContext.defaultParallelism
    size = min(CHUNK[1], max(CHUNK[0], -(-members.count() // tasks)))
    chunks, (blocks, n_blocks) = _chunks(members, width, size), _anchor_blocks(asked, width)
    # Numbers of blocks that meet: as many rows as there are pairs of blocks to compare.
    of = lambda df, name: df.select(F.col("block").alias(name), F.explode("labels").alias("label"))
    alike = of(blocks, "block").join(large(of(chunks, "chunk")), "label").select("block", "chunk").distinct()
    near = _met(blocks, chunks, materialise(alike, "pairs"), _positives(positives, width), _POSITIVES)
    found = _first(near, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank").distinct()
    found = materialise(found, "positives")
    # The positives of a block's anchors go with the block.
    own = blocks.select("block", F.explode("ids").alias("anchor_id")).join(large(found), "anchor_id")
    own = own.groupBy("block").agg(F.collect_list(F.struct(*_OWN)).alias("own"))
    ready = materialise(blocks.join(large(own), "block"), "anchors-with-positives")
    every = chunks.select(F.col("block").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("block"))
    every = every.join(large(ready.select("block")), "block", "left_semi")
    far = _met(ready, chunks, materialise(every, "pairs"), _negatives(negatives, low, high, width), _NEGATIVES, "own")
    return _first(far, [*_OWN], "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
