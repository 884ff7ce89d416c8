"""Approximate nearest-neighbour graph by neighbour descent.

A neighbour of a neighbour is likely a neighbour (Dong, Moses, Li 2011). First lists
come from a few rounds in which vectors are ordered by the signs of random projections
and compared with those next to them. Then each vector's neighbours, in either
direction, are compared with each other; only pairs with an edge that is new since the
round before are, and only what beats a list's last entry is passed on. Rounds end when
few edges change. A sample of vectors is then searched in full; if lists hold too few of its
neighbours, they are made twice as long and the rounds go on.

Vectors are numbered by id, and a shard of them is a task's: lists, groups and vectors move as
a few packed messages between shards, and a vector once to each shard that compares it. A shard
has so many rows that the vectors of its groups take a bounded size. The driver gets counts,
one mean vector, as many vectors as a list is long and the sample.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.embedding import as_matrix
from marginalia.operators.neighbours import _distinct_vectors, _expand_copies, _measured, _nearest, _scaled
from marginalia.session import materialise

PLANES = 48  # signs of an order
WINDOW = 1024  # vectors that are compared at the start
ORDERS = 8  # rounds of the start
SPARE = 15  # entries of a list beyond those asked for
UPDATE_RATE = 0.002  # of all edges; below it, the rounds end
FOUND = 0.92  # of a sample's neighbours; below it, lists are made longer
SAMPLE = 1000
EARLY_LOOKS = ((0.3, 0.25), (0.1, 0.1))  # below that rate, a look at the sample; lists that lack more are made longer at once
SHARD_BYTES = 192 << 20  # of vectors that the groups of a shard compare, about
LEAST_ROWS = 256  # of a shard
PIECE = 4096  # vectors of a message
MOST_EDGES = 1 << 21  # that a task holds before it cuts them
MESSAGE_BYTES = 16 << 20  # that a task holds before it passes them on

# Messages to a shard; of a shard, they arrive in the order of their kinds.
LISTS, POINTS, BOUNDS, MEMBERS, BACK, ASK, GIVE, EDGES, FRESH = range(9)
_KINDS = {
    LISTS: (np.int32, np.float64, np.bool_),  # at: first number; neighbours, distances, fresh
    POINTS: (np.float32, np.int64),  # at: first number; vectors, ids
    BOUNDS: (np.float64,),  # at: first number; last distances
    MEMBERS: (np.int32, np.int32, np.int32),  # sizes of groups, fresh of each, members, fresh ones first
    BACK: (np.int32, np.int32, np.bool_),  # hub, member, fresh
    ASK: (np.int32,),  # at: the shard that asks; numbers
    GIVE: (np.int32, np.float32, np.float64),  # numbers, vectors, last distances
    EDGES: (np.int32, np.int32, np.float64),  # from, to, distance
    FRESH: (),  # at: how many
}
_MESSAGES = "shard int, kind int, at bigint, a binary, b binary, c binary"
_EDGES = "src bigint, dst bigint, dist double"


def _packed(messages: list[tuple]) -> pa.RecordBatch:
    cells = [[*m[3:], *[None] * (6 - len(m))] for m in messages]
    columns = [pa.array([m[n] for m in messages], kind) for n, kind in enumerate((pa.int32(), pa.int32(), pa.int64()))]
    columns += [pa.array([None if c[n] is None else c[n].tobytes() for c in cells], pa.binary()) for n in range(3)]
    return pa.RecordBatch.from_arrays(columns, ["shard", "kind", "at", "a", "b", "c"])


def _sent(messages: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """``(shard, kind, at, arrays...)``, some to a batch."""
    held, size = [], 0
    for message in messages:
        held.append(message)
        size += 100 + sum(x.nbytes for x in message[3:])
        if size > MESSAGE_BYTES:
            yield _packed(held)
            held, size = [], 0
    if held:
        yield _packed(held)


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        head = zip(*(batch[c].to_pylist() for c in ("shard", "kind", "at")))
        for row, (shard, kind, at) in enumerate(head):
            yield shard, kind, at, *(np.frombuffer(batch[c][row].as_buffer(), t) for c, t in zip("abc", _KINDS[kind]))


def _each(messages: DataFrame, run: Callable, tasks: int | None = None) -> DataFrame:
    """``run(shard, messages)`` gives messages; with ``tasks``, all of a shard come together, else they come as they lie."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(m for shard, rows in groupby(_received(batches), lambda m: m[0]) for m in run(shard, rows))

    if tasks:
        messages = messages.repartitionById(tasks, F.col("shard")).sortWithinPartitions("shard", "kind")
    return messages.mapInArrow(each, _MESSAGES)


def _kind(messages: DataFrame, *kinds: int) -> DataFrame:
    return messages.filter(F.col("kind").isin(*kinds))


def _dealt(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Columns by shard."""
    by = np.argsort(shard, kind="stable")
    shard = shard[by]
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(shard[lo]), *(c[by[lo:hi]] for c in columns)


def _rank(group: np.ndarray) -> np.ndarray:
    """The place of each row in its group; rows of a group lie together."""
    at = np.arange(len(group))
    new = np.r_[True, group[1:] != group[:-1]][: len(group)]
    return at - np.maximum.accumulate(np.where(new, at, 0))


def _mean(points: DataFrame) -> np.ndarray:
    """The mean vector: one partial sum per message is added up by Spark."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, vec, ids in _received(batches):
            total = vec.reshape(len(ids), -1).astype(np.float64).sum(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array(total), pa.array([len(ids)] * len(total), pa.int64())], ["at", "total", "n"]
            )

    rows = points.mapInArrow(sums, "at int, total double, n bigint")
    return np.array([r.m for r in rows.groupBy("at").agg((F.sum("total") / F.sum("n")).alias("m")).orderBy("at").collect()])


def _numbered(vectors: DataFrame) -> DataFrame:
    """``POINTS`` messages of all vectors, numbered by id, of no shard yet."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            at = 0
            for whole in batches:
                for lo in range(0, whole.num_rows, PIECE):
                    batch = whole.slice(lo, PIECE)
                    yield TaskContext.get().partitionId(), POINTS, at, as_matrix(batch["vec"], np.float32), batch["rep"].to_numpy()
                    at += batch.num_rows

        yield from _sent(pieces())

    ordered = vectors.repartitionByRange(parts, "rep").sortWithinPartitions("rep", F.xxhash64("vec"))
    placed = materialise(ordered.mapInArrow(pack, _MESSAGES), "descent-placed")
    # One row per task.
    sizes = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum(F.length("b") / 8).cast("bigint").alias("n")).collect()}
    first, total = {}, 0
    for part in sorted(sizes):
        first[part], total = total, total + sizes[part]
    return _each(placed, lambda part, rows: ((0, POINTS, first[part] + m[2], *m[3:]) for m in rows))


def _shard_rows(n: int, most: float, members: int, least_shards: int) -> int:
    """Rows of a shard whose groups of so many ``members`` have about ``most`` different ones of ``n`` together, and whose lists a task can sort."""
    rows = max(LEAST_ROWS, -(-n // least_shards))
    if most < n:
        # Of n, as many draws as leave out all but so many.
        rows = min(rows, int(-n * np.log1p(-most / n) / members))
    return max(1, min(rows, 2 * MOST_EDGES // members))


def _in_shards(points: DataFrame, rows: int) -> DataFrame:
    """``POINTS``, cut where a shard of ``rows`` vectors ends; no row moves yet."""
    def run(_, messages):
        for _, _, at, vec, ids in messages:
            vec = vec.reshape(len(ids), -1)
            for lo, hi in _spans(at, len(ids), rows):
                yield (at + lo) // rows, POINTS, at + lo, vec[lo:hi], ids[lo:hi]

    return _each(points, run)


def _spans(at: int, n: int, rows: int) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < n:
        hi = min(n, lo + rows - (at + lo) % rows)
        yield lo, hi
        lo = hi


def _few(points: DataFrame, numbers: np.ndarray) -> np.ndarray:
    """These vectors, which reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, at, vec, ids in _received(batches):
            own = numbers[(numbers >= at) & (numbers < at + len(ids))]
            if len(own):
                rows = [x.tobytes() for x in vec.reshape(len(ids), -1)[own - at]]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(rows, pa.binary())], ["number", "vec"])

    found = {r.number: r.vec for r in points.mapInArrow(run, "number bigint, vec binary").collect()}
    return np.array([np.frombuffer(found[i], np.float32) for i in numbers.tolist()], dtype=np.float64)


def _first_edges(points: DataFrame, mean: np.ndarray, n: int, length: int, window: int, orders: int, seed: int, rows: int) -> DataFrame:
    """Neighbours among those next in some order; rows of a window arrive together."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Some windows to a task, but for very many vectors.
    tasks = max(1, min(max(parts, orders * n // (64 * window)), orders * n // (2 * window)))
    bits = 1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signs of random projections, the first in the highest bits."""
        for _, _, at, vec, ids in _received(batches):
            vec = vec.reshape(len(ids), -1)
            numbers, packed = pa.array(np.arange(at, at + len(ids))), pa.array([x.tobytes() for x in vec], pa.binary())
            for k in range(orders):
                planes = np.random.default_rng(seed + k).normal(size=(len(mean), PLANES))
                code = ((vec - mean) @ planes > 0) @ bits
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), k, np.int32)), pa.array(code), numbers, packed], ["turn", "code", "number", "vec"]
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows():
            turn, held = None, []
            for batch in batches:
                turns, numbers = batch["turn"].to_numpy(), batch["number"].to_numpy()
                vec = np.frombuffer(b"".join(batch["vec"].to_pylist()), np.float32).reshape(batch.num_rows, -1)
                cuts = np.flatnonzero(np.diff(turns, prepend=-1, append=-1))
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    if held and turns[lo] != turn:
                        yield _joined(held)
                        held = []
                    turn = turns[lo]
                    held.append((numbers[lo:hi], vec[lo:hi]))
                    if sum(len(x) for x, _ in held) >= 3 * window // 2:
                        some, matrix = _joined(held)
                        # The last window of a turn takes up to half a window more.
                        ends = range(window, len(some) - window // 2 + 1, window)
                        for end in ends:
                            yield some[end - window : end], matrix[end - window : end]
                        held = [(some[ends[-1] :], matrix[ends[-1] :])]
            if held:
                yield _joined(held)

        def edges():
            held, size = [], 0
            for numbers, matrix in windows():
                if len(numbers) < 2:
                    continue
                matrix = matrix.astype(np.float64)
                at, dst, dist = _nearest(matrix, matrix, numbers, length + 1)
                other = numbers[at] != dst
                held.append((numbers[at][other].astype(np.int32), dst[other].astype(np.int32), dist[other]))
                size += len(held[-1][0])
                if size > MOST_EDGES:
                    yield _joined(held)
                    held, size = [], 0
            if held:
                yield _joined(held)

        for src, dst, dist in edges():
            yield from _sent((shard, EDGES, 0, *cells) for shard, *cells in _dealt(src // rows, src, dst, dist))

    coded = points.mapInArrow(codes, "turn int, code bigint, number bigint, vec binary")
    by = ["turn", "code", "number"]
    return coded.repartitionByRange(tasks, *by).sortWithinPartitions(*by).mapInArrow(compare, _MESSAGES)


def _joined(held: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*held)]


def _shortest(edges: list[np.ndarray], length: int) -> list[np.ndarray]:
    """The first ``length`` entries per list, copies merged; an edge is fresh unless it was there before."""
    src, dst, dist, fresh = edges
    by = np.lexsort((fresh, dst, dist, src))
    src, dst = src[by], dst[by]
    single = np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])][: len(src)]
    by, src = by[single], src[single]
    kept = by[_rank(src) < length]
    return [x[kept] for x in edges]


def _some(hub: np.ndarray, member: np.ndarray, fresh: np.ndarray, limit: int) -> np.ndarray:
    """Up to ``limit`` fresh and as many other members per hub."""
    drawn = (member.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hub.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
    by = np.lexsort((member, drawn >> np.uint64(20), fresh, hub))
    return by[_rank(hub[by].astype(np.int64) * 2 + fresh[by]) < limit]


def _lists(points_or_lists: DataFrame, edges: DataFrame, length: int, rows: int, tasks: int, landmarks=None, half_full: bool = False) -> DataFrame:
    """The shortest of all edges: ``LISTS`` and their ``BOUNDS``, ``BACK`` edges to the shards of neighbours, and a ``FRESH`` count.

    With ``landmarks``, vectors and their numbers, each vector has edges to these, the same for all: every
    list is full and the graph in one piece from the start. Of lists that are ``half_full``, a bound is what the first
    half lets expect, with some room: all that beats landmarks is not worth a message yet.
    """
    def run(shard, messages):
        first, held, size = shard * rows, [], 0
        for _, kind, at, *cells in messages:
            if kind == LISTS:
                src = np.repeat(np.arange(at, at + len(cells[0]) // length, dtype=np.int32), length)
                held.append((src, cells[0], cells[1], np.zeros(len(src), bool)))
            elif kind == POINTS:
                vec, n = cells[0].reshape(len(cells[1]), -1), len(cells[1])
                for lo in range(0, n, 256):
                    src, dst, dist = _nearest(vec[lo : lo + 256].astype(np.float64), landmarks[0], landmarks[1], len(landmarks[1]))
                    src = (src + at + lo).astype(np.int32)
                    other = src != dst
                    held.append((src[other], dst[other].astype(np.int32), dist[other], np.ones(other.sum(), bool)))
            else:
                held.append((*cells, np.ones(len(cells[0]), bool)))
            size += len(held[-1][0])
            if size > MOST_EDGES:
                held = [_shortest(_joined(held), length)]
                size = len(held[0][0]) // 2
        src, dst, dist, fresh = _shortest(_joined(held), length)
        yield shard, LISTS, first, dst, dist, fresh
        bound = dist[length - 1 :: length].copy()
        if half_full and length > 3:
            quarter, half = dist[length // 4 - 1 :: length], dist[length // 2 - 1 :: length]
            wider = np.full(len(bound), np.inf)
            np.divide(half, quarter, out=wider, where=quarter > 0)
            bound = np.fmin(bound, half * wider**2)
        yield shard, BOUNDS, first, bound
        yield shard, FRESH, int(fresh.sum())
        # A vector that very many have as neighbour: as many of them as a list is long, cut in each shard first.
        kept = _some(dst, src, fresh, length)
        yield from ((to, BACK, 0, *cells) for to, *cells in _dealt(dst[kept] // rows, dst[kept], src[kept], fresh[kept]))

    return materialise(_each(points_or_lists.unionByName(edges), run, tasks), "descent-lists")


def _as_edges(lists: DataFrame, length: int, rows: int) -> DataFrame:
    """Lists as edges, for shards of ``rows`` vectors."""
    def run(_, messages):
        for _, _, at, dst, dist, _ in messages:
            src = np.repeat(np.arange(at, at + len(dst) // length, dtype=np.int32), length)
            yield from ((to, EDGES, 0, *cells) for to, *cells in _dealt(src // rows, src, dst, dist))

    return _each(_kind(lists, LISTS), run)


def _members(lists: DataFrame, length: int, rows: int, tasks: int) -> DataFrame:
    """Each vector's neighbours and some that have it as theirs, where one edge is fresh at least: ``MEMBERS``, and ``ASK`` for their vectors."""
    def run(shard, messages):
        back, hub, member, fresh = [], [], [], []
        for _, kind, at, *cells in messages:
            if kind == LISTS:
                hub.append(np.repeat(np.arange(at, at + len(cells[0]) // length, dtype=np.int32), length))
                member.append(cells[0])
                fresh.append(cells[2])
            else:
                back.append(cells)
        if back:
            cells = _joined(back)
            kept = _some(*cells, length)
            for held, column in zip((hub, member, fresh), cells):
                held.append(column[kept])
        hub, member, fresh = (np.concatenate(x) for x in (hub, member, fresh))
        by = np.lexsort((~fresh, member, hub))
        hub, member, fresh = hub[by], member[by], fresh[by]
        single = np.r_[True, (hub[1:] != hub[:-1]) | (member[1:] != member[:-1])]
        hub, member, fresh = hub[single] - shard * rows, member[single], fresh[single]
        any_fresh = np.bincount(hub, fresh) > 0
        kept = any_fresh[hub]
        hub, member, fresh = hub[kept], member[kept], fresh[kept]
        if not len(hub):
            return
        by = np.lexsort((member, ~fresh, hub))
        sizes, some = np.bincount(hub), np.bincount(hub, fresh)
        yield shard, MEMBERS, 0, sizes[sizes > 0].astype(np.int32), some[sizes > 0].astype(np.int32), member[by]
        asked = np.unique(member)
        yield from ((to, ASK, shard, numbers) for to, numbers in _dealt(asked // rows, asked))

    return materialise(_each(_kind(lists, LISTS, BACK), run, tasks), "descent-members")


def _given(points: DataFrame, bounds: DataFrame, asked: DataFrame, tasks: int) -> DataFrame:
    """Vectors and the ends of their lists, once to each shard that asks."""
    def run(shard, messages):
        pieces, ends = [], []
        vec = bound = None
        for _, kind, at, *cells in messages:
            if kind == POINTS:
                pieces.append((at, cells[0].reshape(len(cells[1]), -1)))
            elif kind == BOUNDS:
                ends.append((at, cells[0]))
            else:
                if vec is None:
                    first = min(p[0] for p in pieces)
                    vec, bound = (np.concatenate([x for _, x in sorted(p, key=lambda p: p[0])]) for p in (pieces, ends))
                own = cells[0] - first
                yield at, GIVE, 0, cells[0], vec[own], bound[own]

    return _each(points.unionByName(bounds).unionByName(asked), run, tasks)


def _pairs(sizes: np.ndarray, some: np.ndarray, places: np.ndarray, vec: np.ndarray, bound: np.ndarray) -> Iterator[tuple]:
    """``left, right, distance`` of all pairs of a group of which one is fresh, if they beat the last entry of either's list."""
    flat, scale, slack, _ = _scaled(vec)
    squares = (flat * flat).sum(1)
    most = ((bound / scale) ** 2 * (1 + 1e-6) + slack).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    by = np.lexsort((sizes, some))  # groups of a shape together
    at = 0
    while at < len(by):
        # Room for about a million pairs.
        n = int(max(1, min((1 << 20) // max(1, some[by[at]] * sizes[by[at]]), (1 << 14) // sizes[by[at]])))
        groups = by[at : at + n]
        at += n
        f, m = some[groups].max(), sizes[groups].max()
        column = np.arange(m)
        place = places[np.minimum(starts[groups][:, None] + column, len(places) - 1)]
        x = flat[place]
        d = np.matmul(x[:, :f], x.transpose(0, 2, 1))
        d *= -2
        d += squares[place][:, :f, None]
        d += squares[place][:, None, :]
        hit = np.flatnonzero(d <= np.maximum(most[place][:, :f, None], most[place][:, None, :]))
        group, i, j = np.unravel_index(hit, d.shape)
        kept = (i < j) & (i < some[groups][group]) & (j < sizes[groups][group])
        left, right = place[group[kept], i[kept]], place[group[kept], j[kept]]
        yield left, right, _measured(vec, left, vec, right)


def _compared(members: DataFrame, given: DataFrame, length: int, rows: int, tasks: int) -> DataFrame:
    def run(shard, messages):
        sizes = some = member = None
        held = []
        for _, kind, _, *cells in messages:
            if kind == MEMBERS:
                sizes, some, member = cells
            else:
                held.append((cells[0], cells[1].reshape(len(cells[0]), -1), cells[2]))
        numbers, vec, bound = _joined(sorted(held, key=lambda x: x[0][0]))
        del held

        def edges():
            out, size = [], 0
            for left, right, dist in _pairs(sizes, some, np.searchsorted(numbers, member), vec, bound):
                for a, b in ((left, right), (right, left)):
                    near = dist <= bound[a] * (1 + 1e-9)
                    out.append((numbers[a[near]], numbers[b[near]], dist[near]))
                    size += len(out[-1][0])
                if size > MOST_EDGES:
                    yield _joined(out)
                    out, size = [], 0
            if out:
                yield _joined(out)

        for src, dst, dist in edges():
            src, dst, dist, _ = _shortest([src, dst, dist, np.ones(len(src), bool)], length)
            yield from ((to, EDGES, 0, *cells) for to, *cells in _dealt(src // rows, src, dst, dist))

    return _each(members.unionByName(given), run, tasks)


def _listed(lists: DataFrame, length: int, k: int, only: np.ndarray | None = None) -> DataFrame:
    """``src, dst, rank, dist`` by number, ``k`` of each list; of all vectors or of some."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, at, dst, dist, _ in _received(batches):
            src = np.arange(at, at + len(dst) // length)
            own = np.arange(len(src)) if only is None else np.flatnonzero(np.isin(src, only))
            dst, dist = (x.reshape(-1, length)[own, :k] for x in (dst, dist))
            if len(own):
                rank = np.tile(np.arange(1, k + 1, dtype=np.int32), len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(src[own], k)), pa.array(dst.reshape(-1).astype(np.int64)), pa.array(rank), pa.array(dist.reshape(-1))],
                    ["src", "dst", "rank", "dist"],
                )

    return _kind(lists, LISTS).mapInArrow(run, "src bigint, dst bigint, rank int, dist double")


def _sample(points: DataFrame, k: int, numbers: np.ndarray) -> DataFrame:
    """``src, dst, dist``: the exact neighbours of these vectors, which go to each task."""
    sample = _few(points, numbers)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, at, vec, ids in _received(batches):
            own = np.arange(at, at + len(ids))
            src, dst, dist = _nearest(sample, vec.reshape(len(ids), -1).astype(np.float64), own, k + 1)
            other = numbers[src] != dst
            yield pa.RecordBatch.from_arrays([pa.array(numbers[src][other]), pa.array(dst[other]), pa.array(dist[other])], ["src", "dst", "dist"])

    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return materialise(points.mapInArrow(search, _EDGES).withColumn("rank", rank).filter(F.col("rank") <= k), "descent-sample")


def _share(lists: DataFrame, length: int, k: int, numbers: np.ndarray, sample: DataFrame) -> float:
    """Of the ``k`` neighbours of the sample, the share that its lists have."""
    row = recall(_listed(lists, length, k, numbers), sample).first()
    return row.found / row.edges


def _with_ids(near: DataFrame, points: DataFrame) -> DataFrame:
    """From numbers back to ids."""
    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, at, _, own in _received(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(own))), pa.array(own)], ["number", "rep"])

    names = points.mapInArrow(ids, "number bigint, rep bigint")
    for column in ("src", "dst"):
        near = near.join(names.select(F.col("number").alias(column), F.col("rep").alias(f"{column}_rep")), column)
    return near.select(F.col("src_rep").alias("src"), F.col("dst_rep").alias("dst"), "rank", "dist")


def approximate_knn(
    emb: DataFrame,
    k: int = 15,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    spare: int = SPARE,
    window: int = WINDOW,
    orders: int = ORDERS,
    update_rate: float = UPDATE_RATE,
    seed: int = 42,
    found: float = FOUND,
) -> DataFrame:
    """``src, dst, rank, dist``: nearly the ``k`` nearest other rows by Euclidean distance.

    Distances are exact, ties go to the smaller id, and every list is full if there are
    rows enough. Copies are merged first and expanded at the end, so a row of a vector
    with many copies gets copies first, at distance zero, as in the exact graph. Longer lists (``spare``) and
    more ``orders`` find more; README has measured shares. Rounds end when fewer than
    ``update_rate`` of the edges change; while a sample's lists then hold less than ``found`` of its
    neighbours, lists are made twice as long and more rounds follow.
    """
    rows, merged = _distinct_vectors(emb, id_col, vec_col, k)
    merged = materialise(merged, "descent-vectors")
    n = merged.count()
    if n < 2:
        empty = emb.sparkSession.createDataFrame([], "src bigint, dst bigint, rank int, dist double")
        return _expand_copies(rows, merged, empty, k) if n else empty
    points = materialise(_numbered(merged.select("rep", "vec")), "descent-points")
    mean = _mean(points)
    few = min(k, n - 1)
    drawn = np.sort(np.random.default_rng(seed + 1).permutation(n)[:SAMPLE])
    sample = _sample(points, few, drawn)
    cores = emb.sparkSession.sparkContext.defaultParallelism
    length, shorter = min(k + spare, n - 1), None
    while True:
        shard_rows = _shard_rows(n, SHARD_BYTES / (4 * len(mean)), 2 * length, 2 * cores)
        tasks = -(-n // shard_rows)
        placed = _in_shards(points, shard_rows)
        if shorter is None:
            edges = _first_edges(points, mean, n, length, max(window, 2 * length), orders, seed, shard_rows)
        else:
            edges = _as_edges(lists, shorter, shard_rows)
        marks = np.sort(np.random.default_rng(seed).permutation(n)[: length + 1])
        lists = _lists(placed, edges, length, shard_rows, tasks, (_few(points, marks), marks), shorter is not None)
        looks = [look for look in EARLY_LOOKS if length < n - 1]
        turn, rate = 0, 1.0
        while rate > update_rate:
            # Longer lists fill for two rounds.
            turn, filling = turn + 1, shorter is not None and turn < 2
            members = _members(lists, length, shard_rows, tasks)
            given = _given(placed, _kind(lists, BOUNDS), _kind(members, ASK), tasks)
            better = _compared(_kind(members, MEMBERS), given, length, shard_rows, tasks)
            lists = _lists(_kind(lists, LISTS), better, length, shard_rows, tasks, half_full=filling)
            rate = _kind(lists, FRESH).agg(F.sum("at")).first()[0] / (n * length)
            if shorter is not None and turn < 3:
                rate = max(rate, 2 * update_rate)
            if looks and update_rate < rate < looks[0][0]:
                # Lists far too short are not brought to rest first.
                share = _share(lists, length, few, drawn, sample)
                if share < found - looks.pop(0)[1]:
                    break
        if length == n - 1 or rate <= update_rate and _share(lists, length, few, drawn, sample) >= found:
            break
        shorter, length = length, min(2 * length, n - 1)
    if merged.agg(F.count_distinct("rep")).first()[0] == n:
        near = _with_ids(_listed(lists, length, few), points)
    else:
        # Several vectors of an id share one list.
        near = _with_ids(_listed(lists, length, length), points).filter("src != dst").groupBy("src", "dst").agg(F.min("dist").alias("dist"))
        rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
        near = near.withColumn("rank", rank).filter(F.col("rank") <= k).select("src", "dst", "rank", "dist")
    if merged.filter(F.size("members") > 1).isEmpty():
        return near
    return _expand_copies(rows, merged, near, k)


def recall(graph: DataFrame, exact: DataFrame) -> DataFrame:
    """``edges, found``: edges of the exact graph, and how many of them the other has, or one as short in its place."""
    last = exact.groupBy("src").agg(F.max("dist").alias("last"), F.count(F.lit(1)).alias("edges"))
    near = graph.join(last, "src").filter(F.col("dist") <= F.col("last") + 1e-9)
    found = near.agg(F.count(F.lit(1)).alias("found"))
    return last.agg(F.sum("edges").alias("edges")).join(F.broadcast(found))  # one row each
