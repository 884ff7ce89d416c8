"""Nearest-neighbour graph over vectors.

Exact by default. Vectors are assigned to the nearest of a few pivots; cells are
cut into blocks of bounded size. A first pass inside each block bounds the
distance to the k-th neighbour; the triangle inequality then tells which other
blocks can still hold a nearer one, and a vector is compared with those only. Blocks
stand on a few shelves of bounded size, and a vector travels once to a shelf, with a
mark for each of its blocks to look into. With ``probes`` it looks into the nearest
cells instead, which bounds the work and makes the graph approximate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.embedding import as_matrix
from marginalia.operators.relational import first_n
from marginalia.session import materialise

# Pivots grow with the square root of the vectors beyond this many.
FEW_PIVOTS = 1024
MAX_VISIT_TASKS = 20_000
SHELVES = 8  # while they are below the size that follows; beyond, there are more
SHELF_BYTES = 128 << 20  # of vectors that a task holds
MOST_HITS = 8192  # pairs of a first look, before they are measured
_SLACK = 1e-6  # rounding allowance of the pruning bounds


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def _nearest(queries: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int, bound=None):
    """Ids and distances of up to ``k`` nearest base rows per query, as rows of
    ``(query index, id, distance)`` arrays; ``bound`` drops what cannot matter."""
    d = _squared(queries, base)
    k = min(k, base.shape[0])
    near = np.argpartition(d, k - 1, axis=1)[:, :k] if k < base.shape[0] else np.tile(
        np.arange(base.shape[0]), (queries.shape[0], 1)
    )
    # The product form loses digits for near copies: measure the chosen few again.
    exact = np.sqrt(((queries[:, None, :] - base[near]) ** 2).sum(2))
    rows = np.repeat(np.arange(queries.shape[0]), k)
    ids, dist = base_ids[near].reshape(-1), exact.reshape(-1)
    if bound is not None:
        keep = dist <= bound[rows] + _SLACK
        rows, ids, dist = rows[keep], ids[keep], dist[keep]
    return rows, ids, dist


def _pivots(vectors: DataFrame, count: int) -> np.ndarray:
    """``count`` distinct vectors drawn by hash, which reach the driver."""
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(count).select("vec").collect()
    return np.array([r.vec for r in rows], dtype=np.float64)


def _assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Nearest pivot and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            d = _squared(as_matrix(batch["vec"]), pivots)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["rep"],
                    batch["vec"],
                    pa.array(cell.astype(np.int32)),
                    pa.array(np.sqrt(d[np.arange(len(cell)), cell])),
                ],
                names=["rep", "vec", "cell", "radius"],
            )

    return vectors.mapInArrow(run, "rep bigint, vec array<float>, cell int, radius double")


def _block_of(cell_blocks: list[int]) -> F.Column:
    """Block number: cells are cut by hash into the given number of blocks."""
    first = np.concatenate([[0], np.cumsum(cell_blocks)[:-1]])
    sizes = F.array(*[F.lit(int(b)) for b in cell_blocks])
    starts = F.array(*[F.lit(int(s)) for s in first])
    at = F.col("cell") + 1
    cut = F.pmod(F.xxhash64("rep"), F.element_at(sizes, at).cast("bigint"))
    return (F.element_at(starts, at) + cut).cast("int")


def _local_pass(points: DataFrame, k: int, tasks: int) -> DataFrame:
    """Nearest neighbours inside each block: ``src, dst, dist``.

    Block rows arrive together and a block has a bounded number of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in _by_block(batches):
            for at in range(0, len(ids), 1024):
                part = matrix[at : at + 1024]
                rows, dst, dist = _nearest(part, matrix, ids, k + 1)
                src = ids[at : at + 1024][rows]
                other = src != dst
                yield _candidates(src[other], dst[other], dist[other])

    return (
        points.repartition(tasks, "block")
        .sortWithinPartitions("block")
        .select("block", "rep", "vec")
        .mapInArrow(run, "src bigint, dst bigint, dist double")
    )


def _candidates(src: np.ndarray, dst: np.ndarray, dist: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(src), pa.array(dst), pa.array(dist)], names=["src", "dst", "dist"]
    )


def _by_block(batches: Iterator[pa.RecordBatch]):
    """Whole blocks out of a sorted stream of batches."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        blocks = batch["block"].to_numpy()
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(blocks)]):
            if hi <= lo:
                continue
            if current is not None and blocks[lo] != current:
                yield _block_arrays(held)
                held = []
            current = blocks[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield _block_arrays(held)


def _block_arrays(parts: list[pa.RecordBatch]):
    ids = np.concatenate([p["rep"].to_numpy() for p in parts])
    return ids, np.concatenate([as_matrix(p["vec"]) for p in parts])


def _near_order(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order that keeps near ones together: halved again and again across the widest dimension."""
    def halved(at: np.ndarray) -> Iterator[np.ndarray]:
        if len(at) < 2:
            yield at
            return
        part = pivots[at]
        by = at[np.argsort(part[:, (part.max(0) - part.min(0)).argmax()], kind="stable")]
        yield from halved(by[: len(by) // 2])
        yield from halved(by[len(by) // 2 :])

    return np.concatenate([*halved(np.arange(len(pivots)))])


def _shelved(pivots: np.ndarray, cell_blocks: list[int], cell_rows: list[int], shelf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shelf of each block, and its slot there; near cells share a shelf of about ``shelf_rows``."""
    blocks = np.array(cell_blocks)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype(int)
    shelf, slot = np.zeros(blocks.sum(), int), np.zeros(blocks.sum(), int)
    at, filled, placed = 0, 0.0, 0
    for cell in _near_order(pivots):
        for block in range(first[cell], first[cell] + blocks[cell]):
            rows = cell_rows[cell] / blocks[cell]
            if placed and filled + rows > shelf_rows:
                at, filled, placed = at + 1, 0.0, 0
            shelf[block], slot[block] = at, placed
            filled, placed = filled + rows, placed + 1
    return shelf, slot


def _route(
    points: DataFrame,
    pivots: np.ndarray,
    cell_blocks: list[int],
    cell_radius: np.ndarray,
    cell_inner: np.ndarray,
    shelf: np.ndarray,
    slot: np.ndarray,
    probes: int | None,
) -> DataFrame:
    """Where each vector still has to look: ``shelf, rep, vec, bound, marks``, a bit per slot of the shelf.

    ``points`` carries ``bound``, the distance to its k-th neighbour so far
    (infinite if it has fewer).
    """
    sizes = np.array(cell_blocks)
    shelves, width = int(shelf.max()) + 1, int(slot.max()) // 8 + 1
    place = shelf * (8 * width) + slot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                own_cell, own_block = batch["cell"].to_numpy(), batch["block"].to_numpy()
                d = np.sqrt(_squared(as_matrix(batch["vec"]), pivots))
                every = np.arange(len(own_cell))
                own = d[every, own_cell]
                if probes is None:
                    # Ball of the cell, ring of the cell, and the plane half way
                    # between the two pivots.
                    cells, cell_at = np.unique(own_cell, return_inverse=True)
                    gaps = np.sqrt(_squared(pivots[cells], pivots))
                    plane = (d**2 - own[:, None] ** 2) / (2.0 * np.maximum(gaps[cell_at], 1e-300))
                    plane[every, own_cell] = 0.0
                    lower = np.maximum.reduce([d - cell_radius, cell_inner - d, plane])
                    visit = lower <= batch["bound"].to_numpy()[:, None] + _SLACK
                else:
                    order = np.argsort(d, axis=1)[:, :probes]
                    visit = np.zeros(d.shape, dtype=bool)
                    np.put_along_axis(visit, order, True, axis=1)
                blocks = np.repeat(visit, sizes, axis=1)
                blocks[every, own_block] = False
                marks = np.zeros((len(every), shelves * 8 * width), dtype=bool)
                marks[:, place] = blocks
                packed = np.packbits(marks.reshape(len(every), shelves, 8 * width), axis=2)
                rows, to = np.nonzero(packed.any(axis=2))
                take = pa.array(rows)
                ends = np.arange(len(rows) + 1, dtype=np.int32) * width
                bits = pa.Array.from_buffers(
                    pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(packed[rows, to].tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.astype(np.int32)), batch["rep"].take(take), batch["vec"].take(take), batch["bound"].take(take), bits],
                    names=["shelf", "rep", "vec", "bound", "marks"],
                )

    return points.select("cell", "block", "rep", "vec", "bound").mapInArrow(
        run, "shelf int, rep bigint, vec array<float>, bound double, marks binary"
    )


def _scaled(vec: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray]:
    """In single precision for a first look: vectors below 1 about their mean, their scale, what may be lost of a squared distance, the mean."""
    sound = np.isfinite(vec).all(1)
    sound = vec if sound.all() else vec[sound]
    if not len(sound):
        return np.zeros(vec.shape, np.float32), 1.0, 0.0, np.zeros(vec.shape[1])
    mid = sound.mean(0, dtype=np.float64)
    scale = max(float((sound.max(0) - mid).max()), float((mid - sound.min(0)).max()), 1e-300)
    flat = np.empty(vec.shape, np.float32)
    for at in range(0, len(vec), 4096):
        flat[at : at + 4096] = (vec[at : at + 4096] - mid) / scale
    squares = (flat * flat).sum(1)
    slack = 4 * np.finfo(np.float32).eps * (vec.shape[1] + 4) * float(squares[np.isfinite(squares)].max(initial=0.0))
    return flat, scale, slack, mid


def _halves(flat: np.ndarray) -> np.ndarray:
    """With half the squares as one more column: a product with ``(x, 1)`` is below half the square of x by half the squared distance."""
    return np.concatenate([flat, -0.5 * (flat * flat).sum(1, keepdims=True)], axis=1)


def _measured(a: np.ndarray, left: np.ndarray, b: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, in double precision."""
    out = np.empty(len(left))
    for at in range(0, len(left), 8192):
        some = slice(at, at + 8192)
        out[some] = np.sqrt(((a[left[some]].astype(np.float64) - b[right[some]]) ** 2).sum(1))
    return out


def _on_shelf(guests: np.ndarray, bound: np.ndarray, wanted: np.ndarray, matrix: np.ndarray, halves: tuple, ids: np.ndarray, slots: np.ndarray, k: int):
    """The ``k`` nearest rows of each guest in the slots it wants, as ``(guest index, id, distance)`` arrays.

    A look in single precision, with room for what that loses, leaves a few rows to measure.
    What is found in some slots narrows the search in the next.
    """
    base, scale, slack, mid = halves
    n = len(guests)
    best, who = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
    bound = bound.copy()
    flat = ((guests - mid) / scale).astype(np.float32)
    squares = (flat.astype(np.float64) ** 2).sum(1)
    flat = np.concatenate([flat, np.ones((n, 1), np.float32)], axis=1)
    room = slack + 4 * np.finfo(np.float32).eps * (flat.shape[1] + 3) * squares
    held, size = [], 0

    def narrow() -> None:
        rows, columns = (np.concatenate(x) for x in zip(*held))
        held.clear()
        dist = _measured(guests, rows, matrix, columns)
        near = dist <= bound[rows] + _SLACK
        rows, dst, dist = rows[near], ids[columns[near]], dist[near]
        hit = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(hit, k)])
        dst, dist = np.concatenate([dst, who[hit].reshape(-1)]), np.concatenate([dist, best[hit].reshape(-1)])
        by = np.lexsort((dst, dist, rows))
        at = np.arange(len(by))
        rows = rows[by]
        place = at - np.maximum.accumulate(np.where(np.diff(rows, prepend=-1) != 0, at, 0))
        some = place < k
        best[rows[some], place[some]], who[rows[some], place[some]] = dist[by[some]], dst[by[some]]
        bound[hit] = np.minimum(bound[hit], best[hit, -1])

    cuts = np.flatnonzero(np.diff(slots, prepend=-1, append=-1))
    least = None
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        rows = np.flatnonzero(wanted[:, slots[lo]])
        if not len(rows):
            continue
        if least is None:
            least = ((squares - ((bound + _SLACK) / scale) ** 2 * (1 + 1e-6) - room) / 2).astype(np.float32)
        every = len(rows) == n
        product = (flat if every else flat[rows]) @ base[lo:hi].T
        at, column = np.divmod(np.flatnonzero(product >= (least if every else least[rows])[:, None]), hi - lo)
        if len(at):
            held.append((rows[at], column + lo))
            size += len(at)
        if size > MOST_HITS:
            narrow()
            size, least = 0, None
    if held:
        narrow()
    at, column = np.nonzero(best <= bound[:, None] + _SLACK)
    found = np.isfinite(best[at, column])
    at, column = at[found], column[found]
    return at, who[at, column], best[at, column]


def _visit_pass(points: DataFrame, visits: DataFrame, shelf: np.ndarray, slot: np.ndarray, k: int, chunk_rows: int, tasks: int) -> DataFrame:
    """Neighbours on the visited shelves: ``src, dst, dist``.

    Each shelf's vectors come first, then the visitors stream past them, so a
    task holds one shelf and one batch. The visitors of a shelf are cut into
    chunks of about ``chunk_rows``, and the shelf is sent to each; a shelf that
    nobody visits is not sent at all.
    """
    visits = materialise(visits, "knn-visits")
    chunked = materialise(
        visits.groupBy("shelf").agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("chunks")), "knn-chunks"
    )
    total = chunked.agg(F.sum("chunks")).first()[0] or 0
    tasks = max(tasks, min(total, MAX_VISIT_TASKS))
    visitor = int(slot.max()) + 1  # a slot after all of the shelf
    of_block = lambda numbers: F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col("block") + 1)
    base = points.withColumns({"shelf": of_block(shelf), "slot": of_block(slot)}).join(F.broadcast(chunked), "shelf").select(
        "shelf",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        "slot",
        "rep",
        "vec",
        F.lit(None).cast("double").alias("bound"),
        F.lit(None).cast("binary").alias("marks"),
    )
    guests = visits.join(F.broadcast(chunked), "shelf").select(
        "shelf",
        F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"),
        F.lit(visitor).alias("slot"),
        "rep",
        "vec",
        "bound",
        "marks",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, matrix = None, [], None
        for batch in batches:
            marks = np.stack([batch["shelf"].to_numpy(), batch["chunk"].to_numpy(), batch["slot"].to_numpy() == visitor], axis=1)
            cuts = np.flatnonzero((np.diff(marks, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(marks)]):
                if hi <= lo:
                    continue
                part = batch.slice(lo, hi - lo)
                if tuple(marks[lo, :2]) != key:
                    key, held, matrix = tuple(marks[lo, :2]), [], None
                if not marks[lo, 2]:
                    held.append((part["rep"].to_numpy(), part["slot"].to_numpy(), as_matrix(part["vec"], np.float32)))
                    continue
                if matrix is None:
                    base_ids, slots, matrix = (np.concatenate(x) for x in zip(*held))
                    held = []
                    flat, *scale = _scaled(matrix)
                    halves = _halves(flat), *scale
                guests_m, guest_ids, bound = as_matrix(part["vec"], np.float32), part["rep"].to_numpy(), part["bound"].to_numpy()
                bits = np.frombuffer(b"".join(part["marks"].to_pylist()), np.uint8).reshape(len(guest_ids), -1)
                for at in range(0, len(guest_ids), 1024):
                    some = slice(at, at + 1024)
                    wanted = np.unpackbits(bits[some], axis=1).astype(bool)
                    rows, dst, dist = _on_shelf(guests_m[some], bound[some], wanted, matrix, halves, base_ids, slots, k)
                    yield _candidates(guest_ids[some][rows], dst, dist)

    return (
        base.unionByName(guests)
        .repartition(tasks, "shelf", "chunk")
        .sortWithinPartitions("shelf", "chunk", "slot")
        .mapInArrow(run, "src bigint, dst bigint, dist double")
    )


def _nearest_k(candidates: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest per source, ranked; cut per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    return candidates.withColumn("rank", rank).filter(F.col("rank") <= k)


def _distinct_vectors(emb: DataFrame, id_col: str, vec_col: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Copies merged: one row per vector with its smallest ids, and the vector of each id.

    ``members`` holds the ``k + 1`` smallest ids, all that a neighbour list of
    ``k`` can use.
    """
    vec = F.col(vec_col).cast("array<float>")
    rows = emb.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec"))
    # The hash goes first in every key, so vectors are seldom compared.
    rows = rows.withColumn("hash", F.xxhash64("vec"))
    few = first_n(rows, ["hash", "vec"], ["id"], k + 1)
    merged = few.groupBy("hash", "vec").agg(
        F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("members")
    )
    return rows, merged


def knn_graph(
    emb: DataFrame,
    k: int = 15,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    cell_rows: int = 512,
    block_rows: int = 8192,
    probes: int | None = None,
) -> DataFrame:
    """``src, dst, rank, dist``: the ``k`` nearest other rows by Euclidean distance.

    Ties go to the smaller id. A row of a vector with many copies gets copies
    first, at distance zero. ``probes=None`` is exact. With ``probes``, a vector
    whose nearest cells hold fewer than ``k`` others searches all cells, so every
    list is full.
    """
    rows, merged = _distinct_vectors(emb, id_col, vec_col, k)
    merged = materialise(merged, "knn-vectors")
    n = merged.count()
    spark = emb.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block_rows))
    pivots = _pivots(merged, int(min(max(FEW_PIVOTS, n**0.5), max(1, n // cell_rows))))
    if n == 0:
        return spark.createDataFrame([], "src bigint, dst bigint, rank int, dist double")

    assigned = _assign(merged.select("rep", "vec"), pivots)
    # One row per pivot.
    stats = {
        r.cell: r
        for r in assigned.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("hi"), F.min("radius").alias("lo"))
        .collect()
    }
    cells = range(len(pivots))
    cell_blocks = [-(-stats[c].n // block_rows) if c in stats else 0 for c in cells]
    radius = np.array([stats[c].hi if c in stats else 0.0 for c in cells])
    inner = np.array([stats[c].lo if c in stats else 0.0 for c in cells])
    points = materialise(assigned.withColumn("block", _block_of(cell_blocks)), "knn-points")

    near = _nearest_k(_local_pass(points, k, tasks), k)
    if sum(cell_blocks) > 1:
        near = materialise(near, "knn-local")
        # The bound holds only for a full list; a shorter one leaves it open.
        bound = near.filter(F.col("rank") == k).select("src", F.col("dist").alias("bound"))
        bounded = points.join(bound, points["rep"] == bound["src"], "left").withColumn(
            "bound", F.coalesce("bound", F.lit(float("inf")))
        )
        most_rows = max(SHELF_BYTES // (8 * pivots.shape[1]), 1)
        shelf_rows = min(max(block_rows, -(-n // SHELVES)), most_rows)
        shelf, slot = _shelved(pivots, cell_blocks, [stats[c].n if c in stats else 0 for c in cells], shelf_rows)
        visits = _route(bounded, pivots, cell_blocks, radius, inner, shelf, slot, probes)
        far = _visit_pass(points, visits, shelf, slot, k, shelf_rows, tasks)
        near = _nearest_k(near.drop("rank").unionByName(far), k)
        if probes is not None:
            near = materialise(near, "knn-probed")
            full = near.filter(F.col("rank") == min(k, n - 1)).select(F.col("src").alias("rep"))
            short = bounded.join(full, "rep", "left_anti")
            visits = _route(short, pivots, cell_blocks, radius, inner, shelf, slot, None)
            far = _visit_pass(points, visits, shelf, slot, k, shelf_rows, tasks)
            near = _nearest_k(near.drop("rank").unionByName(far).distinct(), k)
    near = near.select("src", "dst", "rank", "dist")
    if merged.filter(F.size("members") > 1).isEmpty():
        return near
    return _expand_copies(rows, merged, near, k)


def _expand_copies(rows: DataFrame, merged: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """From distinct vectors back to rows.

    A list of ``k + 1`` (distance, id) pairs per distinct vector serves all its
    copies: each leaves itself out.
    """
    members = merged.select(F.col("rep").alias("dst"), "members")
    pair = lambda d: F.transform("members", lambda m: F.struct(d.alias("dist"), m.alias("dst")))
    others = (
        near.join(members, "dst")
        .select("src", pair(F.col("dist")).alias("pairs"))
        .groupBy("src")
        .agg(F.flatten(F.collect_list("pairs")).alias("pairs"))
    )
    lists = merged.join(others, merged["rep"] == others["src"], "left").select(
        "hash",
        "vec",
        F.slice(
            F.sort_array(
                F.concat(
                    pair(F.lit(0.0)),
                    F.coalesce("pairs", F.array().cast("array<struct<dist:double,dst:bigint>>")),
                )
            ),
            1,
            k + 1,
        ).alias("pairs"),
    )
    # A vector with very many copies makes one large key on the left only; the
    # adaptive skew join splits it.
    own = rows.join(lists, ["hash", "vec"])
    picked = own.select(
        F.col("id").alias("src"),
        F.posexplode(F.slice(F.filter("pairs", lambda p: p["dst"] != F.col("id")), 1, k)).alias(
            "pos", "p"
        ),
    )
    return picked.select(
        "src", F.col("p.dst").alias("dst"), (F.col("pos") + 1).alias("rank"), F.col("p.dist").alias("dist")
    )
