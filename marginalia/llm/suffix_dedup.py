"""Repeated passages of bytes, found by suffix arrays of shards.

A window is ``length`` bytes; it is repeated if the same bytes start anywhere else.
Equal windows choose equal anchors (the q-gram of least hash in them), so only
texts around anchors that occur twice can hold a repeat. Those parts are gathered
by anchor into shards; each shard gets a suffix array, refined by doubling as
Larsson and Sadakane do, and common prefixes as Kasai does. Groups too large for a
shard are cut, and what the cuts have in common is found by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import documents, large, real_id
from marginalia.session import materialise

Q = 64  # bytes of an anchor
CHUNK = 1 << 20  # window starts that are handled at a time
PLACE = np.uint64((1 << 21) - 1)
SHARD = 1_500_000  # bytes of a shard
CUT = 2_000  # occurrences of an anchor that go to one shard


@cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number per byte value, and the powers of ``base`` and of its inverse, modulo 2^64."""
    n = CHUNK + 8192
    table = np.random.default_rng(base % 1_000_003).integers(0, 2**64, 256, np.uint64)
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return table, np.cumprod(up), np.cumprod(down)


def _hashes(data: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes, equal for equal bytes."""
    table, up, down = _powers(base)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=sums[1:])
    n = len(data) - width + 1
    h = (sums[width:] - sums[:n]) * down[:n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: running minima of blocks, from both sides."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, start, end)``: windows that start in ``start:end`` have the same anchor, of that hash."""
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(data) - length + 1, CHUNK):
        part = data[at : at + CHUNK + length - 1]
        h = _hashes(part, q)
        key = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)  # of equal ones the leftmost
        place = (_sliding_least(key, length - q + 1) & PLACE).astype(np.int64)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        ends = np.append(starts[1:], len(place))
        found.append((h[place[starts]].view(np.int64), starts + at, ends + at))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions by their first ``depth`` symbols at least, and the rank of each position.

    Symbols are below 512. The first order is by 7 symbols; then only groups that
    are not yet told apart are refined, by the rank of what follows, at doubled
    distances.
    """
    n, known = len(symbols), 7
    padded = np.zeros(n + known, np.int64)
    padded[:n] = symbols
    key = np.zeros(n, np.int64)
    for k in range(known):
        key = (key << 9) | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    group = np.repeat(first, np.diff(first, append=n))
    rank = np.empty(n + 1, np.int64)
    rank[n], rank[order] = -1, group
    slots = np.flatnonzero(np.repeat(np.diff(first, append=n) > 1, np.diff(first, append=n)))
    while known < depth and len(slots):
        at = order[slots]
        key = rank[at] * (n + 1) + rank[np.minimum(at + known, n)] + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        first = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(first, append=len(key))
        rank[at] = np.repeat(slots[first], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        known *= 2
    final = np.empty(n, np.int64)
    final[order] = np.arange(n)
    return order, final


def common_prefixes(
    symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, pieces: np.ndarray, sizes: np.ndarray, most: int
) -> np.ndarray:
    """Common prefix, up to ``most``, of each rank with the one before it, for the first ``sizes`` places of each piece.

    Kasai's rule, for all pieces in step: one place further on, at most one symbol of
    the known prefix is lost. Seven symbols are compared at a time, then single ones.
    """
    n = len(order)
    out = np.zeros(n + 1, np.int64)
    padded = np.zeros(n + most + 16, np.int64)
    padded[:n] = symbols
    seven = np.zeros(n + most + 8, np.int64)
    for k in range(7):
        seven = (seven << 9) | padded[k : k + len(seven)]
    by = np.argsort(-sizes, kind="stable")
    pieces, sizes = pieces[by], sizes[by]
    have, from_ = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    for step in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -step, side="left"))  # longer pieces come first
        at = pieces[:live] + step
        r = rank[at]
        # The old neighbour's next place must still come before; ties beyond the depth have no order.
        carried = (have[:live] > 1) & (rank[np.minimum(from_[:live] + 1, n - 1)] < r)
        h = np.where(carried, have[:live] - 1, 0)
        before = order[np.maximum(r - 1, 0)]
        for width, table in ((7, seven), (1, padded)):
            going = np.flatnonzero((h < most) & (r > 0))
            while len(going):
                going = going[table[at[going] + h[going]] == table[before[going] + h[going]]]
                h[going] += width
                going = going[h[going] < most]
        h = np.minimum(h, most)
        out[r], have[:live], from_[:live] = h, h, before
    return out


def _runs(mask: np.ndarray) -> np.ndarray:
    """Starts and ends, in turn, of the stretches that are true."""
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edges.astype(np.int32)


def _mark(length: int, q: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shas, found, counts = [], [], [], []
            for value in batch.column(2):
                raw = value.as_py().encode()
                hashes, n = np.unique(anchors(np.frombuffer(raw, np.uint8), length, q)[0], return_counts=True)
                sizes.append(len(raw))
                shas.append(hashlib.sha256(raw).hexdigest())
                found.append(hashes)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(shas),
                 pa.array(found, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                ["doc_id", "version", "n_bytes", "sha", "anchors", "counts"],
            )

    return mark


_PART_SCHEMA = "anchor bigint, piece int, part binary, doc_id bigint, version bigint, starts array<bigint>, n bigint, bytes binary"


def _parts(length: int, q: int):
    """Texts around repeated anchors; equal bytes travel once per batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent: set[bytes] = set()
            for doc_id, version, text, repeated in zip(
                *(batch.column(k).to_pylist() for k in range(4)), strict=True
            ):
                raw = text.encode()
                pieces = {r["anchor"]: r["pieces"] for r in repeated}
                rows: dict[bytes, list] = {}
                for h, s, e in zip(*(x.tolist() for x in anchors(np.frombuffer(raw, np.uint8), length, q)), strict=True):
                    if h in pieces:
                        part = raw[s : e + length - 1]
                        key = xxhash.xxh3_128_digest(part, seed=h & 0xFFFFFFFF)
                        if key in rows:
                            rows[key][5].append(s)
                        else:
                            new = key not in sent
                            sent.add(key)
                            piece = int.from_bytes(key[:4], "little") % pieces[h]
                            rows[key] = [h, piece, key, doc_id, version, [s], e - s, part if new else None]
                if rows:
                    columns = zip(*rows.values(), strict=True)
                    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                        ["anchor", "piece", "part", "doc_id", "version", "starts", "n", "bytes"],
                    )

    return cut


def _search(length: int):
    """Repeated windows of one shard, as runs of places in its parts."""

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        owned = shard["n"].to_numpy(np.int64)
        texts = shard["bytes"].tolist()
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        symbols = np.zeros(int(sum(len(t) + 1 for t in texts)), np.int64)
        for b, t in zip(begins, texts, strict=True):
            symbols[b : b + len(t)] = np.frombuffer(t, np.uint8)
            symbols[b : b + len(t)] += 1  # 0 ends a part
        order, rank = suffix_array(symbols, length)
        shared = common_prefixes(symbols, order, rank, begins, owned, length) >= length
        runs = []
        for b, n, copies in zip(begins, owned, shard["copies"], strict=True):
            r = rank[b : b + n]
            # with the place before, and with the one after
            repeated = np.ones(n, bool) if copies > 1 else shared[r] | shared[r + 1]
            runs.append(_runs(repeated))
        return pd.DataFrame({"anchor": shard["anchor"], "part": shard["part"], "runs": runs})

    return search


def _digests(length: int):
    """Sorted digests of the windows of one cut of a large group, by range."""

    def digest(cut: pd.DataFrame) -> pd.DataFrame:
        ranges = int(cut["pieces"].iloc[0])
        first, second, owner = [], [], []
        for k, t, n in zip(cut["k"], cut["bytes"], cut["n"], strict=True):
            data = np.frombuffer(t, np.uint8)
            first.append(_hashes(data, length)[:n])
            second.append(_hashes(data, length, 0xC2B2AE3D27D4EB4F)[:n])
            owner.append(np.stack([np.full(n, k), np.arange(n)], axis=1))
        a, b, own = np.concatenate(first), np.concatenate(second), np.concatenate(owner).astype(np.int32)
        which = ((a >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        rows = []
        for r in np.unique(which):
            mine = np.flatnonzero(which == r)
            mine = mine[np.lexsort((b[mine], a[mine]))]
            rows.append((cut["anchor"].iloc[0], int(r), int(cut["piece"].iloc[0]), a[mine].tobytes(), b[mine].tobytes(), own[mine].tobytes()))
        return pd.DataFrame(rows, columns=["anchor", "range", "piece", "a", "b", "own"])

    return digest


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """Windows that several cuts of a group have: each cut finds its own in the sorted shared ones by binary search."""
    a, b = (np.concatenate([np.frombuffer(x, np.uint64) for x in group[c]]) for c in "ab")
    own = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in group["own"]]
    piece = np.repeat(np.arange(len(own)), [len(x) for x in own])
    by = np.lexsort((b, a))
    same = (a[by][1:] == a[by][:-1]) & (b[by][1:] == b[by][:-1]) & (piece[by][1:] != piece[by][:-1])
    pairs = np.empty(int(same.sum()), [("a", np.uint64), ("b", np.uint64)])
    pairs["a"], pairs["b"] = a[by][1:][same], b[by][1:][same]
    shared = np.unique(pairs)
    rows = []
    for i, number in enumerate(group["piece"]):
        mine = np.empty(len(own[i]), shared.dtype)
        mine["a"], mine["b"] = a[piece == i], b[piece == i]
        spot = np.minimum(np.searchsorted(shared, mine), max(len(shared) - 1, 0))
        hit = own[i][shared[spot] == mine] if len(shared) else own[i][:0]
        for k in np.unique(hit[:, 0]):
            rows.append((group["anchor"].iloc[0], number, int(k), np.sort(hit[hit[:, 0] == k, 1])))
    return pd.DataFrame(rows, columns=["anchor", "piece", "k", "places"])


def _remove(length: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            kept = []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                for x in found:
                    starts, runs = np.array(x["starts"], np.int64), np.array(x["runs"], np.int64)
                    np.add.at(edge, (starts[:, None] + runs[None, ::2]).ravel(), 1)
                    np.add.at(edge, (starts[:, None] + runs[None, 1::2] + length - 1).ravel(), -1)
                gone = np.cumsum(edge)[:-1] > 0
                rest = data[~gone].tobytes()
                out[0].append(int(gone.sum()))
                out[1].append(len(_runs(gone)) // 2)
                out[2].append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                 pa.array(out[2]), pa.array(kept, pa.string())],
                ["doc_id", "version", "n_removed", "n_spans", "kept_sha", "kept"],
            )

    return remove


def remove_repeats(
    docs: DataFrame, length: int = 400, q: int = Q, shard_bytes: int = SHARD, cut: int = CUT
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, text`` of every row.

    Every byte (of the text in UTF-8) in a string of ``length`` bytes that also
    starts anywhere else, in the same text too, is removed; strings are judged on
    the input. ``text`` holds what is left, without the rest of a character of which
    some bytes are removed; ``kept_sha256`` is of all remaining bytes. ``n_spans`` counts the runs of
    removed bytes.

    Null and empty texts, and those shorter than ``length``, lose nothing. Rows
    repeated in full are copies of each other and lose all they can. An empty table
    gives an empty table; other columns are not read.

    Texts move once, and only those with an anchor that occurs twice go on. Equal
    parts are one entry. An anchor with more than ``cut`` occurrences is spread over
    several shards; windows of these are compared across by sorted 128-bit digests.
    """
    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("version"), "text")
    marks = materialise(
        rows.mapInArrow(
            _mark(length, q),
            "doc_id bigint, version bigint, n_bytes bigint, sha string, anchors array<bigint>, counts array<bigint>",
        ),
        "marks",
    )
    listed = marks.select("doc_id", "version", F.explode(F.arrays_zip("anchors", "counts")).alias("x")).select(
        "doc_id", "version", F.col("x.anchors").alias("anchor"), F.col("x.counts").alias("n")
    )
    repeated = materialise(
        listed.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
        .select("anchor", F.ceil(F.col("n") / cut).cast("int").alias("pieces")),
        "anchors",
    )
    wanted = materialise(
        listed.join(large(repeated.select("anchor", "pieces")), "anchor")
        .groupBy("doc_id", "version").agg(F.collect_set(F.struct("anchor", "pieces")).alias("repeated")),
        "wanted",
    )
    texts = materialise(rows.join(large(wanted), ["doc_id", "version"]), "texts")
    parts = materialise(
        texts.select("doc_id", "version", "text", "repeated").mapInArrow(_parts(length, q), _PART_SCHEMA), "parts"
    )
    entries = materialise(
        parts.groupBy("anchor", "piece", "part").agg(
            F.sum(F.size("starts")).alias("copies"), F.max("n").alias("n"), F.max("bytes").alias("bytes")
        ),
        "entries",
    )
    total = entries.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    shard = F.pmod(F.xxhash64("anchor", "piece"), F.lit(shards))
    inside = (
        entries.withColumn("shard", shard).groupBy("shard")
        .applyInPandas(_search(length), "anchor bigint, part binary, runs array<int>")
    )
    spread = materialise(
        entries.join(large(repeated.filter("pieces > 1")), "anchor")
        .withColumn("k", F.row_number().over(Window.partitionBy("anchor", "piece").orderBy("part")) - 1),
        "spread",
    )
    across = (
        spread.groupBy("anchor", "piece")
        .applyInPandas(_digests(length), "anchor bigint, range int, piece int, a binary, b binary, own binary")
        .groupBy("anchor", "range")
        .applyInPandas(_merge, "anchor bigint, piece int, k int, places array<int>")
    )
    places = across.groupBy("anchor", "piece", "k").agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    runs = F.flatten(F.transform("places", lambda p: F.array(p, p + 1)))
    found = materialise(
        inside.unionByName(
            spread.select("anchor", "piece", "k", "part").join(large(places), ["anchor", "piece", "k"])
            .select("anchor", "part", runs.alias("runs"))
        ).filter(F.size("runs") > 0),
        "runs",
    )
    hits = (
        parts.select("part", "anchor", "doc_id", "version", "starts").join(large(found), ["anchor", "part"])
        .groupBy("doc_id", "version").agg(F.collect_list(F.struct("starts", "runs")).alias("found"))
    )
    removed = (
        texts.select("doc_id", "version", "text").dropDuplicates(["doc_id", "version"])
        .join(large(hits), ["doc_id", "version"])
        .mapInArrow(
            _remove(length),
            "doc_id bigint, version bigint, n_removed bigint, n_spans bigint, kept_sha string, kept string",
        )
    )
    verdicts = marks.select("doc_id", "version", "n_bytes", "sha").dropDuplicates(["doc_id", "version"])
    verdicts = materialise(verdicts.join(large(removed), ["doc_id", "version"], "left"), "verdicts")
    return rows.join(large(verdicts), ["doc_id", "version"]).select(
        real_id("doc_id").alias("doc_id"),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("bigint").alias("n_spans"),
        F.coalesce("kept_sha", "sha").alias("kept_sha256"),
        F.coalesce("kept", "text").alias("text"),
    )
