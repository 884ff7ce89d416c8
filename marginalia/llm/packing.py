"""Packing: documents cut and put into windows by multiway differencing (Karmarkar-Karp)."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marginalia.llm.common import documents, real_id

WINDOW = 2048
PIECE = 256  # rests are cut to this size: several pieces to a window can be balanced
SPARE = 16  # tokens that a window is planned below its size
GROUP = 96  # windows that are balanced together


def differencing(sizes: list[int], bins: int) -> list[list[int]]:
    """Items of each bin, the bins' sums as near to each other as differencing brings them.

    Each partial partition is ``bins`` sums, largest first. The two with the widest
    spread are merged, the largest sums of one with the smallest of the other.
    """
    follows = np.full(len(sizes), -1)

    def alone(i: int, size: int) -> tuple:
        sums, first = np.zeros(bins, np.int64), np.full(bins, -1)
        sums[0], first[0] = size, i
        return -size, i, sums, first, first.copy()

    heap = [alone(i, s) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, sums, first, last = heapq.heappop(heap)
        _, _, other, other_first, other_last = heapq.heappop(heap)
        other_first, other_last = other_first[::-1], other_last[::-1]
        both = (first >= 0) & (other_first >= 0)
        follows[last[both]] = other_first[both]
        sums = sums + other[::-1]
        first, last = np.where(first >= 0, first, other_first), np.where(other_last >= 0, other_last, last)
        order = np.argsort(-sums, kind="stable")
        sums, first, last = sums[order], first[order], last[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, first, last))
    out = []
    for i in heap[0][3] if heap else ():
        items = []
        while i >= 0:
            items.append(int(i))
            i = follows[i]
        out.append(items)
    return out


def windows(sizes: list[int], size: int = WINDOW) -> list[list[int]]:
    """Items of each window; as few windows as differencing fits into ``size``."""
    bins = max(1, -(-sum(sizes) // size))
    while True:
        found = differencing(sizes, bins)
        if all(sum(sizes[i] for i in items) <= size for items in found):
            return [items for items in found if items]
        bins += 1


@cache
def byte_encoder(path: str, pattern: str, special: str, special_id: int) -> tiktoken.Encoding:
    """One per worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: special_id})


class _Packer:
    """Pieces of one task; whole windows leave at once, rests wait for their group."""

    def __init__(self, size: int, sequence: int):
        self._size, self._sequence = size, sequence
        self._waiting: list[tuple[int, int, int, np.ndarray]] = []  # document, start, document's tokens, ids
        self._held = 0
        self.rows: list[tuple] = []

    def _put(self, pieces: list[tuple[int, int, int, np.ndarray]]) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, self._sequence, offset))
            offset += len(ids)
        self._sequence += 1

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        whole = len(ids) // self._size * self._size
        for start in range(0, whole, self._size):
            self._put([(doc_id, start, len(ids), ids[start : start + self._size])])
        for start in range(whole, len(ids), PIECE):
            self._waiting.append((doc_id, start, len(ids), ids[start : start + PIECE]))
        self._held += len(ids) - whole
        if self._held >= GROUP * self._size:
            self._balance(GROUP)

    def _take(self, tokens: int) -> list:
        """The first pieces with as many tokens, the last one cut."""
        out = []
        while tokens:
            doc_id, start, total, ids = self._waiting[len(out)]
            out.append((doc_id, start, total, ids[:tokens]))
            tokens -= len(out[-1][3])
        cut = self._waiting[len(out) - 1]
        rest = [(cut[0], cut[1] + len(out[-1][3]), cut[2], cut[3][len(out[-1][3]) :])]
        self._waiting[: len(out)] = [r for r in rest if len(r[3])]
        self._held -= sum(len(x[3]) for x in out)
        return out

    def _balance(self, count: int) -> None:
        pieces = self._take(count * (self._size - SPARE))
        for items in windows([len(p[3]) for p in pieces], self._size):
            self._put([pieces[i] for i in items])

    def finish(self) -> None:
        """Balances what is left; what does not fill a window makes sequences of powers of two."""
        if count := self._held // (self._size - SPARE):
            self._balance(count)
        while self._held:
            self._put(self._take(1 << (self._held.bit_length() - 1)))


_SCHEMA = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


def _pack(path: str, pattern: str, special: tuple[str, int], end_id: int, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(path, pattern, *special)
        packer = _Packer(size, TaskContext.get().partitionId() << 40)
        rows = lambda: pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (zip(*packer.rows, strict=True) if packer.rows else [[]] * 7)], schema=_SCHEMA
        )
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                ids = encoder.encode(text, allowed_special="all") if special[0] in text else encoder.encode_ordinary(text)
                packer.add(doc_id, np.array([*ids, end_id], np.uint32))
            yield rows()
            packer.rows.clear()
        packer.finish()
        yield rows()

    return pack


def packed(
    docs: DataFrame, ranks_path: str, pattern: str, special: tuple[str, int], end_id: int = 1, size: int = WINDOW
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: a document
    is its ids and ``end_id``; ``start`` counts its ids before the piece, and
    ``offset`` is the piece's place in its sequence. Ids come from a rank file and
    its splitting ``pattern``; the string ``special`` is one token.

    Documents are cut freely: whole windows leave at once, and the rests of a task
    are balanced in groups of ``GROUP`` windows by differencing; if a window is
    over ``size``, the group is balanced again with one more. What a task has left
    in the end makes sequences of powers of two, which need no padding.

    Null and empty texts are one token. Repeated rows are packed as often as they
    occur; a row without an id has pieces without id. An empty table gives an empty
    table; other columns are not read. No shuffle: a task holds the tokens of one
    group and one document, and its sequences are numbered within the task.
    """
    schema = ", ".join(f"`{f.name}` bigint" for f in _SCHEMA)
    rows = documents(docs).mapInArrow(_pack(ranks_path, pattern, special, end_id, size), schema)
    return rows.withColumn("doc_id", real_id("doc_id"))
