"""Katz backoff: bigrams over unigrams, Good-Turing discounts, exactly normalised backoff weights.

Documents are read once, into shards of word numbers. What a shard needs to know
about a word, a bigram or a context it asks of the part of the table that holds the
key: a request has the sorted keys and the shard's own counts, the answer has the
totals in the same order. Requests and answers are rows with packed arrays, dealt
by Spark; a part adds up each key once, whoever asks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import documents, real_id
from marginalia.session import materialise

SHARD = 2_000_000  # tokens of a shard
DISCOUNTED = 5  # counts up to this are discounted
END, START = xxhash.xxh3_64_intdigest(b"\x20end"), xxhash.xxh3_64_intdigest(b"\x20start")  # no word has a blank
FIXED = float(1 << 60)  # probabilities are added up as whole numbers, so in any order


def _pack(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(a.size, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(b: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b, np.uint64), dtype=np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
    for _ in range(2):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Shard:
    """Documents as numbers into ``words`` (hashes; 0 is the end, 1 the start of a text)."""

    words: np.ndarray
    tokens: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray
    held: np.ndarray

    def __post_init__(self):
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        self.first = np.cumsum(self.lengths) - self.lengths
        before[self.first] = 1
        self.in_training = np.repeat(self.held == 0, self.lengths)
        self._codes = before * len(self.words) + self.tokens

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self._codes, return_inverse=True)

    @property
    def left(self) -> np.ndarray:
        return self._pairs[0] // len(self.words)

    @property
    def right(self) -> np.ndarray:
        return self._pairs[0] % len(self.words)

    @property
    def pair_of(self) -> np.ndarray:
        return self._pairs[1]

    def word_request(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys in order, where each came from, and training counts."""
        order = np.argsort(self.words)
        counts = np.bincount(self.tokens[self.in_training], minlength=len(self.words))
        return self.words[order], order, counts[order][None]

    def pair_request(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = _mix(self.words[self.left], self.words[self.right])
        order = np.argsort(keys)
        counts = np.bincount(self.pair_of[self.in_training], minlength=len(keys))
        return keys[order], order, counts[order][None]

    def row(self, number: int) -> dict:
        documents_ = np.concatenate([self.ids, self.lengths, self.held])
        return {"shard": number, "a": self.words.tobytes(), "b": _pack(self.tokens), "c": _pack(documents_)}

    @classmethod
    def of(cls, a: bytes, b: bytes, c: bytes) -> Shard:
        ids, lengths, held = _unpack(c).reshape(3, -1)
        return cls(np.frombuffer(a, np.uint64), _unpack(b), ids, lengths, held)


def _requests(number: int, keys: np.ndarray, values: np.ndarray, parts: int) -> Iterator[dict]:
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.searchsorted(part, np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[p], cuts[p + 1])
        yield {"shard": number, "part": int(p), "a": _pack_keys(keys[s]), "b": _pack(values[:, s].reshape(-1)),
               "n": int(cuts[p + 1] - cuts[p])}


_SHARD = "shard bigint, a binary, b binary, c binary"
_SHARD_ARROW = pa.schema([("shard", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ASK = "shard bigint, part int, a binary, b binary, n bigint"
_ASK_ARROW = pa.schema(
    [("shard", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())]
)


class _Numbers(dict):
    """Numbers of the words of a shard, in the order they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 2
        return n


def _read(shard_tokens: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        words, tokens, ids, held, lengths = _Numbers(), [], [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, words
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            shard = Shard(
                np.concatenate([np.array([END, START], np.uint64), hashes]), np.concatenate(tokens),
                np.array(ids, np.int64), np.array(lengths, np.int64), np.array(held, np.int64),
            )
            yield pa.RecordBatch.from_pylist([shard.row(number)], _SHARD_ARROW)
            number, words = number + 1, _Numbers()
            for x in (tokens, ids, held, lengths):
                x.clear()

        for batch in batches:
            for doc_id, text, out in zip(
                batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True
            ):
                found = text.as_py().encode().lower().split()  # both ASCII only for bytes
                tokens.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                tokens.append(np.zeros(1, np.int64))
                ids.append(doc_id)
                held.append(int(out))
                lengths.append(len(found) + 1)
                if sum_over(lengths, shard_tokens):
                    yield from flush()
        if ids:
            yield from flush()

    return read


def _ask(kind: str, parts: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.of(row["a"], row["b"], row["c"])
                keys, _, counts = shard.word_request() if kind == "word" else shard.pair_request()
                yield pa.RecordBatch.from_pylist(list(_requests(row["shard"], keys, counts, parts)), _ASK_ARROW)

    return ask


def sum_over(lengths: list[int], limit: int) -> bool:
    """Whether the lengths reach the limit; a shard has few enough documents to add them up now and then."""
    return (len(lengths) % 64 == 0 or lengths[-1] > limit // 8) and sum(lengths) >= limit


def _add_up(values: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Totals of each key of a part, in the order each shard asked; and the part's counts of counts."""

    def add_up(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("shard")
        keys = np.concatenate([_unpack_keys(b) for b in part["a"]])
        counts = np.concatenate([_unpack(b).reshape(values, -1) for b in part["b"]], axis=1)
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
        sums = np.add.reduceat(counts[:, order], first, axis=1)
        group = np.empty(len(keys), np.int64)
        group[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
        own = np.zeros(len(keys), np.int64)
        own[order[first]] = 1  # the first that asked answers for the key in later sums
        ends = np.cumsum(part["n"].to_numpy())
        rows = [
            (shard, number, _pack(np.concatenate([sums[:, group[e - n : e]].reshape(-1), own[e - n : e]])), None)
            for shard, number, n, e in zip(part["shard"], part["part"], part["n"], ends, strict=True)
        ]
        total = sums[0]
        stats = [int(total.sum()), int((total > 0).sum()), *(int((total == r).sum()) for r in range(1, DISCOUNTED + 2))]
        rows.append((None, None, None, stats))
        return pd.DataFrame(rows, columns=["shard", "part", "totals", "stats"]).astype({"shard": "Int64", "part": "Int32"})

    return add_up


_ANSWER = "shard bigint, part int, totals binary, stats array<bigint>"


def _answers(requests: DataFrame, values: int, name: str) -> DataFrame:
    return materialise(requests.groupBy("part").applyInPandas(_add_up(values), _ANSWER), name)


def _statistics(answers: DataFrame) -> list[int]:
    sums = [F.sum(F.get("stats", F.lit(k))) for k in range(DISCOUNTED + 3)]
    return [int(x or 0) for x in answers.filter("stats IS NOT NULL").agg(*sums).first()]


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Factor of each count up to ``DISCOUNTED``, by Good-Turing with Katz's cut.

    Where the counts of counts give none between 0 and 1 (a small corpus), half a
    count is taken off.
    """
    n, k = [0, *counts_of_counts], DISCOUNTED
    out = np.ones(k + 1)
    for r in range(1, k + 1):
        plain = (r - 0.5) / r
        if not (n[1] and n[r]):
            out[r] = plain
            continue
        rest = (k + 1) * n[k + 1] / n[1]
        d = ((r + 1) * n[r + 1] / n[r] / r - rest) / (1 - rest) if rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else plain
    return out


@dataclass
class Unigrams:
    """Probabilities of words by their count; one further type stands for all unknown words."""

    tokens: int
    types: int
    factors: np.ndarray
    discounted: bool

    @classmethod
    def of(cls, stats: list[int]) -> Unigrams:
        return cls(stats[0], stats[1], discounts(stats[2:]), any(stats[2 : 2 + DISCOUNTED]))

    def probabilities(self, counts: np.ndarray, unknown: float) -> np.ndarray:
        d = np.where(counts <= DISCOUNTED, self.factors[np.minimum(counts, DISCOUNTED)], 1.0)
        return np.where(counts > 0, d * counts / self.total, unknown)

    @property
    def total(self) -> int:
        return max(self.tokens + (0 if self.discounted else 1), 1)

    def unknown(self, counts_of_counts: list[int]) -> float:
        if not self.discounted:
            return 1 / self.total
        lost = sum((1 - self.factors[r]) * r * n for r, n in enumerate(counts_of_counts[:DISCOUNTED], 1))
        return lost / self.total


def _in_order(answers: pd.DataFrame, order: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray]:
    """Totals and ownership by the shard's own numbers."""
    parts = [_unpack(b).reshape(values + 1, -1) for b in answers.sort_values("part")["totals"]]
    out = np.zeros((values + 1, len(order)), np.int64)
    if parts:
        out[:, order] = np.concatenate(parts, axis=1)
    return out[:values], out[values] == 1


@dataclass
class Model:
    words: Unigrams
    unknown: float
    factors: np.ndarray  # of bigram counts
    parts: int

    def contexts(self, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Requests of one shard: per context, how many bigrams have each small count, and their unigram mass."""
        shard = Shard.of(left["a"].iloc[0], left["b"].iloc[0], left["c"].iloc[0])
        counts, _ = _in_order(right[right["kind"] == "word"], shard.word_request()[1], 1)
        totals, own = _in_order(right[right["kind"] == "pair"], shard.pair_request()[1], 1)
        p = self.words.probabilities(counts[0], self.unknown)
        mine = np.flatnonzero(own & (totals[0] > 0))
        left_of, r = shard.left[mine], totals[0][mine]
        sums = np.zeros((DISCOUNTED + 1, len(shard.words)), np.int64)
        for k in range(1, DISCOUNTED + 1):
            sums[k - 1] = np.bincount(left_of[r == k], minlength=len(shard.words))
        np.add.at(sums[DISCOUNTED], left_of, np.round(p[shard.right[mine]] * FIXED).astype(np.int64))
        keys, order, _ = shard.word_request()
        rows = list(_requests(int(left["shard"].iloc[0]), keys, sums[:, order], self.parts))
        return pd.DataFrame(rows, columns=["shard", "part", "a", "b", "n"])

    def scores(self, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Scores of the documents of one shard."""
        shard = Shard.of(left["a"].iloc[0], left["b"].iloc[0], left["c"].iloc[0])
        by_word = shard.word_request()[1]
        counts = _in_order(right[right["kind"] == "word"], by_word, 1)[0][0]
        pairs = _in_order(right[right["kind"] == "pair"], shard.pair_request()[1], 1)[0][0]
        sums = _in_order(right[right["kind"] == "context"], by_word, DISCOUNTED + 1)[0]
        p = self.words.probabilities(counts, self.unknown)
        # A word is followed by a token each time; texts start as often as they end.
        total = counts.copy()
        total[0], total[1] = 0, counts[0]
        lost = sum((1 - self.factors[r]) * r * sums[r - 1] for r in range(1, DISCOUNTED + 1))
        whole = total + (lost == 0)  # a context without discounts gives one count away
        free = np.where(lost > 0, lost, 1.0) / whole
        weight = np.where(total > 0, free / np.maximum(1 - sums[DISCOUNTED] / FIXED, 1e-300), 1.0)
        d = np.where(pairs <= DISCOUNTED, self.factors[np.minimum(pairs, DISCOUNTED)], 1.0)
        seen = d * pairs / whole[shard.left]
        chance = np.log10(np.where(pairs > 0, seen, weight[shard.left] * p[shard.right]))
        base = np.log10((counts + 1) / (self.words.tokens + self.words.types + 1))
        add = lambda x: np.add.reduceat(x, shard.first)
        return pd.DataFrame({
            "doc_id": shard.ids, "held_out": shard.held == 1, "n_tokens": shard.lengths,
            "n_known": add((counts[shard.tokens] > 0).astype(np.int64)), "train_tokens": self.words.tokens,
            "base_score": add(base[shard.tokens]), "score": add(chance[shard.pair_of]),
        })


def by_crc(doc_id: Column) -> Column:
    """Held out: crc32 of the id as text leaves 2 by 7. A row without an id is for training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def katz_scores(docs: DataFrame, held_out: Callable[[Column], Column] = by_crc, shard_tokens: int = SHARD) -> DataFrame:
    """Scores of every row under a model of the rows that are not held out.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: tokens
    are words parted by ASCII blanks, A-Z in lower case, and an end. ``base_score``
    adds one to each count of a word; ``score`` is the log10 probability of the text
    by Katz backoff from bigrams (with a start of text) to words. Counts up to five
    are discounted by Good-Turing, and what they lose is shared among the words that
    did not follow, in proportion to their own probability, so that each context
    adds up to one over all known words and one unknown type. A context without
    small counts gives away one count more than it has.

    Null and empty texts are an end only. Repeated rows count and are scored each.
    With no training rows at all, every word is the unknown one, of probability one.
    An empty table gives an empty table; other columns are not read.

    Everything is counted over all documents. A word in a third of all texts is one
    entry per shard, wherever it occurs. The driver gets counts of counts.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents(docs).select("doc_id", "text", held_out(real_id("doc_id")).alias("held"))
    # Written once: every later step reads the same shards.
    shards = materialise(rows.mapInArrow(_read(shard_tokens), _SHARD), "shards")
    words = _answers(shards.mapInArrow(_ask("word", parts), _ASK), 1, "word-totals")
    pairs = _answers(shards.mapInArrow(_ask("pair", parts), _ASK), 1, "pair-totals")
    stats, pair_stats = _statistics(words), _statistics(pairs)
    unigrams = Unigrams.of(stats)
    model = Model(unigrams, unigrams.unknown(stats[2:]), discounts(pair_stats[2:]), parts)

    def known(*answers: tuple[str, DataFrame]) -> DataFrame:
        named = [a.filter("shard IS NOT NULL").select(F.lit(k).alias("kind"), "shard", "part", "totals") for k, a in answers]
        out = named[0]
        for a in named[1:]:
            out = out.unionByName(a)
        return out

    def together(answers: DataFrame):
        return shards.groupBy("shard").cogroup(answers.groupBy("shard"))

    asked = together(known(("word", words), ("pair", pairs))).applyInPandas(lambda a, b: model.contexts(a, b), _ASK)
    contexts = _answers(asked, DISCOUNTED + 1, "contexts")
    schema = (
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
        "base_score double, score double"
    )
    scored = together(known(("word", words), ("pair", pairs), ("context", contexts))).applyInPandas(lambda a, b: model.scores(a, b), schema)
    return scored.withColumn("doc_id", real_id("doc_id"))
