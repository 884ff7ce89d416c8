"""Batch text embedding with a cache keyed by text and encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import text_hash
from marginalia.sources.readers import read_embeddings
from marginalia.sources.writers import append_embeddings

# Makes an encoder inside a task: texts in, one vector per text out.
EncoderFactory = Callable[[], Callable[[Sequence[str]], np.ndarray]]


class HashingEncoder:
    """Default encoder: counts of hashed words, scaled to unit length.

    Lexical, not semantic; it stands in where model weights are not at hand.
    Every vector depends on its own text alone, so cached ones stay valid.
    """

    def __init__(self, dim: int = 256):
        self.dim = dim
        self._slots: dict[str, int] = {}

    def _slot(self, word: str) -> int:
        slot = self._slots.get(word)
        if slot is None:
            if len(self._slots) > 200_000:
                self._slots.clear()
            slot = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
            self._slots[word] = slot
        return slot

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            slots = [self._slot(w) for w in text.lower().split()]
            if slots:
                out[row] = np.bincount(slots, minlength=self.dim)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1.0, norms)).astype(np.float32)


def embed(
    df: DataFrame,
    text_col: str,
    encoder: EncoderFactory = HashingEncoder,
    batch_rows: int = 512,
    tasks: int | None = None,
) -> DataFrame:
    """One vector per distinct text: ``text_hash, embedding``.

    The encoder is made once per task and fed ``batch_rows`` texts at a time.
    ``tasks`` spreads slow encoders over more tasks than the byte size of the
    texts would give.
    """
    texts = df.select(text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    # Copies are merged per task before the shuffle.
    texts = texts.filter(F.col("text").isNotNull()).dropDuplicates(["text_hash"])
    if tasks:
        texts = texts.repartition(tasks, "text_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                vectors = np.ascontiguousarray(encode(part["text"].to_pylist()), dtype=np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part["text_hash"], as_lists(vectors)], names=["text_hash", "embedding"]
                )

    return texts.mapInArrow(run, "text_hash string, embedding array<float>")


def as_lists(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column, without a Python loop."""
    n, d = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d or 1, dtype=np.int32)[: n + 1])
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1)))


def as_matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    if len(column) == 0:
        return np.zeros((0, 0), dtype=dtype)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def missing_texts(df: DataFrame, text_col: str, cache_path: str, encoder_name: str) -> DataFrame:
    """Rows whose text has no cached vector of this encoder."""
    cached = read_embeddings(df.sparkSession, cache_path, encoder_name).select("text_hash")
    # Copies meet by hash, and only one text of each goes on to the lookup.
    texts = df.select(F.col(text_col), text_hash(text_col).alias("text_hash")).dropDuplicates(["text_hash"])
    return texts.join(cached, "text_hash", "left_anti").drop("text_hash")


def embed_cached(
    df: DataFrame,
    text_col: str,
    cache_path: str,
    encoder_name: str,
    encoder: EncoderFactory = HashingEncoder,
    embedder: Callable[[DataFrame, str], DataFrame] | None = None,
    **options,
) -> DataFrame:
    """Embed only texts new to the cache, add them, and return the whole cache
    of this encoder as ``text_hash, embedding``.

    Keyed by text, so changed, added or reordered rows never pick up a vector of
    another text. ``embedder`` makes vectors of a table's texts in place of an encoder.
    """
    missing = missing_texts(df, text_col, cache_path, encoder_name)
    fresh = embedder(missing, text_col) if embedder else embed(missing, text_col, encoder, **options)
    append_embeddings(fresh.withColumn("encoder", F.lit(encoder_name)), cache_path)
    return read_embeddings(df.sparkSession, cache_path, encoder_name).select("text_hash", "embedding")


def attach_embeddings(df: DataFrame, embeddings: DataFrame, text_col: str) -> DataFrame:
    """The vector of each row's text."""
    return (
        df.withColumn("text_hash", text_hash(text_col))
        .join(embeddings.select("text_hash", "embedding"), "text_hash")
    )
