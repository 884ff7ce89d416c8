"""Latent vectors of texts, fitted to a corpus: leading axes of weighted word counts.

Words are hashed into a fixed number of slots, so everything the driver and the tasks
hold has a size set by parameters, whatever the corpus. The axes are found by
randomised subspace iteration (Halko, Martinsson, Tropp 2011): each pass over the texts
multiplies a thin matrix by the counts and back, and Spark adds the parts up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.text import text_hash, words
from marginalia.operators.embedding import as_lists
from marginalia.session import materialise

SLOTS = 4096
SPARE = 10  # directions beyond those asked for
STEADY = 1e-3  # relative change of the captured weight below which passes end
MAX_PASSES = 12
_ROWS = 256  # texts that a task turns into a dense matrix at once


@dataclass(frozen=True)
class LatentModel:
    """``rarity`` of each slot and its place on each axis."""

    rarity: np.ndarray
    axes: np.ndarray
    captured: float  # squared length of the training texts along the axes, as a share of all

    @property
    def name(self) -> str:
        """Tells fits apart, so that a cache never mixes vectors of two."""
        digest = hashlib.sha256(self.rarity.tobytes() + self.axes.tobytes()).hexdigest()[:16]
        return f"latent-{self.axes.shape[1]}-{digest}"


def word_slots(text: Column | str, slots: int = SLOTS) -> Column:
    """The slot of each word, in lower case."""
    lower = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.transform(words(lower), lambda w: F.pmod(F.xxhash64(w), F.lit(slots)).cast("int"))


def text_slots(df: DataFrame, text_col: str | None, slots: int = SLOTS) -> DataFrame:
    """``text_hash, slots`` of the distinct texts.

    Texts move once, for this table alone: written, it serves a fit, its check and the
    vectors in place of the texts. Those take such a table where no text column is named.
    """
    if text_col is None:
        return df.select("text_hash", "slots")
    texts = df.select(F.col(text_col).alias("text")).dropna().withColumn("text_hash", text_hash("text")).dropDuplicates(["text_hash"])
    return texts.select("text_hash", word_slots("text", slots).alias("slots"))


def _counts(column: pa.Array, slots: int) -> np.ndarray:
    """Texts by slots: how often each slot occurs."""
    sizes = np.diff(column.offsets.to_numpy())
    rows = np.repeat(np.arange(len(sizes)), sizes)
    flat = column.flatten().to_numpy()
    return np.bincount(rows * slots + flat, minlength=len(sizes) * slots).reshape(len(sizes), slots).astype(float)


def _weighted(column: pa.Array, rarity: np.ndarray) -> np.ndarray:
    """Damped counts times rarity, each text scaled to unit length; texts without words are zero."""
    x = np.log1p(_counts(column, len(rarity))) * rarity
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1.0, length)


def _parts(batches: Iterator[pa.RecordBatch], rarity: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            yield part, _weighted(part["slots"], rarity)


def _round_trip(texts: DataFrame, rarity: np.ndarray, thin: np.ndarray) -> np.ndarray:
    """``A' A thin`` for the matrix ``A`` of all texts: one partial matrix per task, added up by Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(thin.shape)
        for _, x in _parts(batches, rarity):
            total += x.T @ (x @ thin)
        used = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used), as_lists(total[used])], ["slot", "part"])

    parts = texts.select("slots").mapInArrow(run, "slot int, part array<double>")
    summed = parts.withColumn("part", array_to_vector("part")).groupBy("slot").agg(Summarizer.sum(F.col("part")).alias("total"))
    out = np.zeros(thin.shape)
    for row in summed.collect():  # a row per slot
        out[row.slot] = row.total.toArray()
    return out


def fit_latent(df: DataFrame, text_col: str | None, dim: int = 128, slots: int = SLOTS, seed: int = 42) -> LatentModel:
    """Axes along which the distinct texts of ``df`` vary most; ``df`` may be a written table of ``text_slots``.

    Passes end when the captured weight is steady. A corpus of fewer texts or slots
    than ``dim`` has fewer axes; one without words has none.
    """
    found = text_slots(df, text_col, slots).select("slots")
    # Filtered as it is read: a filter before would be pushed below the projection and take all words apart twice.
    texts = (materialise(found, "latent-texts") if text_col is not None else found).filter(F.size("slots") > 0)
    n = texts.count()
    seen = texts.select(F.explode(F.array_distinct("slots")).alias("slot")).groupBy("slot").count().collect()  # a row per slot
    rarity = np.zeros(slots)
    for row in seen:
        rarity[row.slot] = np.log((1 + n) / (1 + row["count"])) + 1
    width = min(dim + SPARE, len(seen), n)
    if width == 0:
        return LatentModel(rarity, np.zeros((slots, 0)), 0.0)
    thin, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(slots, width)) * (rarity > 0)[:, None])
    before = 0.0
    for _ in range(MAX_PASSES):
        back = _round_trip(texts, rarity, thin)
        values, turn = np.linalg.eigh(thin.T @ back)
        best = np.argsort(values)[::-1][:dim]
        captured = float(np.maximum(values[best], 0).sum())
        if captured - before <= STEADY * captured:
            break
        before = captured
        thin, _ = np.linalg.qr(back)
    axes = thin @ turn[:, best]
    # The sign of an axis is free: its largest entry is positive.
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    return LatentModel(rarity, axes, captured / n)  # every text has length one


def embed_latent(df: DataFrame, text_col: str | None, model: LatentModel) -> DataFrame:
    """One vector of unit length per distinct text: ``text_hash, embedding``. A text without known words is zero.

    ``df`` may be a table of ``text_slots`` for as many slots as the model has.
    """
    rarity, axes = model.rarity, model.axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _parts(batches, rarity):
            y = x @ axes
            length = np.linalg.norm(y, axis=1, keepdims=True)
            y = (y / np.where(length < 1e-12, 1.0, length)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part["text_hash"], as_lists(y)], ["text_hash", "embedding"])

    return text_slots(df, text_col, len(rarity)).mapInArrow(run, "text_hash string, embedding array<float>")


def latent_embedder(model: LatentModel) -> Callable[[DataFrame, str], DataFrame]:
    return lambda df, text_col: embed_latent(df, text_col, model)


def save_latent(spark: SparkSession, model: LatentModel, path: str) -> None:
    """The fit as a table: a row per slot."""
    rows = [(k, float(r), [float(v) for v in a], model.captured) for k, (r, a) in enumerate(zip(model.rarity, model.axes))]
    spark.createDataFrame(rows, "slot int, rarity double, axis array<double>, captured double").write.parquet(path)


def load_latent(spark: SparkSession, path: str) -> LatentModel:
    rows = spark.read.parquet(path).orderBy("slot").collect()  # a row per slot
    return LatentModel(np.array([r.rarity for r in rows]), np.array([r.axis for r in rows]), rows[0].captured)


def exact_share(df: DataFrame, text_col: str | None, model: LatentModel) -> float:
    """What the best axes of the same number would capture; for few slots, as the whole matrix of their products is used."""
    # Texts without words are rows of zeros and add nothing.
    whole = _round_trip(text_slots(df, text_col, len(model.rarity)), model.rarity, np.eye(len(model.rarity)))
    values = np.linalg.eigvalsh(whole)[::-1]
    return float(values[: model.axes.shape[1]].sum() / max(np.trace(whole), 1e-300))
