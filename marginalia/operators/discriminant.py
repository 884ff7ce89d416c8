"""Two-class linear discriminant: fit and score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.embedding import as_lists, as_matrix


@dataclass(frozen=True)
class Discriminant:
    """Score is ``(x - centre) . weights``; the mask class has the larger mean."""

    weights: np.ndarray
    centre: np.ndarray


def _middle(rows: DataFrame) -> np.ndarray:
    """The mean of all vectors, by one sum per task."""
    mean = rows.select(array_to_vector(F.col("vec")).alias("v")).agg(Summarizer.mean(F.col("v")).alias("m")).first().m
    return np.zeros(0) if mean is None else mean.toArray()


def _moments(rows: DataFrame, middle: np.ndarray) -> dict[bool, np.ndarray]:
    """Per class the Gram matrix of the vectors, seen from ``middle``, with a one appended.

    Each task adds up its own matrices; Spark sums them row by row. The driver
    gets two matrices, whatever the number of rows. Products of vectors far from
    zero would lose the digits that tell them apart; from the middle they are small.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bool, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = as_matrix(batch["vec"]) - middle
            x = np.hstack([x, np.ones((len(x), 1))])
            mask = batch["mask"].to_numpy(zero_copy_only=False).astype(bool)
            for cls in (False, True):
                part = x[mask == cls]
                if len(part):
                    sums[cls] = sums.get(cls, 0.0) + part.T @ part
        for cls, gram in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([cls] * len(gram)),
                    pa.array(np.arange(len(gram), dtype=np.int32)),
                    as_lists(gram),
                ],
                names=["mask", "row", "part"],
            )

    parts = rows.mapInArrow(run, "mask boolean, row int, part array<double>")
    summed = (
        parts.withColumn("part", array_to_vector("part"))
        .groupBy("mask", "row")
        .agg(Summarizer.sum(F.col("part")).alias("total"))
        .collect()
    )
    out: dict[bool, np.ndarray] = {}
    for cls in (False, True):
        lines = sorted((r.row, r.total.toArray()) for r in summed if r.mask == cls)
        if lines:
            out[cls] = np.stack([line for _, line in lines])
    return out


def fit_discriminant(emb: DataFrame, mask_col: str, vec_col: str = "embedding") -> Discriminant:
    """Direction that separates the mask class from the rest.

    Scaled so that the pooled within-class variance of the score is one. A
    singular covariance is handled by its pseudo-inverse.
    """
    rows = emb.select(F.col(mask_col).cast("boolean").alias("mask"), F.col(vec_col).alias("vec")).dropna()
    middle = _middle(rows)
    grams = _moments(rows, middle)
    if len(grams) < 2:
        raise ValueError("a discriminant needs rows in both classes")
    n = {c: g[-1, -1] for c, g in grams.items()}
    mean = {c: g[-1, :-1] / n[c] for c, g in grams.items()}
    total = n[True] + n[False]
    if total <= 2:
        raise ValueError("a discriminant needs more than two rows")
    within = sum(g[:-1, :-1] - n[c] * np.outer(mean[c], mean[c]) for c, g in grams.items())
    within /= total - 2
    gap = mean[True] - mean[False]
    w = np.linalg.pinv(within, rcond=1e-10, hermitian=True) @ gap
    variance = float(w @ within @ w)
    if variance > 0:
        w = w / np.sqrt(variance)
    centre = middle + (n[True] * mean[True] + n[False] * mean[False]) / total
    return Discriminant(weights=w, centre=centre)


def discriminant_score(
    emb: DataFrame,
    model: Discriminant,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    name: str = "score",
) -> DataFrame:
    """``id, score`` by one narrow pass; only id and vector leave the JVM."""
    rows = emb.select(id_col, vec_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            score = (as_matrix(batch[vec_col]) - model.centre) @ model.weights
            yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(score)], names=[id_col, name])

    id_type = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {id_type}, {name} double")
