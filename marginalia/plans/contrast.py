"""Analysis: clean reviews and summary to map, discriminant scores and curves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.functions.classes import class_mask
from marginalia.operators.analysis import AnalysisParams, analysis_columns, with_metadata
from marginalia.operators.density import density
from marginalia.operators.descent import approximate_knn
from marginalia.operators.discriminant import discriminant_score, fit_discriminant
from marginalia.operators.embedding import EncoderFactory, HashingEncoder, embed_cached
from marginalia.operators.latent import fit_latent, latent_embedder
from marginalia.operators.layout import MAX_EPOCHS, fuzzy_edges, map_2d, map_points
from marginalia.operators.neighbours import knn_graph
from marginalia.session import materialise


@dataclass
class Contrast:
    frame: DataFrame
    points: DataFrame
    author_scores: DataFrame
    author_density: DataFrame
    period_scores: DataFrame
    period_density: DataFrame


def analysis_frame(
    reviews: DataFrame, summary: DataFrame, params: AnalysisParams = AnalysisParams()
) -> DataFrame:
    """Joined, classified and cleaned reviews; ``summary`` carries ``ordinal``."""
    return analysis_columns(with_metadata(reviews, summary), params)


def contrast(
    reviews: DataFrame,
    summary: DataFrame,
    cache_path: str,
    params: AnalysisParams = AnalysisParams(),
    encoder_name: str = "hashing-256",
    encoder: EncoderFactory = HashingEncoder,
    neighbours: int = fv.MAP_NEIGHBOURS,
    epochs: int = MAX_EPOCHS,
    probes: int | None = None,
    approximate: bool = False,
    latent: int | None = None,
) -> Contrast:
    """Everything the analysis yields, as tables.

    Ids of vectors are 60 bits of the text's hash, so the map does not depend on
    partitions. Equal texts share one vector and one place on the map; every review counts
    by itself in the discriminants and curves. The graph is exact; ``probes`` bounds the neighbour
    search to so many cells per text and loses neighbours. None searches all that matter, which on
    vectors without structure is every pair. ``approximate`` takes neighbour descent instead, whose work
    grows with the texts only. ``latent`` fits so many latent axes to the texts and takes
    their vectors in place of the encoder's; the name in the cache is the fit's own.
    """
    frame = materialise(analysis_frame(reviews, summary, params), "frame")
    if latent:
        model = fit_latent(frame, "context_cleaned", latent)
        cached = embed_cached(frame, "context_cleaned", cache_path, model.name, embedder=latent_embedder(model))
    else:
        cached = embed_cached(frame, "context_cleaned", cache_path, encoder_name, encoder)
    used = cached.join(frame.select("text_hash").distinct(), "text_hash", "left_semi")
    vectors = materialise(used.withColumn("vec_id", F.conv(F.substring("text_hash", 1, 15), 16, 10).cast("bigint")), "vectors")

    graph = approximate_knn(vectors, neighbours - 1) if approximate else knn_graph(vectors, neighbours - 1, probes=probes)
    edges = materialise(fuzzy_edges(graph, neighbours), "edges")
    places = map_2d(edges, vectors, epochs=epochs)
    positions = places.join(vectors.select(F.col("vec_id").alias("id"), "text_hash"), "id")

    def scores(column: str, label: str) -> tuple[DataFrame, DataFrame]:
        rows = frame.select("text_hash", column).join(vectors, "text_hash")
        model = fit_discriminant(rows.withColumn("mask", class_mask(column, label)), "mask")
        # Scored once per text, then joined to the reviews.
        per_text = discriminant_score(vectors, model, "text_hash")
        scored = frame.join(per_text, "text_hash")
        return scored, density(scored, "score", column)

    author_scores, author_density = scores("author_class", params.author_label)
    period_scores, period_density = scores("period", params.before_label)
    return Contrast(
        frame=frame,
        points=map_points(frame, positions.drop("id")),
        author_scores=author_scores,
        author_density=author_density,
        period_scores=period_scores,
        period_density=period_density,
    )
