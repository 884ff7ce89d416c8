"""The incremental steps as Structured Streaming queries.

Each takes a streaming DataFrame and reuses the batch expressions, so a stream
and a batch over the same pages give the same rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia import fixed_values as fv
from marginalia.operators.corpus import processed_urls, status_counts
from marginalia.operators.relational import join_keys
from marginalia.operators.reviews import match_status, review_cards, with_context
from marginalia.sources.readers import PAGES_SCHEMA
from marginalia.sources.writers import append_by_status


def page_stream(
    spark: SparkSession, path: str, max_files: int | None = None, schema: str = PAGES_SCHEMA, **options
) -> DataFrame:
    """Page snapshot files as they arrive in a folder."""
    reader = spark.readStream.schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def route_status(
    pages: DataFrame, ledger_path: str, checkpoint: str, keyword: str = fv.KEYWORD
) -> StreamingQuery:
    """Check arriving pages and append each result to the folder of its status.

    A micro-batch is named by the query's checkpoint and its number; if it is
    run again after a failure it replaces its own output.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        append_by_status(batch, ledger_path, f"{run}-{number}")

    return (
        match_status(pages, keyword)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def keep_first_stream(
    stream: DataFrame, keys: list[str] | None = None, time_col: str = "seen_at", delay: str = "1 day"
) -> DataFrame:
    """First arrival per key (a review of a book, by default).

    State is dropped once the watermark passes: a copy that arrives later than
    ``delay`` after the first one is taken for new. The batch operator has no
    such bound.
    """
    keys = keys or ["url", "review_id"]
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return timed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def resume_stream(stream: DataFrame, ledger: DataFrame) -> DataFrame:
    """Arriving rows whose URL has no status yet.

    Files already read are skipped by the query's checkpoint; the join skips
    URLs settled by other runs before this query started. A short ledger is sent
    to the pages; a long one is joined by shuffle.
    """
    return join_keys(stream, processed_urls(ledger), "url", "left_anti")


def running_counts(stream: DataFrame) -> DataFrame:
    """Counts per status so far; for output mode ``complete``."""
    return status_counts(stream)


def context_stream(
    pages: DataFrame, keyword: str = fv.KEYWORD, max_words: int = fv.MAX_WORDS
) -> DataFrame:
    """Keyword contexts of the cards on arriving pages; no state."""
    return with_context(review_cards(pages), keyword, max_words)


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is available now; the file sink commits each micro-batch once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_COMMITTED = "_COMMITTED"
KEPT_VERSIONS = 3  # tables of running counts that readers may still be using


def counts_to_parquet(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep complete tables of running counts, a folder per micro-batch: ``version=<number>`` below ``path``.

    A folder that a reader may be using is never written to: a version counts from its
    own mark on, which is written last whether or not jobs of this session are marked, and the
    last few stay. A batch that is run again after a failure replaces its own folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")
        mark, system = _path(batch.sparkSession, f"{path}/version={number}/{_COMMITTED}")
        system.create(mark, True).close()
        for old in _versions(batch.sparkSession, path)[:-KEPT_VERSIONS]:
            folder, system = _path(batch.sparkSession, f"{path}/version={old}")
            system.delete(folder, True)

    return (
        counts.writeStream.outputMode("complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The last committed table of running counts; a reader keeps its version while later ones are written."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no committed counts below {path}")
    return spark.read.parquet(f"{path}/version={versions[-1]}")


def _path(spark: SparkSession, name: str):
    """A path and its file system, local or not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions, in order; earlier ones may have Spark's mark only."""
    marks, system = _path(spark, f"{path}/version=*/{{{_COMMITTED},_SUCCESS}}")
    return sorted({int(found.getPath().getParent().getName().split("=")[1]) for found in system.globStatus(marks) or []})
