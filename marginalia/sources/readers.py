"""Sources: URL lists, ledgers, CSV tables, page snapshots, embedding cache."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marginalia import fixed_values as fv
from marginalia.functions.text import strip

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"
LEDGER_SCHEMA = "url STRING, error_type STRING, batch_id STRING, status STRING"
REVIEWS_SCHEMA = "book_name STRING, stars STRING, date STRING, context STRING"
SUMMARY_SCHEMA = (
    "book_name STRING, author STRING, avg_rating STRING, total_reviews STRING, "
    "keyword_review_count BIGINT, release_date STRING, genres STRING"
)
EMBEDDINGS_SCHEMA = "text_hash STRING, embedding ARRAY<FLOAT>, encoder STRING"

CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def _or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    """An absent path is an empty table; any other failure is raised."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def clean_url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Stripped, non-blank, distinct lines as ``url``."""
    return lines.select(strip(column).alias("url")).filter(F.col("url") != "").distinct()


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return clean_url_lines(spark.read.text(path))


def read_status_lists(spark: SparkSession, lists: Mapping[str, str]) -> DataFrame:
    """One URL list per status; a list not written yet counts as empty."""
    found = spark.createDataFrame([], "url STRING, status STRING")
    for status, path in lists.items():
        lines = _or_empty(lambda p=path: spark.read.text(p), spark, "value STRING")
        found = found.unionByName(clean_url_lines(lines).withColumn("status", F.lit(status)))
    return found


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The status-partitioned ledger; empty before the first write."""
    return _or_empty(
        lambda: spark.read.schema(LEDGER_SCHEMA).parquet(path), spark, LEDGER_SCHEMA
    ).select("url", "status", "error_type", "batch_id")


def _read_csv(spark: SparkSession, path: str, schema: str, pandas_nulls: bool) -> DataFrame:
    target = T._parse_datatype_string(schema)
    # Everything is read as text first: a null token in a number column is a
    # null, not a broken row.
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in target])
    df = spark.read.schema(as_text).options(**CSV_OPTIONS).csv(path)

    def typed(field: T.StructField):
        c = F.col(field.name)
        if pandas_nulls:
            c = F.when(~c.isin(*fv.PANDAS_NULLS), c)
        return (c if isinstance(field.dataType, T.StringType) else c.try_cast(field.dataType)).alias(
            field.name
        )

    return df.select(*[typed(f) for f in target])


def read_reviews_csv(spark: SparkSession, path: str, pandas_nulls: bool = True) -> DataFrame:
    """Reviews with quoted, multi-line text.

    Multi-line CSV cannot be split, so parallelism is one task per file: keep
    large tables as folders of files. An empty field is null; ``pandas_nulls``
    also reads ``NA``, ``None`` and the like as null.
    """
    return _or_empty(
        lambda: _read_csv(spark, path, REVIEWS_SCHEMA, pandas_nulls), spark, REVIEWS_SCHEMA
    )


def read_summary_csv(spark: SparkSession, path: str, pandas_nulls: bool = True) -> DataFrame:
    return _or_empty(
        lambda: _read_csv(spark, path, SUMMARY_SCHEMA, pandas_nulls), spark, SUMMARY_SCHEMA
    )


def read_embeddings(spark: SparkSession, path: str, encoder: str | None = None) -> DataFrame:
    """Cached vectors, of one encoder if named (a partition, so only it is read).

    One row per text and encoder, even if two runs added the same text at once.
    """
    df = _or_empty(
        lambda: spark.read.schema(EMBEDDINGS_SCHEMA).parquet(path), spark, EMBEDDINGS_SCHEMA
    )
    return (df.filter(F.col("encoder") == encoder) if encoder else df).dropDuplicates(["text_hash", "encoder"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshot table ``(page_id, url, html)``."""
    return spark.read.schema(PAGES_SCHEMA).parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Page snapshot kept as one HTML file per page; the file path is the URL."""
    return spark.read.text(path, wholetext=True).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("page_id"),
        F.col("_metadata.file_path").alias("url"),
        F.col("value").alias("html"),
    )
