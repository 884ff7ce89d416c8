"""Exact duplicates: 128-bit content hash, smallest stable id, bytes compared within groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import digest, documents, large, lower_ascii, real_id
from marginalia.session import materialise

# Members of one group that are compared in one piece.
PIECE = 256


def exact_duplicates(
    docs: DataFrame,
    normalise: Callable[[Column], Column] = lower_ascii,
    key: Callable[[Column], Column] = digest,
    keep: str = "largest",
) -> DataFrame:
    """Every row with the row that stands for its text.

    ``keep`` names the id that stays, ``smallest`` or ``largest``. ``key`` may be
    any function of the text: rows that share a key are compared byte by byte
    with the row that stays, and those that differ form groups by text.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` (lowercase hex of
    the normalised text), one row per input row. Null and empty texts are equal.
    Repeated rows (same id, same text) count as often as they occur and share
    one verdict. A row without id stays only if no equal text has an id and
    ``keep`` is ``largest`` (for ``smallest``, it is the smallest). An empty
    table gives an empty table; other columns are not read.

    Only ids and hashes are shuffled for the grouping. Texts move once, and only
    rows with a partner are compared; large groups are compared in pieces.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = documents(docs).select("doc_id", normalise(F.col("text")).alias("text"))
    marks = materialise(
        rows.select("doc_id", key(F.col("text")).alias("key"), F.unhex(F.sha2("text", 256)).alias("sha")), "marks"
    )
    groups = materialise(
        marks.groupBy("key")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")),
        "groups",
    )
    members = materialise(
        rows.withColumn("key", key(F.col("text")))
        .join(large(groups), "key")
        .withColumn("piece", F.pmod(F.xxhash64("doc_id", "text"), F.col("pieces")).cast("int")),
        "members",
    )
    first = (
        members.filter("doc_id = keep_id")
        .groupBy("key", "pieces")
        .agg(F.min("text").alias("first_text"))
        .select("key", "first_text", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    )
    odd = materialise(
        members.join(large(first), ["key", "piece"]).filter("text != first_text").select("key", "doc_id", "text"), "odd"
    )
    by_text = odd.groupBy("key", "text").agg(best("doc_id").alias("odd_keep"), F.count(F.lit(1)).alias("odd_n"))
    apart = materialise(
        odd.join(materialise(by_text, "odd-texts"), ["key", "text"])
        .select("doc_id", F.unhex(F.sha2("text", 256)).alias("sha"), "key", "odd_keep", "odd_n")
        .distinct(),
        "apart",
    )
    # The row that stays is in the first group of its key, and so the rest counts without the odd ones.
    alike = materialise(
        groups.join(odd.groupBy("key").agg(F.count(F.lit(1)).alias("odd_rows")), "key", "left").select(
            "key", "keep_id", (F.col("n") - F.coalesce("odd_rows", F.lit(0))).alias("n")
        ),
        "alike",
    )
    keep_id = F.coalesce("odd_keep", "keep_id", "doc_id")
    return (
        marks.join(large(alike), "key", "left")
        .join(apart, ["doc_id", "sha", "key"], "left")
        .select(
            real_id("doc_id").alias("doc_id"),
            real_id(keep_id).alias("keep_id"),
            F.coalesce("odd_n", "n", F.lit(1)).cast("bigint").alias("group_size"),
            (F.col("doc_id") == keep_id).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )
