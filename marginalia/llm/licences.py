"""Licence scans: canonical digests of whole texts and of lines, looked up among known licences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import digest, documents, large, lower_ascii, real_id
from marginalia.llm.licence_texts import TEXTS, full_texts, notices
from marginalia.session import materialise

# Spellings that licences use for the same word, after lower-casing (fixed values).
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("non commercial", "noncommercial"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https www", "http www"),
)
# A line that only says who holds the copyright; a year, a sign or "by" follows the word.
COPYRIGHT = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]|by |<|\[)[^\n]*"
RESERVED = r"(^|\n)[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*(\n|$)"


def canonical_lines(text: Column) -> Column:
    """Lower case, without copyright lines, one spelling, words parted by one blank; line ends stay."""
    out = F.regexp_replace(lower_ascii(text), COPYRIGHT, "\n")
    out = F.regexp_replace(out, RESERVED, "\n")
    out = F.regexp_replace(out, r"[^a-z0-9\n]+", " ")
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, out)


def canonical(lines: Column) -> Column:
    """One line of all canonical lines."""
    return F.btrim(F.regexp_replace(lines, r"[ \n]+", " "), F.lit(" "))


def known_digests(spark: SparkSession, further: DataFrame | None = None) -> DataFrame:
    """``hash, licence, notice`` of the known texts and one-line notices, and of ``further`` texts.

    A text that is known as several licences counts as the first of them, the shipped ones before ``further``.
    """
    rows = [(a, b, False) for a, b in TEXTS + full_texts()] + [(a, b, True) for a, b in notices()]
    known = spark.createDataFrame(rows, "licence string, text string, notice boolean").withColumn("is_further", F.lit(False))
    if further is not None:
        known = known.unionByName(
            further.select("licence", "text", F.lit(False).alias("notice"), F.lit(True).alias("is_further"))
            .filter("licence IS NOT NULL AND text RLIKE '[A-Za-z0-9]'")
        )
    first = F.min(F.struct("is_further", "licence", "notice")).alias("first")
    return (
        known.withColumn("hash", digest(canonical(canonical_lines(F.col("text")))))
        .groupBy("hash")
        .agg(first)
        .select("hash", "first.licence", "first.notice")
    )


def licence_scan(docs: DataFrame, further: DataFrame | None = None) -> DataFrame:
    """Known licences in every row; ``further`` (``licence, text``) has texts that are not shipped.

    ``doc_id, text_licence`` (of the text as a whole, or null), ``line_licences``
    (array of ``(pos, licence)`` of the lines that are a notice or text by
    themselves, ascending), ``n_lines_matched``.

    Case, punctuation, spacing, copyright lines and equal spellings do not count.
    ``pos`` counts lines after copyright lines are gone. Null and empty texts have
    no licence; a text without a letter or digit neither. Repeated rows get equal
    results, and so do rows that share an id but not a text get their own. An
    empty table gives an empty table; other columns are not read.

    The known digests are a fixed list of a few hundred rows, and those of ``further``
    texts, which grow with the licences and not with the input; they are broadcast.
    Texts are not shuffled; only ids, and the lines that matched, are.
    """
    known = F.broadcast(known_digests(docs.sparkSession, further))
    rows = documents(docs).select(
        "doc_id", F.xxhash64("text").alias("version"), canonical_lines(F.col("text")).alias("lines")
    )
    marks = materialise(
        rows.select(
            "doc_id",
            "version",
            digest(canonical(F.col("lines"))).alias("hash"),
            F.transform(F.split("lines", "\n"), lambda line: digest(F.btrim(line, F.lit(" ")))).alias("line_hashes"),
        ),
        "licence-marks",
    )
    lines = (
        marks.select("doc_id", "version", F.posexplode("line_hashes").alias("pos", "hash"))
        .join(known, "hash")
        .distinct()  # rows repeated in full
        .groupBy("doc_id", "version")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "licence"))).alias("line_licences"))
    )
    return (
        marks.select("doc_id", "version", "hash")
        .join(known.select("hash", F.col("licence").alias("text_licence")), "hash", "left")
        .join(large(lines), ["doc_id", "version"], "left")
        .select(
            real_id("doc_id").alias("doc_id"),
            "text_licence",
            "line_licences",
            F.coalesce(F.size("line_licences"), F.lit(0)).cast("bigint").alias("n_lines_matched"),
        )
    )
