"""Line dedup: repeated lines are found by hash and marked in a keep bitmap per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import BLANKS, as_before, digest, documents, large, lower_ascii, real_id, rest_of_row
from marginalia.session import materialise

WORD = 64  # bits of a word of the bitmap


def _with_version(docs: DataFrame, *columns: Column) -> DataFrame:
    """Rows that share an id but not a text keep bitmaps of their own."""
    return documents(docs, *columns).withColumn("version", F.xxhash64("text"))


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Keep bitmaps of the documents that lose lines.

    A line's key is the line without blanks at its ends, A-Z in lower case. Keys
    of at least ``min_chars`` code points in at least ``min_docs`` documents lose
    all their lines except those in the largest document id.

    Returns ``doc_id, version, n_dropped, words``: ``version`` tells rows of one
    id with different texts apart, and ``words`` is the bitmap, an array of
    ``(word, keep)`` with bit ``i % 64`` of word ``i // 64`` for line ``i``. A word
    of ones only is left out, and so is a document without a dropped line.

    The hashes are dealt by range of (hash, document), so a line in a third of
    all documents goes to many tasks; within a task, rows stand in the order of
    hash, document, position, and each task adds up its part of a hash before
    the parts meet. The documents of a hash are counted by id; rows without an
    id are one document, below all others.
    """
    lines = F.split(lower_ascii(F.col("text")), "\n")
    key = F.btrim(F.col("line"), F.lit(BLANKS))
    found = materialise(
        _with_version(docs)
        .select("doc_id", "version", F.posexplode(lines).alias("pos", "line"))
        .select("doc_id", "version", "pos", key.alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("doc_id", "version", "pos", digest(F.col("key")).alias("hash")),
        "lines",
    )
    # One row per hash and document: all rows of the pair are in one range, in a row.
    ordered = found.repartitionByRange("hash", "doc_id").sortWithinPartitions("hash", "doc_id", "pos")
    holders = ordered.groupBy("hash", "doc_id").agg(F.min("pos").alias("first_pos"))
    keys = materialise(
        holders.groupBy("hash")
        .agg(F.count("first_pos").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        .filter(F.col("n_docs") >= min_docs)
        .select("hash", "last_doc"),
        "line-keys",
    )
    dropped = found.join(large(keys), "hash").filter("doc_id != last_doc")
    bit = F.expr(f"shiftleft(1L, cast(pos % {WORD} as int))")
    return (
        dropped.repartition("doc_id", "version")
        .groupBy("doc_id", "version", F.expr(f"cast(pos div {WORD} as int)").alias("word"))
        .agg(F.bitwise_not(F.bit_or(bit)).alias("keep"), F.count(F.lit(1)).alias("n"))
        .groupBy("doc_id", "version")
        .agg(F.sum("n").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "keep"))).alias("words"))
    )


def dropped_positions(words: Column) -> Column:
    """Positions of the lines that a bitmap does not keep, ascending."""
    bits = F.sequence(F.lit(0), F.lit(WORD - 1))
    return F.flatten(
        F.transform(
            words,
            lambda w: F.transform(
                F.filter(bits, lambda b: F.getbit(w["keep"], b) == 0), lambda b: w["word"] * WORD + b
            ),
        )
    )


def kept_text(text: Column, words: Column) -> Column:
    """The text without the lines that the bitmap does not keep."""
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped_positions(words))
    return F.when(words.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))


def _without_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    bitmaps = line_bitmaps(docs, min_chars, min_docs)
    return _with_version(docs, rest_of_row(docs)).join(large(bitmaps), ["doc_id", "version"], "left").withColumns(
        {"n_lines": F.size(F.split("text", "\n")), "text": kept_text(F.col("text"), F.col("words"))}
    )


def deduplicated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every row, the text without repeated lines.

    A null or empty text has one empty line, and comes back empty; a document may
    lose all lines. Repeated rows lose the same lines each. An empty table gives
    an empty table; other columns are not read.
    """
    return _without_lines(docs, min_chars, min_docs).select(
        real_id("doc_id").alias("doc_id"),
        "text",
        F.col("n_lines").cast("bigint"),
        F.coalesce("n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def without_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The rows of ``docs`` with all their columns, the text as ``deduplicated_lines`` leaves it."""
    return as_before(_without_lines(docs, min_chars, min_docs), docs)
