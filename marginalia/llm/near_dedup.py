"""Near duplicates: bottom-k sketches of one hash function, inverted lists, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import NO_ID, documents, large, real_id
from marginalia.llm.components import components
from marginalia.session import materialise

K = 32  # values of a sketch
_MULTIPLIER, _FINISH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z in lower case; words are parted by ASCII blanks.

    Fewer words than ``width`` are one shingle; a text without words has none.
    """
    words = text.encode().lower().split()  # both ASCII only for bytes
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))] if words else [], np.uint64).view(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out *= _MULTIPLIER
        out ^= out >> np.uint64(29)
        out += h[k : n + k]
    for _ in range(2):
        out ^= out >> np.uint64(32)
        out *= _FINISH
    out ^= out >> np.uint64(32)
    return np.unique(out.view(np.int64))


def shared_values(percent: int) -> int:
    """Sketch values that linked sets share: six deviations below the mean, missed once in about 10^8 pairs."""
    p = percent / 100
    return max(1, int(K * p - 6 * (K * p * (1 - p)) ** 0.5))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True)


def _set_key(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, keys, sketches = [], [], [], []
        for doc_id, text, _ in _rows(batch):
            s = shingle_hashes(text)
            ids.append(doc_id)
            sizes.append(len(s))
            keys.append(_set_key(s))
            sketches.append(s[:K])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
             pa.array(sketches, pa.list_(pa.int64()))],
            ["doc_id", "version", "n", "set_key", "sketch"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for (text,) in _rows(batch):
            s = shingle_hashes(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_key(s)], pa.binary()), pa.array([len(s)], pa.int64()), pa.array([s], pa.list_(pa.int64()))],
                ["id", "n", "shingles"],
            )


def _linked(percent: int):
    least = shared_values(percent)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            a_values, b_values = (batch.column(k) for k in (2, 3))
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = (np.asarray(v[k].values) for v in (a_values, b_values))
                # The sketch of the union: how many of its values are in both?
                sx, sy = x[:K], y[:K]
                union = np.union1d(sx, sy)[:K]
                both = np.isin(union, sx, assume_unique=True) & np.isin(union, sy, assume_unique=True)
                if len(x) > K and len(y) > K and both.sum() < least:
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return verify


def _common_in_lists(percent: int) -> tuple[str, str]:
    """Lengths of the prefixes, rarest values first, one of which linked sets must share.

    Of two linked sets with n <= m values, at least ``percent / (100 + percent) *
    (n + m)`` are common; the smaller set may leave out the index prefix but one,
    the larger one the probe prefix.
    """
    index = f"n - cast(ceil({2 * percent} * n / {100 + percent}.0) as bigint) + 1"
    probe = f"n - cast(ceil({percent} * n / 100.0) as bigint) + 1"
    return index, probe


def _listed(reps: DataFrame, percent: int) -> DataFrame:
    """Ids of the sets whose sketch shares one of its rarest values with another's.

    Sketches of linked sets share ``shared_values`` values or, where a sketch is the whole
    set, ``percent`` of them; so one of the other values but one is shared. The
    rarest come first: a passage in a third of the documents does not list them.
    """
    whole = int(K * percent / 100)
    postings = reps.select("id", F.size("sketch").alias("k"), F.explode("sketch").alias("v"))
    shared = materialise(
        postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-values"
    )
    spare = F.expr(
        f"CASE WHEN k <= {whole} THEN k - cast(ceil({percent} * k / 100.0) AS int) + 1 ELSE k - {shared_values(percent)} + 1 END"
    )
    values = postings.join(large(shared), "v").groupBy("id", "k").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values")
    )
    # Values that no other sketch has come first and take their places in the prefix.
    left = F.greatest(spare - (F.col("k") - F.size("values")), F.lit(0))
    prefixes = materialise(
        values.select("id", F.explode(F.slice("values", F.lit(1), left)).alias("x")).select("id", "x.v"), "prefixes"
    )
    lists = materialise(prefixes.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "lists")
    return prefixes.join(large(lists), "v").select("id").distinct()


def _prefix_postings(sets: DataFrame, percent: int) -> DataFrame:
    """``v, id, n, place, own, indexed``: the rarest values of the full sets that two of them share."""
    index, probe = _common_in_lists(percent)
    postings = sets.select("id", "n", F.explode("shingles").alias("v"))
    shared = materialise(postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-shingles")
    ordered = (
        postings.join(large(shared), "v")
        .groupBy("id", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values"))
        .withColumn("own", F.col("n") - F.size("values"))
        .withColumn("probed", F.greatest(F.expr(probe) - F.col("own"), F.lit(0)).cast("int"))
    )
    return (
        ordered.select(
            "id", "n", "own", F.posexplode(F.slice("values", F.lit(1), F.col("probed"))).alias("k", "x")
        )
        .select("id", "n", "own", (F.col("k") + F.col("own")).alias("place"), F.col("x.v").alias("v"))
        .withColumn("indexed", F.expr(f"place < {index}"))
    )


def _may_link(percent: int, a: str, b: str) -> Column:
    """Sizes near enough, and enough values left from the shared one on.

    At the first value that two sets share, all their common values are still to
    come; a linked pair passes there, and need not at later ones.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    most = F.least(n - F.col(f"{a}.place"), m - F.col(f"{b}.place"))
    return (
        (100 * F.least(n, m) >= percent * F.greatest(n, m))
        & (100 * most >= percent * (n + m - most))
        & (F.col(f"{a}.id") != F.col(f"{b}.id"))
    )


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    pairs = materialise(pairs, "pairs")
    full = lambda name: large(sets.select(F.col("id").alias(name), F.col("shingles").alias(f"{name}_set")))
    return materialise(
        pairs.join(full("a"), "a").join(full("b"), "b").select("a", "b", "a_set", "b_set")
        .mapInArrow(_linked(percent), "a binary, b binary"),
        "verified",
    )


def _groups(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, version, n, set_key`` of every row; ``set_key, first`` of every set with words.

    ``first`` has the least ``doc_id, version`` of all rows whose sets links lead to. A set
    is a node by its own 128-bit key, whatever ids its rows have.
    """
    rows = documents(docs).withColumn("version", F.xxhash64("text"))
    marks = materialise(
        rows.mapInArrow(_sketch, "doc_id bigint, version bigint, n bigint, set_key binary, sketch array<bigint>"), "sketches"
    )
    reps = materialise(
        marks.filter("n > 0").groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "version", "n", "sketch")).alias("r"))
        .select(F.col("set_key").alias("id"), "r.n", "r.sketch", "r.doc_id", "r.version"),
        "entries",
    )
    listed = materialise(_listed(reps, percent).join(large(reps.select("id", "doc_id", "version")), "id"), "listed")
    # Rows may share id and text; their set is one.
    sets = materialise(
        rows.join(large(listed.select("doc_id", "version").distinct()), ["doc_id", "version"], "left_semi").select("text")
        .mapInArrow(_sets, "id binary, n bigint, shingles array<bigint>")
        .dropDuplicates(["id"]),
        "sets",
    )
    postings = materialise(_prefix_postings(sets, percent), "postings")
    typical = materialise(
        postings.groupBy("v").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("rare"), "id", "n", "place")).alias("t"),
                                  F.count(F.lit(1)).alias("size"))
        .filter("size > 1").select("v", "t.id", "t.n", "t.place"),
        "typical",
    )
    ordered = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    first = postings.alias("x").join(large(typical).alias("y"), "v").filter(_may_link(percent, "x", "y"))
    links = _verified(first.select(*ordered).distinct(), sets, percent)
    labels = components(links)
    labelled = materialise(
        postings.join(large(labels), F.col("id") == F.col("node"), "left")
        .select(*postings.columns, F.coalesce("component", "id").alias("component")),
        "labelled",
    )
    # Lists within one component are done.
    open_lists = materialise(
        labelled.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi"),
        "open-lists",
    )
    rest = materialise(labelled.join(large(open_lists), "v").select(*labelled.columns), "open-postings")
    smaller, larger = rest.filter("indexed").alias("x"), rest.alias("y")
    cross = smaller.join(
        larger,
        (F.col("x.v") == F.col("y.v"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.struct("x.n", "x.id") < F.struct("y.n", "y.id"))
        & _may_link(percent, "x", "y"),
    )
    more = _verified(cross.select(*ordered).distinct(), sets, percent)
    found = materialise(components(links.unionByName(more)), "components")
    entries = materialise(
        reps.join(large(found), F.col("id") == F.col("node"), "left")
        .select("id", "doc_id", "version", F.coalesce("component", "id").alias("component")),
        "entry-components",
    )
    firsts = materialise(entries.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("first")), "firsts")
    return marks, entries.join(large(firsts), "component").select(F.col("id").alias("set_key"), "first")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Rows are linked if their sets of 5-word shingles have a Jaccard similarity of
    at least ``percent`` hundredths, confirmed on the full sets; ``component_id``
    is the least id that links lead to, and ``kept`` tells whether it is the row's
    own. A text without words is linked with nothing. A row without an id counts
    as the least id. Rows that share an id are told apart by their texts, and each has
    its own links; rows repeated in full share a verdict. An empty table gives an empty
    table; other columns are not read.

    Copies (equal sets) are one entry from the start. Inverted lists of the sketch
    values find the entries that can have a partner; only for these, full sets are
    written. Their rarest shingles are matched, first with the most typical entry
    of each list, so a group of near copies links to a few; then the members of
    different components. Groups that a hot value would make are not expanded, and
    nothing is cut off.
    """
    marks, entries = _groups(docs, percent)
    component = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return marks.join(large(entries), "set_key", "left").select(
        real_id("doc_id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        real_id(component).alias("component_id"),
        (component == F.col("doc_id")).alias("kept"),
    )


def one_of_each(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each group of near duplicates, with all its columns, and all rows without words.

    The row of least id stays; of rows that share it, one.
    """
    _, entries = _groups(docs, percent)
    first = entries.select("first.doc_id", "first.version").distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(text).alias("version"),
        text.rlike(r"[^ \t-\r]").alias("worded"),
    )
    kept = rows.filter("worded").join(large(first), ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    return kept.select("row").unionByName(rows.filter("NOT worded").select("row")).select("row.*")
