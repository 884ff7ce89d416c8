"""Quality rules: fixed rules first, then robust outliers per language and source.

The verdict of the method is a minimum covariance determinant estimate (the mean
and covariance of the three quarters of a group that lie closest together) of
four transformed statistics, and a limit on the Mahalanobis distance from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import BLANKS, as_before, documents, let, real_id, rest_of_row
from marginalia.session import materialise

SYMBOLS = "#*$%&|<>"
GROUP = ["lang", "source"]
# Transformed statistics and the least spread each is given: a group whose rows
# are all alike must not reject a row for a trifle. The floors also keep the
# covariance of a small group from being singular.
FEATURES = {"f_length": 0.06, "f_symbols": 0.06, "f_lines": 0.15, "f_repeats": 0.15}
NAMES = list(FEATURES)
P = len(NAMES)
SCALE = 10_000  # statistics are whole numbers of 1/SCALE, so sums do not depend on their order
SHARE = 0.75  # of a group that the estimate rests on
# Chi-square with four degrees of freedom: SHARE quantile, and 0.975 for the reweighting.
CHI_SHARE, CHI_REWEIGHT = 5.3853, 11.1433
LIMIT = 50.0  # of the squared distance
BINS = 50  # of the distance, per factor e


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _covered(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more.

    Window hashes are sorted with their positions; equal neighbours repeat.
    """
    windows = F.when(
        F.size(words) >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.struct(
                    F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")
                ),
            )
        ),
    ).otherwise(F.array().cast("array<struct<h:bigint,p:int>>"))
    repeated = let(
        windows,
        lambda s: F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
            | ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"])),
        ),
    )
    return let(
        F.sort_array(repeated["p"]),
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0).cast("bigint"),
            lambda a, x: a + x,
        ),
    )


def text_statistics(docs: DataFrame, *columns: Column) -> DataFrame:
    """``doc_id``, the given columns and the counts of the text, in one pass without a shuffle.

    ``n_words, word_chars, n_symbols, n_lines`` (with a word), ``n_dup_lines``,
    ``n_repeat_words``.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    base = documents(docs, *columns)
    given = [c for c in base.columns if c != "text"]
    # Built inside an array: a filter on a count then stays above, and each is computed once.
    counts = F.struct(
        let(_words(text), lambda w: F.struct(F.size(w).alias("n"), _covered(w).alias("r"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))).alias("l"),
        F.length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    return base.select(*given, F.explode(F.array(counts)).alias("counts")).select(
        *given,
        F.col("counts.w.n").cast("bigint").alias("n_words"),
        "counts.word_chars",
        "counts.n_symbols",
        F.col("counts.l.n").cast("bigint").alias("n_lines"),
        F.col("counts.l.d").cast("bigint").alias("n_dup_lines"),
        F.col("counts.w.r").alias("n_repeat_words"),
    )


def _features() -> dict[str, Column]:
    """Statistics on scales where equal steps mean equally much, as whole numbers."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    raw = {
        "f_length": F.log(F.greatest("word_chars", F.lit(1)) / words),
        "f_symbols": F.sqrt(F.col("n_symbols") / words),
        "f_lines": F.sqrt(F.col("n_dup_lines") / lines),
        "f_repeats": F.sqrt(F.col("n_repeat_words") / words),
    }
    return {k: F.round(v * SCALE).cast("bigint") for k, v in raw.items()}


def _quantiles(counts: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key, the least values that reach the given shares of ``n``."""
    upto = Window.partitionBy(*keys).orderBy(value)
    share = F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy(*keys))
    return (
        counts.withColumn("share", share)
        .groupBy(*keys)
        .agg(*[F.min(F.when(F.col("share") >= s, F.col(value))).alias(k) for k, s in shares.items()])
    )


def _start(rows: DataFrame) -> DataFrame:
    """Per group, median and quartile spread of each statistic, as a first estimate."""
    step = SCALE // 200
    long = rows.select(*GROUP, F.posexplode(F.array(*NAMES)).alias("k", "x"))
    counts = long.groupBy(*GROUP, "k", F.floor(F.col("x") / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    parts = _quantiles(counts, [*GROUP, "k"], "bin", {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    floors = F.array(*[F.lit(v) for v in FEATURES.values()])
    spread = (F.col("hi") - F.col("lo")) * (step / SCALE / 1.349)
    parts = parts.select(
        *GROUP, "k", ((F.col("mid") + 0.5) * (step / SCALE)).alias("m"),
        F.sqrt(spread * spread + F.get(floors, "k") * F.get(floors, "k")).alias("s"),
    )
    return parts.groupBy(*GROUP).agg(
        *[F.max(F.when(F.col("k") == i, F.col("m"))).alias(f"m{i}") for i in range(P)],
        *[F.max(F.when(F.col("k") == i, F.col("s"))).alias(f"l{i}{i}") for i in range(P)],
    ).withColumns({f"l{i}{j}": F.lit(0.0) for i in range(P) for j in range(i)})


def _distance(estimate: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows with the squared distance ``d2`` from their group's estimate.

    Solves L y = x - m, row by row, with the factor L of the covariance.
    """
    out = rows.join(estimate, GROUP)
    for i, name in enumerate(NAMES):
        rest = F.col(name) / SCALE - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"y{j}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", d2).select(*rows.columns, "d2")


def _estimate(rows: DataFrame, factor: Column) -> DataFrame:
    """Per group, mean and Cholesky factor of the covariance times ``factor``, with ``log_det``.

    Sums of whole numbers: the same whatever the partitions.
    """
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    product = lambda i, j: (F.col(NAMES[i]) * F.col(NAMES[j])).cast("decimal(20,0)")
    out = rows.groupBy(*GROUP).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        factor.alias("factor"),
        *[F.sum(F.col(NAMES[i])).alias(f"s{i}") for i in range(P)],
        *[F.sum(product(i, j)).alias(f"c{i}{j}") for i, j in pairs],
    )
    out = out.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") / SCALE for i in range(P)})
    for i, j in pairs:
        cov = F.col(f"c{i}{j}").cast("double") / F.col("n") / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}")
        floor = F.lit(FEATURES[NAMES[i]] ** 2) if i == j else F.lit(0.0)
        rest = cov * F.col("factor") + floor
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        entry = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
        out = out.withColumn(f"l{i}{j}", entry)
    log_det = sum((F.log(f"l{i}{i}") for i in range(1, P)), F.log("l00"))
    return out.select(
        *GROUP, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in pairs], log_det.alias("log_det")
    )


def _nearest(rows: DataFrame) -> DataFrame:
    """The closest ``SHARE`` of each group, with the distance ``edge`` that holds it."""
    binned = rows.withColumn("bin", F.floor(F.log(F.col("d2") + 1e-6) * BINS))
    counts = binned.groupBy(*GROUP, "bin").agg(F.count(F.lit(1)).alias("n"))
    edges = materialise(_quantiles(counts, GROUP, "bin", {"edge_bin": SHARE}), "edges")
    return (
        binned.join(edges, GROUP)
        .filter("bin <= edge_bin")
        .withColumn("edge", F.exp((F.col("edge_bin") + 1) / BINS))
    )


def mcd_estimate(rows: DataFrame, steps: int = 10) -> DataFrame:
    """Per group, robust mean and covariance factor, by concentration steps.

    A step keeps the closest ``SHARE`` of each group and estimates anew; the
    determinants fall, and the loop ends once their sum falls by no more than
    1e-4 (at most ``steps``). Groups of any size are handled alike: a step sends
    one row of sums per group and task, and one count per distance bin. The driver
    gets one number per step.
    """
    plain = rows.select(*GROUP, *NAMES)
    estimate, before = materialise(_start(plain), "estimate"), None
    for _ in range(steps):
        estimate = materialise(_estimate(_nearest(_distance(estimate, plain)), F.lit(1.0)), "estimate")
        total = estimate.agg(F.sum(F.round("log_det", 4))).first()[0] or 0.0
        if before is not None and before - total <= 1e-4:
            break
        before = total
    # Consistent under normality, then reweighted with the rows that are no outliers.
    near = _nearest(_distance(estimate, plain))
    estimate = materialise(_estimate(near, F.max("edge") / CHI_SHARE), "estimate")
    inliers = _distance(estimate, plain).filter(F.col("d2") <= CHI_REWEIGHT)
    return materialise(_estimate(inliers, F.lit(1.0)), "estimate")


def _stats(docs: DataFrame, min_words: int, repeat_percent: int, *columns: Column) -> DataFrame:
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in docs.columns else F.lit("").alias(c) for c in GROUP]
    return text_statistics(docs, *group, *columns).withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")),
    ).withColumns(_features())


def of_quality(docs: DataFrame, min_words: int = 50, repeat_percent: int = 50, limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns.

    Statistics are taken once for the estimates and once more beside the texts, so
    that no text is shuffled; the estimates are one row per group.
    """
    stats = materialise(_stats(docs, min_words, repeat_percent).filter("NOT base_failed"), "statistics")
    whole = F.struct(F.col("text"), rest_of_row(docs)).alias("whole")
    passed = _stats(docs, min_words, repeat_percent, whole).filter("NOT base_failed")
    kept = _distance(mcd_estimate(stats), passed).filter(F.col("d2") <= limit)
    return as_before(kept.select("doc_id", "whole.*"), docs)


def quality(docs: DataFrame, min_words: int = 50, repeat_percent: int = 50, limit: float = LIMIT) -> DataFrame:
    """Statistics and verdict of every row.

    ``base_failed``: fewer than ``min_words`` words, or more than
    ``repeat_percent`` of a hundred words in repeated 3-word windows. The others
    of a (lang, source) group are the group's sample; those at a squared distance
    over ``limit`` are rejected. ``limit`` is far beyond the 0.9999 quantile of
    chi-square (23.5), because clean text has heavier tails than the normal.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, d2, kept``; ``d2`` is null where the base rules
    failed. A null text has no words and fails; a null lang or source, or a column
    that is not there, counts as the empty value. A group of one row is its own
    centre and is kept. Repeated rows get equal verdicts. An empty table gives an
    empty table.
    """
    stats = materialise(_stats(docs, min_words, repeat_percent), "statistics")
    passed = stats.filter("NOT base_failed")
    judged = _distance(mcd_estimate(passed), passed).withColumn("kept", F.col("d2") <= limit)
    failed = stats.filter("base_failed").withColumns({"d2": F.lit(None).cast("double"), "kept": F.lit(False)})
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept"]
    return judged.unionByName(failed).select(real_id("doc_id").alias("doc_id"), *counts)
