"""Mixing sources to target weights: whole copies first, then Pareto order sampling.

A source's target is its weight's share of all words, up to ``limit`` times its own
words. A document may be wanted 2.3 times: two copies are certain, and 0.3 is its
chance of a third. Documents are ranked by the odds of a keyed random number over
the odds of that chance, and taken in this order as long as they fit into what is
left of the target. So a sample has a fixed size in words, and every document its
own chance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import documents, rest_of_row
from marginalia.session import materialise

WEIGHTS = (5, 2, 1)
BITS = 52  # of a random number and of a rank
NEAR = 1000  # a source is done when less than its target over this is left
BUCKET_ROWS = 10_000  # that one task may sort at the end of a search
SMALL_ROWS, SMALL_BYTES = 100_000, 8_000_000  # of a table that is sent to every task
KEY = ("rank", "size", "tie")
# Digits of the key from the highest on: six bits each.
DIGITS = [(c, s) for c, top in zip(KEY, (48, 36, 60), strict=True) for s in range(top, -1, -6)]
WORDS = r"[^ \t-\r]++"


def word_count(text: Column) -> Column:
    """Words parted by ASCII blanks."""
    return F.regexp_count(text, F.lit(WORDS)).cast("bigint")


def digits(size: Column) -> Column:
    """Digits of a size: within a source, longer documents have better odds."""
    return F.length(size.cast("string"))


def bounded(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` (written before), for a broadcast if it is small: rows of numbers, and the bytes of its strings."""
    found = df.agg(F.count(F.lit(1)), *[F.sum(F.octet_length(c)) for c in texts]).first()
    small = found[0] <= SMALL_ROWS and sum(n or 0 for n in found[1:]) <= SMALL_BYTES
    return F.broadcast(df) if small else df.hint("merge")


def _filled(groups: Sequence[str], amount: Column, cap: Column, weight: Column, per: Column, order) -> Column:
    """The level that is left for this row and all that meet their cap later, as a rising level fills them."""
    by = Window.partitionBy(*groups).orderBy(cap / weight, *order)
    before = F.coalesce(F.sum(per * cap).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(per * weight).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.try_divide(amount - before, rest)


def _with_level(df: DataFrame, name: str, groups, amount, cap, weight, per, order) -> DataFrame:
    """Adds ``least(cap, level * weight)``, at one level per group so that ``per`` times it sums to ``amount``.

    The level is that of the first row, in the order of caps, that it leaves below
    its cap; later rows would count caps that are not met, and have lower ones.
    """
    everything = Window.partitionBy(*groups)
    df = df.withColumn("_level", _filled(groups, amount, cap, weight, per, order))
    level = F.max(F.when(F.col("_level") <= cap / weight, F.col("_level"))).over(everything)
    return df.withColumn(name, F.coalesce(F.least(cap, level * weight), cap)).drop("_level")


def source_targets(classes: DataFrame, weights: Sequence[float], limit: int, share: float) -> DataFrame:
    """``source, source_no, source_size, target``: one row per source, in code point order, null last.

    The table of sources goes through one task; it is as long as there are names.
    """
    sources = classes.groupBy("source").agg(F.sum("class_size").alias("source_size"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    sources = sources.withColumn("source_no", place).withColumn(
        "_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    )
    size = F.col("source_size").cast("double")
    sources = sources.withColumn("_all", F.sum("source_size").over(Window.partitionBy(F.lit(0))).cast("double") * F.lit(float(share)))
    return _with_level(
        sources, "target", [F.lit(0)], F.col("_all"), F.lit(float(limit)) * size, F.col("_weight"), F.lit(1.0), ["source_no"]
    ).drop("_weight", "_all")


def _plan(sizes: DataFrame, weights: Sequence[float], limit: int, share: float) -> DataFrame:
    """One row per source and class of documents: certain copies, the chance of one more, words left to draw."""
    classes = materialise(sizes.groupBy("source", "weight").agg(F.sum("size").alias("class_size")), "classes")
    targets = materialise(source_targets(classes, weights, limit, share), "targets")
    plan = classes.join(bounded(targets, "source").withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    weight = F.col("weight").cast("double")
    plan = _with_level(
        plan, "wanted", ["source_no"], F.col("target"), F.lit(float(limit)), weight, F.col("class_size").cast("double"), ["weight"]
    )
    certain = F.floor("wanted").cast("int")
    sure = F.sum(F.col("certain") * F.col("class_size")).over(Window.partitionBy("source_no"))
    return materialise(
        plan.withColumn("certain", certain)
        .withColumn("chance", F.col("wanted") - F.col("certain"))
        .withColumn("to_draw", F.greatest(F.floor(F.col("target") - sure), F.lit(0)).cast("bigint")),
        "mix-plan",
    )


def pareto_rank(draw: Column, chance: Column) -> Column:
    """Order of a document: the odds of its random number over the odds of its chance, as a whole number."""
    u = (draw + F.lit(0.5)) / F.lit(float(2**BITS))
    odds, wanted = u / (F.lit(1.0) - u), chance / (F.lit(1.0) - chance)
    return F.floor(odds / (odds + wanted) * F.lit(float(2**BITS))).cast("bigint")


def _key(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in KEY])


def _boxes(rows: DataFrame, box: DataFrame | None, fixed: list[tuple[str, int]], digit: tuple[str, int]) -> DataFrame:
    """Of each source's rows in its box, the part in which the words left end: its digit, words before it, rows in it.

    A source all of whose rows are taken has none.
    """
    inside = _inside(rows, box, fixed) if box is not None else rows.withColumn("base", F.lit(0).cast("bigint"))
    column, shift = digit
    parts = inside.groupBy("source_no", "gap", "tolerance", "base", F.shiftright(column, shift).alias("part")).agg(
        F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.first("rank").alias("_rank"), F.first("size").alias("_size")
    )
    by = Window.partitionBy("source_no").orderBy("part")
    ends = parts.withColumn("after", F.col("base") + F.sum("words").over(by)).filter(F.col("after") >= F.col("gap") - F.col("tolerance"))
    first = ends.withColumn("_k", F.row_number().over(by)).filter("_k = 1")
    # What is fixed so far is the same for all rows of the box.
    known = {"rank": F.col("_rank"), "size": F.col("_size")}
    keep = [
        F.col("part").alias(f"p_{c}") if c == column else F.shiftright(known[c], s).alias(f"p_{c}")
        for c, s in [*[x for x in fixed if x[0] != column], digit]
    ]
    return materialise(first.select("source_no", (F.col("after") - F.col("words")).alias("base"), "n", *keep), "boxes")


def _inside(rows: DataFrame, box: DataFrame, fixed: list[tuple[str, int]]) -> DataFrame:
    """The rows of each source's box."""
    box = bounded(box.withColumnRenamed("source_no", "_no"))
    on = F.col("source_no") == F.col("_no")
    for c, s in fixed:
        on = on & (F.shiftright(c, s) == F.col(f"p_{c}"))
    return rows.join(box, on).select(*rows.columns, "base")


def _pass(ranked: DataFrame, state: DataFrame) -> DataFrame:
    """One walk in rank order up to the first document that does not fit.

    ``state``: ``source_no, gap, tolerance, from``. Adds ``until``, the first key that is
    not taken, and ``left``. The place is found by counts of words per digit of the
    key, one digit after the other until few rows are left per source.
    """
    here = bounded(state.withColumnRenamed("source_no", "_no"))
    rows = ranked.join(here, F.col("source_no") == F.col("_no")).filter((F.col("size") <= F.col("gap")) & (_key() >= F.col("from")))
    rows = rows.select("source_no", *KEY, "gap", "tolerance")
    box, fixed = None, []
    for digit in DIGITS:
        box = _boxes(rows, box, fixed, digit)
        fixed = [*[x for x in fixed if x[0] != digit[0]], digit]
        if (box.agg(F.max("n")).first()[0] or 0) <= BUCKET_ROWS:
            break
    by = Window.partitionBy("source_no").orderBy(*KEY)
    ends = _inside(rows, box, fixed).withColumn("after", F.col("base") + F.sum("size").over(by))
    fits = (F.col("after") <= F.col("gap")) & (F.col("after") - F.col("size") < F.col("gap") - F.col("tolerance"))
    cut = ends.withColumn("fits", fits).groupBy("source_no").agg(
        F.coalesce(F.max(F.when(F.col("fits"), F.col("after"))), F.min("base")).alias("words"),
        F.min(F.when(~F.col("fits"), _key())).alias("misfit"),
        F.max(F.struct("rank", "size", (F.col("tie") + 1).alias("tie"))).alias("end"),
    )
    cut = bounded(materialise(cut, "cuts").withColumnRenamed("source_no", "_no"))
    # Without a box, all that fits one by one fits together.
    last = F.struct(*[F.lit(2**62).alias(c) for c in KEY])
    walked = state.join(cut, F.col("source_no") == F.col("_no"), "left")
    return materialise(
        walked.select(
            "source_no", "gap", "tolerance", "from",
            F.coalesce("misfit", "end", last).alias("until"),
            F.when(F.col("_no").isNotNull(), F.col("gap") - F.col("words")).alias("left"),
        ),
        "walk",
    )


def _walks(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """``source_no, walks``: per source, ranges of keys and the largest size that is taken in each."""
    start = F.struct(*[F.lit(-1).cast("bigint").alias(c) for c in KEY])
    state = plan.groupBy("source_no").agg(
        F.max("to_draw").alias("gap"), F.floor(F.max("target") / NEAR).cast("bigint").alias("tolerance")
    )
    state = materialise(state.filter("gap > tolerance").withColumn("from", start), "walk")
    done = []
    while not state.isEmpty():
        step = _pass(ranked, state)
        done.append(step)
        state = step.filter(F.col("left") > F.col("tolerance")).select("source_no", F.col("left").alias("gap"), "tolerance", F.col("until").alias("from"))
    walk = F.struct("from", "until", F.col("gap").alias("most"))
    found = state.select("source_no", F.struct("from", F.col("from").alias("until"), F.col("gap").alias("most")).alias("walk"))
    for step in done:
        found = found.unionByName(step.select("source_no", walk.alias("walk")))
    return materialise(found.groupBy("source_no").agg(F.collect_list("walk").alias("walks")), "walks")


def mix_counts(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    limit: int = 3,
    share: float = 1.0,
    seed: str = "mix",
    weight: Column | None = None,
    carry: Sequence[Column] = (),
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` of every row, and what ``carry`` names.

    ``size`` is the number of words. Sources, by code point with null last, weigh
    ``weights`` in turn and share ``share`` of all words; a target stops at ``limit``
    times its source's words, and the others share the rest by weight. Within a
    source, a document's wanted copies are in proportion to ``weight`` (an expression
    over ``size``; by default the digits of the size), at most ``limit``; a source
    should have few different weights. ``copies`` is their whole part, and one more
    for documents that are drawn; ``taken`` is ``copies`` times ``size``, so no
    document gives more than ``limit`` times its words. A source's taken words are at
    most its target and reach it but for a thousandth, or what no further document
    fits into.

    Null or empty texts have no words: size 0, nothing taken. A row without an id
    draws by its text. Rows that share an id draw alike; of rows that are equal in
    all, any may be the one that is taken, so that the table is the same in each run.
    An empty table gives an empty table; other columns are not read.
    """
    rows = documents(docs, *carry, F.col("doc_id").alias("_id"), F.col("source").cast("string").alias("source"))
    named = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("text:"), F.md5("text")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), named)), 1, BITS // 4), 16, 10).cast("bigint")
    rows = rows.select(
        *[c for c in rows.columns if c not in ("doc_id", "text", "source", "_id")],
        F.col("_id").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), draw.alias("draw"),
    )
    sizes = materialise(
        rows.withColumn("weight", digits(F.col("size")) if weight is None else weight).withColumn("tie", F.monotonically_increasing_id()), "sizes"
    )
    plan = _plan(sizes, weights, limit, share)
    known = bounded(plan, "source").select(
        F.col("source").alias("_s"), F.col("weight").alias("_w"), "source_no", "source_size", "target", "certain", "chance"
    )
    ranked = materialise(
        sizes.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("weight") == F.col("_w")))
        .withColumn("rank", pareto_rank(F.col("draw"), F.col("chance")))
        .drop("_s", "_w", "draw", "weight"),
        "ranked",
    )
    walks = _walks(ranked.filter("size > 0 AND chance > 0").select("source_no", *KEY), plan)
    found = ranked.join(bounded(walks).withColumnRenamed("source_no", "_no"), F.col("source_no") == F.col("_no"), "left")
    drawn = F.exists("walks", lambda w: (_key() >= w["from"]) & (_key() < w["until"]) & (F.col("size") <= w["most"]))
    drawn = F.coalesce(drawn & (F.col("size") > 0) & (F.col("chance") > 0), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("certain") + drawn.cast("int")).otherwise(F.lit(0))
    own = ("doc_id", "size", "source_size", "target")
    carried = [c for c in ranked.columns if c not in (*own, *KEY, "source", "source_no", "certain", "chance")]
    return found.select(*carried, *own, copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with all their columns, as often as ``mix_counts`` says; texts without words are left out."""
    whole = [F.struct(F.col("doc_id"), F.col("text"), rest_of_row(docs)).alias("_row")]
    counted = mix_counts(docs, carry=whole, **options).filter("taken > 0")
    rows = counted.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    own = {c: F.col("_row").getField(c) for c in ("doc_id", "text")}
    return rows.select(*[own[c].alias(c) if c in own else F.col("_row").getField("rest").getField(c).alias(c) for c in docs.columns])
