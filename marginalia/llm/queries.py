"""The operators over their tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.bpe import encoded_digests
from marginalia.llm.clustering import clusters
from marginalia.llm.exact_dedup import exact_duplicates
from marginalia.llm.katz import katz_scores
from marginalia.llm.licence_texts import TEXTS, notices
from marginalia.llm.licences import COPYRIGHT, RESERVED, SPELLINGS, licence_scan
from marginalia.llm.line_dedup import deduplicated_lines
from marginalia.llm.mixing import BITS, NEAR, WEIGHTS, mix_counts
from marginalia.llm.near_dedup import near_duplicates
from marginalia.llm.negatives import mine
from marginalia.llm.packing import packed
from marginalia.llm.pii import pseudonymise
from marginalia.llm.quality import quality
from marginalia.llm.suffix_dedup import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def documents_table(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS_SQL = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, line, pos, trim({LOWER_SQL.format("line")}, {BLANKS_SQL}) AS key FROM l),
h AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.pos, h.key IS NOT NULL AND k.doc_id <> h.last_doc AS gone
      FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op1_line_dedup", LINES_SQL)
def op1_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return deduplicated_lines(documents_table(spark, sf)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


EXACT_SQL = f"""
WITH d AS (SELECT doc_id, {LOWER_SQL.format("coalesce(text, '')")} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""


@query("op7_exact_dedup", EXACT_SQL)
def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_duplicates(documents_table(spark, sf))


# In production the key comes from the operator's own secret store.
PII_KEY = "surrogates of the registered query"


@query("op3_pii_surrogates")
def op3_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonymise(documents_table(spark, sf), PII_KEY)


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality(documents_table(spark, sf))


def _canonical_sql(text: str) -> str:
    out = f"regexp_replace({LOWER_SQL.format(text)}, '{COPYRIGHT}', chr(10), 'g')"
    out = f"regexp_replace({out}, '{RESERVED}', chr(10), 'g')"
    out = f"regexp_replace({out}, '[^a-z0-9\\n]+', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _whole_sql(lines: str) -> str:
    return f"md5(trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'), ' '))"


def _licences_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in TEXTS + notices())
    return f"""
WITH known AS (
  SELECT {_whole_sql(_canonical_sql("t"))} AS h, any_value(licence) AS licence
  FROM (VALUES {known}) v(licence, t) GROUP BY h),
d AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS lines FROM documents),
l AS (SELECT doc_id, unnest(string_split(lines, chr(10))) AS line,
             unnest(range(len(string_split(lines, chr(10))))) AS pos FROM d),
m AS (SELECT doc_id, string_agg(pos || ':' || licence, ',' ORDER BY pos) AS line_licences, count(*) AS n
      FROM l JOIN known ON known.h = md5(trim(line, ' ')) GROUP BY doc_id)
SELECT d.doc_id, known.licence AS text_licence, coalesce(m.line_licences, '') AS line_licences,
       coalesce(m.n, 0) AS n_lines_matched
FROM d LEFT JOIN known ON known.h = {_whole_sql("d.lines")} LEFT JOIN m ON m.doc_id = d.doc_id
"""


@query("op10_licence_scan", _licences_sql())
def op10_licence_scan(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.transform("line_licences", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["licence"]))
    return licence_scan(documents_table(spark, sf)).select(
        "doc_id", "text_licence", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("line_licences"), "n_lines_matched"
    )


@query("op6_minhash_near_dedup")
def op6_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(documents_table(spark, sf))


@query("op9_bpe_prefix")
def op9_bpe_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return encoded_digests(documents_table(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """With the production vocabulary."""
    return packed(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ("<|endoftext|>", 50256)
    )


@query("op5_packing")
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_documents(documents_table(spark, sf))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(documents_table(spark, sf))


@query("op2_katz_backoff")
def op2_katz_backoff(spark: SparkSession, sf: str) -> DataFrame:
    return katz_scores(documents_table(spark, sf))


def _filled_sql(amount: str, cap: str, weight: str, per: str, over: str, order: str) -> str:
    """How far all rise together if this row and those that meet their cap later share what is left."""
    by = f"{over} ORDER BY {cap} / {weight}, {order} ROWS BETWEEN"
    return (
        f"({amount} - coalesce(sum({per} * {cap}) OVER ({by} UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))"
        f" / nullif(sum({per} * {weight}) OVER ({by} CURRENT ROW AND UNBOUNDED FOLLOWING), 0)"
    )


MIX_SQL = rf"""
WITH RECURSIVE
d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  ('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, ''))))[1:{BITS // 4}])::BIGINT AS draw FROM documents),
k AS (SELECT source, length(size::VARCHAR) AS weight, sum(size)::BIGINT AS class_size FROM d GROUP BY ALL),
s AS (SELECT source, sum(class_size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM k GROUP BY source),
w AS (SELECT *, ([{", ".join(f"{x}::DOUBLE" for x in WEIGHTS)}])[(no - 1) % {len(WEIGHTS)} + 1] AS w, 3.0::DOUBLE * source_size AS cap,
  (sum(source_size) OVER ())::DOUBLE AS everything FROM s),
f AS (SELECT *, {_filled_sql("everything", "cap", "w", "1.0::DOUBLE", "", "no")} AS level FROM w),
t AS (SELECT *, coalesce(least(cap, max(level) FILTER (level <= cap / w) OVER () * w), cap) AS target FROM f),
c AS (SELECT t.source, t.no, t.source_size, t.target, k.weight, k.class_size, 3.0::DOUBLE AS cap, k.weight::DOUBLE AS w,
  k.class_size::DOUBLE AS per FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
g AS (SELECT *, {_filled_sql("target", "cap", "w", "per", "PARTITION BY no", "weight")} AS level FROM c),
h AS (SELECT *, coalesce(least(cap, max(level) FILTER (level <= cap / w) OVER (PARTITION BY no) * w), cap) AS wanted FROM g),
p AS (SELECT *, floor(wanted)::BIGINT AS certain, wanted - floor(wanted) AS chance,
  greatest(floor(target - sum(floor(wanted)::BIGINT * class_size) OVER (PARTITION BY no)), 0)::BIGINT AS to_draw FROM h),
r AS MATERIALIZED (SELECT d.doc_id, d.size, d.draw, p.no, p.source_size, p.target, p.certain, p.chance, p.to_draw,
  (d.draw + 0.5::DOUBLE) / {2**BITS}.0::DOUBLE AS u FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source AND length(d.size::VARCHAR) = p.weight),
o AS MATERIALIZED (SELECT *, u / (1 - u) AS odds, chance / (1 - chance) AS hoped FROM r WHERE size > 0 AND chance > 0),
q AS MATERIALIZED (SELECT doc_id, no, size, to_draw, floor(target / {NEAR})::BIGINT AS tolerance,
  row_number() OVER (PARTITION BY no ORDER BY floor(odds / (odds + hoped) * {2**BITS}.0::DOUBLE)::BIGINT, size, doc_id) AS pos FROM o),
walk AS (SELECT no, 0::BIGINT AS pos, to_draw AS gap, tolerance, NULL::BIGINT AS doc_id, false AS taken FROM q GROUP BY no, to_draw, tolerance
  UNION ALL SELECT q.no, q.pos, CASE WHEN q.size <= w.gap AND w.gap > w.tolerance THEN w.gap - q.size ELSE w.gap END, w.tolerance, q.doc_id,
    q.size <= w.gap AND w.gap > w.tolerance FROM walk w JOIN q ON q.no = w.no AND q.pos = w.pos + 1)
SELECT r.doc_id, r.size, r.source_size, r.target, r.size * (r.certain + coalesce(walk.taken, false)::BIGINT) AS taken
FROM r LEFT JOIN walk ON walk.doc_id = r.doc_id
"""


@query("op12_pareto_mix", MIX_SQL)
def op12_pareto_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_counts(documents_table(spark, sf)).drop("copies")


def embeddings_table(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def _whole_sql(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)"


FINITE_SQL = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    nearest = """n{0} AS (SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT e.vec_id, e.v, c.c, list_sum([(e.v[i] - c.v[i]) * (e.v[i] - c.v[i]) for i in range(1, 65)])::BIGINT AS d
  FROM e CROSS JOIN c{0} c) GROUP BY vec_id)"""
    moved = """s{0} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
  SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM n{0}) GROUP BY c, i),
m{0} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{0} GROUP BY c),
c{1} AS (SELECT c{0}.c, coalesce(m{0}.v, c{0}.v) AS v FROM c{0} LEFT JOIN m{0} ON m{0}.c = c{0}.c)"""
    steps = [x for r in range(rounds) for x in (nearest.format(r), moved.format(r, r + 1))] + [nearest.format(rounds)]
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, {_whole_sql(64)} AS v FROM embeddings WHERE {FINITE_SQL} AND len(embedding) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM e QUALIFY c < {k}),
{", ".join(steps)}
SELECT vec_id, n{rounds}.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY n{rounds}.c))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM n{rounds} JOIN c{rounds} USING (c)
"""


@query("op13_sharded_lloyd", _clusters_sql())
def op13_sharded_lloyd(spark: SparkSession, sf: str) -> DataFrame:
    return clusters(embeddings_table(spark, sf))


NEGATIVES_SQL = f"""
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_whole_sql(256)}::DOUBLE[] AS v
  FROM embeddings WHERE label IS NOT NULL AND {FINITE_SQL}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
  FROM e a JOIN e ON a.vec_id % 100 = 0 AND a.vec_id <> e.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op11_segment_negatives", NEGATIVES_SQL)
def op11_segment_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings_table(spark, sf).withColumn("label", label)
    return mine(rows, rows.filter("vec_id % 100 = 0"))
