"""Registered queries and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import table
from marginalia import fixed_values as fv
from marginalia.functions import classes, markup, text, urls
from marginalia.operators import (
    analysis,
    corpus,
    density,
    descent,
    discriminant,
    embedding,
    latent,
    layout,
    names,
    neighbours,
    relational,
    reviews,
    spectral,
)
from marginalia.plans import corpus as corpus_plans
from marginalia.plans import extraction
from marginalia.session import materialise, scratch_path
from marginalia.sources import readers, writers
from marginalia.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WITH = "with"  # keyword of the given texts
NEEDLE, TARGET = "brand#1", "target"
ENTITIES = ("and", "the of", "to", "with by", "is", "on the", "for")
PARAMS = analysis.AnalysisParams(
    author_needle=NEEDLE, author_label=TARGET, other_label="other", split_date="1998-01-01",
    before_label="before", after_label="after", entities=ENTITIES,
)


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- SQL building blocks ---

# White space spelled out: DuckDB's own class is ASCII.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_paragraphs(html: str) -> str:
    marked = f"regexp_replace({html}, '<br{WS}*/?>', chr(1), 'gi')"
    bare = f"regexp_replace({marked}, '<[^>\\n]*>', '', 'g')"
    return (
        f"list_filter(list_transform(string_split({bare}, chr(1)), lambda p: {sql_strip('p')}), lambda p: p <> '')"
    )


def sql_first_with(paragraphs: str, keyword: str) -> str:
    return f"list_filter({paragraphs}, lambda p: contains(lower(p), '{keyword}'))[1]"


def sql_kwic(width: int) -> str:
    """Over columns para, ws (words), n, hit."""
    first = f"greatest(0, hit - 1 - {width // 2})"
    start = f"(CASE WHEN {first} + {width} >= n THEN greatest(0, n - {width}) ELSE {first} END)"
    end = f"least(n, {start} + {width})"
    return (
        f"CASE WHEN n <= {width} THEN para WHEN hit = 0 THEN array_to_string(ws[1:{width}], ' ') || '...' "
        f"ELSE (CASE WHEN {start} > 0 THEN '... ' ELSE '' END) || array_to_string(ws[{start} + 1:{end}], ' ') "
        f"|| (CASE WHEN {end} < n THEN ' ...' ELSE '' END) END"
    )


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


HOST_SQL = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
LINKS_SQL = f"""
links AS (
  SELECT page_id, url, {HOST_SQL} AS host, unnest(hrefs) AS raw, unnest(range(len(hrefs))) AS pos FROM (
    SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS hrefs FROM pages)
),
resolved AS (SELECT *, CASE WHEN raw LIKE '/%' THEN host || raw ELSE raw END AS href FROM links)"""


# --- URL lists and links ---

@query(
    "url_list_distinct",
    "SELECT DISTINCT split_part(split_part(url, '#', 1), '?', 1) AS url FROM pages ORDER BY url",
)
def url_list_distinct(spark, sf):
    lines = table(spark, sf, "pages").select(
        F.concat(F.lit(" \t"), F.substring_index(F.substring_index("url", "#", 1), "?", 1), F.lit(" ")).alias("value")
    )
    return relational.sort_urls(readers.clean_url_lines(lines))


@query("link_harvest", f"WITH {LINKS_SQL} SELECT page_id, pos, href FROM resolved")
def link_harvest(spark, sf):
    return reviews.harvest_links(table(spark, sf, "pages")).withColumn("pos", big("pos"))


@query(
    "link_first_seen",
    f"""WITH {LINKS_SQL},
    firsts AS (SELECT href, arg_min((host, page_id), (host, page_id)) AS f FROM resolved GROUP BY href)
    SELECT host AS list_no, page_id AS page_no, count(*) AS found,
           (SELECT count(*) FROM firsts WHERE f = (r.host, r.page_id)) AS new
    FROM resolved r GROUP BY host, page_id""",
)
def link_first_seen(spark, sf):
    pages = table(spark, sf, "pages")
    links = reviews.harvest_links(pages.select("page_id", "url", "html"))
    host = F.regexp_extract("url", r"^(https?://[^/?#]*)", 1)
    keyed = pages.select("page_id", host.alias("list_no")).join(links, "page_id").select(
        "list_no", F.col("page_id").alias("page_no"), F.col("href").alias("url")
    )
    return corpus.first_seen(keyed)


@query(
    "book_links",
    f"""WITH {fx.LIST_PAGES_SQL}
    SELECT page_id, 0::BIGINT AS pos, '{fx.SITE}/book/show/' || floor(o_totalprice / 100)::BIGINT AS href FROM list_pages""",
)
def book_links(spark, sf):
    links = reviews.harvest_links(fx.list_pages(spark, sf), fv.BOOK_LINK_CLASS)
    return links.withColumn("pos", big("pos"))


@query(
    "crawl_coverage",
    f"""WITH {fx.LIST_PAGES_SQL}
    SELECT list_no, max(page_no) AS pages, bool_or(last) AS complete FROM list_pages GROUP BY list_no""",
)
def crawl_coverage(spark, sf):
    return reviews.crawl_coverage(fx.list_pages(spark, sf)).withColumn("pages", big("pages"))


@query(
    "sorted_list_round_trip",
    f"SELECT DISTINCT {sql_strip('url')} AS url FROM pages",
)
def sorted_list_round_trip(spark, sf):
    path = scratch_path(spark, "sorted-list")
    writers.write_sorted_lines(table(spark, sf, "pages"), "url", path)
    return readers.read_url_list(spark, path)


# --- works, retry rounds, ledger ---

@query(
    "canonical_works",
    f"""WITH {fx.BOOKS_SQL}
    SELECT work_id, min(canonical_url) AS canonical_url FROM books WHERE work_id IS NOT NULL GROUP BY work_id""",
)
def canonical_works(spark, sf):
    found = fx.book_pages(spark, sf).select(F.lit(1).alias("attempt"), markup.canonical_url("html").alias("canonical_url"))
    return corpus.canonical_works(found)


def settled_log(spark, sf):
    return materialise(corpus.settled_urls(fx.attempt_log(spark, sf)), "settled")


@query("retry_rounds", f"WITH {fx.ATTEMPTS_SQL} SELECT attempt, pending, new_works FROM rounds")
def retry_rounds(spark, sf):
    return corpus.retry_rounds(settled_log(spark, sf)).withColumn("attempt", big("attempt"))


@query("fallback_pass", f"WITH {fx.ATTEMPTS_SQL} SELECT url, canonical_url, work_id FROM late")
def fallback_pass(spark, sf):
    pending = corpus.pending_after_rounds(settled_log(spark, sf))
    return corpus.fallback_pass(pending, fx.fallback_log(spark, sf))


@query("unique_works", f"WITH {fx.ATTEMPTS_SQL} SELECT work_id, canonical_url FROM works")
def unique_works(spark, sf):
    return corpus.unique_works(settled_log(spark, sf), fx.fallback_log(spark, sf))


@query(
    "still_pending",
    f"WITH {fx.ATTEMPTS_SQL} SELECT url FROM pending WHERE url NOT IN (SELECT url FROM late)",
)
def still_pending(spark, sf):
    pending = corpus.pending_after_rounds(settled_log(spark, sf))
    return corpus.still_pending(pending, fx.fallback_log(spark, sf))


@query(
    "funnel_counts",
    f"""WITH {fx.ATTEMPTS_SQL}
    SELECT (SELECT count(DISTINCT url) FROM attempts) AS input_urls, (SELECT count(*) FROM works) AS unique_works,
           (SELECT count(*) FROM pending) - (SELECT count(*) FROM late) AS unprocessed""",
)
def funnel_counts(spark, sf):
    settled = settled_log(spark, sf)
    return corpus.funnel(settled.select("url"), settled, fx.fallback_log(spark, sf))


ORDER_URL = f"'{fx.SITE}/o/' || o_orderkey"


@query("backlog", f"SELECT {ORDER_URL} AS url FROM orders WHERE o_orderstatus = 'P'")
def backlog(spark, sf):
    return corpus.backlog(fx.order_urls(spark, sf), fx.order_ledger(spark, sf))


@query(
    "next_batch",
    f"""SELECT url FROM (SELECT {ORDER_URL} AS url FROM orders WHERE o_orderstatus = 'P')
    ORDER BY md5('7:' || url), url LIMIT {fv.BATCH_SIZE}""",
)
def next_batch(spark, sf):
    return corpus.next_batch(backlog(spark, sf), fv.BATCH_SIZE, seed=7)


@query(
    "backlog_counts",
    f"""SELECT count(*) AS remaining, least(count(*), {fv.BATCH_SIZE}) AS in_batch,
    greatest(count(*) - {fv.BATCH_SIZE}, 0) AS remaining_after FROM orders WHERE o_orderstatus = 'P'""",
)
def backlog_counts(spark, sf):
    return corpus.backlog_counts(fx.order_urls(spark, sf), fx.order_ledger(spark, sf))


@query(
    "ledger_union",
    f"""SELECT {ORDER_URL} AS url FROM orders
    EXCEPT SELECT {ORDER_URL} FROM orders WHERE o_orderstatus = 'O'""",
)
def ledger_union(spark, sf):
    """Three status lists, one never written, minus one of them; waiting URLs added."""
    ledger = fx.order_ledger(spark, sf)
    lists = {s: scratch_path(spark, f"list-{s}") for s in (fv.VALID_MATCH, fv.NO_MATCH, fv.FAILURE)}
    for status in (fv.VALID_MATCH, fv.NO_MATCH):
        writers.write_sorted_lines(ledger.filter(F.col("status") == status), "url", lists[status])
    read = readers.read_status_lists(spark, lists)
    unmatched = read.filter(F.col("status") == fv.NO_MATCH).select("url")
    waiting = corpus.backlog(fx.order_urls(spark, sf), read)
    return relational.minus(corpus.processed_urls(read).unionByName(waiting), unmatched)


MATCH_SQL = f"""
match AS (
  SELECT url, CASE WHEN any_value(page_id) % 17 = 0 THEN 'FAILURE'
                   WHEN bool_or(lang <> 'es' AND contains(lower(text), '{WITH}')) THEN 'VALID_MATCH'
                   ELSE 'NO_MATCH' END AS status,
         CASE WHEN any_value(page_id) % 17 = 0 THEN 'LostPage' END AS error_type
  FROM cards GROUP BY url
)"""


def checked_pages(spark, sf):
    """One page in seventeen was lost, as a failed fetch leaves it."""
    lost = F.col("page_id") % 17 == 0
    return fx.review_pages(spark, sf).select(
        "page_id", "url", F.when(~lost, F.col("html")).alias("html"), F.when(lost, "LostPage").alias("error_type")
    )


@query("match_status", f"WITH {fx.CARDS_SQL}, {MATCH_SQL} SELECT url, status, error_type FROM match")
def match_status(spark, sf):
    return reviews.match_status(checked_pages(spark, sf), WITH)


@query("status_counts", f"WITH {fx.CARDS_SQL}, {MATCH_SQL} SELECT status, count(*) AS n FROM match GROUP BY status")
def status_counts(spark, sf):
    return corpus.status_counts(match_status(spark, sf))


@query("ledger_round_trip", f"WITH {fx.CARDS_SQL}, {MATCH_SQL} SELECT url, status, error_type FROM match")
def ledger_round_trip(spark, sf):
    path = scratch_path(spark, "ledger")
    results = materialise(match_status(spark, sf), "results")
    writers.append_by_status(results.filter(F.col("status") != fv.FAILURE), path, "first")
    writers.append_by_status(results.filter(F.col("status") == fv.FAILURE), path, "second")
    writers.append_by_status(results.filter(F.col("status") == fv.FAILURE), path, "second")
    return readers.read_ledger(spark, path).select("url", "status", "error_type")


# --- text ---

@query("stripped_text", f"SELECT doc_id, {sql_strip('text')} AS stripped, {sql_strip(f'''regexp_replace(text, '{WS}+', ' ', 'g')''')} AS collapsed FROM documents")
def stripped_text(spark, sf):
    padded = F.concat(F.lit("\t  \n"), F.col("text"), F.lit(" \x1f\r\n"))
    return table(spark, sf, "documents").select(
        "doc_id", text.strip(padded).alias("stripped"), text.collapse_ws(padded).alias("collapsed")
    )


@query(
    "break_pieces",
    "SELECT page_id, unnest(range(len(p))) AS pos, unnest(p) AS piece FROM "
    f"(SELECT page_id, regexp_split_to_array(html, '(?i)<br{WS}*/?>') AS p FROM pages)",
)
def break_pieces(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(text.split_br("html")).alias("pos", "piece")).withColumn(
        "pos", big("pos")
    )


@query(
    "paragraphs",
    f"SELECT page_id, unnest(range(len(p))) AS pos, unnest(p) AS para FROM (SELECT page_id, {sql_paragraphs('html')} AS p FROM pages)",
)
def paragraphs(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(text.paragraphs("html")).alias("pos", "para")).withColumn(
        "pos", big("pos")
    )


HITS_SQL = f"""hits AS (
  SELECT page_id, {sql_first_with(sql_paragraphs('html'), WITH)} AS para FROM pages
)"""


@query("keyword_paragraph", f"WITH {HITS_SQL} SELECT page_id, para FROM hits WHERE para IS NOT NULL")
def keyword_paragraph(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.keyword_paragraph("html", WITH).alias("para")).filter(
        F.col("para").isNotNull()
    )


@query(
    "keyword_context",
    f"""WITH {HITS_SQL},
    w AS (SELECT page_id, para, {sql_words('para')} AS ws FROM hits WHERE para IS NOT NULL),
    k AS (SELECT *, len(ws) AS n, coalesce(list_position(list_transform(ws, lambda x: contains(lower(x), '{WITH}')), true), 0) AS hit FROM w)
    SELECT page_id, {sql_kwic(20)} AS context_20, {sql_kwic(fv.MAX_WORDS)} AS context_500 FROM k""",
)
def keyword_context(spark, sf):
    para = text.keyword_paragraph("html", WITH)
    return (
        table(spark, sf, "pages")
        .select("page_id", para.alias("para"))
        .filter(F.col("para").isNotNull())
        .select("page_id", text.kwic("para", WITH, 20).alias("context_20"), text.kwic("para", WITH).alias("context_500"))
    )


def sql_without_entities(x: str) -> str:
    for e in ENTITIES:
        x = f"regexp_replace({x}, '\\b{e}\\b', '', 'gi')"
    return sql_strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


@query("entity_removal", f"SELECT doc_id, {sql_without_entities('text')} AS cleaned FROM documents")
def entity_removal(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.remove_entities("text", ENTITIES).alias("cleaned"))


@query("snippet", f"SELECT doc_id, substr(text, 1, {fv.SNIPPET_CHARS}) || '...' AS short FROM documents")
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.snippet("text").alias("short"))


# --- review cards and metadata ---

@query(
    "review_cards",
    f"WITH {fx.CARDS_SQL} SELECT page_id, url, pos, review_id, date, stars, body FROM cards WHERE lang <> 'es'",
)
def review_cards(spark, sf):
    return reviews.review_cards(fx.review_pages(spark, sf)).withColumn("pos", big("pos"))


KEPT_SQL = f"""
kept AS (
  SELECT DISTINCT url, page_id, review_id, date, stars, text,
         'shelf book ' || page_id AS book_name
  FROM cards WHERE lang <> 'es' AND contains(lower(text), '{WITH}')
),
kept_para AS (SELECT *, {sql_first_with("list_filter(list_transform(string_split(text, chr(10)), lambda p: " + sql_strip("p") + "), lambda p: p <> '')", WITH)} AS para FROM kept),
kept_words AS (SELECT *, {sql_words('para')} AS ws FROM kept_para),
kept_hit AS (SELECT *, len(ws) AS n, coalesce(list_position(list_transform(ws, lambda x: contains(lower(x), '{WITH}')), true), 0) AS hit FROM kept_words),
accepted AS (SELECT url, review_id, book_name, stars, date, {sql_kwic(fv.MAX_WORDS)} AS context FROM kept_hit)"""


@query(
    "review_keep_first",
    f"WITH {fx.CARDS_SQL}, {KEPT_SQL} SELECT url, review_id, book_name, stars, date, context FROM accepted",
)
def review_keep_first(spark, sf):
    return reviews.accepted_reviews(fx.review_pages(spark, sf), WITH)


@query(
    "keyword_review_count",
    f"WITH {fx.CARDS_SQL}, {KEPT_SQL} SELECT url, count(*) AS keyword_review_count FROM accepted GROUP BY url",
)
def keyword_review_count(spark, sf):
    return reviews.keyword_review_count(review_keep_first(spark, sf))


@query(
    "book_metadata",
    f"WITH {fx.BOOKS_SQL} SELECT url, book_name, author, avg_rating, total_reviews, release_date, genres FROM books",
)
def book_metadata(spark, sf):
    return reviews.book_metadata(fx.book_pages(spark, sf))


def reviews_by_book(spark, sf):
    return review_keep_first(spark, sf).withColumn("url", urls.book_url("url"))


def relevant(spark, sf):
    found = materialise(reviews_by_book(spark, sf), "found")
    return reviews.relevant_books(found, reviews.relevant_metadata(fx.book_pages(spark, sf), found))


@query(
    "relevant_books",
    f"""WITH {fx.CARDS_SQL}, {KEPT_SQL}, {fx.BOOKS_SQL}
    SELECT b.url, b.author, b.genres, count(*) AS keyword_review_count
    FROM books b JOIN accepted a ON a.url = b.url || '/reviews' GROUP BY ALL""",
)
def relevant_books(spark, sf):
    return relevant(spark, sf)[1].select("url", "author", "genres", "keyword_review_count")


@query(
    "relevant_reviews",
    f"""WITH {fx.CARDS_SQL}, {KEPT_SQL}, {fx.BOOKS_SQL}
    SELECT b.url, a.review_id, a.stars, a.context FROM accepted a JOIN books b ON a.url = b.url || '/reviews'""",
)
def relevant_reviews(spark, sf):
    return relevant(spark, sf)[0].select("url", "review_id", "stars", "context")


@query(
    "summary_columns",
    f"""WITH {fx.CARDS_SQL}, {KEPT_SQL}, {fx.BOOKS_SQL}
    SELECT b.book_name, b.author, b.avg_rating, b.total_reviews, count(*) AS keyword_review_count, b.release_date, b.genres
    FROM books b JOIN accepted a ON a.url = b.url || '/reviews' GROUP BY ALL""",
)
def summary_columns(spark, sf):
    return reviews.summary_columns(relevant(spark, sf)[1])


@query(
    "typed_summary",
    f"""WITH {fx.BOOKS_SQL}
    SELECT url, TRY_CAST(avg_rating AS DOUBLE) AS avg_rating, TRY_CAST(total_reviews AS BIGINT) AS total_reviews,
      CASE WHEN author <> 'Not Found' THEN len(string_split(author, ' | ')) END AS authors,
      CASE WHEN genres = '' THEN 0 WHEN genres <> 'Not Found' THEN len(string_split(genres, ' | ')) END AS genres
    FROM books""",
)
def typed_summary(spark, sf):
    typed = classes.typed_summary(book_metadata(spark, sf))
    return typed.select(
        "url", "avg_rating", "total_reviews", big(F.size("author")).alias("authors"), big(F.size("genres")).alias("genres")
    )


@query(
    "snapshot_union",
    f"""WITH {fx.CARDS_SQL} SELECT url, pos, review_id FROM cards WHERE lang <> 'es'
    UNION ALL SELECT '{fx.SITE}/doc/' || doc_id, copy, review_id FROM cards WHERE lang <> 'es'""",
)
def snapshot_union(spark, sf):
    single = fx.single_card_pages(table(spark, sf, "documents"), table(spark, sf, "orders"))
    both = relational.collect_results(
        reviews.review_cards(fx.review_pages(spark, sf)), reviews.review_cards(single)
    )
    return both.select("url", big("pos").alias("pos"), "review_id")


@query(
    "row_counts",
    f'WITH {fx.CARDS_SQL}, {KEPT_SQL} SELECT count(*) AS "rows", count(DISTINCT url) AS distinct_url FROM accepted',
)
def row_counts(spark, sf):
    return relational.row_counts(review_keep_first(spark, sf), "url")


# --- names ---

@query(
    "reviews_url",
    f"""WITH {fx.NAMES_SQL} SELECT p_partkey, CASE WHEN contains(book_name, '/reviews') THEN book_name
    ELSE split_part(book_name, '?', 1) || '/reviews' END AS reviews_url FROM names""",
)
def reviews_url(spark, sf):
    return fx.name_rows(spark, sf).select("p_partkey", urls.reviews_url("book_name").alias("reviews_url"))


@query(
    "book_url",
    f"""WITH {fx.NAMES_SQL}
    SELECT p_partkey, replace(split_part(book_name, '?', 1), '/reviews', '') AS book_url FROM names""",
)
def book_url(spark, sf):
    return fx.name_rows(spark, sf).select("p_partkey", urls.book_url("book_name").alias("book_url"))


@query(
    "book_name_dot",
    f"""WITH {fx.NAMES_SQL} SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN p_name
    ELSE 'URL_ID_' || regexp_extract(book_name, '/show/([0-9]+)', 1) END AS book_name FROM names""",
)
def book_name_dot(spark, sf):
    return fx.name_rows(spark, sf).select("p_partkey", urls.book_name_dot("book_name").alias("book_name"))


@query(
    "book_name_any",
    f"""WITH {fx.NAMES_SQL} SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE', 'PROMO') THEN fixed
    ELSE 'URL_Parse_Error_For_' || book_name END AS book_name FROM names""",
)
def book_name_any(spark, sf):
    return fx.name_rows(spark, sf).select("p_partkey", urls.book_name_any("book_name").alias("book_name"))


@query("name_repair", f"WITH {fx.NAMES_SQL} SELECT p_partkey, fixed AS book_name FROM names")
def name_repair(spark, sf):
    return names.fix_names(fx.name_rows(spark, sf)).select("p_partkey", "book_name")


@query("name_map_join", f"WITH {fx.NAMES_SQL} SELECT p_partkey, fixed AS book_name FROM names")
def name_map_join(spark, sf):
    rows = fx.name_rows(spark, sf)
    return names.apply_name_map(rows, names.name_map(rows)).select("p_partkey", "book_name")


@query("bad_names", f"WITH {fx.NAMES_SQL} SELECT DISTINCT book_name FROM names WHERE p_type <> 'STANDARD'")
def bad_names(spark, sf):
    return names.bad_names(fx.name_rows(spark, sf))


@query(
    "repair_counts",
    f"""WITH {fx.NAMES_SQL} SELECT count(*) AS "rows", count(DISTINCT book_name) AS names
    FROM names WHERE p_type <> 'STANDARD'""",
)
def repair_counts(spark, sf):
    return names.repair_counts(fx.name_rows(spark, sf))


# --- the steps end to end, through their files ---

@query(
    "plan_discover",
    f"""WITH {fx.LIST_PAGES_SQL}
    SELECT DISTINCT '{fx.SITE}/book/show/' || floor(o_totalprice / 100)::BIGINT AS url FROM list_pages""",
)
def plan_discover(spark, sf):
    path = scratch_path(spark, "discovered")
    corpus_plans.discover(fx.list_pages(spark, sf), path)
    return readers.read_url_list(spark, path)


@query("plan_deduplicate", f"WITH {fx.ATTEMPTS_SQL} SELECT canonical_url AS url FROM works")
def plan_deduplicate(spark, sf):
    path = scratch_path(spark, "unique")
    corpus_plans.deduplicate(fx.attempt_log(spark, sf), fx.fallback_log(spark, sf), path)
    return readers.read_url_list(spark, path)


@query(
    "plan_verify",
    f"""WITH {fx.CARDS_SQL}, {MATCH_SQL}
    SELECT replace(url, '/reviews', '') AS url, status, CASE WHEN status = 'FAILURE' THEN 'MissingPage' END AS error_type FROM match""",
)
def plan_verify(spark, sf):
    """Two batches from one list into one ledger; the second takes what the first has left."""
    listed, ledger = scratch_path(spark, "to-verify"), scratch_path(spark, "verified")
    pages = materialise(checked_pages(spark, sf).drop("error_type"), "pages")
    writers.write_sorted_lines(pages.select(urls.book_url("url").alias("url")), "url", listed)
    for n in (25, 100_000):
        corpus_plans.verify_batch(spark, listed, pages, ledger, n, keyword=WITH)
    return readers.read_ledger(spark, ledger).select("url", "status", "error_type")


@query(
    "plan_extract",
    f"""WITH {fx.CARDS_SQL}, {KEPT_SQL}, {fx.BOOKS_SQL}
    SELECT b.book_name, b.author, b.avg_rating, b.total_reviews, count(*)::VARCHAR AS keyword_review_count, b.release_date,
           nullif(b.genres, '') AS genres
    FROM books b JOIN accepted a ON a.url = b.url || '/reviews' GROUP BY ALL""",
)
def plan_extract(spark, sf):
    """Listed books and one table of all pages to the two CSV tables; the summary, read again."""
    books = fx.book_pages(spark, sf)
    pages = fx.review_pages(spark, sf).select("page_id", "url", "html").unionByName(books)
    found, summary = scratch_path(spark, "reviews-csv"), scratch_path(spark, "summary-csv")
    extraction.extract_to_csv(books.select("url"), pages, found, summary, keyword=WITH)
    read = readers.read_summary_csv(spark, summary)
    return read.withColumn("keyword_review_count", F.col("keyword_review_count").cast("string"))


@query("plan_repair", f"WITH {fx.NAMES_SQL} SELECT fixed AS book_name, p_partkey::VARCHAR AS context FROM names")
def plan_repair(spark, sf):
    path, out = scratch_path(spark, "broken-csv"), scratch_path(spark, "repaired-csv")
    key = F.col("p_partkey").cast("string").alias("context")
    rows = fx.name_rows(spark, sf).select("book_name", F.lit("5").alias("stars"), F.lit("May 1, 2020").alias("date"), key)
    writers.write_csv(rows, path)
    extraction.repair_csv(spark, path, out, "reviews")
    return readers.read_reviews_csv(spark, out).select("book_name", "context")


# --- analysis ---

def analysis_input(spark, sf):
    return fx.analysis_reviews(spark, sf), fx.analysis_summary(spark, sf)


@query("join_key_left_join", f"WITH {fx.ANALYSIS_SQL} SELECT doc_id, book_name, stars, date, author FROM joined")
def join_key_left_join(spark, sf):
    return analysis.with_metadata(*analysis_input(spark, sf)).select("doc_id", "book_name", "stars", "date", "author")


CLASSES_SQL = f"""
classed AS (
  SELECT *, CASE WHEN contains(lower(author), '{NEEDLE}') THEN '{TARGET}' ELSE 'other' END AS author_class,
         CASE WHEN day < TIMESTAMP '1998-01-01' THEN 'before' ELSE 'after' END AS period
  FROM joined WHERE day IS NOT NULL
)"""


@query(
    "author_class",
    f"""WITH {fx.ANALYSIS_SQL} SELECT doc_id, author,
    CASE WHEN contains(lower(author), '{NEEDLE}') THEN '{TARGET}' ELSE 'other' END AS author_class,
    contains(lower(author), '{NEEDLE}') AS is_target FROM joined""",
)
def author_class(spark, sf):
    cls = classes.author_class("author", NEEDLE, TARGET, "other")
    return join_key_left_join(spark, sf).select("doc_id", "author", cls.alias("author_class")).withColumn(
        "is_target", classes.class_mask("author_class", TARGET)
    )


@query(
    "period_class",
    f"WITH {fx.ANALYSIS_SQL}, {CLASSES_SQL} SELECT doc_id, strftime(day, '%Y-%m-%d') AS day, period FROM classed",
)
def period_class(spark, sf):
    rows = analysis.with_classes(analysis.with_metadata(*analysis_input(spark, sf)), PARAMS)
    return rows.select("doc_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "period")


@query(
    "class_period_counts",
    f"""WITH {fx.ANALYSIS_SQL}, {CLASSES_SQL}
    SELECT author_class, period, count(*) AS n FROM classed WHERE contains(lower(context), '{WITH}') GROUP BY ALL""",
)
def class_period_counts(spark, sf):
    found, summary = analysis_input(spark, sf)
    hit = text.keyword_paragraph(F.replace(F.col("context"), F.lit("\n"), F.lit("<br />")), WITH)
    rows = analysis.with_metadata(found.filter(hit.isNotNull()), summary)
    return analysis.class_period_counts(analysis.with_classes(rows, PARAMS))


@query(
    "analysis_frame",
    f"""WITH {fx.ANALYSIS_SQL}, {CLASSES_SQL}
    SELECT doc_id, author_class, period, {sql_without_entities('context')} AS context_cleaned,
           substr(context, 1, {fv.SNIPPET_CHARS}) || '...' AS context_short,
           sha256({sql_without_entities('context')}) AS text_hash FROM classed""",
)
def analysis_frame(spark, sf):
    frame = analysis.analysis_columns(analysis.with_metadata(*analysis_input(spark, sf)), PARAMS)
    return frame.select("doc_id", "author_class", "period", "context_cleaned", "context_short", "text_hash")


# --- tables on disk ---

@query(
    "csv_round_trip",
    "SELECT source AS book_name, lang AS stars, n_chars::VARCHAR AS date, text AS context FROM documents",
)
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "reviews-csv")
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("book_name"), F.col("lang").alias("stars"),
        F.col("n_chars").cast("string").alias("date"), F.col("text").alias("context"),
    )
    writers.write_csv_if_any(rows, path)
    return readers.read_reviews_csv(spark, path)


@query(
    "embedding_round_trip",
    """SELECT vec_id::VARCHAR AS text_hash, unnest(range(64)) AS dim,
    round(unnest(embedding)::DOUBLE, 6) AS v FROM embeddings""",
)
def embedding_round_trip(spark, sf):
    path = scratch_path(spark, "embeddings")
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("text_hash"), "embedding", F.lit("given").alias("encoder")
    )
    writers.append_embeddings(rows, path)
    back = readers.read_embeddings(spark, path, "given")
    return back.select("text_hash", F.posexplode("embedding").alias("dim", "v")).select(
        "text_hash", big("dim").alias("dim"), F.round(F.col("v").cast("double"), 6).alias("v")
    )


# --- vectors ---

def tokens_sql(rows: str) -> str:
    return f"""
texts AS (SELECT DISTINCT text FROM {rows}),
slots AS (
  SELECT text, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS slot, count(*) AS c
  FROM (SELECT text, unnest({sql_words('lower(text)')}) AS w FROM texts) GROUP BY ALL
),
weights AS (SELECT sha256(text) AS text_hash, slot, c / sqrt(sum(c * c) OVER (PARTITION BY text)) AS w FROM slots)"""


TOKENS_SQL = tokens_sql("documents")


@query(
    "map_table",
    f"""WITH {fx.ANALYSIS_SQL}, {CLASSES_SQL},
    cleaned AS (SELECT *, {sql_without_entities('context')} AS text FROM classed), {tokens_sql('cleaned')},
    places AS (SELECT text_hash, coalesce(max(w) FILTER (slot = 0), 0) AS x, coalesce(max(w) FILTER (slot = 1), 0) AS y
               FROM weights GROUP BY text_hash)
    SELECT round(coalesce(x, 0), 4) AS x, round(coalesce(y, 0), 4) AS y, author_class, book_name, author, stars, period,
           substr(context, 1, {fv.SNIPPET_CHARS}) || '...' AS context_short
    FROM cleaned LEFT JOIN places ON text_hash = sha256(text)""",
)
def map_table(spark, sf):
    """Written and read back; the first two dimensions of the texts' vectors stand for positions."""
    frame = analysis.analysis_columns(analysis.with_metadata(*analysis_input(spark, sf)), PARAMS)
    places = embedding.embed(frame, "context_cleaned").select(
        "text_hash",
        F.round(F.col("embedding")[0].cast("double"), 4).alias("x"),
        F.round(F.col("embedding")[1].cast("double"), 4).alias("y"),
    )
    path = scratch_path(spark, "map-points")
    writers.write_map_points(layout.map_points(frame, places), path)
    return spark.read.parquet(path)


@query("embed_hashing", f"WITH {TOKENS_SQL} SELECT text_hash, slot, round(w, 4) AS w FROM weights")
def embed_hashing(spark, sf):
    vectors = embedding.embed(table(spark, sf, "documents"), "text")
    return (
        vectors.select("text_hash", F.posexplode("embedding").alias("slot", "w"))
        .filter(F.col("w") > 0)
        .select("text_hash", big("slot").alias("slot"), F.round(F.col("w").cast("double"), 4).alias("w"))
    )


@query(
    "embed_cache_delta",
    "SELECT doc_id, sha256(text) AS text_hash, 256::BIGINT AS dim FROM documents",
)
def embed_cache_delta(spark, sf):
    """English texts are cached first, then all; each text is embedded once."""
    path = scratch_path(spark, "embedding-cache")
    docs = table(spark, sf, "documents")
    embedding.embed_cached(docs.filter(F.col("lang") == "en"), "text", path, "hashing-256")
    cached = embedding.embed_cached(docs, "text", path, "hashing-256")
    rows = embedding.attach_embeddings(docs.select("doc_id", "text"), cached, "text")
    return rows.select("doc_id", "text_hash", big(F.size("embedding")).alias("dim"))


KNN_SQL = """
e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
knn AS (
  SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS dist,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank
  FROM e a JOIN e b ON a.vec_id <> b.vec_id
  QUALIFY rank <= {k}
)"""


@query("knn_graph", f"WITH {KNN_SQL.format(k=15)} SELECT src, dst, rank, round(dist, 6) AS dist FROM knn")
def knn_graph(spark, sf):
    graph = neighbours.knn_graph(table(spark, sf, "embeddings"), 15)
    return graph.select("src", "dst", big("rank").alias("rank"), F.round("dist", 6).alias("dist"))


@query(
    "fuzzy_edges",
    f"""WITH RECURSIVE {KNN_SQL.format(k=14)},
    lists AS (SELECT src, list(dst ORDER BY rank) AS dsts, list(dist ORDER BY rank) AS ds FROM knn GROUP BY src),
    over_rho AS (
      SELECT src, dsts, list_transform(ds, lambda d: greatest(d - list_min(list_filter(ds, lambda q: q > 0)), 0)) AS o FROM lists
    ),
    bisect AS (
      SELECT src, o, 0 AS step, 0.0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1.0::DOUBLE AS sigma FROM over_rho
      UNION ALL
      SELECT src, o, step + 1, CASE WHEN up THEN lo ELSE sigma END, CASE WHEN up THEN sigma ELSE hi END,
             CASE WHEN up THEN (lo + sigma) / 2 WHEN isinf(hi) THEN sigma * 2 ELSE (sigma + hi) / 2 END
      FROM (SELECT *, list_sum(list_transform(o, lambda d: exp(-d / sigma))) > log2(15) AS up FROM bisect WHERE step < 64)
    ),
    directed AS (
      SELECT src, unnest(dsts) AS dst, unnest(list_transform(b.o, lambda d: exp(-d / sigma))) AS w
      FROM bisect b JOIN over_rho USING (src) WHERE step = 64
    )
    SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst,
           round(coalesce(a.w, 0) + coalesce(b.w, 0) - coalesce(a.w, 0) * coalesce(b.w, 0), 5) AS weight
    FROM directed a FULL JOIN directed b ON a.src = b.dst AND a.dst = b.src""",
)
def fuzzy_edges(spark, sf):
    graph = neighbours.knn_graph(table(spark, sf, "embeddings"), fv.MAP_NEIGHBOURS - 1)
    return layout.fuzzy_edges(graph).withColumn("weight", F.round("weight", 5))


@query("latent_axes", "SELECT count(DISTINCT text) AS texts, 16 AS dims, true AS unit_length, true AS nearly_all_captured FROM documents")
def latent_axes(spark, sf):
    """Vectors of all documents; their axes against the exact ones, over few slots."""
    texts = materialise(latent.text_slots(table(spark, sf, "documents"), "text", 256), "latent-slots")
    model = latent.fit_latent(texts, None, 16, slots=256)
    near = model.captured >= 0.99 * latent.exact_share(texts, None, model)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return latent.embed_latent(texts, None, model).agg(
        F.count(F.lit(1)).alias("texts"), F.max(F.size("embedding")).alias("dims"),
        F.bool_and((F.abs(length - 1) < 1e-5) | (length == 0)).alias("unit_length"), F.lit(near).alias("nearly_all_captured"),
    )


@query("knn_descent", "SELECT count(*) AS points, 15 * count(*) AS edges, true AS nine_tenths_found FROM embeddings")
def knn_descent(spark, sf):
    """The approximate graph against the exact one; windows so short that the start alone finds little."""
    emb = table(spark, sf, "embeddings")
    graph = materialise(descent.approximate_knn(emb, 15, window=64), "descent")
    found = descent.recall(graph, neighbours.knn_graph(emb, 15))
    return found.join(F.broadcast(graph.agg(F.count_distinct("src").alias("points")))).select(
        "points", "edges", (F.col("found") >= 0.9 * F.col("edges")).alias("nine_tenths_found")
    )


_MAPS: dict[tuple[str, str], tuple[str, str]] = {}


def _settled_map(spark, sf):
    """Graph and map of a session's ``embeddings``, computed once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MAPS:
        emb = table(spark, sf, "embeddings")
        paths = scratch_path(spark, "map-graph"), scratch_path(spark, "map")
        neighbours.knn_graph(emb, fv.MAP_NEIGHBOURS - 1).write.parquet(paths[0])
        layout.map_2d(layout.fuzzy_edges(spark.read.parquet(paths[0])), emb).write.parquet(paths[1])
        _MAPS[key] = paths
    return tuple(spark.read.parquet(path) for path in _MAPS[key])


@query("map_points")
def map_points(spark, sf):
    return _settled_map(spark, sf)[1]


@query("map_preservation", "SELECT 14 * count(*) AS edges, true AS twice_the_components FROM embeddings")
def map_preservation(spark, sf):
    """Edges of the graph that are neighbours on the map too: twice as many at least as on the principal components."""
    graph, places = _settled_map(spark, sf)
    flat = layout.pca_positions(table(spark, sf, "embeddings"), "vec_id", "embedding")
    kept = [spectral.preserved(graph, p, fv.MAP_NEIGHBOURS - 1) for p in (places, materialise(flat, "components"))]
    both = kept[0].join(F.broadcast(kept[1].select(F.col("kept").alias("before"))))
    return both.select("edges", (F.col("kept") >= 2 * F.col("before")).alias("twice_the_components"))


@query(
    "discriminant_scores",
    """WITH RECURSIVE e AS (
      SELECT vec_id, label < 5 AS m,
             list_transform(embedding::DOUBLE[], lambda v, i: v + CASE WHEN i = 1 AND label < 5 THEN 0.5 ELSE 0 END) AS v
      FROM embeddings
    ),
    flat AS (SELECT vec_id, m, unnest(range(1, 65)) AS i, unnest(v) AS x FROM e),
    mu AS (SELECT m, i, avg(x) AS x FROM flat GROUP BY m, i),
    centred AS (SELECT vec_id, f.i, f.x - mu.x AS x FROM flat f JOIN mu ON f.m = mu.m AND f.i = mu.i),
    sw AS (
      SELECT a.i, b.i AS j, sum(a.x * b.x) / ((SELECT count(*) FROM e) - 2) AS s
      FROM centred a JOIN centred b USING (vec_id) GROUP BY a.i, b.i
    ),
    gap AS (SELECT p.i, p.x - q.x AS g FROM mu p JOIN mu q ON p.i = q.i AND p.m AND NOT q.m),
    augmented AS (
      SELECT list(row ORDER BY i) AS mat FROM (
        SELECT sw.i, list_append(list(s ORDER BY j), any_value(g)) AS row FROM sw JOIN gap ON gap.i = sw.i GROUP BY sw.i)
    ),
    gauss AS (
      SELECT 1 AS k, mat FROM augmented
      UNION ALL
      SELECT k + 1, list_transform(mat, lambda r, i: CASE WHEN i = k
          THEN list_transform(r, lambda x: x / mat[k][k])
          ELSE list_transform(r, lambda x, j: x - r[k] / mat[k][k] * mat[k][j]) END)
      FROM gauss WHERE k <= 64
    ),
    w AS (SELECT unnest(range(1, 65)) AS i, unnest(list_transform(mat, lambda r: r[65])) AS w FROM gauss WHERE k = 65),
    scale AS (SELECT sqrt(sum(w.w * g)) AS s FROM w JOIN gap USING (i)),
    centre AS (SELECT i, avg(x) AS c FROM flat GROUP BY i)
    SELECT vec_id, round(sum((x - c) * w) / any_value(s), 5) AS score
    FROM flat JOIN centre USING (i) JOIN w USING (i), scale GROUP BY vec_id""",
)
def discriminant_scores(spark, sf):
    rows = fx.planted(spark, sf)
    model = discriminant.fit_discriminant(rows, "mask")
    return discriminant.discriminant_score(rows, model).withColumn("score", F.round("score", 5))


@query(
    "density_curves",
    """WITH s AS (
      SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi
      FROM events GROUP BY event_type
    ),
    g AS (SELECT *, p, lo - 3 * h + p * (hi - lo + 6 * h) / 199 AS x FROM s, (SELECT unnest(range(200)) AS p))
    SELECT event_type, round(any_value(x), 6) AS x,
           round(sum(exp(-0.5 * ((x - value) / h) ** 2)) / any_value(n * h * sqrt(2 * pi())), 8) AS density
    FROM g JOIN events USING (event_type) GROUP BY event_type, p""",
)
def density_curves(spark, sf):
    curve = density.density(table(spark, sf, "events"), "value", "event_type")
    return curve.select("event_type", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


# --- streams ---

def stream_of(spark, sf, name):
    """A given table, one file or a folder of them, as a file stream."""
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    # A path by pattern: a plain one to a file is no stream, and a filter on file names leaves a folder's files out.
    rows = spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")
    return rows.repartition(spark.sparkContext.defaultParallelism, fx.WIDE[name]) if name in fx.WIDE else rows


def streamed_pages(spark, sf):
    return fx.single_card_pages(stream_of(spark, sf, "documents"), table(spark, sf, "orders"))


def finish(query):
    query.awaitTermination()


STREAM_MATCH_SQL = f"""
match AS (
  SELECT '{fx.SITE}/doc/' || doc_id AS url, o_orderstatus,
         CASE WHEN lang <> 'es' AND contains(lower(text), '{WITH}') THEN 'VALID_MATCH' ELSE 'NO_MATCH' END AS status
  FROM documents JOIN orders ON doc_id = o_orderkey
)"""


@query("stream_status", f"WITH {STREAM_MATCH_SQL} SELECT url, status FROM match")
def stream_status(spark, sf):
    path = scratch_path(spark, "stream-ledger")
    finish(jobs.route_status(streamed_pages(spark, sf), path, scratch_path(spark, "stream-cp"), WITH))
    return readers.read_ledger(spark, path).select("url", "status")


@query("stream_keep_first", "SELECT DISTINCT user_id, event_type FROM events")
def stream_keep_first(spark, sf):
    path = scratch_path(spark, "stream-first")
    events = jobs.keep_first_stream(
        stream_of(spark, sf, "events").select("ts", "user_id", "event_type"), ["user_id", "event_type"], "ts", "3650 days"
    )
    finish(jobs.to_parquet(events, path, scratch_path(spark, "stream-cp")))
    return spark.read.parquet(path).select("user_id", "event_type")


@query("stream_resume", f"WITH {STREAM_MATCH_SQL} SELECT url, status FROM match WHERE o_orderstatus = 'P'")
def stream_resume(spark, sf):
    path = scratch_path(spark, "stream-resume")
    ledger = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P").select(
        F.concat(F.lit(f"{fx.SITE}/doc/"), fx.text_of("o_orderkey")).alias("url"), F.lit(fv.NO_MATCH).alias("status")
    )
    fresh = jobs.resume_stream(streamed_pages(spark, sf), ledger)
    finish(jobs.route_status(fresh, path, scratch_path(spark, "stream-cp"), WITH))
    return readers.read_ledger(spark, path).select("url", "status")


@query("stream_counts", f"WITH {STREAM_MATCH_SQL} SELECT status, count(*) AS n FROM match GROUP BY status")
def stream_counts(spark, sf):
    path = scratch_path(spark, "stream-counts")
    counts = jobs.running_counts(reviews.match_status(streamed_pages(spark, sf), WITH))
    finish(jobs.counts_to_parquet(counts, path, scratch_path(spark, "stream-cp")))
    return jobs.latest_counts(spark, path)


@query(
    "stream_context",
    f"""WITH {fx.CARDS_SQL}, {KEPT_SQL}
    SELECT '{fx.SITE}/doc/' || doc_id AS url, copy AS pos, review_id, context
    FROM accepted JOIN cards USING (review_id)""",
)
def stream_context(spark, sf):
    path = scratch_path(spark, "stream-context")
    found = jobs.context_stream(streamed_pages(spark, sf), WITH).select("url", "pos", "review_id", "context")
    finish(jobs.to_parquet(found, path, scratch_path(spark, "stream-cp")))
    return spark.read.parquet(path).withColumn("pos", big("pos"))
