"""Inputs built from the given tables, in Spark; the oracles build theirs in SQL.

The given pages hold no review cards, canonical tags, ratings or list pages, so
these are written around the rows of ``documents``, ``orders``, ``part`` and
``events``. All rows of the tables are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.session import spread

SITE = "https://books.example"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # The tables with long texts come as one row group each.
    return spread(df, WIDE[name]) if name in WIDE else df


WIDE = {"documents": "doc_id", "pages": "page_id"}


def text_of(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


FAKES = (
    '<meta property="og:url" content="/book/show/0.no"><a class="next_page listTitle bookTitle" href="/no">no</a>'
    '<article class="ReviewCard"><a href="/review/show/no">no</a><span class="Formatted">with no</span></article>'
    '<div class="BookPage__mainContent"></div><div class="RatingStatistics__rating">no</div>'
)


def odd_markup(page_id: str) -> Column:
    """On one page in fifty: a tag of thousands of attributes that hold tags, and tags in comments and scripts. None counts."""
    odd = (
        "<div" + f" data-card='{FAKES}' href=/no class ''" * 3 + ' = " x=y' * 3001 + '" >'
        + f"</div><!-- {FAKES} -- ><script>var page = '{FAKES}';</script -->"
        + f"<script>var page = '{FAKES}' < 1;</script><style>{FAKES}</style><a <a <a </a><!DOCTYPE <a>"
    )
    return F.when(F.col(page_id) % 50 == 0, F.lit(odd)).otherwise(F.lit(""))


# --- review pages: one card per document, ten documents to a page ---

def card_rows(documents: DataFrame, orders: DataFrame) -> DataFrame:
    """Documents with the order that lends them a date and a rating."""
    return documents.join(orders, F.col("doc_id") == F.col("o_orderkey"))


def book_of(doc: str = "doc_id") -> Column:
    book = F.floor(F.col(doc) / 10)
    return F.concat(F.lit(f"{SITE}/book/show/"), text_of(book), F.lit("-shelf-book-"), text_of(book))


def card_html() -> Column:
    """Orders without priority carry no rating label; Spanish texts no body."""
    label = F.when(
        F.col("o_orderpriority") != "4-NOT SPECIFIED",
        F.concat(F.lit(' aria-label="Rating '), F.substring("o_orderpriority", 1, 1), F.lit(' out of 5"')),
    ).otherwise(F.lit(""))
    body = F.when(
        F.col("lang") != "es",
        F.concat(
            F.lit('<section><span class="Formatted">'),
            F.replace(F.col("text"), F.lit("\n"), F.lit("<br />")),
            F.lit("</span></section>"),
        ),
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit('<article class="ReviewCard wide"><div><span class="RatingStars small"'),
        label,
        F.lit('></span><a class="when" href="/review/show/'),
        text_of("doc_id"),
        F.lit('"> '),
        F.date_format("o_orderdate", "MMMM d, yyyy"),
        F.lit(" </a></div>"),
        body,
        F.lit("<div><span>like</span></div></article>"),
    )


def cards_html() -> Column:
    """Orders in part delivery show their card twice."""
    return F.when(F.col("o_orderstatus") == "P", F.concat(card_html(), card_html())).otherwise(card_html())


def review_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = card_rows(table(spark, sf, "documents"), table(spark, sf, "orders"))
    cards = rows.select(F.floor(F.col("doc_id") / 10).alias("page_id"), "doc_id", book_of().alias("book"), cards_html().alias("cards"))
    # Ten documents to a page by construction.
    return cards.groupBy("page_id", "book").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "cards"))), lambda x: x["cards"]), "").alias("cards")
    ).select(
        "page_id",
        F.concat("book", F.lit("/reviews")).alias("url"),
        F.concat(F.lit("<html><body>"), odd_markup("page_id"), F.col("cards"), F.lit("</body></html>")).alias("html"),
    )


def single_card_pages(documents: DataFrame, orders: DataFrame) -> DataFrame:
    """One page per document; also for a stream of documents."""
    return card_rows(documents, orders).select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit(f"{SITE}/doc/"), text_of("doc_id")).alias("url"),
        F.concat(F.lit("<html><body>"), odd_markup("doc_id"), cards_html(), F.lit("</body></html>")).alias("html"),
        "o_orderdate",
    )


CARDS_SQL = f"""
cards AS (
  SELECT doc_id // 10 AS page_id, doc_id, c AS copy, lang, text, o_orderdate, o_orderpriority,
         '{SITE}/book/show/' || (doc_id // 10) || '-shelf-book-' || (doc_id // 10) || '/reviews' AS url,
         row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id, c) - 1 AS pos,
         '/review/show/' || doc_id AS review_id,
         strftime(o_orderdate, '%B %-d, %Y') AS date,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Not rated'
              ELSE substr(o_orderpriority, 1, 1) END AS stars,
         replace(text, chr(10), '<br />') AS body
  FROM documents JOIN orders ON doc_id = o_orderkey
  CROSS JOIN LATERAL (SELECT unnest(CASE WHEN o_orderstatus = 'P' THEN [0, 1] ELSE [0] END) AS c)
)"""


# --- list pages: the orders of a customer are the pages of a list ---

def list_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The last page lacks a next link; it is not crawled if its order is in part delivery."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    back = Window.partitionBy("o_custkey").orderBy(F.col("o_orderkey").desc())
    rows = table(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus",
        F.row_number().over(w).alias("page_no"),
        (F.row_number().over(back) == 1).alias("last"),
    ).filter(~(F.col("last") & (F.col("o_orderstatus") == "P")))
    nav = F.when(F.col("last"), F.lit("<span>end</span>")).otherwise(
        F.lit('<a class="next_page" rel="next" href="?page=next">next</a>')
    )
    html = F.concat(
        F.lit("<html>"),
        odd_markup("o_orderkey"),
        F.lit('<a class="listTitle" href="/list/1">up</a><a href="/book/show/'),
        text_of(F.floor(F.col("o_totalprice") / 100)),
        F.lit('" class="bookTitle wide"><span>t</span></a>'),
        nav,
        F.lit("</html>"),
    )
    return rows.select(
        F.col("o_custkey").alias("list_no"), "page_no", F.col("o_orderkey").alias("page_id"),
        F.concat(F.lit(f"{SITE}/list/show/"), text_of("o_custkey")).alias("url"), html.alias("html"),
    )


LIST_PAGES_SQL = """
list_pages AS (
  SELECT * FROM (
    SELECT o_custkey AS list_no, o_orderkey AS page_id, o_orderstatus, o_totalprice,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS last
    FROM orders)
  WHERE NOT (last AND o_orderstatus = 'P')
)"""


# --- book pages: one per part, with a supplier as contributor ---

def book_pages(spark: SparkSession, sf: str) -> DataFrame:
    supplier = table(spark, sf, "supplier")
    count = supplier.agg(F.count(F.lit(1))).scalar()
    parts = spread(table(spark, sf, "part"), "p_partkey").withColumn("supp", F.col("p_partkey") % count)
    rows = parts.join(supplier, F.col("supp") == F.col("s_suppkey"))
    slug = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    work = F.concat(F.lit("/book/show/"), text_of(F.col("p_partkey") % 500), F.lit("."), slug)
    kind = F.col("p_type")

    def tag(text: Column) -> Column:
        return F.concat(
            F.lit('<span><a class="Button Button--tag small"><span class="Button__labelItem">'), text, F.lit("</span></a></span>")
        )

    def name(text: Column) -> Column:
        return F.concat(F.lit('<a><span class="ContributorLink__name" data-x="1">'), text, F.lit("</span></a>"))

    html = F.concat(
        F.lit("<html><head>"),
        odd_markup("p_partkey"),
        F.when(kind == "PROMO", F.lit(""))
        .when(kind == "SMALL", F.concat(F.lit('<meta content="'), work, F.lit('" property="og:url">')))
        .otherwise(F.concat(F.lit('<meta property="og:url" content="'), work, F.lit('"/>'))),
        F.lit('</head><body><div class="BookPage__mainContent"><div class="ContributorLinksList"><span>'),
        F.when(F.col("p_size") == 50, F.lit("")).otherwise(name(F.col("s_name"))),
        F.when((F.col("p_size") > 25) & (F.col("p_size") < 50), name(F.col("p_brand"))).otherwise(F.lit("")),
        F.when(kind == "LARGE", name(F.lit(""))).otherwise(F.lit("")),
        F.lit("</span></div>"),
        F.when(kind == "STANDARD", F.lit("")).otherwise(
            F.concat(F.lit('<div class="RatingStatistics__rating">'), text_of("p_size"), F.lit(".5</div>"))
        ),
        F.lit('<a href="/x#CommunityReviews"><span>9,999 ratings</span> and <span>'),
        text_of("p_partkey"),
        F.when(F.col("p_size") == 1, F.lit(" notes")).otherwise(F.lit(",000&nbsp;reviews")),
        F.lit("</span></a>"),
        F.when(F.col("p_size") == 2, F.lit("")).otherwise(
            F.concat(F.lit('<p data-testid="publicationInfo">First published '), F.col("p_name"), F.lit(" </p>"))
        ),
        F.when(kind == "ECONOMY", F.lit(""))
        .when(kind == "MEDIUM", F.lit('<div data-testid="genresList"></div>'))
        .otherwise(
            F.concat(
                F.lit('<div data-testid="genresList"><div>'),
                tag(F.substring_index("p_name", " ", 1)),
                tag(F.substring_index("p_name", " ", -1)),
                F.lit("</div></div>"),
            )
        ),
        F.lit("</div></body></html>"),
    )
    return rows.select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit(f"{SITE}/book/show/"), text_of("p_partkey"), F.lit("-shelf-book-"), text_of("p_partkey")).alias("url"),
        html.alias("html"),
    )


BOOKS_SQL = f"""
books AS (
  SELECT '{SITE}/book/show/' || p_partkey || '-shelf-book-' || p_partkey AS url,
         'shelf book ' || p_partkey AS book_name,
         CASE WHEN p_type = 'PROMO' THEN NULL
              ELSE '/book/show/' || (p_partkey % 500) || '.' || replace(p_name, ' ', '_') END AS canonical_url,
         CASE WHEN p_type = 'PROMO' THEN NULL ELSE (p_partkey % 500)::VARCHAR END AS work_id,
         CASE WHEN p_size = 50 THEN 'Not Found' WHEN p_size > 25 THEN s_name || ' | ' || p_brand ELSE s_name END AS author,
         CASE WHEN p_type = 'STANDARD' THEN 'Not Found' ELSE p_size || '.5' END AS avg_rating,
         CASE WHEN p_size = 1 THEN 'Not Found' ELSE p_partkey || '000' END AS total_reviews,
         CASE WHEN p_size = 2 THEN 'Not Found' ELSE p_name END AS release_date,
         CASE WHEN p_type = 'ECONOMY' THEN 'Not Found' WHEN p_type = 'MEDIUM' THEN ''
              ELSE split_part(p_name, ' ', 1) || ' | ' || split_part(p_name, ' ', -1) END AS genres
  FROM part JOIN supplier ON s_suppkey = p_partkey % (SELECT count(*) FROM supplier)
)"""


# --- analysis input: documents as reviews, parts as metadata ---

def analysis_reviews(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part")
    count = parts.agg(F.count(F.lit(1))).scalar()
    rows = card_rows(table(spark, sf, "documents"), table(spark, sf, "orders")).withColumn(
        "book", F.col("doc_id") % count
    )
    rows = rows.join(parts.select("p_partkey", "p_name"), F.col("book") == F.col("p_partkey"))
    cased = F.when(F.col("o_orderstatus") == "F", F.upper("p_name")).otherwise(F.col("p_name"))
    return rows.select(
        "doc_id",
        F.when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit(" \t"), cased, F.lit("\n"))).otherwise(cased).alias("book_name"),
        F.substring("o_orderpriority", 1, 1).alias("stars"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "P"), F.lit("unknown"))
        .otherwise(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("date"),
        F.col("text").alias("context"),
    )


def analysis_summary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_name").alias("book_name"), F.col("p_brand").alias("author"), F.col("p_partkey").alias("ordinal")
    )


ANALYSIS_SQL = """
meta AS (
  SELECT p_name AS join_key, arg_min(p_brand, p_partkey) AS author FROM part GROUP BY p_name
),
reviews AS (
  SELECT doc_id, p_name AS join_key, substr(o_orderpriority, 1, 1) AS stars, text AS context,
         CASE WHEN o_orderstatus = 'F' THEN upper(p_name) ELSE p_name END AS cased,
         CASE WHEN o_orderpriority = '2-HIGH' THEN chr(32) || chr(9) || cased || chr(10) ELSE cased END AS book_name,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS day,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'unknown'
              ELSE strftime(o_orderdate, '%B %-d, %Y') END AS date
  FROM documents JOIN orders ON doc_id = o_orderkey
  JOIN part ON p_partkey = doc_id % (SELECT count(*) FROM part)
),
joined AS (SELECT * EXCLUDE (join_key) FROM reviews JOIN meta USING (join_key))"""


# --- attempt log and fallback log: one URL per user, one attempt per event ---

def _canonical(kind: Column, path: Column) -> Column:
    return (
        F.when(kind == "error", F.lit(None).cast("string"))
        .when(kind == "signup", F.concat(F.lit(f"{SITE}/list/"), path))
        .otherwise(F.concat(F.lit(f"{SITE}/book/show/"), path))
    )


def attempt_log(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf, "events").withColumn("attempt", F.row_number().over(w))
    path = F.concat(text_of(F.col("user_id") % 60), F.lit(".n"), text_of("attempt"))
    return rows.select(
        F.concat(F.lit("u"), text_of("user_id")).alias("url"), "attempt",
        _canonical(F.col("event_type"), path).alias("canonical_url"),
    )


def fallback_log(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("e"))
    return last.select(
        F.concat(F.lit("u"), text_of("user_id")).alias("url"),
        _canonical(F.col("e.event_type"), text_of("user_id")).alias("canonical_url"),
    )


ATTEMPTS_SQL = f"""
attempts AS (
  SELECT 'u' || user_id AS url, attempt,
         CASE event_type WHEN 'error' THEN NULL
              WHEN 'signup' THEN '{SITE}/list/' || (user_id % 60) || '.n' || attempt
              ELSE '{SITE}/book/show/' || (user_id % 60) || '.n' || attempt END AS canonical_url,
         CASE WHEN event_type NOT IN ('error', 'signup') THEN (user_id % 60)::VARCHAR END AS work_id
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events)
),
fallback AS (
  SELECT 'u' || user_id AS url,
         CASE last_type WHEN 'error' THEN NULL WHEN 'signup' THEN '{SITE}/list/' || user_id
              ELSE '{SITE}/book/show/' || user_id END AS canonical_url,
         CASE WHEN last_type NOT IN ('error', 'signup') THEN user_id::VARCHAR END AS work_id
  FROM (SELECT user_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id)
),
settled AS (
  SELECT url, min(attempt) FILTER (work_id IS NOT NULL AND attempt <= 50) AS attempt,
         arg_min(work_id, attempt) FILTER (work_id IS NOT NULL AND attempt <= 50) AS work_id,
         arg_min(canonical_url, attempt) FILTER (work_id IS NOT NULL AND attempt <= 50) AS canonical_url
  FROM attempts GROUP BY url
),
passes AS (
  SELECT n AS attempt,
         (SELECT count(*) FROM settled s WHERE s.attempt >= n OR s.attempt IS NULL) AS pending,
         (SELECT count(*) FROM (SELECT work_id, min(attempt) AS a FROM settled WHERE work_id IS NOT NULL GROUP BY work_id) w
          WHERE w.a = n) AS new_works
  FROM (SELECT unnest(range(1, 51)) AS n)
),
stop AS (SELECT coalesce(min(attempt), 50) AS n FROM passes WHERE attempt > 1 AND new_works = 0),
rounds AS (SELECT passes.* FROM passes, stop WHERE attempt <= stop.n AND pending > 0),
pending AS (
  SELECT url FROM settled
  WHERE attempt IS NULL OR attempt > (SELECT max(attempt) FROM rounds)
),
late AS (SELECT url, canonical_url, work_id FROM pending JOIN fallback USING (url) WHERE canonical_url IS NOT NULL),
works AS (
  SELECT work_id, arg_min(canonical_url, (attempt, canonical_url)) AS canonical_url FROM (
    SELECT work_id, attempt, canonical_url FROM settled WHERE attempt <= (SELECT max(attempt) FROM rounds)
    UNION ALL SELECT work_id, 51, canonical_url FROM late WHERE work_id IS NOT NULL)
  GROUP BY work_id
)"""


# --- ledger: orders delivered or open have a status, those in part delivery wait ---

def order_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.concat(F.lit(f"{SITE}/o/"), text_of("o_orderkey")).alias("url"), "o_orderstatus")


def order_ledger(spark: SparkSession, sf: str) -> DataFrame:
    return order_urls(spark, sf).filter(F.col("o_orderstatus") != "P").select(
        "url",
        F.when(F.col("o_orderstatus") == "F", "VALID_MATCH").otherwise("NO_MATCH").alias("status"),
        F.lit(None).cast("string").alias("error_type"),
    )


# --- name column: every form a name takes before repair ---

def name_column() -> Column:
    kind, key = F.col("p_type"), text_of("p_partkey")
    under = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    dashed = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    show = F.lit(f"{SITE}/book/show/")
    return (
        F.when(kind == "SMALL", F.concat(show, key, F.lit("."), under, F.lit("?x=1")))
        .when(kind == "LARGE", F.concat(show, key, F.lit("-"), dashed, F.lit("/reviews")))
        .when(kind == "MEDIUM", F.concat(show, key))
        .when(kind == "PROMO", F.concat(F.lit("URL_Parse_Error_For_"), show, text_of("p_size"), F.lit("---"), dashed))
        .when(kind == "ECONOMY", F.concat(F.lit("URL_ID_"), text_of("p_size")))
        .otherwise(F.col("p_name"))
    )


def name_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", name_column().alias("book_name"), "p_type")


NAMES_SQL = f"""
names AS (
  SELECT p_partkey, p_type, p_name,
    CASE p_type
      WHEN 'SMALL' THEN '{SITE}/book/show/' || p_partkey || '.' || replace(p_name, ' ', '_') || '?x=1'
      WHEN 'LARGE' THEN '{SITE}/book/show/' || p_partkey || '-' || replace(p_name, ' ', '-') || '/reviews'
      WHEN 'MEDIUM' THEN '{SITE}/book/show/' || p_partkey
      WHEN 'PROMO' THEN 'URL_Parse_Error_For_{SITE}/book/show/' || p_size || '---' || replace(p_name, ' ', '-')
      WHEN 'ECONOMY' THEN 'URL_ID_' || p_size
      ELSE p_name END AS book_name,
    CASE p_type
      WHEN 'SMALL' THEN p_name WHEN 'LARGE' THEN p_name
      WHEN 'MEDIUM' THEN 'Book_ID_' || p_partkey
      WHEN 'PROMO' THEN '  ' || p_name
      WHEN 'ECONOMY' THEN 'URL_ID_' || p_size
      ELSE p_name END AS fixed
  FROM part
)"""


# --- planted classes: one dimension moved for half of the labels ---

def planted(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda v, i: v + F.when((i == 0) & (F.col("label") < 5), 0.5).otherwise(0.0),
    )
    return table(spark, sf, "embeddings").select("vec_id", moved.alias("embedding"), (F.col("label") < 5).alias("mask"))
