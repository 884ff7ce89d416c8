"""Results depend on them, so they are stated as they are.

Everything here is a default of some parameter; none is baked into an operator.
"""

# --- white space, as Python's str.strip / str.split / re '\s' see it ---
# The Unicode property and the four separators Python adds to it.
WS = r"(?U:[\s\x1c-\x1f])"
NOT_WS = r"(?U:[^\s\x1c-\x1f])"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- keyword search ---
KEYWORD = "kafkaesque"
MAX_WORDS = 500
SNIPPET_CHARS = 150

# --- author and period classes ---
AUTHOR_NEEDLE = "kafka"
AUTHOR_LABEL = "Franz Kafka"
OTHER_LABEL = "Other"
SPLIT_DATE = "2021-01-01"
BEFORE_LABEL = "Pre-2021"
AFTER_LABEL = "2021+"
DATE_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd")

# --- entities deleted before embedding, in this order ---
ENTITIES = (
    "metamorphosis", "gregor", "samsa", "the trial", "josef k", "joseph k",
    "the castle", "in the penal colony", "a hunger artist", "the judgement",
    "amerika", "catch-22", "catch 22", "murakami", "saramago", "blindness", "camus",
    "meursault", "the stranger",
)

# --- sentinels and joined lists ---
NOT_FOUND = "Not Found"
NOT_RATED = "Not rated"
MISSING_PAGE = "MissingPage"  # error of a URL without a page
LIST_SEPARATOR = " | "
FIRST_PUBLISHED = "First published "

# --- page vocabulary: CSS classes, attributes and link marks ---
CANONICAL_PROPERTY = "og:url"
LIST_LINK_CLASS = "listTitle"
BOOK_LINK_CLASS = "bookTitle"
NEXT_LINK_CLASS = "next_page"
REVIEW_CARD_CLASS = "ReviewCard"
REVIEW_LINK_MARK = "/review/show/"
REVIEW_BODY_CLASS = "Formatted"
STARS_CLASS = "RatingStars"
BOOK_CONTENT_CLASS = "BookPage__mainContent"
AUTHOR_LIST_CLASS = "ContributorLinksList"
AUTHOR_NAME_CLASS = "ContributorLink__name"
RATING_CLASS = "RatingStatistics__rating"
REVIEWS_LINK_MARK = "#CommunityReviews"
PUBLICATION_TEST_ID = "publicationInfo"
GENRES_TEST_ID = "genresList"
GENRE_LINK_CLASS = "Button--tag"
GENRE_LABEL_CLASS = "Button__labelItem"

# --- URL and name patterns ---
WORK_ID_PATTERN = r"(?U)/book/show/(\d+)"
NAME_DOT_PATTERN = r"(?U)/show/\d+\.([^/?]+)"
NAME_ANY_PATTERN = r"(?U)/show/\d+[.\-]([^/?]+)"
SHOW_ID_PATTERN = r"(?U)/show/(\d+)"
BAD_NAME_PATTERN = r"[/_]|^(Unknown_Book_From_|URL_ID_)"
REVIEW_COUNT_PATTERN = r"([\d,]+)" + WS + r"+reviews"
UNNAMED_PREFIX = "URL_ID_"
UNPARSED_PREFIX = "URL_Parse_Error_For_"
BOOK_ID_PREFIX = "Book_ID_"

# --- statuses of a checked page ---
VALID_MATCH = "VALID_MATCH"
NO_MATCH = "NO_MATCH"
FAILURE = "FAILURE"

# --- limits of the corpus steps ---
MAX_PASSES = 50
BATCH_SIZE = 150

# --- two-dimensional map ---
MAP_NEIGHBOURS = 15
MAP_MIN_DIST = 0.1
MAP_SEED = 42
DENSITY_GRID = 200

# --- column order of the book summary ---
SUMMARY_COLUMNS = (
    "book_name", "author", "avg_rating", "total_reviews",
    "keyword_review_count", "release_date", "genres",
)
REVIEW_COLUMNS = ("book_name", "stars", "date", "context")
HOVER_COLUMNS = ("book_name", "author", "stars", "period", "context_short")
REQUIRED_REVIEW_COLUMNS = ("context", "author", "date", "book_name", "stars")

# --- strings that pandas.read_csv takes for missing ---
PANDAS_NULLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)
