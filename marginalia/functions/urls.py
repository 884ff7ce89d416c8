"""URL and book-name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.functions.text import _col, non_empty


def _group(c: Column, pattern: str, index: int = 1) -> Column:
    """A regex group, null (not empty) without a match."""
    return non_empty(F.regexp_extract(c, pattern, index))


def _spaced(slug: Column) -> Column:
    return F.translate(slug, "_-", "  ")


def work_id(url: Column | str) -> Column:
    """Digits of the work in a canonical URL, as text."""
    return _group(_col(url), fv.WORK_ID_PATTERN)


def reviews_url(url: Column | str) -> Column:
    u = _col(url)
    return F.when(F.contains(u, F.lit("/reviews")), u).otherwise(
        F.concat(F.substring_index(u, "?", 1), F.lit("/reviews"))
    )


def book_url(url: Column | str) -> Column:
    return F.replace(reviews_url(url), F.lit("/reviews"), F.lit(""))


def book_name_dot(url: Column | str) -> Column:
    """Name after ``<id>.``; otherwise the id stands for the name."""
    u = _col(url)
    return F.coalesce(
        _spaced(_group(u, fv.NAME_DOT_PATTERN)),
        F.concat(F.lit(fv.UNNAMED_PREFIX), F.coalesce(_group(u, fv.SHOW_ID_PATTERN), F.lit(""))),
    )


def book_name_any(url: Column | str) -> Column:
    """Name after ``<id>.`` or ``<id>-``; otherwise the URL is kept for repair."""
    u = _col(url)
    return F.coalesce(
        _spaced(_group(u, fv.NAME_ANY_PATTERN)), F.concat(F.lit(fv.UNPARSED_PREFIX), u)
    )


def is_bad_name(name: Column | str) -> Column:
    return F.coalesce(_col(name).rlike(fv.BAD_NAME_PATTERN), F.lit(False))


def repair_name(name: Column | str) -> Column:
    """Name in the embedded URL, else ``Book_ID_<id>``, else the input."""
    n = _col(name)
    url = F.coalesce(_group(n, f"(https?://{fv.NOT_WS}+)"), n)
    return F.coalesce(
        _spaced(_group(url, fv.NAME_ANY_PATTERN)),
        F.concat(F.lit(fv.BOOK_ID_PREFIX), _group(url, fv.SHOW_ID_PATTERN)),
        n,
    )


def absolute_url(href: Column | str, base: Column | str) -> Column:
    """``href`` seen from the page at ``base``, as a browser reports links.

    Dot segments (``../``) are left as written.
    """
    h, b = _col(href), _col(base)
    page = F.substring_index(F.substring_index(b, "#", 1), "?", 1)
    host = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.concat(host, F.coalesce(_group(F.substring(page, F.length(host) + 1, F.length(page)), r"^(.*/)"), F.lit("/")))
    return (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(host, h))
        .when(h.startswith("#"), F.concat(F.substring_index(b, "#", 1), h))
        .when(h.startswith("?"), F.concat(page, h))
        .otherwise(F.concat(folder, h))
    )
