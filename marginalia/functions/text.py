"""Text expressions: white space, paragraphs, keyword in context, entities.

Everything is a ``Column`` built from Spark functions, so it stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import fixed_values as fv

_BREAK = r"(?i)<br" + fv.WS + r"*/?>"
# Stands for a cut while a text is taken apart. A NUL of the text itself becomes
# the replacement character first, as in a browser.
_MARK = "\u0000"
_REPLACED = "\ufffd"
# A tag, or all from a ``<`` that no ``>`` follows on to the end of its line.
_TAG = r"<[^>\n]*+>|(<[^>\n]*+)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def non_empty(value: Column) -> Column:
    """Null for an empty text; unlike ``nullif``, with ``value`` computed once per row."""
    return F.get(F.filter(F.array(value), lambda v: v != ""), F.lit(0))


def strip(c: Column | str) -> Column:
    """Both ends, all Unicode white space (``trim`` knows the blank only)."""
    return F.btrim(_col(c), F.lit(fv.WS_CHARS))


def collapse_ws(c: Column | str) -> Column:
    """Words joined by one blank."""
    return strip(F.regexp_replace(_col(c), f"{fv.WS}+", " "))


def words(c: Column | str) -> Column:
    """White-space split without empty ends; a blank text has no words."""
    return drop_empty(F.split(F.regexp_replace(_col(c), f"{fv.WS}+", " "), " "))


def without_marks(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(_MARK), F.lit(_REPLACED))


def split_on(c: Column | str, pattern: str, cut: str = "{}") -> Column:
    """Split on a pattern; ``cut`` is what a match leaves, with the place of the cut.

    ``F.split`` compiles its pattern for every row, ``regexp_replace`` once; a
    split on a plain character needs none.
    """
    return F.split(F.regexp_replace(without_marks(c), pattern, cut.format(_MARK)), _MARK)


def split_br(html: Column | str) -> Column:
    """Pieces between ``<br>`` tags, markup kept."""
    return split_on(html, _BREAK)


def strip_tags(c: Column | str) -> Column:
    """Tags within one line are deleted; entities stay encoded."""
    return F.regexp_replace(_col(c), _TAG, "$1")


def drop_empty(pieces: Column | str) -> Column:
    return F.filter(_col(pieces), lambda p: p != "")


def paragraphs(html: Column | str) -> Column:
    """Stripped, non-empty paragraphs without markup.

    Breaks are marked first and tags go second, so a break inside a tag or
    between a bare ``<`` and ``>`` goes with them.
    """
    marked = F.regexp_replace(without_marks(html), _BREAK, _MARK)
    return drop_empty(F.transform(F.split(strip_tags(marked), _MARK), strip))


def has_keyword(c: Column | str, keyword: str) -> Column:
    return F.contains(F.lower(_col(c)), F.lit(keyword.lower()))


def first_with(pieces: Column | str, keyword: str) -> Column:
    """First piece that holds the keyword in any case; null if none does."""
    return F.try_element_at(F.filter(_col(pieces), lambda p: has_keyword(p, keyword)), F.lit(1))


def keyword_paragraph(html: Column | str, keyword: str = fv.KEYWORD) -> Column:
    return first_with(paragraphs(html), keyword)


def kwic(paragraph: Column | str, keyword: str = fv.KEYWORD, max_words: int = fv.MAX_WORDS) -> Column:
    """At most ``max_words`` words around the first word with the keyword.

    Short paragraphs come back unchanged. A keyword that spans two words has no
    position: the first words are kept, closed by dots without a blank.
    """
    para = _col(paragraph)
    half = max_words // 2

    def around(ws: Column, hit: Column) -> Column:
        n = F.size(ws)
        first = F.greatest(F.lit(0), hit - 1 - half)
        # A window that touches the end is pulled back to full width.
        start = F.when(first + max_words >= n, F.greatest(F.lit(0), n - max_words)).otherwise(first)
        window = F.concat(
            F.when(start > 0, F.lit("... ")).otherwise(F.lit("")),
            F.array_join(F.slice(ws, start + 1, max_words), " "),
            F.when(start + max_words < n, F.lit(" ...")).otherwise(F.lit("")),
        )
        head = F.concat(F.array_join(F.slice(ws, 1, max_words), " "), F.lit("..."))
        return F.when(hit == 0, head).otherwise(window)

    def cut(ws: Column) -> Column:
        hit = F.array_position(F.transform(ws, lambda w: has_keyword(w, keyword)), True)
        return F.when(F.size(ws) <= max_words, para).otherwise(
            let(hit.cast("int"), lambda at: around(ws, at))
        )

    return F.when(para.isNotNull(), let(words(para), cut))


def keyword_context(
    html: Column | str, keyword: str = fv.KEYWORD, max_words: int = fv.MAX_WORDS
) -> Column:
    """Keyword window of the first paragraph with the keyword; null if there is none."""
    return let(keyword_paragraph(html, keyword), lambda p: kwic(p, keyword, max_words))


def join_key(c: Column | str) -> Column:
    """Lower case without outer white space; a missing name is the empty key."""
    return strip(F.lower(F.coalesce(_col(c), F.lit(""))))


def quote_regex(text: str) -> str:
    """Escaped so that Java takes every character literally."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def remove_entities(c: Column | str, entities: Sequence[str] = fv.ENTITIES) -> Column:
    """Delete each entity, in list order, as a whole word in any case.

    Texts that hold none of them (most) cost a single pattern match: a first
    deletion needs a match in the untouched text.
    """
    text = F.coalesce(_col(c), F.lit(""))
    if not entities:
        return collapse_ws(text)
    quoted = [quote_regex(e) for e in entities]
    cleaned = text
    for entity in quoted:
        cleaned = F.regexp_replace(cleaned, rf"(?iU)\b{entity}\b", "")
    any_entity = r"(?iU)\b(?:" + "|".join(quoted) + r")\b"
    return collapse_ws(F.when(text.rlike(any_entity), cleaned).otherwise(text))


def snippet(c: Column | str, n: int = fv.SNIPPET_CHARS) -> Column:
    """First ``n`` characters and dots, dots even if nothing was cut."""
    return F.concat(F.substring(_col(c), 1, n), F.lit("..."))


def text_hash(c: Column | str) -> Column:
    """Identity of a text across jobs."""
    return F.sha2(_col(c), 256)
