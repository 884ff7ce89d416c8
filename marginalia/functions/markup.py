"""Field expressions over page HTML.

Elements are found by class or attribute and closed by counting their own open
and close tags, so nested markup inside a review or a list is kept whole. The names
of classes, attributes and links are arguments; their defaults are fixed values.
"""

from __future__ import annotations

import html.entities as html_tables
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.functions.text import _col, collapse_ws, let, non_empty, split_on, strip_tags, without_marks
from marginalia.functions.urls import _group

# A page is read as a row of tokens from its start on. Every character belongs to one
# token and every repeated group is possessive, so a scan takes one pass and no stack,
# whatever the page holds. What stands in a comment, in a script or in another tag's
# attributes is no tag. One attribute, or a character that is none; quoted values may
# hold anything but their quote:
_ATTRIBUTE = r"""(?:[^\s=>/"']++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+|[\s/"'=])"""
_REST = rf"{_ATTRIBUTE}*+>"
_RAW = "script|style|textarea|title"  # elements whose content is text


def _skip(wanted: str) -> str:
    """All tokens before the next ``wanted`` tag."""
    return (
        r"(?:[^<]++"
        r"|<!--(?:-?+>|(?:[^-]++|-(?!->))*+(?:-->|\z))"
        rf"|<(?:{_RAW})(?=[\s/>]){_REST}(?:[^<]++|<(?!/(?:{_RAW})\b))*+"
        rf"""|(?!{wanted})</?[a-z](?:[^>"']*+>|{_ATTRIBUTE}*+(?:>|\z))"""
        r"|<(?:[!?]|/(?![a-z]))[^>]*+(?:>|\z)"
        r"|<(?![a-z!?/]))*+"
    )


def _first_tag(wanted: str, capturing: str | None = None) -> str:
    """The first ``wanted`` tag of the text, and all before it."""
    return rf"(?is)\A{_skip(wanted)}{capturing or wanted}"


def _each_tag(wanted: str, capturing: str | None = None) -> str:
    """A ``wanted`` tag and all between the one before and it."""
    return rf"(?is)\G{_skip(wanted)}{capturing or wanted}"


def _value(name: str, double: str, single: str, bare: str) -> str:
    """An attribute whose value, in any quotes, fits; a quote that is never closed is none."""
    return rf"""(?<=[\s"'/]){name}\s*+=\s*+(?:"(?=[^"]*+"){double}"|'(?=[^']*+'){single}'|(?!["']){bare}(?=[\s>]))"""


def _with(attribute: str) -> str:
    """Lookahead: the open tag has this attribute."""
    return rf"(?=(?:(?!{attribute}){_ATTRIBUTE})*+{attribute})"


def _has_class(name: str) -> str:
    """Lookahead: the open tag carries this class among others."""
    n = re.escape(name)
    return _with(_value("class", rf'(?:[^"]*\s)?{n}(?:\s[^"]*)?', rf"(?:[^']*\s)?{n}(?:\s[^']*)?", n))


def _has_attribute(name: str, value: str) -> str:
    v = re.escape(value)
    return _with(_value(name, v, v, v))


def _open_tag(tag: str, condition: str = "") -> str:
    return rf"<{tag}\b{condition}{_REST}"


def _attribute(tag: str, name: str, condition: str = "", must_hold: str = "") -> tuple[str, str]:
    """An open tag with the attribute, and the same with the value and its quotes as a group."""
    m = re.escape(must_hold)
    double, single, bare = r'[^"]*', r"[^']*", r"[^\s>]*"
    if must_hold:
        double, single, bare = double + m + double, single + m + single, bare + m + bare
    plain = _value(name, double, single, bare)
    head, tail = plain.split(r"\s*+=\s*+", 1)
    grouped = rf"{head}\s*+=\s*+({tail})"
    before = rf"<{tag}\b{condition}(?:(?!{plain}){_ATTRIBUTE})*+"
    return f"{before}{plain}{_REST}", f"{before}{grouped}{_REST}"


def _unquoted(value: Column) -> Column:
    """An attribute value as text; the empty match stays empty."""
    return let(
        value,
        lambda v: decode_entities(F.when(v.rlike("^[\"']"), F.substring(v, 2, F.length(v) - 2)).otherwise(v)),
    )


_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
# Names by the public table of the HTML standard, as Python carries it.
_NAMED = json.dumps({k: v for k, v in html_tables.html5.items() if k.endswith(";")})
# Numbers that stand for characters of the Windows code page.
_WINDOWS = json.dumps(
    {str(n): bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
)


def _code_point(number: Column) -> Column:
    """The character; what is none becomes the replacement character."""
    valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    windows = F.from_json(F.lit(_WINDOWS), "map<string,string>")
    return F.coalesce(
        F.try_element_at(windows, number.cast("string")), F.when(valid, plain), F.lit("�")
    )


def _referenced(code: Column) -> Column:
    """The text of one reference; an unknown name stays as it is."""
    named = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), F.substring(code, 2, 40))
    digits = F.regexp_extract(code, "([0-9a-fA-F]+);$", 1)
    number = F.when(code.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    return F.when(code.startswith("&#"), F.coalesce(_code_point(number), F.lit("�"))).otherwise(
        F.coalesce(named, code)
    )


def decode_entities(c: Column) -> Column:
    """Text with all numeric references, and all named ones that end in a semicolon, decoded once."""
    def decoded(text: Column) -> Column:
        codes = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
        return let(
            codes,
            lambda found: F.array_join(
                F.transform(
                    split_on(text, _REFERENCE),
                    lambda piece, i: F.concat(
                        piece, F.coalesce(_referenced(F.get(found, i)), F.lit(""))
                    ),
                ),
                "",
            ),
        )

    return let(c, lambda text: F.when(text.rlike(_REFERENCE), decoded(without_marks(text))).otherwise(text))


def inner_text(html: Column) -> Column:
    """Text as a browser shows it: no tags, references decoded, blanks collapsed."""
    return collapse_ws(decode_entities(strip_tags(html)))


def _at_tags(html: Column | str, wanted: str) -> Column:
    """Text before, between and after the tags; each piece but the first begins with its tag."""
    return split_on(html, rf"(?is)\G({_skip(wanted)})({wanted})", "$1{}$2")


def _plain_inner(tag: str) -> str:
    """All up to the close tag of an already open ``tag``, as a group, where no other such tag is opened before."""
    return rf"({_skip(_any_tag(tag))})(?=</{tag}\b{_REST})"


def _any_tag(tag: str) -> str:
    return rf"</?{tag}\b{_REST}"


def _balanced_prefix(rest: Column, tag: str) -> Column:
    """``rest`` up to the close tag that matches an already open ``tag``."""
    def cut(pieces: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            depth = state["depth"] + F.when(piece.startswith("</"), -1).otherwise(1)
            return F.when(state["depth"] == 0, state).otherwise(
                F.struct(depth.alias("depth"), (state["taken"] + (depth > 0).cast("int")).alias("taken"))
            )

        start = F.struct(F.lit(1).alias("depth"), F.lit(1).alias("taken"))
        taken = F.aggregate(F.slice(pieces, 2, F.size(pieces)), start, step, lambda s: s["taken"])
        return F.array_join(F.slice(pieces, 1, taken), "")

    return let(_at_tags(rest, _any_tag(tag)), cut)


def _counted_inners(html: Column | str, tag: str, wanted: str) -> Column:
    """Inner HTML of every ``wanted`` element, by counting tags."""
    return let(
        split_on(html, rf"(?is)\G({_skip(wanted)}){wanted}", "$1{}"),
        lambda pieces: F.transform(
            F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
            lambda rest: _balanced_prefix(rest, tag),
        ),
    )


def element_inners(html: Column | str, tag: str, condition: str) -> Column:
    """Inner HTML of every ``tag`` element that meets the condition.

    Where none holds another ``tag`` element, the page is read once; else, or where one is
    empty or left open, tags are counted.
    """
    wanted = _open_tag(tag, condition)
    plain = F.regexp_extract_all(_col(html), F.lit(_each_tag(wanted) + f"(?:{_plain_inner(tag)})?+"), F.lit(1))
    return let(
        plain,
        lambda found: F.when(F.forall(found, lambda x: x != ""), F.transform(found, without_marks)).otherwise(
            _counted_inners(html, tag, wanted)
        ),
    )


def first_inner(html: Column | str, tag: str, condition: str) -> Column:
    """The first of ``element_inners``; read in one pass, no further than its end, if it holds no ``tag`` element."""
    plain = F.regexp_extract(_col(html), _first_tag(_open_tag(tag, condition)) + _plain_inner(tag), 1)
    return let(
        plain, lambda p: F.when(p != "", without_marks(p)).otherwise(_first(element_inners(html, tag, condition)))
    )


def _first(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def _joined(items: Column) -> Column:
    return F.array_join(F.filter(items, lambda x: x != ""), fv.LIST_SEPARATOR)


def canonical_url(html: Column | str, prop: str = fv.CANONICAL_PROPERTY) -> Column:
    """Content of the canonical meta tag, attributes in any order."""
    meta = _attribute("meta", "content", _has_attribute("property", prop))
    return non_empty(_unquoted(_group(_col(html), _first_tag(*meta))))


def link_hrefs(html: Column | str, css_class: str | None = None) -> Column:
    """Targets of all anchors, or of those with the class, in page order."""
    condition = _has_class(css_class) if css_class else ""
    anchors = _each_tag(*_attribute("a", "href", condition))
    return F.transform(F.regexp_extract_all(_col(html), F.lit(anchors), 1), _unquoted)


def has_next_page(html: Column | str, css_class: str = fv.NEXT_LINK_CLASS) -> Column:
    link = _first_tag(_open_tag("a", _has_class(css_class)))
    return F.coalesce(_col(html).rlike(link), F.lit(False))


def card_htmls(html: Column | str, css_class: str = fv.REVIEW_CARD_CLASS) -> Column:
    """Inner HTML of the review cards of a page, in page order.

    A page where the name of the class stands nowhere is not read as tokens.
    """
    page = _col(html)
    cards = element_inners(page, "article", _has_class(css_class))
    named = page.rlike(f"(?i){re.escape(css_class)}")
    return F.when(named, cards).when(page.isNotNull(), F.array().cast("array<string>"))


def _link_to(mark: str) -> str:
    """The first link whose target holds ``mark``; its target and its inner HTML are groups."""
    return _first_tag(*_attribute("a", "href", must_hold=mark)) + r"(.*?)</a\s*+>"


def review_id(card: Column | str, mark: str = fv.REVIEW_LINK_MARK) -> Column:
    """Target of the review link."""
    link = _first_tag(*_attribute("a", "href", must_hold=mark))
    return non_empty(_unquoted(_group(_col(card), link)))


def review_date(card: Column | str, mark: str = fv.REVIEW_LINK_MARK) -> Column:
    """Text of the review link."""
    return inner_text(F.regexp_extract(_col(card), _link_to(mark), 2))


def review_body(card: Column | str, css_class: str = fv.REVIEW_BODY_CLASS) -> Column:
    """Inner HTML of the review text; null if the card has none."""
    return first_inner(card, "span", _has_class(css_class))


def stars_from_label(label: Column | str) -> Column:
    return F.coalesce(_group(_col(label), r"(?U)\d+", 0), F.lit(fv.NOT_RATED))


def stars(card: Column | str, css_class: str = fv.STARS_CLASS) -> Column:
    """First number of the rating label."""
    label = _first_tag(*_attribute("span", "aria-label", _has_class(css_class)))
    return stars_from_label(_unquoted(F.regexp_extract(_col(card), label, 1)))


def authors(html: Column | str, list_class: str = fv.AUTHOR_LIST_CLASS, name_class: str = fv.AUTHOR_NAME_CLASS) -> Column:
    """Non-empty names of all contributor lists."""
    lists = element_inners(html, "div", _has_class(list_class))
    names = F.flatten(
        F.transform(lists, lambda x: F.transform(element_inners(x, "span", _has_class(name_class)), inner_text))
    )
    return F.coalesce(non_empty(_joined(names)), F.lit(fv.NOT_FOUND))


def avg_rating(html: Column | str, css_class: str = fv.RATING_CLASS) -> Column:
    found = first_inner(html, "div", _has_class(css_class))
    return F.coalesce(inner_text(found), F.lit(fv.NOT_FOUND))


def total_reviews(html: Column | str, mark: str = fv.REVIEWS_LINK_MARK) -> Column:
    """Count in the link to the community reviews, thousands marks removed."""
    text = inner_text(F.regexp_extract(_col(html), _link_to(mark), 2))
    count = F.replace(_group(text, fv.REVIEW_COUNT_PATTERN), F.lit(","), F.lit(""))
    return F.coalesce(count, F.lit(fv.NOT_FOUND))


def release_date(html: Column | str, test_id: str = fv.PUBLICATION_TEST_ID) -> Column:
    rest = rf"\b{_has_attribute('data-testid', test_id)}{_REST}"
    pattern = _first_tag(rf"<[a-z][\w-]*+{rest}", rf"<([a-z][\w-]*+){rest}") + r"(.*?)</\1\s*+>"
    found = _first(F.regexp_extract_all(_col(html), F.lit(pattern), 2))
    text = F.replace(inner_text(found), F.lit(fv.FIRST_PUBLISHED), F.lit(""))
    return F.coalesce(text, F.lit(fv.NOT_FOUND))


def genres(
    html: Column | str,
    test_id: str = fv.GENRES_TEST_ID,
    link_class: str = fv.GENRE_LINK_CLASS,
    label_class: str = fv.GENRE_LABEL_CLASS,
) -> Column:
    """Labels of the genre tags; no list, or a tag without label, is the sentinel."""
    listed = first_inner(html, "div", _has_attribute("data-testid", test_id))
    labels = F.transform(
        element_inners(listed, "a", _has_class(link_class)),
        lambda x: inner_text(first_inner(x, "span", _has_class(label_class))),
    )
    complete = F.forall(labels, lambda x: x.isNotNull())
    return F.coalesce(F.when(complete, _joined(labels)), F.lit(fv.NOT_FOUND))


def is_book_page(html: Column | str, css_class: str = fv.BOOK_CONTENT_CLASS) -> Column:
    """The page shows its main content, so its metadata can be trusted."""
    return F.coalesce(_col(html).rlike(_first_tag(_open_tag("div", _has_class(css_class)))), F.lit(False))
