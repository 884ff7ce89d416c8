"""Text expressions against plain Python models of the rules."""

import random
import re

from pyspark.sql import functions as F

from marginalia import fixed_values as fv
from marginalia.functions import text

SPACES = [" a ", " \t x\n", "\x1c\x1fy\x85", "   ", "", "a b", None, "　z \r\n q "]


def test_white_space_set_is_pythons():
    ours = set(fv.WS_CHARS)
    assert ours == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_and_collapse(one):
    assert one(text.strip("x"), SPACES) == [s and s.strip() if s is not None else None for s in SPACES]
    assert one(text.collapse_ws("x"), SPACES) == [None if s is None else " ".join(s.split()) for s in SPACES]
    assert one(text.words("x"), SPACES) == [None if s is None else s.split() for s in SPACES]


def test_strip_tags(one):
    rows = ["<b>x</b>", "a<b", "<a\nb>stays", "<i j>gone", "&amp;<br/>", "<<x>>", "no"]
    assert one(text.strip_tags("x"), rows) == [re.sub("<.*?>", "", r) for r in rows]


def test_split_br(one):
    assert one(text.split_br("x"), ["a<BR>b<br/>c<br  />d<br>", "none"]) == [["a", "b", "c", "d", ""], ["none"]]


def model_paragraphs(html):
    pieces = re.sub(r"<[^>\n]*>", "", re.sub(r"(?i)<br\s*/?>", "\0", html)).split("\0")
    return [p.strip() for p in pieces if p.strip()]


def model_context(html, keyword, width):
    """Window rules stated over word indices."""
    if html is None:
        return None
    keyword = keyword.lower()
    hits = [p for p in model_paragraphs(html) if keyword in p.lower()]
    if not hits:
        return None
    ws = hits[0].split()
    if len(ws) <= width:
        return hits[0]
    at = [i for i, w in enumerate(ws) if keyword in w.lower()]
    if not at:
        return " ".join(ws[:width]) + "..."
    lo = min(max(at[0] - width // 2, 0), len(ws) - width)
    hi = lo + width
    return ("... " if lo else "") + " ".join(ws[lo:hi]) + (" ..." if hi < len(ws) else "")


def test_keyword_context_matches_model(spark):
    rng = random.Random(7)
    vocab = ["alpha", "beta", "Key", "xkeyx", "k", "ey", "two\nlines", "<i>", "</i>", "&amp;", " ", "KEY", "d e", "f"]
    breaks = ["<br>", "<br />", "<BR/>", "<br  />"]
    rows = [None, "", "key", "<br>", "a<br>the key b", "to kd ey", "x < y<br>z > key"]
    for _ in range(400):
        parts = [rng.choice(vocab) if rng.random() > 0.12 else rng.choice(breaks) for _ in range(rng.randrange(1, 30))]
        rows.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(rows)), "i int, x string").repartition(4)
    for keyword in ("KEY", "k ey"):
        for width in (1, 4, 5, 500):
            out = {r.i: r.y for r in df.select("i", text.keyword_context("x", keyword, width).alias("y")).collect()}
            want = {i: model_context(r, keyword, width) for i, r in enumerate(rows)}
            assert out == want


def test_break_between_angle_brackets_goes_with_them(one):
    assert one(text.paragraphs("x"), ["x < y<br>z > w"]) == [["x  w"]]


def test_remove_entities_in_order(one):
    entities = ["the trial", "trial", "catch-22", "k.", "stranger", "a+b"]
    rows = [
        "The Trial of trials: trial!", "CATCH-22 catch 22 catch-223", "joseph k. and k.x", "éstranger stranger",
        "  the  trial ", None, "", "the the trial trial", "a+b c", "nothing here\tbut  space",
    ]

    def model(t):
        for e in entities:
            t = re.sub(rf"\b{re.escape(e)}\b", "", t or "", flags=re.I)
        return " ".join((t or "").split())

    assert one(text.remove_entities("x", entities), rows) == [model(r) for r in rows]


def test_removal_that_makes_a_new_match(one):
    # Deleting the first entity joins nothing across blanks, the second still sees its own text.
    assert one(text.remove_entities("x", ["b", "a  c"]), ["a b c", "a  c", "zzz"]) == ["", "", "zzz"]


def test_default_entities_leave_none(one):
    rows = [f"before {e.upper()} after {e}" for e in fv.ENTITIES]
    assert one(text.remove_entities("x"), rows) == ["before after"] * len(rows)


def test_join_key_and_snippet(one):
    assert one(text.join_key("x"), [" The Castle ", None, "  "]) == ["the castle", "", ""]
    assert one(text.snippet("x", 3), ["abcdef", "ab", ""]) == ["abc...", "ab...", "..."]


def test_first_with_is_case_blind(one):
    pieces = F.split("x", "/")
    assert one(text.first_with(pieces, "Key"), ["a/bKEYb/key", "a/b", None]) == ["bKEYb", None, None]
