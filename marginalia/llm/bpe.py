"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a word, exactly one token can be the last of its encoding: one
that ends there and is compatible with the last token of the prefix before it. An
automaton over the vocabulary gives the tokens that end at a place; the pair test
says whether two neighbours stay two tokens; back-pointers give the ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import documents, real_id

_END = "</w>"
_SHIFT = 0x10000  # a symbol that ends a word is another symbol
_NEVER = 1 << 60
# White space as the vocabulary's own pattern has it; Python's class has four control characters more.
_BLANK = r"\t-\r \x85\p{Z}"
_ODD = regex.compile(r"[\x1c-\x1f]")
CACHE = 200_000  # parts and words a task remembers, and as many from before these


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class PrefixBpe:
    """Encoder of single words for a vocabulary whose tokens each come from one merge."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = _END):
        self._end = end
        self._names = {i: t for t, i in vocab.items()}
        self._rank: dict[tuple[int, int], int] = {}
        # What a token was made of, and when; a single symbol was there from the start.
        self._made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            made = vocab[a + b]
            if made in self._made:
                raise ValueError(f"{a + b!r} comes from two merges")
            self._rank[pair], self._made[made] = rank, (*pair, rank)
        self._edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._compatible: dict[tuple[int, int], bool] = {}
        self._automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            s = self._symbols(token)
            self._automaton.add_word(s, (i, len(s)))
        self._automaton.make_automaton()

    def _symbols(self, token: str) -> str:
        if self._end and token.endswith(self._end) and token != self._end:
            body = token.removesuffix(self._end)
            return body[:-1] + chr(ord(body[-1]) + _SHIFT)
        return token

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one side of a token over time: each part, and the rank at which it goes."""
        found = self._edges.get((token, side))
        if found is None:
            found, gone, part = [], _NEVER, token
            while True:
                found.append((part, gone))
                if part not in self._made:
                    break
                gone = self._made[part][2]
                part = self._made[part][side]
            self._edges[token, side] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` before ``b`` stays ``a, b``: no merge across the border comes before the parts are gone.

        Of equal ranks the leftmost merge is first.
        """
        known = self._compatible.get((a, b))
        if known is None:
            known = not any(
                (r := self._rank.get((x, y))) is not None and r < x_gone and r <= y_gone
                for x, x_gone in self._edge(a, 1)
                for y, y_gone in self._edge(b, 0)
            )
            if len(self._compatible) > 4 * CACHE:
                self._compatible.clear()
            self._compatible[a, b] = known
        return known

    def encode(self, word: str) -> list[int]:
        """Ids of a word given in byte symbols."""
        if not word:
            return []
        if self._end:
            word = word[:-1] + chr(ord(word[-1]) + _SHIFT)
        # By end: the last token, and where it starts.
        last: list[int | None] = [None] * len(word)
        starts = [0] * len(word)
        known = self._compatible.get
        for end, (token, size) in self._automaton.iter(word):
            if last[end] is None:
                start = end + 1 - size
                if start:
                    before = last[start - 1]
                    if before is None:
                        continue
                    fits = known((before, token))
                    if not (self.compatible(before, token) if fits is None else fits):
                        continue
                last[end], starts[end] = token, start
        out, at = [], len(word)
        while at:
            token = last[at - 1]
            if token is None:
                raise ValueError("the vocabulary does not cover the word")
            out.append(token)
            at = starts[at - 1]
        return out[::-1]

    def name(self, token: int) -> str:
        return self._names[token]


Coded = tuple[str, str, int]  # ids as text, tokens as text, and their number


def _joined(coded: list[Coded]) -> Coded:
    kept = [x for x in coded if x[2]]
    if len(kept) == 1:
        return kept[0]
    return " ".join([x[0] for x in kept]), " ".join([x[1] for x in kept]), sum([x[2] for x in kept])


class _Memory(dict):
    """Results of a function; the older half of them goes when there are too many."""

    def __init__(self, function: Callable[[str], Coded]):
        super().__init__()
        self._function, self._older = function, {}

    def __missing__(self, text: str) -> Coded:
        found = self._older.get(text)
        if found is None:
            found = self._function(text)
        if len(self) >= CACHE:
            self._older = dict(self)
            self.clear()
        self[text] = found
        return found


class WordTokenizer:
    """A whole text with the normal form, pattern, special tokens and vocabulary of a tokenizer file.

    For files that normalise to NFC and lower case, drop white space and mark word
    ends. Every part of a text between blanks is encoded by itself, so results are
    kept per part.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        special = set(self._special.values())
        vocab = {t: i for t, i in model["vocab"].items() if i not in special}
        self._bpe = PrefixBpe(vocab, merges, model["end_of_word_suffix"])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pattern = regex.compile(pattern.replace(r"\s", _BLANK))
        self._blanks = regex.compile(f"[{_BLANK}]+")
        self._special_pattern = regex.compile("(" + "|".join(map(regex.escape, self._special)) + ")")
        self._symbols = byte_symbols()
        self._parts, self._words = _Memory(self._part), _Memory(self._word)

    def _word(self, word: str) -> Coded:
        ascii_only = word.isascii() and word.isprintable()  # such bytes stand for themselves
        ids = self._bpe.encode(word if ascii_only else "".join([self._symbols[b] for b in word.encode()]))
        return " ".join(map(str, ids)), " ".join(map(self._bpe.name, ids)), len(ids)

    def _part(self, part: str) -> Coded:
        """What stands between blanks, word by word of the file's pattern."""
        # Character by character: a final sigma is no special case.
        lower = part.lower() if part.isascii() else "".join(map(str.lower, unicodedata.normalize("NFC", part)))
        return _joined([self._words[w] for w in ([lower] if lower.isalpha() else self._pattern.findall(lower))])

    def encode(self, text: str) -> Coded:
        """Ids parted by blanks, their decoded text, and their number."""
        found: list[Coded] = []
        for k, piece in enumerate(self._special_pattern.split(text) if "<|" in text else (text,)):
            if k % 2:
                found.append((str(self._special[piece]), piece, 1))
            else:
                parts = self._blanks.split(piece) if _ODD.search(piece) else piece.split()
                found += map(self._parts.__getitem__, parts)
        return _joined(found)


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    return WordTokenizer(path)


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            n, ids, texts = [], [], []
            for value in batch.column(1):
                numbers, decoded, count = tokenizer.encode(value.as_py())
                n.append(count)
                ids.append(hashlib.sha256(numbers.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encode


def _id_writer(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        for batch in batches:
            coded = [tokenizer.encode(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(map(int, c[0].split())) for c in coded], pa.list_(pa.int32())),
                 pa.array([c[1] for c in coded])],
                ["doc_id", "ids", "decoded"],
            )

    return encode


def encode_words(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row: token ids, and what decoding them gives.

    ``path`` names a tokenizer file that every task can read. Null and empty texts
    have no tokens. Rows are independent of each other: no shuffle, one text at a
    time. An empty table gives an empty table; other columns are not read.
    """
    rows = documents(docs).mapInArrow(_id_writer(path), "doc_id bigint, ids array<int>, decoded string")
    return rows.withColumn("doc_id", real_id("doc_id"))


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``encode_words``, without moving the ids.

    The ids as decimal numbers parted by one blank, and the decoded text in UTF-8.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return documents(docs).mapInArrow(_encoder(path), schema).withColumn("doc_id", real_id(F.col("doc_id")))
