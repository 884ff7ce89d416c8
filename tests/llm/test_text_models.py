"""Scores, tokens, packing, quality, surrogates and licences against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marginalia.llm import packing, pii, quality
from marginalia.llm.bpe import encode_words, word_tokenizer
from marginalia.llm.katz import discounts, katz_scores
from marginalia.llm.licence_texts import END_OF_TERMS, TEXTS, full_texts
from marginalia.llm.licences import licence_scan
from marginalia.llm.queries import PII_KEY, documents_table, pack_documents
from tests.llm.brute import katz

SF = "/root/testdata/sf0.001"
ODD = [
    "", "  ", "A\x1cb\x85c d", "<|endoftext|>Hi<|startoftext|> there<|endoftext|>", "ΣΑΣ Σ", "İstanbul é é ﬁ",
    "it's we'll 'S 12a3", "日本語 テスト 😀😀 ​ x", "a" * 3000, "!!!???...", "<| x <|endoftext", " ́abc", "ǅ ß ẞ",
]


def frame(spark, texts, partitions=4):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)


@pytest.mark.parametrize("shard", [60, 10**6])
def test_katz(spark, shard):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("a b c d E f g hh II jj".split()) for _ in range(rng.randint(0, 30))) for i in range(60)}
    got = {r.doc_id: r for r in katz_scores(frame(spark, texts.values()), shard_tokens=shard).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    want, probability, words, after = katz(texts, held)
    for i, (n, known, base, score) in want.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].held_out) == (n, known, held[i])
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(score)
        assert got[i].train_tokens == sum(words.values())
    for a in [*after, "never seen"]:
        assert sum(probability(a, w) for w in [*words, "unknown"]) == pytest.approx(1)


def test_katz_is_the_same_for_any_partitions_and_beats_its_base_on_held_out(spark):
    docs = documents_table(spark, SF)
    one = {r.doc_id: r.score for r in katz_scores(docs.coalesce(1)).collect()}
    rows = katz_scores(docs.repartition(7), shard_tokens=5000).collect()
    assert all(r.score == pytest.approx(one[r.doc_id], rel=1e-12) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_discounts():
    d = discounts([100, 40, 20, 12, 8, 6])
    assert d[0] == 1 and all(0 < x < 1 for x in d[1:])
    assert discounts([0] * 6)[1:] == pytest.approx([0.5, 0.75, 5 / 6, 7 / 8, 9 / 10])


def test_bpe_equals_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), word_tokenizer(path)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abc deé'sΣ1!\n\t日😀́") for _ in range(40)) for _ in range(500)]
    texts += ["".join(rng.choice("aabcdefghiilmnoorstu") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += [r.text or "" for r in documents_table(spark, SF).collect()]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False), len(ids))
    row = encode_words(frame(spark, ["one small text"]), path).first()
    assert row.ids == library.encode("one small text", add_special_tokens=False).ids


def test_packing_holds_every_id_once(spark):
    docs = documents_table(spark, SF).select("doc_id", "text").unionByName(
        spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    ).repartition(3)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack_documents(docs).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i]) and r.length > 0
            part = np.array(ids[i][at : at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids[i])
    sizes = []
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert max(sizes) <= 2048
    assert sum(2048 - s for s in sizes if s & (s - 1)) < 0.01 * sum(sizes)


def test_differencing():
    rng = random.Random(3)
    sizes = [rng.randint(1, 256) for _ in range(700)]
    found = packing.differencing(sizes, 40)
    assert sorted(i for items in found for i in items) == list(range(700))
    sums = [sum(sizes[i] for i in items) for items in found]
    assert max(sums) - min(sums) <= 8
    # Three items of more than half a window each need three windows, whatever their sum.
    assert sorted(map(len, packing.windows([1100, 1100, 1100], 2048))) == [1, 1, 1]
    assert packing.differencing([], 3) == [] and packing.windows([5]) == [[0]]


def plain_statistics(text):
    words = [w.decode() for w in text.encode().split()]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark):
    rng = random.Random(4)
    texts = [r.text or "" for r in documents_table(spark, SF).collect()] + ODD
    texts += ["".join(rng.choice("ab c\n\t\x0b|#\xa0") for _ in range(300)) for _ in range(50)]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for r in quality.text_statistics(frame(spark, texts)).collect():
        assert tuple(r[c] for c in names) == plain_statistics(texts[r.doc_id])


def test_outliers_of_their_group(spark):
    rng = random.Random(5)

    def text(size, symbols=0.0):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.choice([size - 1, size, size + 1]))) for _ in range(200)]
        return " ".join(w + "###" * (rng.random() < symbols) for w in words)

    rows = [(i, text(4), "en", "a") for i in range(60)] + [(100 + i, text(9), "de", "a") for i in range(60)]
    rows += [(200, text(9), "en", "a"), (201, text(4), "de", "a"), (202, text(4, 0.3), "en", "a"), (203, text(4), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert [i for i, r in got.items() if not r.kept and not r.base_failed] == [200, 201, 202]
    # The same to the last bit, however the rows are dealt.
    again = {r.doc_id: r.d2 for r in quality.quality(df.repartition(5)).collect()}
    assert again == {i: r.d2 for i, r in got.items()}


def test_quality_labels(spark):
    """Against the labels: of clean texts long enough none goes, of junk none stays."""
    docs, labels = documents_table(spark, "/root/testdata/sf0.01"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in rows if r.quality == 1 and not r.base_failed)
    # Groups of a dozen rows say less: nine of ten.
    assert sum(not r.kept for r in rows if r.quality == 0) > 0.9 * sum(r.quality == 0 for r in rows)


NAMES = (
    "Mr. John Smith met Mrs Anna Smith; Dr Smith and Mr JOHN SMITH agreed. Mail J.Smith9@Example.com or "
    "j.smith9@example.com, call (212) 555-1234 or 212-555-1234, card 4111 1111 1111 1111 or 4111-1111-1111-1111, not "
    'order 4111 1111 1111 1112, at 10.1.2.3 or 8.8.4.4. господин Иванов, api_key: "Abc123xyz9", token = "0a1b2c3d4e"'
)


def test_surrogates(spark):
    rows = {r.doc_id: r for r in pii.pseudonymise(frame(spark, [NAMES, "call 212-555-1234", "nothing"]), "k").collect()}
    text = rows[0].text
    for gone in ("Smith", "SMITH", "Anna", "555-1234", "4111 1111 1111 1111", "8.8.4.4", "xyz9", "0a1b", "Иванов", "@example"):
        assert gone not in text
    assert "order 4111 1111 1111 1112" in text and rows[2].text == "nothing" and rows[2].n_entities == 0
    words = text.split()
    john, smith, anna = words[1], words[2], words[5]
    assert words[6] == f"{smith};" and words[8] == smith and text.count(smith.upper()) == 1 and john.upper() in text
    assert john.endswith("n") and anna.endswith("a") and john != anna and "господин " in text
    mails = [w.strip(",") for w in words if "@" in w]
    assert mails[0] == mails[1] and mails[0].endswith(".com") and mails[0].split("@")[0][1] == "."
    number = rows[1].text.removeprefix("call ")
    assert number in text and f"({number[:3]}) {number[4:]}" in text
    card = text.split("card ")[1][:19]
    assert card.replace(" ", "-") in text and int(pii_luhn(card.replace(" ", ""))) == 0 and " 10." in text
    other = pii.pseudonymise(frame(spark, [NAMES]), "another key").first().text
    assert smith not in other


def pii_luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10


def test_colliding_surrogates_stay_apart(spark, monkeypatch):
    plain = pii._surrogate
    from pyspark.sql import functions as F

    # At first all get the same one, then an entity of the corpus, then their own.
    monkeypatch.setattr(
        pii, "_surrogate", lambda k, c, n, key: [F.lit("same"), F.lit("a1@b.org"), plain(k, c, n, key)][min(n, 2)]
    )
    texts = [f"a{i}@b.org" for i in range(30)]
    rows = pii.pseudonymise(frame(spark, texts), PII_KEY).collect()
    assert len({r.text for r in rows}) == 30 and not {r.text for r in rows} & set(texts)


def test_licences(spark):
    mit = TEXTS[0][1]
    texts = [
        mit, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(" ", "  "), mit.replace("License", "Licence"),
        mit + " And more.", "Some words\nReleased under the MIT Licence.\nmore", "© 1999 X. All rights reserved.", "", "...",
    ]
    got = {r.doc_id: r for r in licence_scan(frame(spark, texts)).collect()}
    assert [got[i].text_licence for i in range(8)] == ["MIT"] * 3 + [None] * 5
    assert [(x.pos, x.licence) for x in got[4].line_licences] == [(1, "MIT")] and got[4].n_lines_matched == 1
    assert got[7].n_lines_matched == 0


@pytest.mark.parametrize(
    "text, gone",
    [
        ('config has password="correcthorse" here', "correcthorse"),
        ("config has api_key:'correcthorse' here", "correcthorse"),
        ('config has Secret  =  "correcthorse" here', "correcthorse"),
        ("write to ab@cd.ef now", "ab@cd.ef"),
        ("card 4111 1111 1111 1111 here", "4111 1111 1111 1111"),
        ("call 212-555-0100 now", "212-555-0100"),
        ("host 8.8.4.4 is up", "8.8.4.4"),
        *[(f"with {t} Zubov here", "Zubov") for group in pii.TITLES.values() for t in group],
    ],
)
def test_each_kind_is_found_in_a_text_without_other_hints(spark, text, gone):
    row = frame(spark, [text]).select(pii._matches(F.col("text")).alias("found")).first()
    assert len(row.found) == 1 and gone in row.found[0]


def test_phones_and_cards_next_to_digits(spark):
    card, phones = "4111 1111 1111 1111", ["212-555-0100", "212-555-0101"]
    texts = [
        " ".join(phones), "-".join(phones), f"{phones[0]} 2024", f"2024 {phones[0]}", f"{phones[0]}, 2024", f"+1 {phones[0]} 2024 17",
        f"{card} 123", f"{card} {phones[0]}", f"2023 {card}", f"{card}-{phones[0]} {phones[1]} 7", f"12 10.1.2.3 {card} 10.1.2.3",
        "order 4111 1111 1111 1112 of 2024", " ".join(phones * 3000),
    ]
    rows = {r.doc_id: r for r in pii.pseudonymise(frame(spark, texts), "k").collect()}
    assert [rows[i].n_entities for i in range(13)] == [2, 2, 1, 1, 1, 1, 1, 2, 1, 3, 3, 0, 6000]
    for i in range(11):
        assert not any(gone in rows[i].text for gone in (card, *phones, "10.1.2.3"))
    # One surrogate each, wherever it stands; other digits stay.
    one, two = rows[0].text.split()
    number = rows[6].text.removesuffix(" 123")
    assert [rows[i].text for i in range(1, 6)] == [f"{one}-{two}", f"{one} 2024", f"2024 {one}", f"{one}, 2024", rows[5].text]
    assert rows[5].text.endswith(" 2024 17") and int(pii_luhn(number.replace(" ", ""))) == 0
    assert [rows[i].text for i in (7, 8, 9)] == [f"{number} {one}", f"2023 {number}", f"{number}-{one} {two} 7"]
    assert rows[11].text == texts[11] and rows[12].text == " ".join([one, two] * 3000)


def test_surrogates_that_cannot_change_in_their_own_format(spark):
    secrets = ["********", "пароль-Секрет", "пароль-секрет", "密码密码密码密码", "--------", "_-" * 5, "İßçñéüöä", "😀" * 9, "0" * 8, "Ab-12-Cd"]
    texts = [f'password = "{s}"' for s in secrets]
    rows = {r.doc_id: r for r in pii.pseudonymise(frame(spark, [*texts, texts[0]]), "k").collect()}
    values = [rows[i].text.removeprefix('password = "').removesuffix('"') for i in range(len(texts))]
    assert not set(values) & set(secrets) and len(set(values)) == len(secrets)
    assert rows[len(texts)].text == rows[0].text and all(r.n_entities == 1 for r in rows.values())
    for old, new in zip(secrets, values, strict=True):
        assert not {c for c in old if not c.isascii()} - set(pii.CYRILLIC + pii.CYRILLIC.upper()) & set(new)
    assert [c for c in values[-1] if c == "-"] == ["-", "-"] and "-" not in values[4]


def test_surrogates_where_all_of_a_range_are_real(spark):
    rows = spark.range(65536).select(
        F.lit("address").alias("kind"), F.concat(F.lit("192.168."), F.expr("id div 256"), F.lit("."), F.expr("id % 256")).alias("canon")
    )
    got = pii.surrogates(rows, "k")
    assert got.select("surrogate").distinct().count() == 65536
    assert got.filter(F.col("surrogate").rlike(rf"^{pii.ADDRESS}$") & ~F.col("surrogate").startswith("192.168.")).count() == 65536


@pytest.mark.parametrize("kind, canon, shape", [
    ("phone", "12125550100", "[0-9]{15}"), ("card", "4111111111111", "4[0-9]{16}"), ("address", "10.1.2.3", "fd[0-9a-f]{2}(:[0-9a-f]{4}){7}"),
    ("secret", "0123456789", "[0-9a-f]{46}"), ("email", "a@b.org", "[a-z]{37}@[a-z][.]org"),
])
def test_late_attempts_have_room(spark, kind, canon, shape):
    one = spark.createDataFrame([(kind, canon)], "kind string, canon string")
    late = pii._surrogate(F.col("kind"), F.col("canon"), 11, "k")
    row = one.select(late.alias("s"), pii._in_format(F.col("canon"), late, F.col("kind")).alias("shown")).first()
    assert row.s == row.shown and re.fullmatch(shape, row.s)
    assert kind != "card" or int(pii_luhn(row.s)) == 0


def test_licences_in_full_and_further_ones(spark):
    whole = {name: text for name, text in full_texts() if END_OF_TERMS not in text or text.count("\n") > 150}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-SA-4.0"} <= set(whole)
    names = [name for name, _ in full_texts()]
    texts = [text.upper().replace("\n", "\r\n") for _, text in full_texts()]
    apache = dict(full_texts())["Apache-2.0"].split(END_OF_TERMS)[0]
    docs = frame(spark, [*texts, apache, "My own licence, version 9.", "Another text.", apache + " and more"])
    further = spark.createDataFrame([("Own-9", "my own license version 9"), ("Mine", texts[0]), (None, "another text"), ("None", "...")], "licence string, text string")
    got = {r.doc_id: r.text_licence for r in licence_scan(docs, further).collect()}
    n = len(texts)
    assert [got[i] for i in range(n)] == names and [got[i] for i in range(n, n + 4)] == ["Apache-2.0", "Own-9", None, None]
    assert {r.text_licence for r in licence_scan(docs).filter(f"doc_id > {n}").collect()} == {None}
