"""Line, exact, near and suffix dedup against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm.components import components
from marginalia.llm.exact_dedup import exact_duplicates
from marginalia.llm.line_dedup import deduplicated_lines, line_bitmaps
from marginalia.llm.near_dedup import near_duplicates, one_of_each, shingle_hashes
from marginalia.llm.suffix_dedup import common_prefixes, remove_repeats, suffix_array
from tests.llm.brute import repeats


def frame(spark, texts, partitions=8):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)


@pytest.mark.parametrize("key", [lambda c: F.lit(b"x"), lambda c: F.unhex(F.hex(F.length(c)))])
def test_bytes_are_compared_where_hashes_collide(spark, key):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB") for _ in range(rng.randint(0, 4))) for _ in range(300)]
    got = {r.doc_id: r for r in exact_duplicates(frame(spark, texts), key=key).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t.lower()].append(i)
    for members in groups.values():
        for i in members:
            assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(members), len(members), i == max(members))
    assert {r.keep_id for r in exact_duplicates(frame(spark, texts), key=key, keep="smallest").collect()} == {
        min(m) for m in groups.values()
    }


def test_lines(spark):
    rng = random.Random(2)
    pool = [f"{'Common line that many have, number'} {k} " + "x" * rng.randint(0, 9) for k in range(12)]
    texts = ["\n".join(rng.choice([*pool, "short", ""]) for _ in range(rng.randint(0, 150))) for _ in range(40)]
    docs = defaultdict(set)
    norm = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            if len(norm(line)) >= 40:
                docs[norm(line)].add(i)
    hit = {k: max(v) for k, v in docs.items() if len(v) >= 5}
    assert hit
    for partitions in (1, 7):
        for r in deduplicated_lines(frame(spark, texts, partitions)).collect():
            kept = [x for x in texts[r.doc_id].split("\n") if hit.get(norm(x), r.doc_id) == r.doc_id]
            assert r.text == "\n".join(kept) and r.n_lines - r.n_dropped == len(kept)
    bitmaps = line_bitmaps(frame(spark, texts)).collect()
    assert all(1 <= len(r.words) <= 3 for r in bitmaps)


def plain_components(texts):
    sets = [set(shingle_hashes(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets], links


def test_near_duplicates(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 4000)}"
    passage = [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    texts = ["", "one two", "ONE  two\n", "a b c d e f", "a b c d e g"]
    for k in range(60):  # a large group of near copies, at any distance around the limit
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = word()
        texts.append(" ".join(near))
    for k in range(60):  # a passage in many texts that are no copies
        own = [word() for _ in range(rng.randint(5, 60))]
        texts.append(" ".join(own[: len(own) // 2] + passage + own[len(own) // 2 :]))
    for k in range(20):  # pairs, and chains that drift away
        chain = [word() for _ in range(rng.randint(20, 400))]
        for _ in range(3):
            texts.append(" ".join(chain))
            chain = chain[max(1, len(chain) // 20) :] + [word()]
    rng.shuffle(texts)
    want, sizes, links = plain_components(texts)
    assert links > 100
    for partitions in (1, 9):
        got = {r.doc_id: r for r in near_duplicates(frame(spark, texts, partitions)).collect()}
        assert [got[i].component_id for i in range(len(texts))] == want
        assert [got[i].n_shingles for i in range(len(texts))] == sizes
        assert all(got[i].kept == (want[i] == i) for i in range(len(texts)))


def plain_classes(rows, percent=85):
    """The least id of each row's component, rows told apart by their place; a missing id is the least."""
    sets = [set(shingle_hashes(t or "").tolist()) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    least = lambda i: -1 if i is None else i
    return [min((rows[j][0] for j in range(len(rows)) if label[j] == label[i]), key=least) for i in range(len(rows))], label


def test_near_duplicates_whatever_the_ids(spark):
    rng = random.Random(8)
    base = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(200)) for _ in range(6)]
    rows = [(6, base[0] + " y"), (7, base[0]), (None, base[1]), (None, base[2] + " a"), (None, base[3]), (None, base[2])]
    rows += [(1, base[4]), (1, base[5]), (3, base[4] + " z"), (1, base[5] + " x"), (9, base[3] + " q"), (1, base[1] + " r")]
    rows += [(None, base[0] + " v"), (2, "one"), (2, "one"), (2, "two"), (None, "two"), (None, None), (4, ""), (4, ""), (5, base[5])]
    want, label = plain_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs.repartition(3)).collect()
    sizes = [len(shingle_hashes(t or "")) for _, t in rows]
    kept = lambda i: want[i] == rows[i][0]
    expected = sorted(((r[0], n, want[i] if n else r[0], kept(i) or not n) for i, (r, n) in enumerate(zip(rows, sizes, strict=True))), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == expected
    # One row of each group, and those without words.
    extra = docs.withColumns({"kept": F.lit("own"), "row": F.lit(1)})
    one = [(r.doc_id, r.text) for r in one_of_each(extra).collect()]
    assert len(one) == len({label[i] for i, n in enumerate(sizes) if n}) + sizes.count(0)
    groups = Counter(label[rows.index(r)] for r in one if r[1])
    assert set(groups.values()) == {1} and all(r[0] == want[rows.index(r)] for r in one if r[1])
    assert one_of_each(extra).columns == extra.columns


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(90), rng.randrange(90)) for _ in range(50)] + [(5, 5)]
    parent = {x: x for p in links for x in p if p[0] != p[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


def test_suffix_array_and_prefixes():
    import numpy as np

    rng = random.Random(5)
    for length in (1, 7, 30):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(length, 90))) for _ in range(20)]
        text = np.array([ord(c) if c != "|" else 0 for c in "|".join(parts) + "|"])
        order, rank = suffix_array(text, length)
        heads = [tuple(text[i : i + length]) for i in order]
        assert heads == sorted(heads) and sorted(order) == list(range(len(text)))
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
        owned = np.array([len(p) - length + 1 for p in parts])
        got = common_prefixes(text, order, rank, begins, owned, length)
        for b, n in zip(begins, owned, strict=True):
            for i in range(b, b + n):
                if rank[i]:
                    j, h = order[rank[i] - 1], 0
                    while h < length and j + h < len(text) and text[i + h] == text[j + h]:
                        h += 1
                    assert got[rank[i]] == h


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 500, "cut": 3}])
def test_repeats(spark, sizes):
    rng = random.Random(6)
    base = "".join(rng.choice("abcd ") for _ in range(300))
    texts = ["", "x" * 200, "abab" * 60, base, base[:150] + "zz" + base[150:], base[20:90] + "q", "é" * 100]
    for _ in range(50):
        a = rng.randint(0, 200)
        t = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 60)))
        texts.append(t + base[a : a + rng.randint(10, 120)] + t[::-1])
    texts += [texts[9]] * 2
    got = {r.doc_id: r for r in remove_repeats(frame(spark, texts), length=40, q=8, **sizes).collect()}
    for i, want in enumerate(repeats(texts, 40)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want
        if want[1] == 0:
            assert got[i].text == texts[i]
        elif texts[i].isascii():
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == want[3]
