"""Mixing against a plain walk, source by source."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import mixing
from marginalia.llm.mixing import BITS, NEAR, mix_counts, mixed

SCHEMA = "doc_id long, text string, source string"


def filled(amount, caps, weights):
    """Reshare the excess until no row is above its cap."""
    out, left = [0.0] * len(caps), set(range(len(caps)))
    while left:
        level = amount / sum(weights[k] for k in left)
        above = {k for k in left if level * weights[k] > caps[k]}
        if not above:
            for k in left:
                out[k] = level * weights[k]
            break
        for k in above:
            out[k] = caps[k]
            amount -= caps[k]
        left -= above
    return out


def plain(rows, limit=3, weights=(5, 2, 1)):
    """``(doc_id, source, size, target, taken)`` of each row; ids are not repeated."""
    sizes = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    of = [sum(n for n, r in zip(sizes, rows, strict=True) if r[2] == s) for s in sources]
    parts = [weights[k % len(weights)] for k in range(len(sources))]
    targets = filled(sum(sizes), [limit * n for n in of], parts)
    out = []
    for s, target in zip(sources, targets, strict=True):
        own = [(r[0], r[1], n) for r, n in zip(rows, sizes, strict=True) if r[2] == s]
        # Copies of a document rise with the digits of its size.
        low, high = 0.0, 10.0
        for _ in range(200):
            level = (low + high) / 2
            full = sum(n * min(limit, level * len(str(n))) for *_, n in own) >= target
            low, high = (low, level) if full else (level, high)
        wanted = {i: min(limit, high * len(str(n))) for i, _, n in own}
        taken = {i: int(wanted[i]) * n for i, _, n in own}
        gap, tolerance = int(target - sum(taken.values()) + 1e-6), int(target / NEAR)

        def rank(i, t):
            named = f"text:{hashlib.md5((t or '').encode()).hexdigest()}" if i is None else str(i)
            u = (int(hashlib.md5(f"mix:{named}".encode()).hexdigest()[: BITS // 4], 16) + 0.5) / 2**BITS
            p = wanted[i] - int(wanted[i])
            return u / (1 - u) / (p / (1 - p)) if p > 1e-9 else None

        for _, i, n in sorted((rank(i, t), i, n) for i, t, n in own if n and rank(i, t) is not None):
            if n <= gap and gap > tolerance:
                taken[i] += n
                gap -= n
        out += [(i, s, n, target, taken[i]) for i, _, n in own]
    return out


def corpus(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for s, (n, longest) in sizes.items():
        for _ in range(n):
            rows.append((len(rows), " ".join(["w"] * int(rng.random() ** 3 * longest)), s))
    return rows


SIZES = {"hot": (900, 60), "b": (40, 200), None: (60, 30), "": (5, 3), "a": (3, 500), "c": (30, 1), "z": (80, 90)}


@pytest.mark.parametrize("bucket", [7, 10_000])
def test_against_a_plain_walk(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rows = corpus(1, SIZES)
    want = {r[0]: r for r in plain(rows)}
    got = mix_counts(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        _, _, size, target, taken = want[r.doc_id]
        assert (r.size, r.taken) == (size, taken) and r.target == pytest.approx(target)
        assert r.taken <= 3 * r.size
    by = defaultdict(int)
    for r in got:
        by[want[r.doc_id][1], r.target] += r.taken
    for (source, target), taken in by.items():
        assert taken <= target + 1e-6 and (taken >= 0.95 * target or target < 20), source


def test_chances_of_documents(spark):
    rows = [(i, "w " * (9 if i % 2 else 10), "s" if i % 4 < 2 else "t") for i in range(4000)]
    got = mix_counts(spark.createDataFrame(rows, SCHEMA), weights=(3, 1), seed="chances").collect()
    copies = defaultdict(Counter)
    for r in got:
        copies[r.doc_id % 4 < 2, r.size][r.copies] += 1
    mean = {k: sum(a * n for a, n in c.items()) / sum(c.values()) for k, c in copies.items()}
    for long_source in (True, False):
        # Two digits are wanted twice as often as one.
        assert mean[long_source, 10] / mean[long_source, 9] == pytest.approx(2, rel=0.1)
    assert all(len(c) <= 2 for c in copies.values())  # whole copies, and one more for some


def test_rows_of_the_mix(spark):
    rows = [(*r, f"own {r[0]}") for r in corpus(2, {"a": (30, 40), "b": (5, 20)})]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, size string")
    got = Counter((r.doc_id, r.text, r.size) for r in mixed(docs).collect())
    want = {r.doc_id: r.copies for r in mix_counts(docs).collect() if r.taken}
    assert {k[0]: n for k, n in got.items()} == want
    assert mixed(docs).columns == docs.columns and all(k[2] == f"own {k[0]}" for k in got)


def test_odd_rows(spark):
    same = [(None, "a b c", "s")] * 40 + [(7, "a b", "s")] * 30 + [(7, "a", "s")] * 30
    rows = [*same, (1, None, "s"), (2, "", None), (3, " \n\t", "t"), (None, None, None)]
    runs = []
    for partitions in (1, 6):
        got = mix_counts(spark.createDataFrame(rows, SCHEMA).repartition(partitions)).collect()
        runs.append(Counter((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got))
        assert len(got) == len(rows)
        assert sum(r.taken for r in got) == sum(r.size for r in got) == 210  # all words have one source
    assert runs[0] == runs[1]
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_counts(empty).collect() == [] and mixed(empty).collect() == []
    silent = mix_counts(spark.createDataFrame([(1, None, "a"), (2, "", "b")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in silent] == [(0, 0.0, 0)] * 2


def test_limit_and_share(spark):
    docs = spark.createDataFrame(corpus(3, {"a": (10, 10), "b": (200, 50)}), SCHEMA)
    got = mix_counts(docs, weights=(1, 1), limit=1, share=0.5, weight=F.lit(1)).collect()
    by = {r.target: r.source_size for r in got}
    # The small source gives all it has.
    assert min(by) == by[min(by)] and sum(by) == pytest.approx(sum(by.values()) / 2)
    assert all(r.copies <= 1 for r in got)
    everything = mix_counts(docs, limit=2, share=9.0).collect()
    assert all(r.copies == 2 or r.size == 0 for r in everything)
