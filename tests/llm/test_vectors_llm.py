"""Clustering and hard negatives against plain versions, on odd vectors too."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import clustering, negatives
from marginalia.llm.clustering import clusters, lloyd
from marginalia.llm.negatives import LEVELS, Tile, level_columns, mine, summaries
from marginalia.llm.vectors import products

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale):
    return [math.floor(scale * float(np.float32(x))) for x in v]


def random_rows(seed, n, width=64, spread=0.1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(5)]
    return [(i, [c + rng.gauss(0, spread) for c in centres[i % 5]], rng.randrange(3)) for i in range(n)]


ODD = [
    (1000, None, 1), (1001, [], 1), (1002, [0.5] * 63, 2), (1003, [0.5] * 65, 2), (1004, [None] + [0.1] * 63, 0),
    (1005, [NAN] + [0.1] * 63, 0), (1006, [INF] + [0.1] * 63, 0), (1007, [-INF] * 64, 0), (1008, [0.0] * 64, None),
    (1100, [0.25] * 64, 1), (1200, [0.0] * 64, 0), (1300, [-0.25] * 64, 2),
]


def plain_lloyd(rows, k, rounds, width, scale):
    kept = [(i, np.array(whole(v, scale), np.int64)) for i, v, _ in rows if usable(v) and len(v) == width]
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (digest(r[0]), r[1].tolist()))
    order += sorted((r for r in kept if r[0] is None), key=lambda r: r[1].tolist())
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, g in groups.items():
            centroids[j] = np.array([sum(int(x) for x in column) // len(g) for column in zip(*g, strict=True)])
    last = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = defaultdict(int)
    for _, j, d in last:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in last), key=str)


@pytest.mark.parametrize(("k", "rounds", "width"), [(16, 3, 64), (5, 1, 20), (700, 2, 64)])
def test_lloyd(spark, monkeypatch, k, rounds, width):
    monkeypatch.setattr(clustering, "CHUNK", 50)
    rows = random_rows(1, 300, width) + ODD + [(None, [0.3] * width, 1), (None, [0.3] * width, 1), (7, [0.1] * width, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"chunk": F.lit("own"), "block": F.lit(1)}).repartition(7)
    got = clusters(docs, k=k, rounds=rounds, width=width)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lloyd(rows, k, rounds, width, 64)


def test_ties_and_centroids_without_vectors(spark):
    rows = [(i, [0.5, 0.5], 0) for i in range(40)] + [(99, [float(2), 2.0], 0)]
    got = clusters(spark.createDataFrame(rows, SCHEMA), k=8, width=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_lloyd(rows, 8, 3, 2, 64)
    assert len({r.cluster for r in got}) <= 2
    assert clusters(spark.createDataFrame([], SCHEMA)).collect() == []
    assert clusters(spark.createDataFrame(ODD[:8], SCHEMA)).collect() == []
    one, centroids = lloyd(spark.createDataFrame([(3, [1e30] * 64, 0)], SCHEMA))
    assert [tuple(r) for r in one.collect()] == [(3, 0, 0)]
    assert centroids.first().centroid == [2**26] * 64


def plain_negatives(rows, anchors, positives=5, most=10, low=30, high=90):
    def members(source):
        out = {(i, y, tuple(whole(v, 256))) for i, v, y in source if i is not None and y is not None and usable(v)}
        return sorted(out)

    width = max([len(v) for *_, v in members(rows + anchors)] + [1])
    pad = lambda v: np.array([*v, *[0] * (width - len(v))], np.int64)
    vectors = [(i, y, pad(v)) for i, y, v in members(rows)]
    first = {}
    for i, y, v in members(anchors):
        first.setdefault(i, (y, pad(v)))
    out = []
    for a, (y, v) in first.items():
        scored = sorted((-int(v @ w), i, label) for i, label, w in vectors)
        same = [(i, -s) for s, i, label in scored if label == y and i != a][:positives]
        for p, score in dict.fromkeys(same):
            inside = [(i, -s) for s, i, label in scored if label != y and low * score <= -100 * s <= high * score]
            out += [(a, p, k + 1, i, score, s) for k, (i, s) in enumerate(inside[:most])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [None, (7, 40, 8)])
def test_negatives(spark, monkeypatch, sizes):
    if sizes:
        monkeypatch.setattr(negatives, "ANCHORS", sizes[0])
        monkeypatch.setattr(negatives, "CHUNK", (sizes[1], sizes[1]))
        monkeypatch.setattr(negatives, "TILE", (3, sizes[2]))
    rows = random_rows(2, 400) + ODD + [(401, [0.25] * 64, 0), (402, [0.25] * 64, 0), (402, [0.25] * 64, 0), (None, [0.2] * 64, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("own")).repartition(6)
    asked = docs.filter("vec_id % 20 = 0")
    want = plain_negatives(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0])
    got = sorted(tuple(r) for r in mine(docs, asked).collect())
    assert got == want and len(want) > 300
    want = plain_negatives(rows, [r for r in rows if r[0] == 1100 or r[0] == 0], 2, 3, 0, 100)
    assert sorted(tuple(r) for r in mine(docs, docs.filter("vec_id IN (0, 1100)"), 2, 3, 0, 100).collect()) == want


def test_negatives_of_equal_vectors_and_empty_tables(spark):
    rows = [(i, [0.5] * 8, i % 2) for i in range(60)] + [(200, [0.4] * 8, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(tuple(r) for r in mine(docs, docs.filter("vec_id = 0")).collect())
    assert got == plain_negatives(rows, rows[:1]) and len(got) == 5  # only 200 is below 90 %
    empty = spark.createDataFrame([], SCHEMA)
    assert mine(empty, empty).collect() == [] and mine(docs, empty).collect() == [] and mine(empty, docs).collect() == []
    assert mine(spark.createDataFrame(ODD[:1] + ODD[4:8], SCHEMA), docs).collect() == []


def test_bounds_hold_and_rule_pairs_out():
    rng = np.random.default_rng(5)
    # Smooth vectors: segments say much about their components.
    v = np.floor(np.cumsum(rng.normal(size=(400, 64)), axis=1) * 40).astype(np.int32)
    a = v[:30]
    sa, sv, exact = summaries(a), summaries(v), products(a, v)
    spans = []
    for level in range(len(LEVELS)):
        m, d = level_columns(level)
        middle, around = (x[:, c].astype(float) @ y[:, c].T.astype(float) for x, y, c in ((sa, sv, m), (sa, sv, d)))
        slack = 1e-5 * np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :] + 1
        assert (np.abs(exact - middle) <= around + slack).all()
        spans.append(around.mean())
    assert spans[0] > 2 * spans[1] > 4 * spans[2]  # each level is much closer
    lowest = np.sort(exact, axis=1)[:, -10].astype(float)
    for dense in (0.0, 1.1):
        negatives.DENSE, before = dense, negatives.DENSE
        tile = Tile(a, sa, v, sv, np.ones(exact.shape, bool))
        tile.narrow(lowest, np.full(len(a), np.inf))
        rows, columns, scores = tile.scores()
        negatives.DENSE = before
        assert (scores == exact[rows, columns]).all()
        assert (exact >= lowest[:, None])[~tile.open].sum() == 0 and tile.open.mean() < 0.2
