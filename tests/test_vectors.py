import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import text_hash
from marginalia.operators import density, descent, discriminant, embedding, latent, layout, neighbours, spectral
from marginalia.session import materialise, scratch_path


def vectors(spark, x, ids=None, **columns):
    ids = range(len(x)) if ids is None else ids
    rows = [
        (int(i), [float(v) for v in row], *[c[n] for c in columns.values()]) for n, (i, row) in enumerate(zip(ids, x))
    ]
    types = "".join(f", {name} {'boolean' if isinstance(c[0], bool) else 'string'}" for name, c in columns.items())
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<float>{types}").repartition(4)


def brute_force(x, ids, k):
    x = np.asarray(x, dtype=np.float32).astype(float)
    out = {}
    for i, row in enumerate(x):
        d = np.sqrt(((x - row) ** 2).sum(1))
        out[ids[i]] = [b for _, b in sorted((round(a, 9), b) for a, b in zip(d, ids) if b != ids[i])[:k]]
    return out


def lists(graph):
    out = {}
    for r in sorted(graph.collect(), key=lambda r: (r.src, r["rank"])):
        out.setdefault(r.src, []).append(r.dst)
    return out


@pytest.mark.parametrize("sizes", [{}, {"cell_rows": 40, "block_rows": 25}, {"cell_rows": 10_000, "block_rows": 60}])
def test_neighbours_are_exact(spark, sizes):
    rng = np.random.default_rng(1)
    # A third of the rows is one vector; small groups of copies; clusters; noise.
    x = np.vstack([
        np.tile(rng.normal(size=6), (130, 1)), rng.normal(size=(15, 6)).repeat(4, 0),
        rng.normal(size=(100, 6)) * 0.05 + rng.normal(size=6) * 3, rng.normal(size=(100, 6)),
    ])
    ids = [int(i) for i in rng.permutation(len(x)) * 3 + 1]
    assert lists(neighbours.knn_graph(vectors(spark, x, ids), 7, **sizes)) == brute_force(x, ids, 7)


def test_neighbours_of_few_rows(spark):
    df = vectors(spark, np.eye(3))
    assert lists(neighbours.knn_graph(df, 7)) == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    assert neighbours.knn_graph(df.limit(0), 7).count() == 0


def test_probes_bound_the_search(spark):
    x = np.random.default_rng(2).normal(size=(200, 4))
    approximate = neighbours.knn_graph(vectors(spark, x), 5, cell_rows=25, probes=2)
    exact = brute_force(x, list(range(200)), 5)
    found = lists(approximate)
    hits = sum(len(set(found[i]) & set(exact[i])) for i in exact)
    assert hits > 0.6 * 5 * 200


def text_vectors(spark, n):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(n)
    ids = F.conv(F.substring("text_hash", 1, 15), 16, 10).cast("bigint")
    return materialise(embedding.embed(docs, "text").withColumn("vec_id", ids), "text-vectors")


def test_descent_finds_nine_tenths_on_texts(spark):
    emb = text_vectors(spark, 2000)
    graph = materialise(descent.approximate_knn(emb, 15, window=100), "descent")
    row = descent.recall(graph, neighbours.knn_graph(emb, 15)).first()
    n = emb.count()
    assert graph.count() == row.edges == 15 * n and row.found >= 0.9 * row.edges
    short = graph.groupBy("src").agg(F.max("rank").alias("last"), F.count_distinct("dst").alias("n")).filter("last != 15 OR n != 15")
    assert short.isEmpty() and graph.filter("src = dst").isEmpty()


def test_descent_with_copies_few_rows_and_any_partitions(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([np.tile(rng.normal(size=6), (130, 1)), rng.normal(size=(15, 6)).repeat(4, 0), rng.normal(size=(300, 6))])
    ids = [int(i) for i in rng.permutation(len(x)) * 3 + 1]
    df = vectors(spark, x, ids)
    got = lists(descent.approximate_knn(df, 7, window=80))
    want = brute_force(x, ids, 7)
    assert got.keys() == want.keys() and all(len(v) == 7 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) >= 0.95 * 7 * len(want)
    assert lists(descent.approximate_knn(df.repartition(1), 7, window=80)) == got
    few = vectors(spark, np.eye(3))
    assert lists(descent.approximate_knn(few, 7)) == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    assert descent.approximate_knn(few.limit(0), 7).count() == 0 and descent.approximate_knn(few.limit(1), 7).count() == 0
    assert lists(descent.approximate_knn(vectors(spark, np.ones((6, 3))), 2))[0] == [1, 2]


def test_descent_makes_lists_longer_until_a_sample_is_found(spark):
    # Noise of many dimensions: lists of 8 lead to three quarters of the neighbours.
    x = np.random.default_rng(21).normal(size=(3000, 24)).astype(np.float32)
    graph = materialise(descent.approximate_knn(vectors(spark, x), 8, spare=0, window=16, orders=2), "descent")
    row = descent.recall(graph, neighbours.knn_graph(vectors(spark, x), 8)).first()
    assert graph.count() == row.edges == 8 * 3000 and row.found >= 0.9 * row.edges
    assert graph.groupBy("src").agg(F.count_distinct("dst").alias("n")).filter("n != 8").isEmpty()


def test_descent_moves_messages_of_shards_and_no_row_for_each_edge(spark, monkeypatch):
    rows = {}

    def watched(df, name):
        rows.setdefault(name, []).append((out := materialise(df, name)).count())
        return out

    monkeypatch.setattr(descent, "materialise", watched)
    monkeypatch.setattr(descent, "LEAST_ROWS", 100)
    x = np.random.default_rng(22).normal(size=(2000, 5))
    assert descent.approximate_knn(vectors(spark, x), 6, window=40).count() == 6 * 2000
    shards = 20
    assert max(rows["descent-lists"]) <= shards * (shards + 3) and max(rows["descent-members"]) <= shards * (shards + 1)


def test_neighbours_are_exact_far_from_zero_and_next_to_outliers(spark):
    # Single precision tells none of these apart.
    rng = np.random.default_rng(23)
    near = 4096 + rng.integers(0, 1 << 9, size=(300, 5)) / 1024
    for x in (near, np.vstack([near, np.full((1, 5), 1e12), np.full((1, 5), -1e25)])):
        ids = [int(i) for i in rng.permutation(len(x))]
        got = neighbours.knn_graph(vectors(spark, x, ids), 4, cell_rows=20, block_rows=30).filter(F.col("dist") < 10)
        want = brute_force(near, ids, 4)
        assert {a: b for a, b in lists(got).items() if a in want} == want


def test_a_shelf_narrows_and_keeps_the_nearest(monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_HITS", 50)
    rng = np.random.default_rng(24)
    base, guests = rng.normal(size=(600, 7)).astype(np.float32), rng.normal(size=(90, 7)).astype(np.float32)
    slots, ids = np.repeat(np.arange(6), 100), rng.permutation(600).astype(np.int64)
    wanted = rng.random((90, 6)) < 0.7
    flat, *scale = neighbours._scaled(base)
    at, dst, dist = neighbours._on_shelf(guests, np.full(90, np.inf), wanted, base, (neighbours._halves(flat), *scale), ids, slots, 5)
    d = np.sqrt(((guests[:, None].astype(float) - base[None]) ** 2).sum(2))
    for i in range(90):
        far = np.where(wanted[i][slots], d[i], np.inf)
        want = [int(j) for j in np.lexsort((ids, far))[:5] if np.isfinite(far[j])]
        own = at == i
        assert dst[own].tolist() == ids[want].tolist() and dist[own] == pytest.approx(far[want])

def test_spectral_positions_are_leading_eigenvectors(spark):
    rng = np.random.default_rng(12)
    n = 60
    w = 0.5 + rng.random((n, n))
    group = np.arange(n) // 20  # three groups with few links between them: two eigenvalues stand out
    w = np.where(group[:, None] == group[None, :], w, w * 0.01)
    w = np.triu(w, 1) + np.triu(w, 1).T
    edges = spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in np.argwhere(w)], "src bigint, dst bigint, weight double")
    start = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(n + 2)], "id bigint, x double, y double")
    got = {r.id: (r.x, r.y) for r in spectral.spectral_positions(edges, start, n + 2, rounds=20).collect()}
    root = np.sqrt(w.sum(1))
    _, basis = np.linalg.eigh(w / np.outer(root, root))
    found = np.array([got[i] for i in range(n)])
    found = found / np.linalg.norm(found, axis=0)
    assert np.linalg.norm(basis[:, [-2, -3]].T @ found, axis=0) == pytest.approx([1, 1], abs=0.02)
    assert len(got) == n + 2 and all(np.isfinite(p).all() and np.abs(p).max() <= 10.1 for p in got.values())


def test_map_ends_when_it_is_settled(spark, monkeypatch):
    x = np.random.default_rng(13).normal(size=(6, 5)).repeat(12, 0) + np.random.default_rng(14).normal(size=(72, 5)) * 0.1
    emb = vectors(spark, x)
    edges = layout.fuzzy_edges(neighbours.knn_graph(emb, 8), 9).cache()
    seen = []
    look = layout._movement
    monkeypatch.setattr(layout, "_movement", lambda nodes: seen.append(look(nodes)) or seen[-1])
    layout.map_2d(edges, emb, settled=0.01)
    assert seen[-1] < 0.01 and all(m >= 0.01 for m in seen[:-1])
    seen.clear()
    layout.map_2d(edges, emb, epochs=10, settled=0.0)
    assert len(seen) == 2 and seen[-1] > 0


def test_vectors_travel_once_to_a_shelf(spark, monkeypatch):
    """Without structure nothing can be left out; what moves must not grow with the number of cells."""
    x = np.random.default_rng(5).normal(size=(1200, 24))
    moved = {}

    def kept(df, name):
        moved[name] = materialise(df, name)
        return moved[name]

    monkeypatch.setattr(neighbours, "materialise", kept)
    ids = np.arange(1200) * 3
    got = lists(neighbours.knn_graph(vectors(spark, x, ids), 7, cell_rows=12, block_rows=40))
    assert got == brute_force(x, ids, 7)
    assert moved["knn-visits"].count() <= 1200 * (neighbours.SHELVES + 2)


def test_fuzzy_edges(spark):
    x = np.random.default_rng(3).normal(size=(80, 5))
    k = 15
    graph = neighbours.knn_graph(vectors(spark, x), k - 1)
    edges = {(r.src, r.dst): r.weight for r in layout.fuzzy_edges(graph, k).collect()}
    assert all(abs(edges[b, a] - w) < 1e-12 and 0 < w <= 1 for (a, b), w in edges.items())
    one_way = {}
    for src, near in lists(graph).items():
        d = np.sqrt(((x.astype(np.float32).astype(float)[near] - x.astype(np.float32).astype(float)[src]) ** 2).sum(1))
        over = np.maximum(d - d.min(), 0)
        lo, hi = 1e-9, 1e3
        for _ in range(200):
            mid = math.sqrt(lo * hi)
            lo, hi = (lo, mid) if np.exp(-over / mid).sum() > math.log2(k) else (mid, hi)
        one_way.update({(src, n): w for n, w in zip(near, np.exp(-over / lo))})
    for (a, b), w in edges.items():
        p, q = one_way.get((a, b), 0), one_way.get((b, a), 0)
        assert abs(w - (p + q - p * q)) < 1e-6


def test_edges_of_equal_points(spark):
    graph = neighbours.knn_graph(vectors(spark, np.ones((6, 3))), 4)
    assert {r.weight for r in layout.fuzzy_edges(graph, 5).collect()} == {1.0}


def trustworthiness(x, y, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, -1)
    rank = d.argsort(1).argsort(1)
    e = ((y[:, None] - y[None]) ** 2).sum(2)
    np.fill_diagonal(e, np.inf)
    near = e.argsort(1)[:, :k]
    n = len(x)
    penalty = np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()
    return 1 - penalty * 2 / (n * k * (2 * n - 3 * k - 1))


def test_map_keeps_neighbourhoods(spark):
    rng = np.random.default_rng(4)
    # Forty groups in twelve dimensions: two principal components mix them up.
    x = rng.normal(size=(40, 12)).repeat(8, 0) + rng.normal(size=(320, 12)) * 0.25
    emb = vectors(spark, x)
    edges = layout.fuzzy_edges(neighbours.knn_graph(emb, 14), 15).cache()
    def run(**kw):
        rows = sorted(tuple(r) for r in layout.map_2d(edges, emb, **kw).collect())
        return np.array([r[1:] for r in rows])
    y = run(epochs=30)
    start = np.array([r[1:] for r in sorted(tuple(r) for r in layout.pca_positions(emb, "vec_id", "embedding").collect())])
    assert y.shape == (320, 2) and np.isfinite(y).all()
    assert trustworthiness(x, y, 7) > max(trustworthiness(x, start, 7) + 0.05, 0.95)
    assert np.allclose(run(epochs=2), run(epochs=2), atol=1e-6)


def test_map_is_the_same_for_any_partitions_and_sends_blocks(spark, monkeypatch):
    """Random partners go by numbers in the order of ids, and a task gets positions as a row per block of points."""
    rng = np.random.default_rng(15)
    emb = vectors(spark, rng.normal(size=(10, 6)).repeat(9, 0) + rng.normal(size=(90, 6)) * 0.2, [int(i) for i in rng.permutation(90) * 5])
    edges = layout.fuzzy_edges(neighbours.knn_graph(emb, 8), 9).cache()
    sent = []

    def run(df):
        return np.array(sorted(tuple(r) for r in layout.map_2d(edges, df, epochs=2).collect()))

    whole = run(emb)
    assert np.allclose(whole, run(emb.repartition(1)), atol=1e-4) and np.allclose(whole, run(emb.repartition(7)), atol=1e-4)
    monkeypatch.setattr(spectral, "BLOCK", 25)
    monkeypatch.setattr(spectral, "sent_if_small", lambda df, count: sent.append(df) or F.broadcast(df))
    assert np.allclose(whole, run(emb), atol=1e-4)
    assert max(df.count() for df in sent if any(c.endswith("_block") for c in df.columns)) == 4
    assert sum("id" not in df.columns and len(df.columns) == 3 and any(c.endswith("_block") for c in df.columns) for df in sent) >= 6
    monkeypatch.setattr(spectral, "sent_if_small", lambda df, count: df)
    assert np.allclose(whole, run(emb), atol=1e-4)


def test_hub_edges_are_cut(spark, monkeypatch):
    rng = np.random.default_rng(5)
    emb = vectors(spark, rng.normal(size=(60, 3)))
    hub = [(0, i, 0.5) for i in range(1, 60)] + [(i, 0, 0.5) for i in range(1, 60)]
    edges = spark.createDataFrame(hub, "src bigint, dst bigint, weight double")
    def run():
        return {r.id: (r.x, r.y) for r in layout.map_2d(edges, emb, epochs=2).collect()}
    whole = run()
    monkeypatch.setattr(layout, "_HUB_EDGES", 7)
    cut = run()
    assert whole.keys() == cut.keys()
    assert all(np.allclose(whole[i], cut[i], atol=1e-8) for i in whole)


def test_curve_parameters():
    a, b = layout.curve_parameters(0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01


def test_discriminant_full_dimension(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16)) @ rng.normal(size=(16, 16))
    mask = [bool(i % 3 == 0) for i in range(300)]
    x[mask] += 0.7
    x = x.astype(np.float32).astype(float)
    emb = vectors(spark, x, mask=mask)
    model = discriminant.fit_discriminant(emb, "mask")
    score = np.array([s for _, s in sorted(tuple(r) for r in discriminant.discriminant_score(emb, model).collect())])
    m = np.array(mask)
    within = sum(np.cov(x[g].T, ddof=0) * g.sum() for g in (m, ~m)) / 298
    w = np.linalg.solve(within, x[m].mean(0) - x[~m].mean(0))
    want = (x - x.mean(0)) @ (w / math.sqrt(w @ within @ w))
    assert np.allclose(score, want, atol=1e-6)
    pooled = sum(((score[g] - score[g].mean()) ** 2).sum() for g in (m, ~m)) / 298
    assert abs(pooled - 1) < 1e-9 and score[m].mean() > score[~m].mean() and abs(score.mean()) < 1e-9


def test_discriminant_far_from_zero(spark):
    rng = np.random.default_rng(16)
    x = rng.normal(size=(200, 8)) @ rng.normal(size=(8, 8))
    mask = [bool(i % 4 == 0) for i in range(200)]
    x[mask] += 0.5

    def scores(offset):
        rows = [(i, [float(v) + offset for v in r], m) for i, (r, m) in enumerate(zip(x, mask))]
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, mask boolean")
        model = discriminant.fit_discriminant(df, "mask")
        return np.array([s for _, s in sorted(tuple(r) for r in discriminant.discriminant_score(df, model).collect())])

    assert np.allclose(scores(1e6), scores(0.0), atol=1e-5)


def test_discriminant_edge_cases(spark):
    x = np.random.default_rng(7).normal(size=(40, 3))
    mask = [bool(i % 2) for i in range(40)]
    doubled = np.hstack([x, x])  # singular covariance
    emb = vectors(spark, doubled, mask=mask)
    model = discriminant.fit_discriminant(emb, "mask")
    assert np.isfinite(model.weights).all() and np.allclose(model.weights[:3], model.weights[3:])
    with pytest.raises(ValueError):
        discriminant.fit_discriminant(emb.filter("mask"), "mask")


def test_density(spark):
    rng = np.random.default_rng(8)
    values = {"a": np.r_[rng.normal(size=400), 60.0], "b": rng.normal(size=50) * 3 + 5, "single": [1.0], "flat": [2.0, 2.0]}
    rows = [(c, float(v)) for c, vs in values.items() for v in vs] + [("b", None)]
    out = density.density(spark.createDataFrame(rows, "cls string, v double").repartition(4), "v", "cls").collect()
    assert {r.cls for r in out} == {"a", "b"}
    for c in "ab":
        curve = sorted((r.x, r.density) for r in out if r.cls == c)
        xs, ys = np.array(curve).T
        v = np.asarray(values[c])
        h = v.std(ddof=1) * len(v) ** -0.2
        grid = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 200)
        want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.allclose(xs, grid) and np.allclose(ys, want, atol=1e-12)
        assert abs(np.trapezoid(ys, xs) - 1) < 0.01




class Counting:
    """Writes every text it is given to a folder, so calls can be counted across workers."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self):
        import uuid
        from pathlib import Path

        encode = embedding.HashingEncoder(8)

        def run(texts):
            Path(self.folder, uuid.uuid4().hex).write_text("\n".join(texts))
            return encode(texts)

        return run


def test_cache_embeds_each_text_once(spark, tmp_path):
    cache = scratch_path(spark, "cache")
    seen = lambda: sorted(t for f in tmp_path.iterdir() for t in f.read_text().split("\n"))
    first = spark.createDataFrame([("a",), ("b",), ("a",)], "t string")
    embedding.embed_cached(first, "t", cache, "enc", Counting(str(tmp_path)))
    assert seen() == ["a", "b"]
    more = spark.createDataFrame([("c",), ("b",), ("b",), ("c",), (None,)], "t string")
    all_vectors = embedding.embed_cached(more, "t", cache, "enc", Counting(str(tmp_path)))
    assert seen() == ["a", "b", "c"] and all_vectors.count() == 3
    embedding.embed_cached(more, "t", cache, "other", Counting(str(tmp_path)))
    assert seen() == ["a", "b", "b", "c", "c"]
    assert embedding.attach_embeddings(more, all_vectors, "t").count() == 4


def test_latent_vectors_against_a_small_exact_decomposition(spark, tmp_path):
    rng = np.random.default_rng(21)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(5)]
    texts = [" ".join(rng.choice(topics[i % 5], 15)) + f" Common word{i % 7}" for i in range(400)] + ["", "  ", None, "t0w1 t0w2"]
    df = spark.createDataFrame([(t,) for t in texts] * 2, "t string").repartition(5)
    model = latent.fit_latent(df, "t", 6, slots=128)
    # The same matrix in one place.
    kept = [t for t in dict.fromkeys(texts) if t and t.strip()]
    slots = [r.s for r in spark.createDataFrame([(t,) for t in kept], "t string").select(latent.word_slots("t", 128).alias("s")).collect()]
    counts = np.array([np.bincount(s, minlength=128) for s in slots])
    rarity = np.where(counts.any(0), np.log((1 + len(kept)) / (1 + (counts > 0).sum(0))) + 1, 0)
    a = np.log1p(counts) * rarity
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(model.rarity, rarity)
    assert model.captured == pytest.approx((s[:6] ** 2).sum() / len(kept), rel=0.01)
    assert np.linalg.norm(vt[:4] @ model.axes) ** 2 > 3.9
    assert latent.exact_share(df, "t", model) == pytest.approx((s[:6] ** 2).sum() / (s**2).sum())
    got = {r.text_hash: np.array(r.embedding) for r in latent.embed_latent(df, "t", model).collect()}
    hashes = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_hash("t").alias("h")).collect()}
    assert len(got) == len(kept) + 2 and not got[hashes[""]].any()
    for t, row in zip(kept, a):
        assert np.allclose(got[hashes[t]], row @ model.axes / np.linalg.norm(row @ model.axes), atol=1e-5)
    # Texts of a topic that share no word are near.
    a, b = " ".join(topics[0][:3]), " ".join(topics[0][3:6])
    c = " ".join(topics[1][:3])
    near = latent.embed_latent(spark.createDataFrame([(a,), (b,), (c,)], "t string"), "t", model).collect()
    x = {r.text_hash: np.array(r.embedding) for r in near}
    x = [x[r.h] for r in spark.createDataFrame([(a,), (b,), (c,)], "t string").select(text_hash("t").alias("h")).collect()]
    assert x[0] @ x[1] > 0.8 > 0.3 > abs(x[0] @ x[2])
    latent.save_latent(spark, model, str(tmp_path / "model"))
    again = latent.load_latent(spark, str(tmp_path / "model"))
    assert again.name == model.name and again.name != latent.fit_latent(df.limit(50), "t", 6, slots=128).name
    assert latent.fit_latent(df.limit(0), "t", 6).axes.shape == (4096, 0)


def test_a_table_of_word_slots_serves_fit_share_and_vectors(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(30)], 8)) for _ in range(60)] + ["", " ", None]
    df = spark.createDataFrame([(t,) for t in texts] * 2, "t string").repartition(3)
    table = materialise(latent.text_slots(df, "t", 32), "slots")
    assert table.count() == len(set(texts)) - 1
    model, again = latent.fit_latent(df, "t", 4, slots=32), latent.fit_latent(table, None, 4, slots=32)
    assert np.allclose(model.axes, again.axes) and np.allclose(model.rarity, again.rarity)
    assert model.captured == pytest.approx(again.captured)
    assert latent.exact_share(table, None, model) == pytest.approx(latent.exact_share(df, "t", model))
    got, want = ({r.text_hash: r.embedding for r in latent.embed_latent(*x, model).collect()} for x in ((table, None), (df, "t")))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in got)
    # Words are taken apart in one place of the plan.
    plan = latent.text_slots(df, "t", 32)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") == 1


def test_cache_of_a_fit(spark):
    cache = scratch_path(spark, "cache")
    df = spark.createDataFrame([("a b",), ("c d",), ("a c",)], "t string")
    models = [latent.fit_latent(d, "t", 2, slots=64) for d in (df, df.limit(2))]
    for model in models:
        got = embedding.embed_cached(df, "t", cache, model.name, embedder=latent.latent_embedder(model))
        want = {r.text_hash: r.embedding for r in latent.embed_latent(df, "t", model).collect()}
        assert {r.text_hash: r.embedding for r in got.collect()} == want


def test_batches_and_unit_length(spark):
    df = spark.createDataFrame([(f"word{i} common word{i % 3}",) for i in range(50)] + [("",), ("  ",)], "t string")
    out = embedding.embed(df, "t", batch_rows=7, tasks=3).join(df.select("t", text_hash("t").alias("text_hash")), "text_hash").collect()
    assert len(out) == 52
    for r in out:
        want = embedding.HashingEncoder()([r.t])[0]
        assert np.allclose(r.embedding, want) and abs(np.linalg.norm(r.embedding) - (1 if r.t.strip() else 0)) < 1e-6
