import random
import re

from marginalia.operators import corpus

SHOW = "https://b/book/show/"


def rounds_model(log, limit):
    """Plays the passes over a dict of url -> list of canonical URLs."""
    pending, known, out, works = set(log), set(), [], {}
    for n in range(1, limit + 1):
        if not pending:
            break
        settled = {}
        for url in pending:
            canonical = log[url][n - 1] if n <= len(log[url]) else None
            m = re.search(r"/book/show/(\d+)", canonical or "")
            if m:
                settled[url] = (m.group(1), canonical)
        fresh = {w for w, _ in settled.values()} - known
        for w in fresh:
            works[w] = min(c for x, c in settled.values() if x == w)
        known |= fresh
        out.append((n, len(pending), len(fresh)))
        pending -= set(settled)
        if n > 1 and not fresh:
            break
    return out, pending, works


def frame(spark, log):
    rows = [(u, i + 1, c) for u, cs in log.items() for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "url string, attempt int, canonical_url string")


def check(spark, log, limit=50, both=False):
    want, pending, works = rounds_model(log, limit)
    attempts = frame(spark, log).repartition(3)
    settled = corpus.settled_urls(attempts, limit).cache()
    for source in (attempts, settled) if both else (settled,):
        assert sorted(tuple(r) for r in corpus.retry_rounds(source, limit).collect()) == want
        assert {r.url for r in corpus.pending_after_rounds(source, limit).collect()} == pending
        assert {r.work_id: r.canonical_url for r in corpus.unique_works(source, None, limit).collect()} == works


def test_rounds_edge_cases(spark):
    check(spark, {"a": [None], "b": [None, SHOW + "1"]})  # nothing new in pass 1 goes on
    check(spark, {"a": [SHOW + "1"], "b": [None, SHOW + "1", None], "c": [None, None, SHOW + "2"]})  # pass 2 stalls
    check(spark, {"a": [SHOW + "1"], "b": ["https://b/list/1", "", SHOW + "2"], "c": [SHOW + "1"]}, both=True)
    check(spark, {"a": [SHOW + "1"], "b": [SHOW + "2"]})  # all done after one pass
    check(spark, {"a": [None, SHOW + "1"], "b": [None, SHOW + "2"], "c": [None, None, SHOW + "3"]}, limit=2)


def test_rounds_random(spark):
    rng = random.Random(3)
    for _ in range(2):
        log = {}
        for u in range(40):
            log[f"u{u}"] = [
                rng.choice([None, None, "https://b/list/1", f"{SHOW}{rng.randrange(15)}.n{rng.randrange(3)}"])
                for _ in range(rng.randrange(1, 9))
            ]
        check(spark, log, rng.choice([3, 50]))


def test_fallback_and_funnel(spark):
    log = {"a": [SHOW + "1.x"], "b": [None], "c": [None], "d": ["https://b/list"], "e": [None]}
    late = spark.createDataFrame(
        [("b", SHOW + "2"), ("c", "https://b/list"), ("d", None), ("a", SHOW + "99"), ("e", SHOW + "1.zz")],
        "url string, canonical_url string",
    )
    attempts = frame(spark, log)
    pending = corpus.pending_after_rounds(attempts)
    assert {r.url: r.work_id for r in corpus.fallback_pass(pending, late).collect()} == {"b": "2", "c": None, "e": "1"}
    assert [r.url for r in corpus.still_pending(pending, late).collect()] == ["d"]
    works = {r.work_id: r.canonical_url for r in corpus.unique_works(attempts, late).collect()}
    assert works == {"1": SHOW + "1.x", "2": SHOW + "2"}
    assert tuple(corpus.funnel(attempts.select("url"), attempts, late).first()) == (5, 2, 1)


def test_first_seen(spark):
    rows = [(1, 1, "a"), (1, 1, "a"), (1, 1, "b"), (1, 2, "b"), (1, 2, "c"), (2, 1, "a"), (2, 2, "d"), (2, 2, "d")]
    out = corpus.first_seen(spark.createDataFrame(rows, "list_no int, page_no int, url string").repartition(4))
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 3, 2), (1, 2, 2, 1), (2, 1, 1, 0), (2, 2, 2, 1)]


def test_backlog_and_batch(spark):
    urls = spark.createDataFrame([(f"u{i % 40}",) for i in range(80)], "url string")
    ledger = spark.createDataFrame([(f"u{i}", "NO_MATCH") for i in (1, 2, 3, 3)], "url string, status string")
    left = corpus.backlog(urls, ledger)
    assert left.count() == 37
    assert tuple(corpus.backlog_counts(urls, ledger, 10).first()) == (37, 10, 27)
    assert tuple(corpus.backlog_counts(urls, ledger, 50).first()) == (37, 37, 0)
    first = [r.url for r in corpus.next_batch(left, 10, seed=1).collect()]
    again = [r.url for r in corpus.next_batch(left.repartition(7), 10, seed=1).collect()]
    other = [r.url for r in corpus.next_batch(left, 10, seed=2).collect()]
    assert first == again and len(set(first)) == 10 and first != other
    done = ledger.unionByName(urls.selectExpr("url", "'FAILURE' AS status"))
    assert corpus.backlog(urls, done).count() == 0
    assert {r.status: r.n for r in corpus.status_counts(ledger).collect()} == {"NO_MATCH": 4}
