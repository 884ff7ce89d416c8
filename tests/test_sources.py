from marginalia.session import materialise, scratch_path, spread
from marginalia.sources import readers, writers


def test_url_list(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("  b \n\na\nb\n \t\n a\n")
    assert sorted(r.url for r in readers.read_url_list(spark, str(path)).collect()) == ["a", "b"]


def test_status_lists(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("a\nb\n")
    (tmp_path / "no.txt").write_text("c\na\n")
    lists = {"VALID_MATCH": str(tmp_path / "ok.txt"), "NO_MATCH": str(tmp_path / "no.txt"), "FAILURE": str(tmp_path / "none.txt")}
    out = sorted(tuple(r) for r in readers.read_status_lists(spark, lists).collect())
    assert out == [("a", "NO_MATCH"), ("a", "VALID_MATCH"), ("b", "VALID_MATCH"), ("c", "NO_MATCH")]


def test_sorted_lines(spark):
    path = scratch_path(spark, "lines")
    writers.write_sorted_lines(spark.range(500).selectExpr("lpad(cast((id * 37) % 500 AS string), 3, '0') AS u").repartition(8), "u", path)
    assert [r.value for r in spark.read.text(path).collect()] == [f"{i:03d}" for i in range(500)]


def test_ledger(spark):
    path = scratch_path(spark, "ledger")
    assert readers.read_ledger(spark, path).count() == 0
    rows = spark.createDataFrame([("a", "VALID_MATCH", None), ("b", "FAILURE", "Timeout")], "url string, status string, error_type string")
    writers.append_by_status(rows, path, "1")
    writers.append_by_status(rows, path, "1")  # a retried batch
    writers.append_by_status(rows.limit(1), path)
    assert readers.read_ledger(spark, path).count() == 3
    plan = readers.read_ledger(spark, path).filter("status = 'FAILURE'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(status" in plan


NASTY = [
    ("He said \"hi\", twice", "5", "May 5, 2021", "line one\nline \"two\", end\n\n  spaced  "),
    ("NA", "Not rated", "", "None"),
    ("back\\slash", "4", None, "a\r\nb"),
    ('"', "1", "x", "\\\""),
]


def test_csv_round_trip(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame(NASTY, readers.REVIEWS_SCHEMA)
    assert writers.write_csv_if_any(df, path)
    plain = sorted(map(tuple, readers.read_reviews_csv(spark, path, pandas_nulls=False).collect()), key=str)
    # An empty field is a null in either mode, as in pandas.
    assert plain == sorted([tuple(v or None for v in row) for row in NASTY], key=str)
    nulled = {r.book_name: tuple(r) for r in readers.read_reviews_csv(spark, path).collect()}
    assert nulled[None] == (None, "Not rated", None, None)
    assert not writers.write_csv_if_any(df.limit(0), scratch_path(spark, "csv"))


def test_pandas_reads_the_same(spark):
    import pandas as pd

    path = scratch_path(spark, "csv")
    writers.write_csv(spark.createDataFrame(NASTY, readers.REVIEWS_SCHEMA).coalesce(1), path)
    import glob

    back = pd.read_csv(glob.glob(f"{path}/*.csv")[0], dtype=str)
    theirs = {tuple(None if pd.isna(v) else v for v in row) for row in back.itertuples(index=False)}
    assert theirs == {tuple(r) for r in readers.read_reviews_csv(spark, path).collect()}


def test_summary_types_and_missing_table(spark):
    path = scratch_path(spark, "summary")
    row = ("N", "A", "4.1", "Not Found", 3, "May 1, 1915", "")
    writers.write_csv(spark.createDataFrame([row], readers.SUMMARY_SCHEMA), path)
    assert tuple(readers.read_summary_csv(spark, path).first()) == row[:6] + (None,)
    assert readers.read_summary_csv(spark, path + "-absent").count() == 0


def test_embeddings(spark):
    path = scratch_path(spark, "emb")
    assert readers.read_embeddings(spark, path, "e").count() == 0
    df = spark.createDataFrame([("h", [1.0, 2.0], "e"), ("h", [3.0], "f")], "text_hash string, embedding array<float>, encoder string")
    writers.append_embeddings(df, path)
    assert [r.embedding for r in readers.read_embeddings(spark, path, "f").collect()] == [[3.0]]


def test_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\nx</p>")
    row = readers.read_page_files(spark, str(tmp_path)).first()
    assert row.html == "<p>\nx</p>" and row.url.endswith("a.html")


def test_pages_and_helpers(spark):
    df = spark.createDataFrame([(1, "u", "h")], readers.PAGES_SCHEMA)
    kept = materialise(df, "pages")
    assert kept.collect() == df.collect()
    assert spread(kept.coalesce(1), "page_id").rdd.getNumPartitions() == 8
    big = spark.range(10).repartition(9)
    assert spread(big) is big
