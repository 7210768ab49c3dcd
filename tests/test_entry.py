import importlib

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def entry():
    return importlib.import_module("__spark_entry__")


def test_flagship(spark, entry):
    assert entry.entry(spark).count() == 50


def test_oracles_belong_to_queries(entry):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_page_queries_agree_with_oracles(spark, entry):
    duckdb = pytest.importorskip("duckdb")
    from pagewright.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name in ("quality_score_corpus", "metric_line", "trim_opening", "collapse_duplicates", "pp_label_date", "resolve_url", "page_metadata", "links_distinct"):
        done = con.execute(ORACLES[name])
        columns = sorted(c[0] for c in done.description)
        order = [[c[0] for c in done.description].index(c) for c in columns]
        want = sorted((tuple(r[i] for i in order) for r in done.fetchall()), key=repr)
        df = QUERIES[name](spark, SF)
        assert sorted(df.columns) == columns, name
        assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == want, name


def test_links_to_any_page(spark, entry, tmp_path):
    rows = [(0, "http://a.org/x/1", '<a href="2">n</a><a href="/y#top">n</a><a href="http://b.org/">n</a>'), (1, "http://a.org/x/2#f", '<a href="//b.org/">n</a><a href="../y">n</a>'), (2, "http://b.org/", '<a href="http://a.org/x/1">n</a>'), (3, "http://a.org/y", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {name: sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()) for name in ("link_page_known", "link_page_unknown")}
    assert got["link_page_unknown"] == []
    assert got["link_page_known"] == [(0, "http://a.org/x/2"), (0, "http://a.org/y"), (0, "http://b.org/"), (1, "http://a.org/y"), (1, "http://b.org/"), (2, "http://a.org/x/1")]


def test_histogram_counts_the_longest(spark, entry, tmp_path):
    spark.createDataFrame([("x" * n,) for n in (3, 999_999, 1_000_000, 1_000_001)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in entry.queries()["length_histogram"](spark, str(tmp_path)).collect()}
    assert got == {(0, 500, 1), (8000, 1_000_000, 1), (1_000_000, None, 2)}


def test_stream_reads_pages_in_any_layout(spark, entry, tmp_path):
    from pagewright.operators.convert import convert_pages

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").where("page_id < 12")
    pages.repartition(3).write.parquet(f"{tmp_path}/parts/pages.parquet")
    pages.coalesce(1).write.parquet(f"{tmp_path}/written")
    (tmp_path / "file").mkdir()
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "file" / "pages.parquet")
    want = sorted(tuple(r) for r in convert_pages(pages).select("page_id", "markdown", "quality.fallback_used").collect())
    for layout in ("parts", "file"):
        got = entry.queries()["stream_convert"](spark, str(tmp_path / layout))
        assert len(want) == 12 and sorted(tuple(r) for r in got.collect()) == want, layout
