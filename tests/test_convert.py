import json

import pytest
from pyspark.sql import functions as F

from pagewright.api import convert_html
from pagewright.cli import main
from pagewright.operators.convert import convert_pages, to_markdown
from pagewright.options import ConvertOptions
from pagewright.plans import analytics
from pagewright.schema import RESPONSE
from pagewright.sources import pages as src
from pagewright.sources import sinks
from pagewright.sql import register
from pagewright.streaming.convert import stream_convert, stream_envelopes, write_stream

ARTICLE = "<html><head><title>T</title></head><body><nav><a href='/n'>nav</a></nav><article><h1>Head</h1><p>" + "Readable sentence here. " * 8 + "</p><p>More <a href='x'>link</a>.</p></article></body></html>"
WEAK = "<html><body><aside><p>Only an aside.</p><p><a href='/a'>go</a></p></aside></body></html>"
ROWS = [(1, "https://e.com/p", ARTICLE), (2, "https://e.com/q", WEAK), (3, "https://e.com/r", "  "), (4, None, None), (5, "", ARTICLE)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def converted(pages):
    return {r["page_id"]: r for r in convert_pages(pages).collect()}


def test_main_pass(converted):
    r = converted[1]
    assert r["markdown"].startswith("# Head\n\nReadable") and r["links"] == ["https://e.com/x"] and r["error"] is None
    assert r["quality"]["used_main_content"] and not r["quality"]["fallback_used"]
    assert r["metadata"]["title"] == "T" and r["metadata"]["canonical_url"] == "https://e.com/p" and r["metadata"]["extras"] == {}


def test_weak_page_takes_the_full_pass(converted):
    r = converted[2]
    assert "Only an aside." in r["markdown"] and r["links"] == ["https://e.com/a"]
    assert r["quality"]["fallback_used"] and not r["quality"]["used_main_content"]


def test_blank_and_null_pages(converted):
    for k in (3, 4):
        r = converted[k]
        assert (r["error"], r["markdown"], r["links"], r["quality"]["text_length"]) == ("html is required", "", [], 0)
    assert converted[5]["links"] == ["x"] and converted[5]["metadata"]["canonical_url"] == ""


def test_strict(pages):
    with pytest.raises(Exception, match="html is required"):
        convert_pages(pages, ConvertOptions(strict=True)).collect()


def raise_on_marked(root):
    if "boom" in root.text():
        raise ValueError("boom was found")


def test_a_page_that_fails_is_its_own_error(spark):
    from pagewright.dom.render import MarkdownConfig

    options = ConvertOptions(markdown=MarkdownConfig().with_before_hook("raise", raise_on_marked))
    df = spark.createDataFrame([(1, "<p>boom"), (2, "<p>fine " + "word " * 60), (3, None), (4, "<node><wrapped>x" + "<div>" * 2000)], "page_id long, html string")
    rows = {r["page_id"]: r for r in convert_pages(df, options).collect()}
    assert rows[1]["error"] == "ValueError: boom was found" and (rows[1]["markdown"], rows[1]["html_clean"], rows[1]["links"], rows[1]["quality"]["text_length"]) == ("", "", [], 0)
    assert rows[2]["error"] is None and rows[2]["markdown"].startswith("fine word") and rows[3]["error"] == "html is required" and rows[4]["markdown"] == "x"
    with pytest.raises(Exception, match="boom was found"):
        convert_pages(df.where("page_id < 3"), ConvertOptions(markdown=options.markdown, strict=True)).collect()
    assert options.describe()["before_hooks"] == ["drop_button_like_elements", "raise"] and options.describe()["after_hooks"][0] == "trim_opening_shell_controls"


def test_filters_stay_above_the_steps(pages):
    """A filter on quality must not copy the steps into itself: the plan stays small."""
    plain, filtered = (len(df._jdf.queryExecution().optimizedPlan().toString()) for df in (convert_pages(pages), convert_pages(pages).where("quality.fallback_used and markdown != ''")))
    assert filtered < 1.2 * plain + 2000


def test_full_mode_never_falls_back(pages):
    rows = {r["page_id"]: r for r in convert_pages(pages, ConvertOptions(only_main_content=False)).collect()}
    assert rows[1]["links"][0] == "https://e.com/n" and not any(r["quality"]["fallback_used"] for r in rows.values())


def test_include_without_match_is_empty_fallback(pages):
    rows = {r["page_id"]: r for r in convert_pages(pages, ConvertOptions(include_selectors=(".none",))).collect()}
    assert rows[1]["markdown"] == "" and rows[1]["quality"]["fallback_used"]


def test_options_by_row(spark):
    schema = "page_id int, url string, html string, options struct<only_main_content:boolean,include_selectors:array<string>,exclude_selectors:array<string>>"
    rows = [(1, "", ARTICLE, (None, None, None)), (2, "", ARTICLE, (False, None, ["article"])), (3, "", ARTICLE, (True, ["h1"], None))]
    out = {r["page_id"]: r for r in convert_pages(spark.createDataFrame(rows, schema)).collect()}
    assert out[1]["quality"]["used_main_content"] and out[2]["html_clean"].startswith("<nav>") and out[3]["html_clean"] == "<h1>Head</h1>"


def test_final_url_wins_and_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "https://a.com/", " https://b.com/d/ ", ARTICLE, "old", "x")], "page_id int, url string, final_url string, html string, markdown string, extra string")
    r = convert_pages(df).first()
    assert r["links"] == ["https://b.com/d/x"] and r["markdown"].startswith("# Head") and r["extra"] == "x"


def test_empty_table(spark, pages):
    assert convert_pages(pages.limit(0)).count() == 0


def test_partitioning_does_not_matter(pages, converted):
    again = {r["page_id"]: r for r in convert_pages(pages.repartition(5)).collect()}
    assert again == converted


def test_plan_has_two_gated_kernels_and_no_shuffle(pages):
    plan = convert_pages(pages)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 2 and "Exchange" not in plan and "Union" not in plan
    plan = convert_pages(pages, ConvertOptions(only_main_content=False))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_to_markdown_only(pages):
    rows = {r["page_id"]: r["markdown"] for r in to_markdown(pages).collect()}
    assert rows[1].startswith("# Head") and rows[4] == ""


def shout(c):
    return F.upper(c)


def test_user_after_hook(pages):
    r = convert_pages(pages.where("page_id = 1"), ConvertOptions(after_hooks=(("shout", shout),))).first()
    assert r["markdown"].startswith("# HEAD")


def test_json_round_trip(pages, converted):
    done = convert_pages(pages)
    back = {r["page_id"]: r for r in done.select("page_id", sinks.parse_response(sinks.response_json(done)).alias("r")).select("page_id", "r.*").collect()}
    assert all(back[k][f.name] == converted[k][f.name] for k in back for f in RESPONSE)
    assert "<" in done.where("page_id = 1").select(sinks.response_json(done)).first()[0]


def test_response_defaults(column):
    r = column(sinks.parse_response, "{}")
    assert r["quality"]["used_main_content"] is True and r["links"] == [] and r["metadata"]["title"] == ""


def test_markdown_text(column):
    assert column(sinks.markdown_text, "", "a", "a\n") == ["", "a\n", "a\n"]


def test_requests(spark, tmp_path):
    lines = [{"html": "x", "url": " u "}, {"html": "y", "options": {"only_main_content": False}}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, lines)))
    rows = src.read_requests(spark, str(tmp_path)).orderBy("html").collect()
    assert rows[0]["url"] == "u" and rows[0]["options"]["only_main_content"] is True and rows[1]["options"]["only_main_content"] is False
    df = spark.createDataFrame([("u", "", "h")], "url string, final_url string, html string")
    assert json.loads(df.select(src.request_payload(df)).first()[0]) == {"url": "u", "html": "h", "options": {"only_main_content": True}}


def test_files_and_envelopes(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>é\n</p>", "utf-8")
    row = src.read_html_files(spark, str(tmp_path / "a.html"), "https://e.com").first()
    assert row["html"] == "<p>é\n</p>" and row["path"].endswith("a.html")
    (tmp_path / "e.json").write_text(json.dumps({"html": "h", "url": "u", "rendered": True}) + "\n" + json.dumps({"url": "v"}))
    rows = src.read_envelopes(spark, str(tmp_path / "e.json"), final_url="f").orderBy("url").collect()
    assert [(r["html"], r["url"], r["final_url"]) for r in rows] == [("h", "u", "f"), ("", "v", "f")]


def test_envelopes_round_trip(spark, tmp_path):
    from pagewright.sources.pages import read_envelopes
    from pagewright.sources.sinks import write_envelopes

    rows = [("<p>a\n\"q\"</p>", "https://a.org/", None, True), (None, None, "text/html", None)]
    write_envelopes(spark.createDataFrame(rows, "html string, url string, content_type string, rendered boolean"), f"{tmp_path}/out")
    got = sorted(tuple(r) for r in read_envelopes(spark, f"{tmp_path}/out").select("html", "url", "content_type", "title", "rendered").collect())
    assert got == [("", "", "text/html", "", False), ("<p>a\n\"q\"</p>", "https://a.org/", "", "", True)]


def test_writers(spark, pages, tmp_path):
    done = convert_pages(pages)
    sinks.write_responses(done, str(tmp_path / "j"))
    sinks.write_markdown(done.where("page_id = 1"), str(tmp_path / "m"))
    sinks.write_documents(done, str(tmp_path / "p"))
    assert len([json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()]) == 5
    assert spark.read.text(str(tmp_path / "m"), wholetext=True).first()[0].endswith(".\n")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text(json.dumps({"html": ARTICLE.replace("Head", f"Head{k}"), "url": f"https://e.com/{k}"}))
    write_stream(stream_convert(stream_envelopes(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = convert_pages(src.read_envelopes(spark, str(folder)))
    key = lambda r: r["url"]
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key) == sorted(batch.select(spark.read.parquet(str(tmp_path / "out")).columns).collect(), key=key)


def test_sql_functions(spark, pages):
    register(spark)
    pages.createOrReplaceTempView("some_pages")
    assert spark.sql("SELECT md_visible_text('# [a](b)  x'), md_paragraph_count('a\\n\\nb'), md_link_density(1, 0), resolve_url('https://e.com/a', '/b')").first()[:] == ("a x", 2, 0.0, "https://e.com/b")
    assert spark.sql("SELECT html_to_markdown(html, url) FROM some_pages WHERE page_id = 1").first()[0].startswith("# Head")
    got = spark.sql("SELECT page_id, pos, link FROM some_pages, LATERAL page_links(html, url) WHERE page_id = 1 ORDER BY pos").collect()
    assert [(r["pos"], r["link"]) for r in got] == [(0, "https://e.com/n"), (1, "https://e.com/x")]
    assert spark.sql("SELECT count(*) FROM md_lines('a\\nb')").first()[0] == 2
    assert "Python" not in spark.sql("SELECT md_visible_text(html) FROM some_pages")._jdf.queryExecution().executedPlan().toString()


def test_cli(spark, tmp_path, capsys):
    page = tmp_path / "p.html"
    page.write_text(ARTICLE)
    assert main(["convert", "--html-file", str(page), "--url", "https://e.com/p"], spark) == 0
    assert json.loads(capsys.readouterr().out)["metadata"]["title"] == "T"
    assert main(["convert", "--html-file", str(page), "--output-format", "markdown", "--full-content", "--exclude-selector", "article"], spark) == 0
    assert "Readable" not in capsys.readouterr().out
    capture = tmp_path / "c.json"
    capture.write_text(json.dumps({"html": ARTICLE, "url": "https://e.com/p"}))
    assert main(["convert", "--from-capture", "--html-file", str(capture), "--final-url", "https://o.org/"], spark) == 0
    assert json.loads(capsys.readouterr().out)["links"] == ["https://o.org/x"]
    page.write_text(" ")
    assert main(["convert", "--html-file", str(page)], spark) == 1
    assert "conversion failed" in capsys.readouterr().err
    assert main(["convert", "--input", str(capture), "--input-kind", "envelopes", "--output", str(tmp_path / "o"), "--output-kind", "json"], spark) == 0
    assert spark.read.text(str(tmp_path / "o")).count() == 1


def test_single_page_api(spark):
    r = convert_html(spark, ARTICLE, url="https://e.com/p")
    assert r.quality.title_present and r.links == ["https://e.com/x"]
    with pytest.raises(ValueError, match="required"):
        convert_html(spark, "")


def test_analytics(spark):
    edges = analytics.link_edges(spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "page_id int, links array<string>"))
    assert {r["target"]: (r["pages"], r["links"]) for r in analytics.linked_by(edges).collect()} == {"a": (2, 2), "b": (1, 1)}
    pages = spark.createDataFrame([("a",)], "url string")
    assert analytics.known_targets(edges, pages).count() == 2 and analytics.unknown_targets(edges, pages).count() == 1
