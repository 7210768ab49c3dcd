import pytest
from pyspark.sql import functions as F

from pagewright.operators import quality as ql

SHELL = "[Skip to content](#x)\n\n[Search docs](/s)\n\nSearch the blog\n\nPrimary navigation\n\nNotifications\n\nGo to file here now"


@pytest.fixture(scope="module")
def score(spark):
    def run(md, title="", links=0, images=0):
        df = spark.createDataFrame([(md, title)], "md string, title string")
        q = ql.quality(F.col("md"), F.col("title"), F.lit(links), F.lit(images), F.lit(True), F.lit(False))
        row = df.select(q.alias("q"), ql.needs_fallback(q).alias("weak")).first()
        return row["q"], row["weak"]

    return run


def test_tiny_text_needs_fallback(score):
    q, weak = score("tiny")
    assert (q["text_length"], q["paragraph_count"], q["title_present"], weak) == (4, 1, False, True)
    assert q["quality_score"] == pytest.approx(0.4 * 4 / 800 + 0.2 / 3 + 0.1)


def test_empty_text_has_density_bonus_only(score):
    q, weak = score("")
    assert (q["link_density"], q["quality_score"], weak) == (0.0, pytest.approx(0.1), True)


def test_long_text_is_capped(score):
    q, _ = score("\n\n".join(["word " * 100] * 4), "t", 0, 3)
    assert q["quality_score"] == pytest.approx(1.0)


def test_shell_lowers_the_score(score):
    assert score(SHELL, "t", 25)[0]["quality_score"] < score("A plain readable paragraph. " * 6, "t", 3, 1)[0]["quality_score"]


def test_penalties(column):
    assert column(ql.shell_penalty, "loading\nnotifications", "search x search", "navigation", "plain") == pytest.approx([0.12, 0.04, 0.04, 0.0])
    assert column(ql.shell_penalty, "\n".join(ql.SHELL_PHRASES[:12])) == pytest.approx(0.4)
    assert column(ql.table_penalty, "|a|\n|b|\n|c|", "| x |\n| --- |", "a | b", "|" * 16) == [0.18, 0.1, 0.0, 0.18]


def test_score_stays_in_range(column):
    texts = ["", SHELL * 3, "| " * 40, "x" * 5000]
    scores = column(lambda c: ql.quality(c, F.lit(""), F.lit(9), F.lit(0), F.lit(True), F.lit(False))["quality_score"], *texts)
    assert all(0 <= s <= 1 for s in scores)
