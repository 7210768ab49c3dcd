from pyspark.sql import functions as F

from pagewright.functions import text as tx


def test_unicode_space(column):
    assert column(tx.trim_space, "   a b　\u0085", "\t\n", "\u001c x") == ["a b", "", "\u001c x"]
    assert column(tx.collapse_space, " a  b\r\n c ", "") == ["a b c", ""]


def test_visible_text(column):
    assert column(tx.visible_text, "# Head [a](b)\n\n**x** `y` > z ![alt](src)") == "Head a x y z !alt"
    assert column(tx.visible_text, "[a\n](b)") == "[a ](b)"


def test_paragraphs_and_opening(column):
    assert column(tx.paragraph_count, "a\n\nb\n\n\n\nc", "", "a\nb") == [3, 0, 1]
    assert column(lambda c: tx.opening_text(c, 2), "\n# A\n\n***\nb\nc") == "A\nb"


def test_comparable_line(column):
    assert column(tx.comparable_line, "## [A b](x) \\#1!", "  ", "é a", "ü a", "éé") == ["a b 1", "", "a", "a", ""]


def test_largest_source(column):
    cases = {"a.png 1x, b.png 2x": "b.png", "a.png, b.png": "a.png", "a 100w, b 2x": "a", " , ": None, "a 1x, b big": "a", "a 0.5x, b": "b", "x,y 3x": "y"}
    assert column(tx.largest_source, *cases) == list(cases.values())


def test_occurrences(column):
    assert column(lambda c: tx.occurrences(c, "ab"), "ababab", "", "b") == [3, 0, 0]


def test_let_is_native(spark):
    plan = spark.range(1).select(tx.let(F.col("id"), lambda v: v + v))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
