import itertools
import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import lines, postprocess
from pagewright.plans import analytics, queries

WORDS = ["", "", "12", "Follow", "# Head one", "[Head one](/x)", "Head one", "- [x](/y)", "- [broken", "text [l](m)", "```", "[a](b) [c](d)", "[next](/n)", "~~~", "[timeline](x)", "  ", "* Head one"]


def documents(seed: int, n: int) -> list[str]:
    draw = random.Random(seed)
    return ["\n".join(draw.choice(WORDS) for _ in range(draw.randint(1, 12))) for _ in range(n)]


def test_control_and_pager_lines(column):
    assert column(lines.is_control_line, "Follow", " [Share](/s) ", "[timeline](x) more", "followers", "") == [True, True, True, False, False]
    assert column(lines.is_pagination_line, "[1](/a) [Next](/b)", "[1](/a) text", "[about](/a)", "[older](/x)") == [True, False, False, True]


def test_opening_shell_lines(column):
    long = "[" + "x" * 130 + "](y)"
    got = column(lines.is_opening_shell_line, "[a](b)", long, "42", "- [a](b)", "- Follow", "[o](/o)/ **[r](/r)** Public", "words")
    assert got == [True, False, True, True, True, True, False]


def test_trim_opening(column):
    trim = lambda *t: column(lines.trim_opening_shell, *t)
    assert trim("\n[home](/)\n12\n\n# Title\ntext") == "# Title\ntext"
    assert trim("- [watch\n\n[1.2k](/w)\nbody") == "body"
    assert trim("```\n[a](b)\n```") == "```\n[a](b)\n```"
    assert trim("body\r\n[a](b)") == "body\r\n[a](b)"
    assert trim("[a](b)\n\n") == ""


def test_metric_lines(column):
    assert column(lines.drop_metric_lines, "# T\n\n12\ntext") == "# T\n\ntext"
    assert column(lines.drop_metric_lines, "text\n12\ntext") == "text\n12\ntext"
    assert column(lines.drop_metric_lines, "# T\n```\n12\n```") == "# T\n```\n12\n```"


def test_heading_echoes(column):
    assert column(lines.drop_heading_echoes, "# A b\n\n[A b](/x)\ntext\nA b") == "# A b\n\ntext\nA b"
    far = "# A b\n" + "\n".join("t%d" % i for i in range(8)) + "\n[A b](/x)"
    assert column(lines.drop_heading_echoes, far) == far


def test_third_spaced_duplicate_stays(column):
    assert column(lines.collapse_duplicate_lines, "a b\n\na b\n\na b") == "a b\n\n\na b"
    assert column(lines.collapse_duplicate_lines, "a\na\n- b\n- b") == "a\n- b\n- b"


def model_collapse(md: str) -> str:
    """Straight reading of the rule, for comparison."""
    import re

    def name(t):
        t = re.sub(r"\[([^\]]+)\]\([^)]+\)", r"\1", t.lstrip("#").strip() if t.startswith("#") else t).replace("\\", "")
        return re.sub("[^a-z0-9]+", " ", t.lower()).strip()

    out, fenced, last, blanks = [], False, "", 0
    for line in md.split("\n"):
        t = line.strip()
        if t.startswith(("```", "~~~")):
            fenced, last, blanks = not fenced, "", 0
        elif not fenced:
            if not t:
                blanks += 1
            elif name(t) and name(t) == last and blanks <= 1 and not t.startswith(("- ", "* ")) and len(t) <= 120:
                continue
            else:
                last, blanks = name(t), 0
        out.append(line)
    return "\n".join(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_collapse_agrees_with_a_plain_loop(column, seed):
    docs = documents(seed, 60)
    assert column(lines.collapse_duplicate_lines, *docs) == [model_collapse(d) for d in docs]


def test_null_markdown(column):
    assert column(lines.after_hooks, None, "x") == [None, "x"]


def test_postprocess_cases(column):
    pp = lambda t: column(postprocess.postprocess, t)
    assert pp("a\r\n\r\n\r\n\r\nb") == "a\n\nb"
    assert pp("```\na\n\n\nb\n```") == "```\na\n\n\nb\n```"
    assert pp("[a](b)[![c](d)](e)") == "[a](b)\n\n[![c](d)](e)"
    assert pp("![c](d)\n\n[![c](d) T](e)") == "[![c](d) T](e)"
    assert pp("filter sort\ntext") == "text"
    assert pp("Switch cards to show media Filter\n## Sort\nx") == "x"
    assert pp("EngineeringMar 3, 2024") == "Engineering\\\n\\\nMar 3, 2024"
    assert pp("[Skip to content](#main)\n\nx") == "x"
    assert pp("a  \t\nb") == "a\nb"


def test_postprocess_is_stable(column):
    docs = documents(5, 40)
    once = column(postprocess.postprocess, *docs)
    assert column(postprocess.postprocess, *once) == once


def test_window_form_agrees_with_fold(spark):
    from pyspark.sql import functions as F

    from pagewright.plans.analytics import line_windows

    docs = spark.createDataFrame(list(enumerate(documents(9, 30))), "doc int, md string")
    rows = line_windows(lines.md_lines(docs, "md", "doc"), "doc", ["pos"])
    by_window = {(r["doc"], r["pos"]): r["inside"] for r in rows.collect()}
    by_fold = {r["doc"]: r["x"] for r in docs.select("doc", F.transform(lines.annotated(F.col("md")), lambda x: x["inside"]).alias("x")).collect()}
    assert by_window == {(d, i): v for d, x in by_fold.items() for i, v in enumerate(x)}
    assert len(list(itertools.chain(*by_fold.values()))) == len(by_window)


def test_long_documents_take_linear_time(spark):
    """64,000 lines through all hooks and post-processing, equal to the hooks one by one on a short document of the same lines."""
    import time

    from pagewright.operators import lines, postprocess

    def text(n):
        return "\n".join(("", "[a](/b)", "word %d" % (i % 50), "12", "```" if i % 997 == 0 else "", "# Heading", "same", "same", "![i](/i)", "[![i](/i)](/j)")[i % 10] for i in range(n))

    def run(md, steps):
        df = spark.createDataFrame([(md,)], "md string")
        for step in steps:
            df = df.select(step(F.col("md")).alias("md"))
        return df.first()[0]

    both = [lines.after_hooks, postprocess.postprocess]
    start = time.perf_counter()
    long = run(text(64_000), both)
    assert time.perf_counter() - start < 60 and 20_000 < long.count("\n") < 64_000
    assert run(text(2_000), both) == run(text(2_000), [*lines.AFTER_HOOKS.values(), postprocess.postprocess])


def test_neighbours_of_long_documents(spark):
    """Against a walk over the lines; no frame may reach ahead to the end, as Spark reads such frames anew for every row."""
    draw = random.Random(5)
    docs = {d: [draw.choice(["", "  ", "a", " b ", "```", "12", "- [broken", "[x](/y)", "# T"]) for _ in range(n)] for d, n in ((1, 1), (2, 40), (3, 3000))} | {4: [""] * 50}
    rows = spark.createDataFrame([(d, i, t) for d, texts in docs.items() for i, t in enumerate(texts)], "doc long, pos long, line string").repartition(4)
    found = analytics.line_windows(rows, "doc", ["pos"])
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {(r["doc"], r["pos"]): (r["fence"], r["inside"], r["before"], r["after"]) for r in found.collect()}
    assert found.columns == ["doc", "pos", "line", "fence", "inside", "before", "after"] and len(got) == sum(map(len, docs.values()))
    for d, texts in docs.items():
        bare, inside = [t.strip() for t in texts], False
        before = [""]
        for t in bare:
            before.append(t or before[-1])
        after = [""]
        for t in reversed(bare):
            after.append(t or after[-1])
        after.reverse()
        for i, t in enumerate(bare):
            inside ^= t == "```"
            assert got[d, i] == (t == "```", inside, before[i], after[i + 1])


@pytest.mark.parametrize("name", ["broken_metric", "line_neighbours", "metric_line"])
def test_line_queries_are_linear(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "window" in plan and "unboundedfollowing" not in plan


@pytest.mark.parametrize("name", ["line_neighbours", "metric_line"])
def test_line_queries_move_each_line_once(spark, name):
    """One exchange, one sort and one window; no documents are put together to be cut again."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") == 1 and "Aggregate" not in plan and "Generate" not in plan
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
