"""Operators on the lines of a Markdown document: Column to Column, fence-aware, native, linear in the lines.

A document is annotated once (line, trimmed line, whether it is a fence or lies in one) and every hook takes the
annotated lines to fewer of them. Nothing grows inside a fold: whether a line lies in a fence follows from the
segments between fences, neighbours are looked up by index among the lines that are not blank, and the one rule
that depends on its own decisions folds over blocks of lines into a string of marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import ASCII_SPACE, LINK, LINK_LABELS, SPACE, comparable_line, let, link_labels, trim_space, unix_lines

# Lines that are controls of a page's shell, and labels of a pager.
CONTROL_LINES = (
    "add a comment",
    "copy",
    "follow",
    "highest score (default)",
    "improve this answer",
    "improve this question",
    "new issue",
    "reset to default",
    "share",
    "sorted by:",
    "trending (recent votes count more)",
    "date modified (newest first)",
    "date created (oldest first)",
)
PAGER_LABELS = ("next", "previous", "prev", "older", "newer")
LONGEST_SHELL_LINE = 120
ECHO_WINDOW = 8

LINK_ONLY = rf"\A{LINK}\z"
LINKS_ONLY = rf"\A(?:{LINK}(?:{ASCII_SPACE}+|\z))+\z"
NUMBER = r"\A[0-9]+\z"
BREADCRUMB = rf"\A{LINK}/{ASCII_SPACE}+\*\*{LINK}\*\*(?:{ASCII_SPACE}+\w+)?\z"


def is_fence(trimmed: Column) -> Column:
    return trimmed.startswith("```") | trimmed.startswith("~~~")


def is_control_line(line: Column) -> Column:
    def test(text: Column) -> Column:
        label = F.lower(trim_space(F.regexp_extract(text, rf"\A{LINK_LABELS}\z", 1)))
        low = F.lower(text)
        return low.isin(*CONTROL_LINES) | text.startswith("[") & (low.startswith("[timeline](") | label.isin(*CONTROL_LINES))

    return let(trim_space(line), test)


def is_links_only(text: Column) -> Column:
    return text.startswith("[") & text.rlike(LINKS_ONLY)


def is_pagination_line(line: Column) -> Column:
    pager = lambda label: let(F.lower(trim_space(label)), lambda v: v.rlike(NUMBER) | v.isin(*PAGER_LABELS))
    return let(trim_space(line), lambda text: is_links_only(text) & F.forall(link_labels(text), pager))


def is_short_link(text: Column) -> Column:
    return text.startswith("[") & (F.length(text) <= LONGEST_SHELL_LINE) & text.rlike(LINK_ONLY)


def is_opening_shell_line(trimmed: Column) -> Column:
    item = trim_space(F.regexp_replace(trimmed, r"\A- ", ""))
    listed = trimmed.startswith("- ") & (is_control_line(item) | is_short_link(item))
    return is_control_line(trimmed) | trimmed.rlike(NUMBER) | trimmed.startswith("[") & trimmed.rlike(BREADCRUMB) | is_short_link(trimmed) | listed


def is_broken_metric_line(trimmed: Column, following: Column) -> Column:
    return trimmed.startswith("- [") & ~trimmed.contains("](") & F.coalesce(following, F.lit("")).contains("](")


def is_metric_line(line: Column, before: Column, after: Column) -> Column:
    """A bare number beside a control, pager, link or heading line; ``before`` and ``after`` are the nearest non-blank lines."""
    def frames(near: Column) -> Column:
        return let(trim_space(F.coalesce(near, F.lit(""))), lambda t: (t != "") & (is_control_line(t) | is_pagination_line(t) | is_links_only(t) | t.startswith("#")))

    return trim_space(line).rlike(NUMBER) & (frames(before) | frames(after))


def is_collapsible_line(line: Column) -> Column:
    text = trim_space(line)
    return (text != "") & ~text.startswith("- ") & ~text.startswith("* ") & (F.length(text) <= LONGEST_SHELL_LINE)


#: Lines in a block of a fold.
BLOCK = 256
_FENCE_AHEAD = r"(?dm)^(?=" + SPACE.replace("\\u0009-\\u000D", "\\u0009\\u000B-\\u000D") + r"*+(?:```|~~~))"


def annotated(markdown: Column) -> Column:
    """array<struct<line, text, fence, inside>>; inside: in a fence once this line's own mark has counted.

    The text is cut before each fence line; the pieces lie outside and inside fences in turn.
    """
    def lines_of(pieces: Column, headless: Column) -> Column:
        def piece(text: Column, i: Column) -> Column:
            fences = i + F.when(headless, 0).otherwise(1)  # fence lines up to and with this piece's own
            lines = F.split(text, "\n")
            # a piece that others follow ends in a newline, which closes its last line
            lines = F.when(i < F.size(pieces) - 1, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
            row = lambda x, k: F.struct(x.alias("line"), trim_space(x).alias("text"), ((k == 0) & (fences > 0)).alias("fence"), (fences % 2 == 1).alias("inside"))
            return F.transform(lines, row)

        return F.flatten(F.transform(pieces, piece))

    pieces = F.split(unix_lines(markdown), _FENCE_AHEAD)
    return let(pieces, lambda p: let(~is_fence(trim_space(F.substring_index(p[0], "\n", 1))), lambda headless: lines_of(p, headless)))


def _numbered(rows: Column) -> Column:
    return F.transform(rows, lambda x, i: F.struct(x["line"].alias("line"), x["text"].alias("text"), x["fence"].alias("fence"), x["inside"].alias("inside"), i.alias("i")))


def _spoken(rows: Column) -> Column:
    """The lines that are not blank, each with its place ``i`` among all."""
    return F.filter(_numbered(rows), lambda x: x["text"] != "")


def without(rows: Column, dropped: Column) -> Column:
    """``rows`` less those at the places in ``dropped``."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), dropped)
    return F.when(F.size(dropped) == 0, rows).otherwise(F.transform(kept, lambda i: rows[i]))


def places_between(rows: Column, test: Callable[[Column, Column, Column], Column]) -> Column:
    """Places of non-blank lines for which ``test(row, text before, text after)`` holds; '' at the ends."""
    text = lambda at: F.coalesce(at["text"], F.lit(""))
    drop = lambda spoken: F.transform(
        F.filter(F.transform(spoken, lambda x, k: F.struct(x["i"].alias("i"), test(x, text(F.get(spoken, k - 1)), text(F.get(spoken, k + 1))).alias("drop"))), lambda x: x["drop"]), lambda x: x["i"]
    )
    return let(_spoken(rows), drop)


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda x: x["line"]), "\n")


def _opening(rows: Column) -> Column:
    """How many lines to cut off the top."""
    def cut(spoken: Column) -> Column:
        # state: at (spoken lines cut so far), pair (the line that ends a broken pair is still to be skipped), done
        def step(state: Column, x: Column) -> Column:
            text = x["text"]
            broken = is_broken_metric_line(text, F.get(spoken, state["at"] + 1)["text"])
            opens = ~x["fence"] & (broken | is_opening_shell_line(text))
            move = lambda pair: F.struct((state["at"] + 1).alias("at"), pair.alias("pair"), F.lit(False).alias("done"))
            stopped = F.struct(state["at"].alias("at"), F.lit(False).alias("pair"), F.lit(True).alias("done"))
            return F.when(state["done"], state).when(state["pair"], move(F.lit(False))).when(opens, move(broken)).otherwise(stopped)

        start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("pair"), F.lit(False).alias("done"))
        return F.coalesce(F.get(spoken, F.aggregate(spoken, start, step, lambda s: s["at"]))["i"], F.size(rows))

    return let(_spoken(rows), cut)


def _trim_opening(rows: Column) -> Column:
    return let(_opening(rows), lambda n: F.slice(rows, n + 1, F.size(rows)))


def _drop_controls(rows: Column) -> Column:
    return F.filter(rows, lambda x: x["fence"] | x["inside"] | ~(is_control_line(x["text"]) | is_pagination_line(x["text"])))


def _drop_metrics(rows: Column) -> Column:
    return let(places_between(rows, lambda x, before, after: ~x["fence"] & ~x["inside"] & is_metric_line(x["text"], before, after)), lambda dropped: without(rows, dropped))


def _drop_echoes(rows: Column) -> Column:
    def echoes(open_: Column) -> Column:
        head = F.array_position(F.transform(open_, lambda x: x["text"].startswith("#") & (comparable_line(x["text"]) != "")), F.lit(True)).cast("int")
        name = lambda at: comparable_line(open_[at - 1]["text"])
        near = lambda at: let(name(at), lambda n: F.filter(F.slice(open_, at + 1, ECHO_WINDOW), lambda x: x["text"].contains("](") & (comparable_line(x["text"]) == n)))
        return let(head, lambda at: F.when(at > 0, F.transform(near(at), lambda x: x["i"])).otherwise(F.array().cast("array<int>")))

    return let(let(F.filter(_spoken(rows), lambda x: ~x["fence"] & ~x["inside"]), echoes), lambda dropped: without(rows, dropped))


def _collapse_duplicates(rows: Column) -> Column:
    def step(state: Column, x: Column) -> Column:
        make = lambda mark, last, blanks: F.struct(F.concat(state["marks"], F.lit(mark)).alias("marks"), last.alias("last"), blanks.alias("blanks"))

        def decide(v: Column) -> Column:
            repeats = (v != "") & (v == state["last"]) & (state["blanks"] <= 1) & is_collapsible_line(x["text"])
            return F.when(repeats, make("-", state["last"], state["blanks"])).otherwise(make("+", v, F.lit(0)))

        return (
            F.when(x["fence"], make("+", F.lit(""), F.lit(0)))
            .when(x["inside"], make("+", state["last"], state["blanks"]))
            .when(x["text"] == "", make("+", state["last"], state["blanks"] + 1))
            .otherwise(let(comparable_line(x["text"]), decide))
        )

    def block(state: Column, part: Column) -> Column:
        fresh = F.struct(F.lit("").alias("marks"), state["last"].alias("last"), state["blanks"].alias("blanks"))
        return let(F.aggregate(part, fresh, step), lambda s: F.struct(F.concat(state["marks"], s["marks"]).alias("marks"), s["last"].alias("last"), s["blanks"].alias("blanks")))

    start = F.struct(F.lit("").alias("marks"), F.lit("").alias("last"), F.lit(0).alias("blanks"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))
    marks = F.split(F.aggregate(blocks, start, block, lambda s: s["marks"]), "")
    return F.when(F.size(rows) == 0, rows).otherwise(let(marks, lambda m: F.filter(rows, lambda x, i: m[i] == "+")))


#: The after hooks by name, in order, on annotated lines.
_HOOKS = {
    "trim_opening_shell_controls": _trim_opening,
    "drop_standalone_control_lines": _drop_controls,
    "drop_standalone_metric_lines": _drop_metrics,
    "drop_redundant_opening_heading_echoes": _drop_echoes,
    "collapse_adjacent_duplicate_lines": _collapse_duplicates,
}


def trim_opening_shell(markdown: Column) -> Column:
    """Cut blank, shell and broken-metric lines off the top; unchanged if there are none."""
    return let(annotated(markdown), lambda rows: let(_opening(rows), lambda n: F.when(n == 0, markdown).otherwise(_joined(F.slice(rows, n + 1, F.size(rows))))))


def drop_control_lines(markdown: Column) -> Column:
    return let(annotated(markdown), lambda rows: _joined(_drop_controls(rows)))


def drop_metric_lines(markdown: Column) -> Column:
    return let(annotated(markdown), lambda rows: _joined(_drop_metrics(rows)))


def drop_heading_echoes(markdown: Column) -> Column:
    """Among the first non-blank lines after the first heading, linked lines that repeat it go."""
    return let(annotated(markdown), lambda rows: _joined(_drop_echoes(rows)))


def collapse_duplicate_lines(markdown: Column) -> Column:
    """A line that repeats the last kept one with at most one blank line between goes; dropping keeps the blank count."""
    return let(annotated(markdown), lambda rows: _joined(_collapse_duplicates(rows)))


#: The same on whole documents.
AFTER_HOOKS = dict(zip(_HOOKS, (trim_opening_shell, drop_control_lines, drop_metric_lines, drop_heading_echoes, collapse_duplicate_lines)))


def after_hooks(markdown: Column) -> Column:
    """All hooks over one annotation: none of them takes a fence line away, so it stays true."""
    def run(rows: Column, hooks: tuple[Callable[[Column], Column], ...]) -> Column:
        return _joined(rows) if not hooks else let(hooks[0](rows), lambda left: run(left, hooks[1:]))

    return let(annotated(markdown), lambda rows: run(rows, tuple(_HOOKS.values())))


def hook_steps(markdown: Column, rows: str) -> list[Column]:
    """``after_hooks`` as steps, each to be put into the column ``rows`` in turn; the analyzer takes far less time over them."""
    return [annotated(markdown), *(hook(F.col(rows)) for hook in _HOOKS.values()), _joined(F.col(rows))]


def md_lines(df: DataFrame, markdown: str = "markdown", key: str = "page_id") -> DataFrame:
    """(key, pos, line): one row per line."""
    return df.select(key, F.posexplode(F.split(unix_lines(F.col(markdown)), "\n")).alias("pos", "line"))
