"""Column helpers for text: Unicode white space, visible text, link labels, comparable lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of Unicode White_Space, and RE2's ASCII white space.
SPACE = r"[\u0009-\u000D\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
ASCII_SPACE = r"[\t\n\f\r ]"

LINK = r"\[[^\]]+\]\([^)]+\)"
LINK_LABELS = r"\[([^\]]+)\]\([^)]+\)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it any number of times in ``body`` (stays one native expression)."""
    return F.transform(F.array(value), body)[0]


#: The same characters as a set to trim.
SPACES = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_space(text: Column) -> Column:
    """Trim Unicode white space; Spark's plain trim knows only U+0020."""
    return F.btrim(text, F.lit(SPACES))


def collapse_space(text: Column) -> Column:
    """Fields joined by single spaces."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}++", " "))


def unix_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def split_lines(text: Column) -> Column:
    return F.split(unix_lines(text), "\n")


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def visible_text(markdown: Column) -> Column:
    """Links become their labels, emphasis and heading marks go, white space collapses."""
    bare = F.regexp_replace(unix_lines(markdown), r"(?d)\[(.*?)\]\((.*?)\)", "$1")
    return collapse_space(F.translate(bare, "`*_#>", ""))


def link_labels(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(LINK_LABELS), 1)


def comparable_line(line: Column) -> Column:
    """Heading marks and links stripped, lower case, every run outside a-z 0-9 one space."""
    bare = trim_space(F.regexp_replace(trim_space(line), r"\A#+", ""))
    plain = F.translate(F.regexp_replace(bare, LINK_LABELS, "$1"), "\\", "")
    return F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", " "))


def paragraph_count(markdown: Column) -> Column:
    parts = F.split(trim_space(markdown), "\n\n")
    return F.size(F.filter(parts, lambda p: trim_space(p) != ""))


def first_lines(markdown: Column, count: int, shape: Callable[[Column], Column]) -> Column:
    """The first ``count`` non-empty results of ``shape`` over the lines; others than the first few are shaped only where those do not suffice."""
    few = 2 * count
    shaped = lambda lines: F.filter(F.transform(lines, shape), lambda v: v != "")

    def told(lines: Column) -> Column:
        return let(shaped(F.slice(lines, 1, few)), lambda head: F.slice(F.when((F.size(head) >= count) | (F.size(lines) <= few), head).otherwise(shaped(lines)), 1, count))

    return let(F.filter(split_lines(markdown), lambda line: trim_space(line) != ""), told)


def opening_text(markdown: Column, lines: int) -> Column:
    """The first lines with visible text, visible parts only, joined by newlines."""
    return F.array_join(first_lines(markdown, lines, visible_text), "\n")


def largest_source(srcset: Column) -> Column:
    """The candidate of largest descriptor (first of equals) in a srcset; null if it has none."""
    parts = F.filter(F.transform(F.split(srcset, ","), collapse_space), lambda p: p != "")

    def candidate(part: Column, place: Column) -> Column:
        tokens = F.split(part, " ")
        last = F.element_at(tokens, -1)
        number = F.when((F.size(tokens) > 1) & last.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[xw]\z"), F.regexp_replace(last, r"[xw]\z", "").try_cast("double"))
        return F.struct(F.coalesce(number, F.lit(1.0)).alias("size"), (-place).alias("place"), tokens[0].alias("url"))

    return F.array_max(F.transform(parts, candidate))["url"]
