"""DuckDB fragments that oracles are put together from. They share no code or constants with the engine.

Regular expressions are RE2, like the rules they check.
"""

from __future__ import annotations

from pagewright.plans.corpus import DUCK

# What the rules name, stated again so that a wrong value in the engine shows.
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
SHELL_PHRASES = (
    "skip to content",
    "skip to main content",
    "search the blog",
    "search docs",
    "primary navigation",
    "repository files navigation",
    "you signed in with another tab or window",
    "you signed out in another tab or window",
    "you switched accounts on another tab or window",
    "please reload this page",
    "dismiss alert",
    "open more actions menu",
    "go to file",
    "top stories",
    "career site cookie settings",
    "loading",
    "birthday mode",
    "notifications",
    "new issue",
)
LIST_CONTROLS = (
    "switch cards to show media",
    "switch cards to hide media",
    "filter",
    "sort",
)


SP = r"[\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINK = r"\[[^\]]+\]\([^)]+\)"
LABEL_ONLY = r", '^\[([^\]]+)\]\([^)]+\)$', 1)"


def d_trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SP}+', ''), '{SP}+$', '')"


def d_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'), ' ')"


def d_visible(x: str) -> str:
    return d_collapse(rf"translate(regexp_replace({x}, '\[(.*?)\]\((.*?)\)', '\1', 'g'), '`*_#>', '')")


def d_in(x: str, values: tuple[str, ...]) -> str:
    return f"{x} IN ({', '.join(repr(v) for v in values)})"


def d_control(t: str) -> str:
    label = f"lower({d_trim('regexp_extract(' + t + LABEL_ONLY)})"
    return f"({d_in(f'lower({t})', CONTROL_LINES)} OR starts_with(lower({t}), '[timeline](') OR {d_in(label, CONTROL_LINES)})"


def d_pagination(t: str) -> str:
    labels = rf"regexp_extract_all({t}, '\[([^\]]+)\]\([^)]+\)', 1)"
    good = f"regexp_matches(lower({d_trim('x')}), '^(\\d+|{'|'.join(PAGER_LABELS)})$')"
    return rf"(regexp_matches({t}, '^(?:{LINK}(?:\s+|$))+$') AND len(list_filter({labels}, lambda x: NOT {good})) = 0)"


def d_short_link(t: str) -> str:
    return f"(regexp_matches({t}, '^{LINK}$') AND length({t}) <= 120)"


def d_opening(t: str) -> str:
    item = d_trim(f"substr({t}, 3)")
    return rf"({d_control(t)} OR regexp_matches({t}, '^\d+$') OR regexp_matches({t}, '^{LINK}/\s+\*\*{LINK}\*\*(?:\s+\w+)?$') OR {d_short_link(t)} OR (starts_with({t}, '- ') AND ({d_control(item)} OR {d_short_link(item)})))"


def d_frames(t: str) -> str:
    return rf"({t} <> '' AND ({d_control(t)} OR {d_pagination(t)} OR regexp_matches({t}, '^{LINK}$') OR regexp_matches({t}, '^(?:{LINK}(?:\s+|$))+$') OR starts_with({t}, '#')))"


def d_comparable(t: str) -> str:
    bare = d_trim(f"regexp_replace({t}, '^#+', '')")
    plain = rf"replace(regexp_replace({bare}, '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\', '')"
    return f"trim(regexp_replace(lower({plain}), '[^a-z0-9]+', ' ', 'g'), ' ')"


def d_paragraphs(x: str) -> str:
    return f"len(list_filter(string_split({d_trim(x)}, chr(10) || chr(10)), lambda p: {d_trim('p')} <> ''))::INT"


def d_opening_text(x: str) -> str:
    return f"array_to_string(list_slice(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {d_visible('l')}), lambda v: v <> ''), 1, 14), chr(10))"


def d_shell(opening: str) -> str:
    hits = " + ".join(f"(CASE WHEN contains({opening}, '{p}') THEN 1 ELSE 0 END)" for p in SHELL_PHRASES)
    count = f"(length({opening}) - length(replace({opening}, 'search', ''))) / 6"
    return f"least(0.06::DOUBLE * ({hits}) + CASE WHEN {count} >= 2 THEN 0.04::DOUBLE ELSE 0 END + CASE WHEN contains({opening}, 'navigation') THEN 0.04::DOUBLE ELSE 0 END, 0.4::DOUBLE)"


def d_table(x: str) -> str:
    rows = f"list_slice(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {d_trim('l')}), lambda l: l <> ''), 1, 12)"
    marked = f"len(list_filter({rows}, lambda l: starts_with(l, '|') OR contains(l, '| --- |')))"
    pipes = f"coalesce(list_sum(list_transform({rows}, lambda l: length(l) - length(replace(l, '|', '')))), 0)"
    return f"CASE WHEN {marked} >= 3 OR {pipes} >= 16 THEN 0.18::DOUBLE WHEN {marked} >= 2 OR {pipes} >= 8 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"


def annotated(source: str, i: str = "") -> str:
    """CTEs a, b: lines (doc, pos, line) with t (trimmed), fence, inside, before, after, as window functions."""
    return f"""a{i} AS (SELECT doc, pos, line, {d_trim('line')} AS t FROM {source}
), b{i} AS (
  SELECT *, (starts_with(t, '```') OR starts_with(t, '~~~')) AS fence,
    sum((starts_with(t, '```') OR starts_with(t, '~~~'))::INT) OVER w % 2 = 1 AS inside,
    coalesce(last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(first_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM a{i} WINDOW w AS (PARTITION BY doc ORDER BY pos)
)"""


D_LINES = annotated("corpus_lines")


D_SKIP = r"regexp_replace(md, '(?im)^\[skip to content\]\(#[^)]+\)\s*$', '', 'g')"
D_DATE = r"regexp_replace({x}, '([A-Za-z])((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{{1,2}},\s+\d{{4}})', '\1\\' || chr(10) || '\\' || chr(10) || '\2', 'g')"


def d_list_control(line: str) -> str:
    normal = d_collapse(rf"translate(translate(lower({d_trim(line)}), '\', ' '), '*_#`', '')")
    left = "v"
    for phrase in LIST_CONTROLS:
        left = f"replace({left}, '{phrase}', '')"
    return f"list_transform([{normal}], lambda v: v <> '' AND {d_collapse(left)} = '')[1]"
