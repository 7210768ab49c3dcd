"""DuckDB oracles of cleaning, rendering, hooks and post-processing, for the grammar of the ``pages`` table.

A page there is a nav list of links, a comment, a div, an article of a heading and paragraphs, some of which
open a ``<b>`` that nothing closes, and a footer. The tree that the HTML standard builds of it is written down
here directly: a paragraph is wrapped once for each ``<b>`` left open before it, three at most, and once for its
own.
"""

from __future__ import annotations

from pagewright.plans.corpus import DUCK
from pagewright.plans.duck import D_DATE, D_SKIP, annotated, d_collapse, d_comparable, d_control, d_frames, d_list_control, d_opening, d_opening_text, d_pagination, d_paragraphs, d_shell, d_table, d_trim, d_visible

D_HREFS = "h AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages)"
NL = "chr(10)"


def d_unescape(x: str) -> str:
    named = (("&quot;?", "chr(34)"), ("&copy;?", "'©'"), ("&middot;?", "'·'"), ("&amp;?", "'&'"))
    for name, char in named:
        x = f"regexp_replace({x}, '{name}', {char}, 'g')"
    return x


def d_escape(x: str) -> str:
    """Text as markup."""
    for char, name in (("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"), ("chr(34)", "'&#34;'"), ("chr(39)", "'&#39;'")):
        x = f"replace({x}, {char}, {name})"
    return x


def d_markup(x: str) -> str:
    return d_escape(d_unescape(x))


def d_markdown(x: str) -> str:
    """Text of one block as Markdown: white space collapsed, markup escaped, at the start of a line more of it."""
    x = rf"trim(regexp_replace({d_unescape(x)}, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')"
    x = rf"replace({x}, '\', '\\')"
    for char in "[]*_`":
        x = f"replace({x}, '{char}', '\\{char}')"
    x = rf"list_transform([{x}], lambda e: substr(e, 1, 1) || replace(substr(e, 2), '#', '\#'))[1]"
    x = rf"regexp_replace({x}, '^(#{{1,6}}|[-+*])(\s)', '\\\1\2')"
    return rf"regexp_replace({x}, '^(\d+)([.)])(\s)', '\1\\\2\3')"


D_TITLE = d_collapse(d_unescape("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))
D_ARTICLE = d_collapse(d_unescape("regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', '', 'g')"))
D_TARGET = "regexp_extract(url, '^[a-z]+://[^/?#]+') || replace(replace(url_encode({href}), '%2F', '/'), '%2C', ',')"

#: Pages taken apart: parts of each, its list items, its paragraphs (k from 1, own: opens a b, wrapped: how often).
PARTS = f"""parts AS (
  SELECT page_id, url, html, {D_TITLE} AS title, regexp_extract(html, '<h1>(.*?)</h1>', 1, 's') AS heading, regexp_extract(html, '<!--(.*?)-->', 1, 's') AS remark,
    regexp_extract(html, '<div class="ad">(.*?)</div>', 1, 's') AS ad, regexp_extract(html, '<footer>(.*?)(?:</footer>|$)', 1, 's') AS foot,
    string_split(regexp_extract(html, '</h1>(.*?)</article>', 1, 's'), '<p>')[2:] AS pieces,
    regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS labels
  FROM pages
), pieces AS (SELECT page_id, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS k FROM parts
), paragraphs AS (
  SELECT page_id, k, starts_with(piece, '<b>') AS own, regexp_replace(piece, '^<b>|<br>$|</p>$', '', 'g') AS words,
    least(3, coalesce(sum(starts_with(piece, '<b>')::INT) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT + starts_with(piece, '<b>')::INT AS wrapped
  FROM pieces
), items AS (SELECT page_id, url, unnest(hrefs) AS href, unnest(labels) AS label, generate_subscripts(hrefs, 1) AS k FROM parts
), opened AS (SELECT page_id, least(3, sum(own::INT))::INT AS open FROM paragraphs GROUP BY page_id)"""


def _paragraph_html(where: str = "true") -> str:
    inner = f"{d_markup('words')} || CASE WHEN own THEN '<br/>' ELSE '' END"
    return f"coalesce(string_agg('<p>' || repeat('<b>', wrapped) || {inner} || repeat('</b>', wrapped) || '</p>', '' ORDER BY k) FILTER ({where}), '')"


#: The pieces of markup that outputs are made of.
HTML = f"""shown AS (
  SELECT page_id, {_paragraph_html()} AS all_paragraphs, {_paragraph_html('k = 1')} AS first_paragraph FROM paragraphs GROUP BY page_id
), lists AS (
  SELECT page_id, string_agg('<li><a href="' || {d_markup('href')} || '">' || {d_markup('label')} || '</a></li>', '' ORDER BY k) AS items,
    string_agg('<li><a href="' || {d_escape(D_TARGET.format(href='href'))} || '">' || {d_markup('label')} || '</a></li>', '' ORDER BY k) AS resolved,
    string_agg('<li><a href="' || {d_markup('href')} || '">' || {d_markup('label')} || '</a></li>', '' ORDER BY k) FILTER (k = 1) AS first_item
  FROM items GROUP BY page_id
), marked AS (
  SELECT p.page_id, '<article><h1>' || {d_markup('heading')} || '</h1>' AS head, all_paragraphs || '</article>' AS tail, first_paragraph || '</article>' AS short_tail, items, resolved, first_item,
    '<h1>' || {d_markup('heading')} || '</h1>' AS heading, '<!--' || remark || '-->' AS remark, '<div class="ad">' || {d_markup('ad')} || '</div>' AS ad,
    '<footer>' || repeat('<b>', open) || {d_markup('foot')} || repeat('</b>', open) || '</footer>' AS foot
  FROM parts p LEFT JOIN shown s ON p.page_id = s.page_id LEFT JOIN lists l ON p.page_id = l.page_id LEFT JOIN opened o ON p.page_id = o.page_id
)"""

MAIN_ROOT = f"SELECT page_id, length({D_ARTICLE})::INT AS root_length FROM pages"
CLEAN_HTML = f"WITH {PARTS}, {HTML} SELECT page_id, head || tail AS main, '<nav><ul>' || items || '</ul></nav>' || remark || ad || head || tail || foot AS \"full\" FROM marked"
SELECT_INCLUDE = f"WITH {PARTS}, {HTML} SELECT page_id, first_item || {NL} || heading AS html_clean FROM marked"
SELECT_EXCLUDE = f"WITH {PARTS}, {HTML} SELECT page_id, remark || head || short_tail || foot AS html_clean FROM marked"

#: Lines of the rendered article (main) and of the rendered page (whole), before any hook: (doc, part, k, line).
RENDERED = f"""article_blocks AS (
  SELECT page_id AS doc, 0 AS k, '# ' || {d_markdown('heading')} AS line FROM parts
  UNION ALL SELECT page_id, k, '**' || {d_markdown('words')} || '**' FROM paragraphs
), main_lines AS (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY k, gap DESC) AS pos, CASE WHEN gap THEN '' ELSE line END AS line
  FROM article_blocks, (VALUES (true), (false)) g(gap) WHERE NOT (gap AND k = 0)
), whole_blocks AS (
  SELECT page_id AS doc, 0 AS part, k, '- [' || {d_markdown('label')} || '](' || {D_TARGET.format(href='href')} || ')' AS line FROM items
  UNION ALL SELECT page_id, 1, 0, {d_markdown('ad')} FROM parts
  UNION ALL SELECT doc, 2, k, line FROM article_blocks
  UNION ALL SELECT page_id, 3, 0, '**' || {d_markdown('foot')} || '**' FROM parts
), whole_lines AS (
  SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY part, k, gap DESC) AS pos, CASE WHEN gap THEN '' ELSE line END AS line
  FROM whole_blocks, (VALUES (true), (false)) g(gap) WHERE NOT (gap AND part = 0)
)"""


def _renumbered(i: str, keep: str, source: str) -> str:
    return f"l{i} AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) AS pos, line FROM {source} WHERE {keep})"


def hooks(source: str, n: str) -> tuple[str, str]:
    """(CTEs, name of the lines that the five hooks leave of ``source``); ``n`` keeps names apart."""
    trim, control, metric, echo, same = (f"{n}{k}" for k in range(5))
    steps = [
        annotated(source, trim),
        f"n{trim} AS (SELECT *, starts_with(t, '- [') AND NOT contains(t, '](') AND contains(after, '](') AS broken, {d_opening('t')} AS shell FROM b{trim})",
        f"""r{trim} AS (
  SELECT doc, 0::BIGINT AS pos, false AS pair, false AS stop, 0::BIGINT AS cut FROM (SELECT DISTINCT doc FROM n{trim})
  UNION ALL
  SELECT n.doc, n.pos, CASE WHEN r.pair THEN t = '' ELSE NOT fence AND t <> '' AND broken END, NOT r.pair AND t <> '' AND (fence OR NOT (broken OR shell)),
    CASE WHEN r.pair OR t = '' OR (NOT fence AND (broken OR shell)) THEN n.pos ELSE r.cut END
  FROM r{trim} r JOIN n{trim} n ON n.doc = r.doc AND n.pos = r.pos + 1 WHERE NOT r.stop
)""",
        f"c{trim} AS (SELECT n.*, cut FROM n{trim} n JOIN (SELECT doc, max(cut) AS cut FROM r{trim} GROUP BY doc) c ON n.doc = c.doc)",
        _renumbered(trim, "pos > cut", f"c{trim}"),
        annotated(f"l{trim}", control),
        _renumbered(control, f"fence OR inside OR NOT ({d_control('t')} OR {d_pagination('t')})", f"b{control}"),
        annotated(f"l{control}", metric),
        _renumbered(metric, rf"fence OR inside OR NOT (regexp_matches(t, '^\d+$') AND ({d_frames('before')} OR {d_frames('after')}))", f"b{metric}"),
        annotated(f"l{metric}", echo),
        f"n{echo} AS (SELECT *, {d_comparable('t')} AS name FROM b{echo})",
        f"h{echo} AS (SELECT doc, min(pos) AS opens, arg_min(name, pos) AS heading FROM n{echo} WHERE NOT fence AND NOT inside AND starts_with(t, '#') AND name <> '' GROUP BY doc)",
        f"c{echo} AS (SELECT n.*, opens, heading, sum((NOT fence AND NOT inside AND t <> '' AND pos > opens)::INT) OVER (PARTITION BY n.doc ORDER BY pos) AS k FROM n{echo} n LEFT JOIN h{echo} h ON n.doc = h.doc)",
        _renumbered(echo, "fence OR inside OR NOT coalesce(pos > opens AND t <> '' AND k <= 8 AND name = heading AND contains(t, ']('), false)", f"c{echo}"),
        annotated(f"l{echo}", same),
        f"n{same} AS (SELECT *, {d_comparable('t')} AS name, (NOT starts_with(t, '- ') AND NOT starts_with(t, '* ') AND length(t) <= 120) AS short FROM b{same})",
        f"""r{same} AS (
  SELECT doc, 0::BIGINT AS pos, '' AS last, 0 AS blanks, false AS gone FROM (SELECT DISTINCT doc FROM n{same})
  UNION ALL
  SELECT n.doc, n.pos, CASE WHEN fence THEN '' WHEN inside OR t = '' THEN last ELSE name END,
    CASE WHEN fence THEN 0 WHEN inside THEN blanks WHEN t = '' THEN blanks + 1 WHEN name <> '' AND name = last AND blanks <= 1 AND short THEN blanks ELSE 0 END,
    NOT fence AND NOT inside AND t <> '' AND name <> '' AND name = last AND blanks <= 1 AND short
  FROM r{same} r JOIN n{same} n ON n.doc = r.doc AND n.pos = r.pos + 1
)""",
        f"g{same} AS (SELECT n.*, gone FROM n{same} n JOIN r{same} r ON n.doc = r.doc AND n.pos = r.pos)",
        _renumbered(same, "NOT gone", f"g{same}"),
    ]
    return ",\n".join(steps), f"l{same}"


def joined(name: str, docs: str, lines: str) -> str:
    """A CTE (doc, md): lines of each document of ``docs``, '' where none are left."""
    return f"{name} AS (SELECT d.doc, coalesce(string_agg(line, {NL} ORDER BY pos), '') AS md FROM (SELECT DISTINCT doc FROM {docs}) d LEFT JOIN {lines} l ON d.doc = l.doc GROUP BY d.doc)"


def post(source: str, name: str, n: str) -> str:
    """CTEs up to ``name`` (doc, md): ``source`` (doc, md) after post-processing."""
    text = D_DATE.format(x=f"replace({D_SKIP}, ')[![', ')' || {NL} || {NL} || '[![')")
    lines = f"s{n} AS (SELECT doc, unnest(string_split({text}, {NL})) AS line, generate_subscripts(string_split({text}, {NL}), 1) AS pos FROM {source})"
    steps = [
        lines,
        annotated(f"s{n}", f"{n}5"),
        f"p{n} AS (SELECT doc, pos, regexp_replace(line, '[ \\t]+$', '') AS line FROM b{n}5 WHERE NOT (starts_with(t, '![') AND starts_with(after, '[' || t)) AND NOT {d_list_control('line')})",
        annotated(f"p{n}", f"{n}6"),
        f"q{n} AS (SELECT *, NOT fence AND NOT inside AND t = '' AS blank FROM b{n}6)",
        f"v{n} AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc ORDER BY pos), false) AS again FROM q{n})",
        f"k{n} AS (SELECT doc, pos, CASE WHEN blank THEN '' ELSE line END AS line FROM v{n} WHERE NOT (blank AND again))",
        joined(f"j{n}", source, f"k{n}"),
        f"{name} AS (SELECT doc, {d_trim('md')} AS md FROM j{n})",
    ]
    return ",\n".join(steps)


def finished(source: str, name: str, n: str) -> str:
    """CTEs up to ``name`` (doc, md): the lines of ``source`` after hooks and post-processing."""
    told, left = hooks(source, n)
    return f"{told},\n{joined(f'm{n}', source, left)},\n{post(f'm{n}', name, n)}"


_HOOKED, _LEFT = hooks("corpus_lines", "x")
AFTER_HOOKS = f"WITH RECURSIVE {DUCK}, {_HOOKED}, {joined('done', 'corpus_lines', _LEFT)} SELECT doc, md FROM done"
POSTPROCESS = f"WITH {DUCK}, {post('corpus', 'done', 'x')} SELECT doc, md FROM done"
TO_MARKDOWN = f"WITH RECURSIVE {PARTS}, {RENDERED}, {finished('main_lines', 'done', 'x')} SELECT doc AS page_id, md AS markdown FROM done"


def scored(source: str, name: str) -> str:
    """CTEs up to ``name``: ``source`` (page_id, md, title, links) with the columns of quality."""
    return f"""{name}_m AS (
  SELECT *, length({d_visible('md')})::INT AS text_length, {d_paragraphs('md')} AS paragraph_count, {d_trim('title')} <> '' AS title_present, {d_shell(f'lower({d_opening_text(chr(109) + chr(100))})')} AS shell, {d_table('md')} AS tab FROM {source}
), {name}_d AS (SELECT *, CASE WHEN text_length > 0 THEN links::DOUBLE / text_length ELSE 0.0::DOUBLE END AS density FROM {name}_m
), {name} AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
    CASE WHEN title_present THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN text_length >= 800 THEN 0.4::DOUBLE ELSE 0.4::DOUBLE * (text_length / 800.0::DOUBLE) END
    + CASE WHEN paragraph_count >= 3 THEN 0.2::DOUBLE ELSE 0.2::DOUBLE * (paragraph_count / 3.0::DOUBLE) END
    + CASE WHEN density <= 0.01 THEN 0.1::DOUBLE WHEN density <= 0.02 THEN 0.07::DOUBLE WHEN density <= 0.03 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END - shell - tab)) AS score FROM {name}_d)"""


#: Both passes over every page, scored: main_scored and whole_scored.
PASSES = f"""{PARTS}, {HTML}, {RENDERED}, {finished('main_lines', 'main_done', 'x')}, {finished('whole_lines', 'whole_done', 'y')}, linked AS (
  SELECT page_id, count(DISTINCT {D_TARGET.format(href='href')}) AS n FROM items GROUP BY page_id
), told AS (
  SELECT p.page_id, title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, trim(url) AS canonical_url, head || tail AS main_html,
    '<nav><ul>' || resolved || '</ul></nav>' || m.remark || m.ad || head || tail || m.foot AS whole_html, coalesce(l.n, 0)::INT AS n
  FROM parts p JOIN marked m ON p.page_id = m.page_id LEFT JOIN linked l ON p.page_id = l.page_id
), main_src AS (SELECT t.*, md, 0 AS links, main_html AS html_clean FROM told t JOIN main_done d ON d.doc = t.page_id
), whole_src AS (SELECT t.*, md, n AS links, whole_html AS html_clean FROM told t JOIN whole_done d ON d.doc = t.page_id
), {scored('main_src', 'main_scored')}, {scored('whole_src', 'whole_scored')}"""
WEAK = "(text_length < 80 OR paragraph_count < 1 OR score < 0.18)"


def _flat(source: str, used: str, fell: str, where: str = "true") -> str:
    return f"""SELECT page_id, md AS markdown, html_clean, title, language, canonical_url, links AS n_links, 0 AS n_images, text_length, paragraph_count, links AS link_count, 0 AS image_count, title_present,
  round(density, 9) AS link_density, round(score, 9) AS quality_score, {used} AS used_main_content, {fell} AS fallback_used, NULL::VARCHAR AS error FROM {source} WHERE {where}"""


_CHOSEN = f"{_flat('main_scored', 'true', 'false', f'NOT {WEAK}')} UNION ALL {_flat('whole_scored', 'false', 'true', f'page_id IN (SELECT page_id FROM main_scored WHERE {WEAK})')}"
CONVERT_MAIN = f"WITH RECURSIVE {PASSES} {_CHOSEN}"
CONVERT_FULL = f"WITH RECURSIVE {PASSES} {_flat('whole_scored', 'false', 'false')}"
FALLBACK_ROWS = f"WITH RECURSIVE {PASSES}, chosen AS ({_CHOSEN}) SELECT page_id, text_length, n_links FROM chosen WHERE fallback_used"
RESPONSE = f"WITH RECURSIVE {PASSES}, chosen AS ({_CHOSEN}) SELECT page_id, title, text_length, {d_trim('markdown')} || {NL} AS markdown FROM chosen"
STREAM = f"WITH RECURSIVE {PASSES}, chosen AS ({_CHOSEN}) SELECT page_id, markdown, fallback_used FROM chosen"
#: Edges of pages to absolute targets, and the urls of all pages, both without fragments.
PAGE_EDGES = f"""{D_HREFS}, edges AS (SELECT DISTINCT page_id, regexp_replace({D_TARGET.format(href='href')}, '#.*', '') AS target FROM h WHERE trim(href) <> ''
), known AS (SELECT DISTINCT regexp_replace(url, '#.*', '') AS url FROM pages WHERE url IS NOT NULL)"""
