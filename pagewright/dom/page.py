"""One page: metadata, cleaning, URL resolution, links, images and Markdown.

A page is parsed once; a body that holds a link, a table or pre is written out and parsed a second time, as
its tree may not survive that unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pagewright.dom.render import MarkdownConfig, to_markdown
from pagewright.dom.select import Union, find_all, remove_all
from pagewright.dom.tree import Node, inner_html, parse
from pagewright.dom.urls import absolutise, base_of, largest_source

# The roots of main content, in order of preference, and what counts as chrome.
MAIN_ROOTS = (
    "article",
    "[role='article']",
    "[itemprop='articleBody']",
    "main",
    "[role='main']",
    "#main",
    ".main-content",
    ".main",
)
NOT_CONTENT = ("head", "meta", "noscript", "style", "script")
MAIN_CHROME = (
    "header", "footer", "nav", "aside",
    ".header", ".footer", ".sidebar", ".nav", ".navbar", ".menu", ".breadcrumb", ".breadcrumbs", ".social", ".share",
)
CHROME = (
    "dialog", "template", "[hidden]", "[aria-hidden='true']",
    "[role='banner']", "[role='dialog']", "[role='navigation']", "[role='contentinfo']", "[role='complementary']", "[role='tablist']", "[role='tab']",
    "[role='toolbar']", "[role='tooltip']", "[role='progressbar']", "[aria-modal='true']", "[role='alert']", "[role='status']", "[role='search']",
    "a[href*='#skip']", "a[aria-label*='Skip']", "a[aria-label*='skip']",
    ".sr-only", ".visually-hidden", ".cookie", ".modal", ".popup", ".advert", ".ads",
    "[class*='sr-only']", "[class*='visually-hidden']", ".skip-link", ".skip-to-content",
    "[class*='skip-nav']", "[class*='skip-link']", "[class*='cookie']", "[class*='modal']", "[class*='popup']", "[class*='overlay']",
    "[class*='popover']", "[class*='tooltip']", "[class*='loading']", "[class*='spinner']", "[class*='skeleton']", "[class*='shimmer']",
)

_FULL, _MAIN, _CONTENT = Union(CHROME), Union(CHROME + MAIN_CHROME), Union(NOT_CONTENT)
#: Characters of Unicode White_Space.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SPACE = re.compile(f"[{SPACES}]+")


def fields(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def trim(text: str) -> str:
    return text.strip(SPACES)


def metadata(document: Node) -> dict[str, str]:
    """Each field from the first element that names it, '' without; the title falls back to og:title."""
    found: dict[str, str] = {}
    for e in document.elements():
        a = e.attrs
        if e.tag == "title":
            found.setdefault("title", fields(e.text()))
        elif e.tag == "html" and "lang" in a:
            found.setdefault("language", trim(a["lang"]))
        elif e.tag == "link" and a.get("rel") == "canonical":
            found.setdefault("canonical_url", trim(a.get("href", "")))
        elif e.tag == "meta":
            name = {"description": "description", "author": "author"}.get(a.get("name", ""))
            prop = {"og:title": "og_title", "og:description": "og_description"}.get(a.get("property", ""))
            for field in (name, prop):
                if field:
                    found.setdefault(field, fields(a.get("content", "")))
    out = {k: found.get(k, "") for k in ("title", "description", "canonical_url", "language", "author", "og_title", "og_description")}
    out["title"] = out["title"] or out["og_title"]
    return out


def _body_of(document: Node) -> Node:
    return document.first("body") or document


def _rehomed(nodes: Sequence[Node]) -> Node:
    """A document whose body holds copies of ``nodes``, a newline between."""
    document, html, body = Node("#document"), Node("html"), Node("body")
    document.append(html)
    html.append(body)
    for k, n in enumerate(nodes):
        if k:
            body.append("\n")
        twin = n.copy()
        if twin.tag == "body":
            body.attrs = {**twin.attrs, **body.attrs}
            for c in list(twin.children):
                body.append(c)
        elif twin.tag == "html":
            for c in [c for e in twin.children if isinstance(e, Node) and e.tag == "body" for c in list(e.children)]:
                body.append(c)
        else:
            body.append(twin)
    return document


def main_root(document: Node) -> Node | None:
    """The element that preferred selectors agree on: the longest with text, unless several articles compete."""
    for selector in MAIN_ROOTS:
        texts = [(n, fields(n.text())) for n in find_all(document, selector)]
        texts = [(n, t) for n, t in texts if t]
        if not texts or len(texts) > 1 and "article" in selector:
            continue
        return max(texts, key=lambda x: len(x[1]))[0]
    return None


def clean(document: Node, only_main: bool, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Node:
    """The body that is left (or the document, if the body itself was chrome). Works on the tree given."""
    wanted = [s.strip() for s in include if s.strip()]
    if wanted:
        document = _rehomed([n for s in wanted for n in find_all(document, s)])
    elif only_main and (root := main_root(document)) is not None:
        document = _rehomed([root])
    remove_all(document, _CONTENT)
    for s in exclude:
        if s.strip() and (gone := {id(n) for n in find_all(document, s.strip())}):
            document.prune(lambda n: id(n) in gone)
    remove_all(document, _MAIN if only_main else _FULL)
    return _body_of(document)


def resolve(body: Node, page_url: str, base_href: str | None = None) -> None:
    """Pick the largest image source and make href and src absolute, in place."""
    own = next((e.attrs["href"] for e in body.elements() if e.tag == "base" and "href" in e.attrs), base_href)
    base = base_of(page_url, own)
    for e in body.elements():
        if e.tag in ("img", "source"):
            if "srcset" in e.attrs and (pick := largest_source(e.attrs["srcset"])):
                e.attrs["src"] = absolutise(pick, base)
            if "src" in e.attrs:
                e.attrs["src"] = absolutise(e.attrs["src"], base)
        elif e.tag == "a" and "href" in e.attrs:
            e.attrs["href"] = absolutise(e.attrs["href"], base)


def references(body: Node, tags: tuple[str, ...], attribute: str) -> list[str]:
    """Values as they stand, in document order; trimming and distinctness are native."""
    return [e.attrs[attribute] for e in body.elements() if e.tag in tags and attribute in e.attrs]


def convert_page(html: str, url: str, only_main: bool, include: Sequence[str] = (), exclude: Sequence[str] = (), config: MarkdownConfig | None = None, honor_head_base: bool = False) -> dict:
    """Everything the kernel emits for one page."""
    document = parse(html)
    out: dict = metadata(document)
    head_base = None
    if honor_head_base:
        head_base = next((e.attrs["href"] for e in document.elements() if e.tag == "base" and "href" in e.attrs), None)
    body = clean(document, only_main, include, exclude)
    if body.tag != "body":
        body = Node("body")
    if any(e.tag in ("a", "table", "pre") for e in body.elements()):
        # stages exchange markup: trees that do not survive that (nested links, moved table text) must not differ
        body = _body_of(parse(inner_html(body)))
    resolve(body, url, head_base)
    out["html_clean"] = trim(inner_html(body))
    out["links"] = references(body, ("a",), "href")
    out["images"] = references(body, ("img", "source"), "src")
    out["md_raw"] = to_markdown(body, config)
    return out


