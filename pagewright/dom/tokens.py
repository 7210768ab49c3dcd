"""HTML tokens in one pass: every character is looked at a bounded number of times, whatever the markup.

Follows the HTML standard: comments, quoted values and raw text that are never closed reach to the end of the
input, and a tag that the input ends in is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape
from html.entities import html5
from typing import Protocol

RAW_TEXT = frozenset("script style xmp iframe noembed noframes noscript".split())
RCDATA = frozenset("title textarea".split())

_MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
_NAME = re.compile(r"[A-Za-z][^\t\n\f\r />]*+")
_ATTRIBUTE = re.compile(
    r"""[\t\n\f\r /]*+
    (?:(=?[^\t\n\f\r />=]++|=)                                                # name
       (?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:"([^"]*+)("?)|'([^']*+)('?)|([^\t\n\f\r >]*+)))?+  # value: quoted, quoted, bare
    )?+""",
    re.X,
)
_COMMENT_END = re.compile(r"--!?>")
_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);?|([A-Za-z][A-Za-z0-9]*)(;?))")


class Sink(Protocol):
    def handle_starttag(self, tag: str, attrs: dict[str, str]) -> None: ...
    def handle_endtag(self, tag: str) -> None: ...
    def handle_data(self, data: str) -> None: ...
    def handle_comment(self, data: str) -> None: ...
    def handle_doctype(self, data: str) -> None: ...


def attribute_text(value: str) -> str:
    """References in an attribute: a named one without semicolon counts only as a whole word not followed by ``=``."""
    def told(m: re.Match) -> str:
        if m[1] is None or m[2]:
            return unescape(m[0])
        return unescape(m[0]) if m[1] in html5 and value[m.end() : m.end() + 1] != "=" else m[0]

    return _REFERENCE.sub(told, value) if "&" in value else value


def _tag(html: str, at: int) -> tuple[str, dict[str, str], int]:
    """(name, attributes, place after ``>``) of the tag whose name begins at ``at``; -1 if the input ends in it."""
    name = _NAME.match(html, at)
    attrs: dict[str, str] = {}
    at = name.end()
    while True:
        m = _ATTRIBUTE.match(html, at)
        at = m.end()
        if m[1] is None:
            break
        if m[3] == "" or m[5] == "":  # a quote that never closes
            return name[0].lower(), attrs, -1
        value = m[2] if m[2] is not None else m[4] if m[4] is not None else m[6]
        attrs.setdefault(m[1].lower(), attribute_text(value) if value else "")
    return name[0].lower(), attrs, at + 1 if at < len(html) else -1


def tokenize(html: str, sink: Sink) -> None:
    html = html.replace("\r\n", "\n").replace("\r", "\n")
    n, at, ends = len(html), 0, {}
    while at < n:
        m = _MARKUP.search(html, at)
        start = m.start() if m else n
        if at < start:
            sink.handle_data(unescape(html[at:start]))
        if m is None:
            return
        kind = html[start + 1]
        if kind == "!" or kind == "?":
            at = _declaration(html, start, sink)
        elif kind == "/":
            if start + 2 >= n:
                sink.handle_data("</")
                return
            if html[start + 2].isascii() and html[start + 2].isalpha():
                name, _, at = _tag(html, start + 2)
                if at < 0:
                    return
                sink.handle_endtag(name)
            else:
                stop = html.find(">", start + 2)
                if stop != start + 2:
                    sink.handle_comment(html[start + 2 : n if stop < 0 else stop])
                at = n if stop < 0 else stop + 1
        else:
            name, attrs, at = _tag(html, start + 1)
            if at < 0:
                return
            sink.handle_starttag(name, attrs)
            if name in RAW_TEXT or name in RCDATA:
                at = _raw(html, at, name, ends, sink)
            elif name == "plaintext":
                sink.handle_data(html[at:])
                return


def _declaration(html: str, start: int, sink: Sink) -> int:
    n = len(html)
    if html.startswith("<!--", start):
        if html.startswith(">", start + 4) or html.startswith("->", start + 4):
            sink.handle_comment("")
            return html.index(">", start + 4) + 1
        end = _COMMENT_END.search(html, start + 4)
        sink.handle_comment(html[start + 4 : end.start() if end else n])
        return end.end() if end else n
    stop = html.find(">", start + 2)
    stop = n if stop < 0 else stop
    if html[start + 1] == "!" and html[start + 2 : start + 9].lower() == "doctype":
        sink.handle_doctype(html[start + 9 : stop].strip())
    else:
        sink.handle_comment(html[start + 1 + (html[start + 1] == "!") : stop])
    return stop + 1


def _raw(html: str, at: int, name: str, ends: dict[str, Callable], sink: Sink) -> int:
    """Text up to the end tag of ``name``, or to the end of the input."""
    if name not in ends:
        ends[name] = re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I | re.A).search
    m = ends[name](html, at)
    stop = m.start() if m else len(html)
    if at < stop:
        sink.handle_data(unescape(html[at:stop]) if name in RCDATA else html[at:stop])
    return stop
