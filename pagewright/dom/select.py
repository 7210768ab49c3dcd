"""CSS selectors compiled to matchers; an invalid selector matches nothing."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable

from pagewright.dom.tree import Node

Matcher = Callable[[Node], bool]

_NAME = r"(?:[-_a-zA-Z0-9\u0080-\U0010ffff]|\\.)+"
_ATTR = re.compile(rf"\[\s*({_NAME})\s*(?:([~|^$*!]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|({_NAME})))?\s*(i)?\s*\]")
_NTH = re.compile(r"\s*(?:([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*\Z")


class Invalid(ValueError):
    pass


def kin(node: Node) -> list[Node]:
    return [c for c in node.parent.children if isinstance(c, Node) and c.tag[0] not in "#!"] if node.parent else [node]


def _attribute(name: str, op: str | None, value: str) -> Matcher:
    name = name.lower()
    if op is None:
        return lambda n: name in n.attrs
    if op == "=":
        return lambda n: n.attrs.get(name) == value
    if op == "!=":
        return lambda n: n.attrs.get(name) != value
    if op == "~=":
        return lambda n: value != "" and value in n.attrs.get(name, "").split()
    if op == "|=":
        return lambda n: (v := n.attrs.get(name)) is not None and (v == value or v.startswith(value + "-"))
    if not value:
        return lambda n: False
    if op == "^=":
        return lambda n: n.attrs.get(name, "").startswith(value)
    if op == "$=":
        return lambda n: n.attrs.get(name, "").endswith(value)
    return lambda n: value in n.attrs.get(name, "")


def _nth(formula: str, last: bool = False, typed: bool = False) -> Matcher:
    formula = {"odd": "2n+1", "even": "2n"}.get(formula.strip().lower(), formula.strip().lower())
    m = _NTH.match(formula)
    if not m:
        raise Invalid(formula)
    if m[4] is not None:
        a, b = 0, int(m[4])
    else:
        a = int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
        b = int(m[2] + m[3]) if m[3] else 0

    def match(n: Node) -> bool:
        row = [k for k in kin(n) if not typed or k.tag == n.tag]
        place = next(i for i, k in enumerate(row) if k is n)
        place = len(row) - place if last else place + 1
        return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0

    return match


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def _take(self, pattern: str) -> str | None:
        m = re.compile(pattern).match(self.text, self.at)
        if m:
            self.at = m.end()
            return m[0]
        return None

    def group(self, stop: str = "") -> Matcher:
        parts = []
        while True:
            parts.append(self.chain())
            self._take(r"\s*")
            if not self._take(","):
                break
        if stop:
            if not self._take(re.escape(stop)):
                raise Invalid(self.text)
        elif self.at < len(self.text):
            raise Invalid(self.text)
        return parts[0] if len(parts) == 1 else lambda n: any(p(n) for p in parts)

    def chain(self) -> Matcher:
        self._take(r"\s*")
        match = self.compound()
        while True:
            link = self._take(r"\s*[>+~]\s*|\s+(?=[^\s,)])")
            if link is None:
                return match
            match = _combine(match, link.strip() or " ", self.compound())

    def compound(self) -> Matcher:
        tests: list[Matcher] = []
        if self._take(r"\*"):
            tests.append(lambda n: True)
        elif name := self._take(_NAME):
            tag = name.lower()
            tests.append(lambda n: n.tag == tag)
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in "#.":
                self.at += 1
                name = self._take(_NAME)
                if not name:
                    raise Invalid(self.text)
                name = name.replace("\\", "")
                tests.append((lambda v: lambda n: n.attrs.get("id") == v)(name) if c == "#" else (lambda v: lambda n: v in n.attrs.get("class", "").split())(name))
            elif c == "[":
                m = _ATTR.match(self.text, self.at)
                if not m:
                    raise Invalid(self.text)
                self.at = m.end()
                tests.append(_attribute(m[1], m[2], next((v for v in m.groups()[2:5] if v is not None), "")))
            elif c == ":":
                self.at += 1
                tests.append(self.pseudo())
            else:
                break
        if not tests:
            raise Invalid(self.text)
        return tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)

    def pseudo(self) -> Matcher:
        name = (self._take(_NAME) or "").lower()
        if self._take(r"\("):
            if name == "not":
                inner = self.group(")")
                return lambda n: not inner(n)
            if name == "has":
                inner = self.group(")")
                return lambda n: any(inner(e) for e in n.elements())
            raw = self._take(r"[^()]*")
            if not self._take(r"\)"):
                raise Invalid(self.text)
            if name == "contains":
                wanted = raw.strip().strip("\"'")
                return lambda n: wanted in n.text()
            if name.startswith("nth-"):
                return _nth(raw, "last" in name, name.endswith("of-type"))
            raise Invalid(name)
        plain = {
            "first-child": lambda: _nth("1"), "last-child": lambda: _nth("1", True), "first-of-type": lambda: _nth("1", False, True), "last-of-type": lambda: _nth("1", True, True),
            "only-child": lambda: lambda n: len(kin(n)) == 1, "empty": lambda: lambda n: not any(isinstance(c, Node) and c.tag[0] != "#" or isinstance(c, str) and c for c in n.children),
            "root": lambda: lambda n: n.tag == "html", "checked": lambda: lambda n: "checked" in n.attrs, "disabled": lambda: lambda n: "disabled" in n.attrs,
        }
        if name not in plain:
            raise Invalid(name)
        return plain[name]()


def _combine(left: Matcher, link: str, right: Matcher) -> Matcher:
    def above(n: Node) -> bool:
        p = n.parent
        while p is not None:
            if p.tag[0] not in "#!" and left(p):
                return True
            p = p.parent
        return False

    def before(n: Node) -> list[Node]:
        row = kin(n)
        return row[: next(i for i, k in enumerate(row) if k is n)]

    if link == " ":
        return lambda n: right(n) and above(n)
    if link == ">":
        return lambda n: right(n) and n.parent is not None and n.parent.tag[0] not in "#!" and left(n.parent)
    if link == "+":
        return lambda n: right(n) and bool(b := before(n)) and left(b[-1])
    return lambda n: right(n) and any(left(b) for b in before(n))


@functools.lru_cache(maxsize=1024)
def compile_selector(text: str) -> Matcher | None:
    try:
        return _Parser(text.strip()).group()
    except (Invalid, IndexError, re.error):
        return None


def find_all(root: Node, selector: str) -> list[Node]:
    match = compile_selector(selector)
    return [] if match is None else [n for n in root.elements() if match(n)]


def remove_all(root: Node, matches: Matcher) -> None:
    """Detach every descendant that matches; nothing below a detached one is visited."""
    root.prune(matches)


class Union:
    """Many simple selectors tested at once, by tag, class and attribute; others one by one."""

    def __init__(self, selectors: Iterable[str]):
        self.tags: set[str] = set()
        self.classes: set[str] = set()
        self.parts: list[str] = []
        self.values: dict[str, set[str]] = {}
        self.rest: list[Matcher] = []
        for s in selectors:
            if re.fullmatch(r"[a-z0-9]+", s):
                self.tags.add(s)
            elif re.fullmatch(r"\.[-\w]+", s):
                self.classes.add(s[1:])
            elif m := re.fullmatch(r"\[class\*='([^']+)'\]", s):
                self.parts.append(m[1])
            elif m := re.fullmatch(r"\[([-\w]+)='([^']*)'\]", s):
                self.values.setdefault(m[1], set()).add(m[2])
            elif (match := compile_selector(s)) is not None:
                self.rest.append(match)

    def __call__(self, n: Node) -> bool:
        if n.tag in self.tags:
            return True
        attrs = n.attrs
        if not attrs:
            return False
        css = attrs.get("class")
        if css and (not self.classes.isdisjoint(css.split()) or any(p in css for p in self.parts)):
            return True
        return any(attrs.get(k) in v for k, v in self.values.items()) or any(m(n) for m in self.rest)
