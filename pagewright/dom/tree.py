"""HTML tree construction: a subset of the HTML standard's algorithm.

Covered: implied head/body, implied end tags, scopes, the list of active formatting elements with
reconstruction (at most three alike), a simplified adoption agency, table structure with foster parenting,
raw text. Any input gives a tree, in time linear in its length: elements nested more than ``DEPTH`` deep become
siblings at that depth, and at most ``ACTIVE`` formatting elements wait to be opened again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pagewright.dom.tokens import RAW_TEXT, tokenize

DEPTH, ACTIVE = 128, 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul listing".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = CLOSES_P | HEADINGS | frozenset("body html head li dd dt td th tr tbody thead tfoot caption colgroup button select textarea template applet marquee object iframe title style script".split())
SCOPE_END = frozenset("applet caption html table td th marquee object template".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
#: Elements that formatting does not cross: a marker in the list of active formatting stands for each.
MARKED = frozenset("td th caption applet object marquee template".split())
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
RAW = RAW_TEXT | {"plaintext"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def append(self, child: Node | str) -> None:
        if isinstance(child, str):
            if self.children and isinstance(self.children[-1], str):
                self.children[-1] += child
                return
        else:
            child.detach()
            child.parent = self
        self.children.append(child)

    def detach(self) -> None:
        if self.parent is not None:
            kin = self.parent.children
            at = self.parent._place(self)
            del kin[at]
            if 0 < at < len(kin) and isinstance(kin[at - 1], str) and isinstance(kin[at], str):
                kin[at - 1] += kin.pop(at)
            self.parent = None

    def _place(self, mark: Node) -> int:
        """Of a child; the last ones are looked at first."""
        return next(i for i in range(len(self.children) - 1, -1, -1) if self.children[i] is mark)

    def insert_before(self, child: Node | str, mark: Node) -> None:
        at = self._place(mark)
        if isinstance(child, str):
            if at and isinstance(self.children[at - 1], str):
                self.children[at - 1] += child
                return
        else:
            child.detach()
            at = self._place(mark)
            child.parent = self
        self.children.insert(at, child)

    def prune(self, matches: Callable[[Node], bool]) -> None:
        """Detach every descendant element that matches; nothing below one is visited. Each child list is rebuilt once."""
        stack = [self]
        while stack:
            node = stack.pop()
            kept: list[Node | str] = []
            for c in node.children:
                if isinstance(c, str):
                    if kept and isinstance(kept[-1], str):
                        kept[-1] += c
                        continue
                elif c.tag[0] not in "#!":
                    if matches(c):
                        c.parent = None
                        continue
                    stack.append(c)
                kept.append(c)
            node.children = kept

    def elements(self) -> Iterator[Node]:
        """Descendant elements in document order."""
        stack = self.children[::-1]
        while stack:
            node = stack.pop()
            if node.__class__ is Node:
                if node.tag[0] not in "#!":
                    yield node
                stack += node.children[::-1]

    def text(self) -> str:
        out, stack = [], self.children[::-1]
        while stack:
            c = stack.pop()
            if c.__class__ is str:
                out.append(c)
            elif c.tag[0] not in "#!":
                stack += c.children[::-1]
        return "".join(out)

    def copy(self) -> Node:
        top = Node(self.tag, dict(self.attrs))
        stack = [(self, top)]
        while stack:
            old, new = stack.pop()
            for c in old.children:
                if isinstance(c, str):
                    new.children.append(c)
                else:
                    twin = Node(c.tag, dict(c.attrs))
                    twin.parent = new
                    new.children.append(twin)
                    stack.append((c, twin))
        return top

    def first(self, tag: str) -> Node | None:
        return next((e for e in self.elements() if e.tag == tag), None)


class TreeBuilder:
    """Takes the tokens; ``document`` is the tree."""

    def __init__(self):
        self.document = Node("#document")
        self.html: Node | None = None
        self.head: Node | None = None
        self.body: Node | None = None
        self.open: list[Node] = []
        self.active: list[Node | None] = []

    # structure

    def _root(self) -> None:
        if self.html is None:
            self.html = Node("html")
            self.document.append(self.html)
            self.open = [self.html]

    def _in_head(self) -> bool:
        return self.head is not None and self.head in self.open and self.body is None

    def _start_head(self) -> None:
        self._root()
        if self.head is None:
            self.head = Node("head")
            self.html.append(self.head)
            self.open = [self.html, self.head]

    def _start_body(self, attrs: dict[str, str] | None = None) -> None:
        self._start_head()
        if self.body is None:
            self.body = Node("body", attrs)
            self.html.append(self.body)
            self.open = [self.html, self.body]

    def _insert(self, node: Node | str) -> None:
        top = self.open[-1]
        if top.tag in TABLE_PARTS and (isinstance(node, str) and node.strip() or isinstance(node, Node) and node.tag not in TABLE_PARTS | {"td", "th", "caption", "colgroup", "col", "style", "script", "template", "#comment"}):
            table = next((n for n in reversed(self.open) if n.tag == "table"), None)
            if table is not None and table.parent is not None:
                table.parent.insert_before(node, table)
                return
        top.append(node)

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        if len(self.open) >= DEPTH:
            top = self.open.pop()
            if top.tag in MARKED:
                self._forget_to_marker()
            elif top.tag in FORMATTING and top in self.active:
                self.active.remove(top)
        node = Node(tag, attrs)
        self._insert(node)
        self.open.append(node)
        return node

    def _scope(self, tags: frozenset[str] | set[str], more: tuple[str, ...] = ()) -> Node | None:
        for node in reversed(self.open):
            if node.tag in tags:
                return node
            if node.tag in SCOPE_END or node.tag in more:
                return None
        return None

    def _pop_to(self, node: Node) -> None:
        while self.open and self.open.pop() is not node:
            pass

    def _imply_ends(self, but: str = "") -> None:
        while self.open[-1].tag in IMPLIED_END and self.open[-1].tag != but:
            self.open.pop()

    def _close_p(self) -> None:
        p = self._scope({"p"}, ("button",))
        if p is not None:
            self._pop_to(p)

    # formatting

    def _reconstruct(self) -> None:
        at = len(self.active)
        while at and self.active[at - 1] is not None and self.active[at - 1] not in self.open:
            at -= 1
        for k in range(at, len(self.active)):
            old = self.active[k]
            self.active[k] = self._push(old.tag, dict(old.attrs))

    def _remember(self, node: Node) -> None:
        alike = []
        for k in range(len(self.active) - 1, -1, -1):
            n = self.active[k]
            if n is None:
                break
            if n.tag == node.tag and n.attrs == node.attrs:
                alike.append(k)
        if len(alike) >= 3:
            del self.active[alike[-1]]
        elif len(self.active) >= ACTIVE and None not in self.active[-ACTIVE:]:
            del self.active[-ACTIVE]
        self.active.append(node)

    def _forget_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _adopt(self, tag: str) -> None:
        for _ in range(8):
            node = None
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == tag:
                    node = n
                    break
            if node is None:
                self._close_any(tag)
                return
            if node not in self.open:
                self.active.remove(node)
                return
            at = self.open.index(node)
            if any(n.tag in SCOPE_END for n in self.open[at + 1 :]):
                return
            furthest = next((k for k in range(at + 1, len(self.open)) if self.open[k].tag in SPECIAL), None)
            if furthest is None:
                del self.open[at:]
                self.active.remove(node)
                return
            block, ancestor = self.open[furthest], self.open[at - 1]
            place = self.active.index(node)
            last = block
            for n in reversed(self.open[at + 1 : furthest]):
                if n not in self.active:
                    self.open.remove(n)
                    continue
                twin = Node(n.tag, dict(n.attrs))
                self.active[self.active.index(n)] = twin
                self.open[self.open.index(n)] = twin
                twin.append(last)
                last = twin
            ancestor.append(last)
            twin = Node(node.tag, dict(node.attrs))
            for c in list(block.children):
                if isinstance(c, Node):
                    c.parent = twin
            twin.children, block.children = block.children, []
            block.append(twin)
            self.active.remove(node)
            self.active.insert(min(place, len(self.active)), twin)
            self.open.remove(node)
            self.open.insert(self.open.index(block) + 1, twin)

    def _close_any(self, tag: str) -> None:
        for node in reversed(self.open):
            if node.tag == tag:
                self._imply_ends(tag)
                self._pop_to(node)
                return
            if node.tag in SPECIAL:
                return

    # tokens

    def handle_starttag(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            self._root()
            for k, v in attrs.items():
                self.html.attrs.setdefault(k, v)
            return
        if tag == "head":
            if self.head is None:
                self._start_head()
                self.head.attrs.update(attrs)
            return
        if self.body is None and tag in HEAD_ONLY:
            self._start_head()
            if self.head not in self.open:
                self.open = [self.html, self.head]
            self._push(tag, attrs)
            if tag in VOID or tag in ("basefont", "bgsound"):
                self.open.pop()
            return
        if tag == "body":
            if self.body is None:
                self._start_body(attrs)
            else:
                for k, v in attrs.items():
                    self.body.attrs.setdefault(k, v)
            return
        if tag in ("frame", "frameset"):
            return
        self._start_body()
        self._start_in_body(tag, attrs)

    def _start_in_body(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in CLOSES_P:
            self._close_p()
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        elif tag == "li":
            self._close_item({"li"}, ("ul", "ol"))
            self._close_p()
        elif tag in ("dd", "dt"):
            self._close_item({"dd", "dt"}, ("dl",))
            self._close_p()
        elif tag in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self.open.pop()
        elif tag == "button" and (old := self._scope({"button"})):
            self._pop_to(old)
        elif tag in ("td", "th"):
            self._to_table({"td", "th"}, ("tr",))
            if self.open[-1].tag in ("tbody", "thead", "tfoot", "table"):
                if self.open[-1].tag == "table":
                    self._push("tbody", {})
                self._push("tr", {})
        elif tag == "tr":
            self._to_table({"tr"}, ("tbody", "thead", "tfoot"))
            if self.open[-1].tag == "table":
                self._push("tbody", {})
        elif tag in ("tbody", "thead", "tfoot", "caption", "colgroup"):
            self._to_table({"tbody", "thead", "tfoot", "caption", "colgroup"}, ("table",))
        if tag == "a":
            for n in reversed(self.active):
                if n is None:
                    break
                if n.tag == "a":
                    self._adopt("a")
                    if n in self.active:
                        self.active.remove(n)
                    if n in self.open:
                        self.open.remove(n)
                    break
        if tag in FORMATTING:
            self._reconstruct()
            self._remember(self._push(tag, attrs))
            return
        if tag in MARKED:
            self._push(tag, attrs)
            self.active.append(None)
            return
        if tag not in CLOSES_P and tag not in TABLE_PARTS | {"li", "dd", "dt", "colgroup", "col"}:
            self._reconstruct()
        self._push(tag, attrs)
        if tag in VOID:
            self.open.pop()

    def _close_item(self, tags: set[str], lists: tuple[str, ...]) -> None:
        for node in reversed(self.open):
            if node.tag in tags:
                self._pop_to(node)
                return
            if node.tag in lists or node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                return

    def _to_table(self, close: set[str], keep: tuple[str, ...]) -> None:
        """Unwind to the nearest table part that may hold the new one."""
        table = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k].tag == "table"), None)
        if table is None:
            return
        for k in range(len(self.open) - 1, table, -1):
            if self.open[k].tag in keep:
                break
            if self.open[k].tag in ("td", "th", "caption"):
                self._forget_to_marker()
            if self.open[k].tag in close or self.open[k].tag not in TABLE_PARTS or "table" in keep or self.open[k].tag == "tr":
                del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if self._in_head() and (tag == "head" or tag in HEAD_ONLY):
            node = next((n for n in reversed(self.open) if n.tag == tag), None)
            if node is not None:
                self._pop_to(node)
            return
        if tag == "head" or tag in VOID and tag != "br" and tag != "p":
            return
        self._start_body()
        if tag == "br":
            self._start_in_body("br", {})
        elif tag == "p":
            if self._scope({"p"}, ("button",)) is None:
                self._push("p", {})
            self._close_p()
        elif tag in FORMATTING:
            self._adopt(tag)
        elif tag in HEADINGS:
            node = self._scope(HEADINGS)
            if node is not None:
                self._imply_ends()
                self._pop_to(node)
        elif tag in MARKED:
            node = next((n for n in reversed(self.open) if n.tag == tag), None)
            if node is not None:
                self._pop_to(node)
                self._forget_to_marker()
        elif tag in TABLE_PARTS:
            node = next((n for n in reversed(self.open) if n.tag == tag), None)
            if node is not None:
                for n in self.open[self.open.index(node) :]:
                    if n.tag in ("td", "th", "caption"):
                        self._forget_to_marker()
                self._pop_to(node)
        elif tag in CLOSES_P or tag in ("li", "dd", "dt", "button"):
            node = self._scope({tag}, ("ul", "ol") if tag == "li" else ())
            if node is not None:
                self._imply_ends(tag)
                self._pop_to(node)
        else:
            self._close_any(tag)

    def handle_data(self, data: str) -> None:
        data = data.replace("\x00", "")
        if not data:
            return
        if self.body is None:
            if self.open and self.open[-1].tag in ("title", "style", "script", "noscript", "noframes", "template"):
                self.open[-1].append(data)
                return
            bare = data.lstrip(" \t\n\f\r")
            if not bare:
                if self.head is not None:
                    self.open[-1].append(data)
                return
            data = bare
            self._start_body()
        if self.open[-1].tag not in RAW and data.strip(" \t\n\f\r"):
            if self.open[-1].tag not in TABLE_PARTS:
                self._reconstruct()
        if self.open[-1].tag in ("pre", "listing", "textarea") and not self.open[-1].children and data[:1] == "\n":
            data = data[1:]
        if data:
            self._insert(data)

    def handle_comment(self, data: str) -> None:
        node = Node("#comment", {"": data})
        (self.open[-1] if self.open else self.document).append(node)

    def handle_doctype(self, data: str) -> None:
        if self.html is None:
            self.document.append(Node("!doctype", {"": data}))


def parse(html: str) -> Node:
    builder = TreeBuilder()
    tokenize(html, builder)
    builder._start_body()
    return builder.document


_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;", "\r": "&#13;"})


def escape(text: str) -> str:
    return text.translate(_TEXT)


def outer_html(node: Node | str, raw: bool = False) -> str:
    """Serialised markup; iterative, so deep trees are fine."""
    return _markup([(node, False, raw)])


def _markup(stack: list[tuple[Node | str, bool, bool]]) -> str:
    out: list[str] = []
    while stack:
        x, closing, in_raw = stack.pop()
        if isinstance(x, str):
            out.append(x if in_raw else escape(x))
        elif closing:
            out.append(f"</{x.tag}>")
        elif x.tag == "#comment":
            out.append(f"<!--{x.attrs['']}-->")
        elif x.tag == "!doctype":
            out.append(f"<!DOCTYPE {x.attrs['']}>")
        else:
            if x.tag != "#document":
                out.append("<" + x.tag + "".join(f' {k}="{escape(v)}"' for k, v in x.attrs.items()))
                if x.tag in VOID:
                    out.append("/>")
                    continue
                out.append(">")
                if x.tag in ("pre", "listing", "textarea") and x.children and isinstance(x.children[0], str) and x.children[0][:1] == "\n":
                    out.append("\n")
                stack.append((x, True, False))
            inside = x.tag in RAW
            stack.extend((c, False, inside) for c in reversed(x.children))
    return "".join(out)


def inner_html(node: Node) -> str:
    return _markup([(c, False, node.tag in RAW) for c in reversed(node.children)])
