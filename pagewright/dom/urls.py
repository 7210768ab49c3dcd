"""URL reference resolution by RFC 3986, written back in the form the page operators promise.

Paths with characters that a URL may not hold are percent-encoded; queries stay as they are; a reference
that cannot be parsed stays unchanged.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_BAD_ESCAPE = re.compile(r"%(?![0-9A-Fa-f]{2})")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")
_PATH_OK = re.compile(r"[-A-Za-z0-9._~!$&'()*+,;=:@/%\[\]]*\Z")
_PATH_SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~$&+,/:;=@")
_FRAGMENT_OK = re.compile(r"[-A-Za-z0-9._~!$&'()*+,;=:@/?%\[\]]*\Z")
_HOST_BAD = re.compile(r"[\s\"<>\\^`{|}]")


class Unparsable(ValueError):
    pass


@dataclass
class Url:
    scheme: str = ""
    opaque: str = ""
    authority: str | None = None
    path: str = ""
    query: str | None = None
    fragment: str | None = None

    def __str__(self) -> str:
        out = self.scheme + ":" if self.scheme else ""
        if self.opaque:
            out += self.opaque
        else:
            if self.authority:
                out += "//" + self.authority
            elif self.authority is not None and self.path.startswith("//"):
                out += "//"
            path = _encoded(self.path, _PATH_OK)
            if path and path[0] != "/" and self.authority:
                path = "/" + path
            out += path
        if self.query is not None:
            out += "?" + self.query
        return out + ("#" + _encoded(self.fragment, _FRAGMENT_OK) if self.fragment else "")


def _encoded(path: str, ok: re.Pattern) -> str:
    if ok.match(path):
        return path
    raw, out, k = path.encode("utf-8", "surrogatepass"), [], 0
    safe = _PATH_SAFE | (frozenset(b"?!()*") if ok is _FRAGMENT_OK else frozenset())
    while k < len(raw):
        byte = raw[k]
        if byte == 0x25:
            byte, k = int(raw[k + 1 : k + 3], 16), k + 2
        out.append(chr(byte) if byte in safe else f"%{byte:02X}")
        k += 1
    return "".join(out)


def parse_url(text: str) -> Url:
    url = Url()
    text, hash_, fragment = text.partition("#")
    if hash_:
        if _BAD_ESCAPE.search(fragment):
            raise Unparsable(fragment)
        url.fragment = fragment
    if _CONTROL.search(text):
        raise Unparsable(text)
    if m := _SCHEME.match(text):
        url.scheme, text = m[1].lower(), text[m.end() :]
    elif text.startswith(":"):
        raise Unparsable(text)
    text, mark, query = text.partition("?")
    if mark:
        url.query = query
    if not text.startswith("/"):
        if url.scheme:
            url.opaque = text
            return url
        if ":" in text.split("/", 1)[0]:
            raise Unparsable(text)
    if text.startswith("//") and not text.startswith("///"):
        url.authority, slash, rest = text[2:].partition("/")
        text = slash + rest
        host = url.authority.rpartition("@")[2]
        port = re.search(r":([^:\]]*)\Z", host)
        if _HOST_BAD.search(host) or _BAD_ESCAPE.search(host) or port and not re.fullmatch(r"[0-9]*", port[1]):
            raise Unparsable(text)
    if _BAD_ESCAPE.search(text):
        raise Unparsable(text)
    url.path = text
    return url


def _join_path(base: str, ref: str) -> str:
    full = base if ref == "" else base[: base.rfind("/") + 1] + ref if not ref.startswith("/") else ref
    if not full:
        return ""
    out: list[str] = []
    parts = full.lstrip("/").split("/") if full.startswith("/") else full.split("/")
    lead = len(full) - len(full.lstrip("/"))
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif part == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" * max(lead, 1) + "/".join(out) if lead != 1 else "/" + "/".join(out)


def join(base: Url, ref: Url) -> Url:
    out = Url(ref.scheme or base.scheme, ref.opaque, ref.authority, ref.path, ref.query, ref.fragment)
    if ref.opaque:
        out.authority = None
        return out
    if ref.scheme or ref.authority is not None:
        out.path = _join_path(ref.path, "")
        return out
    if ref.path == "" and ref.query is None:
        out.query = base.query
        if ref.fragment is None:
            out.fragment = base.fragment
    if ref.path == "" and base.opaque:
        out.opaque = base.opaque
        return out
    out.authority, out.path = base.authority, _join_path(base.path, ref.path)
    return out


def base_of(page_url: str, href: str | None = None) -> Url | None:
    """The base for a page: null for a blank or unparsable page URL; ``href``: of a base element."""
    page_url = page_url.strip()
    if not page_url:
        return None
    try:
        page = parse_url(page_url)
    except Unparsable:
        return None
    if href is not None:
        try:
            return join(page, parse_url(href))
        except Unparsable:
            pass
    return page


def absolutise(value: str, base: Url | None) -> str:
    if base is None or not value.strip():
        return value
    try:
        return str(join(base, parse_url(value)))
    except Unparsable:
        return value


def resolve_url(base: str | None, ref: str | None) -> str | None:
    return None if ref is None else absolutise(ref, base_of(base or ""))


def largest_source(srcset: str) -> str | None:
    """URL of the largest candidate, first of equals; candidates are cut at every comma."""
    best: tuple[float, str] | None = None
    for part in srcset.split(","):
        tokens = part.split()
        if not tokens:
            continue
        size = 1.0
        if len(tokens) > 1 and re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?[xw]", tokens[-1]):
            size = float(tokens[-1][:-1])
        if best is None or size > best[0]:
            best = (size, tokens[0])
    return best[1] if best else None
