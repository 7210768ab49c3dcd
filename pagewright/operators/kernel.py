"""The page kernel as Arrow UDFs: Arrow batches in and out, null in means null out.

A page that cannot be converted (a hook or rule of the caller's raises, memory runs out) gives its message in
``error`` and null elsewhere; the other rows of its batch are not touched.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pagewright import schema
from pagewright.dom.page import clean, convert_page, fields, main_root, metadata, references, resolve, trim
from pagewright.dom.tree import inner_html, parse
from pagewright.dom.urls import resolve_url as _resolve_url
from pagewright.options import ConvertOptions

_KERNEL = to_arrow_type(schema.KERNEL)
_METADATA_FIELDS = ("title", "description", "canonical_url", "language", "author", "og_title", "og_description")


def guarded(html: str | None, *args) -> dict | None:
    """``convert_page``, or the message of what it raised."""
    if html is None:
        return None
    try:
        return convert_page(html, *args)
    except Exception as e:  # noqa: BLE001 - whatever it is, it is this row's
        return {"error": f"{type(e).__name__}: {e}"[:500]}


def page_kernel(options: ConvertOptions, only_main: bool) -> Callable[[Column, Column], Column]:
    """(html, url) to the KERNEL struct. Non-deterministic to the planner, so it is evaluated once."""
    include, exclude, config, head_base = options.include_selectors, options.exclude_selectors, options.markdown, options.honor_head_base

    def run(html: pa.Array, url: pa.Array) -> pa.Array:
        rows = [guarded(h, u or "", only_main, include, exclude, config, head_base) for h, u in zip(html.to_pylist(), url.to_pylist())]
        return pa.array(rows, _KERNEL)

    run.__annotations__ = {"html": pa.Array, "url": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema.KERNEL).asNondeterministic()


def row_kernel(options: ConvertOptions) -> Callable[[Column, Column, Column, Column, Column], Column]:
    """As ``page_kernel`` with options by row: (html, url, only_main, include, exclude)."""
    config, head_base = options.markdown, options.honor_head_base

    def run(html: pa.Array, url: pa.Array, main: pa.Array, include: pa.Array, exclude: pa.Array) -> pa.Array:
        rows = zip(*(a.to_pylist() for a in (html, url, main, include, exclude)))
        return pa.array([guarded(h, u or "", m is not False, i or (), e or (), config, head_base) for h, u, m, i, e in rows], _KERNEL)

    run.__annotations__ = {k: pa.Array for k in ("html", "url", "main", "include", "exclude", "return")}
    return F.arrow_udf(run, schema.KERNEL).asNondeterministic()


def _text_udf(function: Callable[..., str | None], arity: int) -> Callable[..., Column]:
    if arity == 1:

        def run(a: pa.Array) -> pa.Array:
            return pa.array([None if x is None else function(x) for x in a.to_pylist()], pa.string())

        run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    else:

        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array([function(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.string())

        run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")


def resolve_url() -> Callable[[Column, Column], Column]:
    """(base, reference) to the absolute URL; the reference as it is where it cannot be resolved."""
    return _text_udf(_resolve_url, 2)


def clean_html(only_main: bool = True, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    def run(html: str) -> str:
        body = clean(parse(html), only_main, include, exclude)
        return trim(inner_html(body)) if body.tag == "body" else ""

    return _text_udf(run, 1)


def root_text() -> Callable[[Column], Column]:
    """Collapsed text of the main root; null if the page has none."""
    def run(html: str) -> str | None:
        root = main_root(parse(html))
        return None if root is None else fields(root.text())

    return _text_udf(run, 1)


def resolve_html() -> Callable[[Column, Column], Column]:
    """(html, page URL) to the body's markup with absolute references; a base element counts here."""
    def run(html: str | None, url: str | None) -> str | None:
        if html is None:
            return None
        document = parse(html)
        head = next((e.attrs["href"] for e in document.elements() if e.tag == "base" and "href" in e.attrs), None)
        resolve(document, url or "", head)
        body = document.first("body")
        return inner_html(body) if body is not None else ""

    return _text_udf(run, 2)


def page_references(tags: tuple[str, ...], attribute: str) -> Callable[[Column], Column]:
    def run(html: pa.Array) -> pa.Array:
        return pa.array([None if h is None else references(parse(h), tags, attribute) for h in html.to_pylist()], pa.list_(pa.string()))

    run.__annotations__ = {"html": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")


def page_metadata() -> Callable[[Column], Column]:
    """Metadata only: no cleaning, no rendering."""
    kind = pa.struct([(f, pa.string()) for f in _METADATA_FIELDS])

    def run(html: pa.Array) -> pa.Array:
        return pa.array([None if h is None else metadata(parse(h)) for h in html.to_pylist()], kind)

    run.__annotations__ = {"html": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ", ".join(f"{f} string" for f in _METADATA_FIELDS)).asNondeterministic()
