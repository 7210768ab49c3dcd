"""SQL surface: text operators as inlined SQL functions, kernels as Arrow UDFs, two table functions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagewright.dom.urls import resolve_url
from pagewright.operators.kernel import guarded

_SPACE = r"[\\u0009-\\u000D \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"

#: Name, parameters, type, body. Catalyst inlines the body, so these plan like hand-written expressions.
NATIVE = (
    ("md_trim_space", "t STRING", "STRING", rf"regexp_replace(t, '\\A{_SPACE}++|{_SPACE}++\\z', '')"),
    ("md_collapse_space", "t STRING", "STRING", rf"trim(regexp_replace(t, '{_SPACE}++', ' '))"),
    ("md_visible_text", "md STRING", "STRING", r"md_collapse_space(translate(regexp_replace(replace(md, '\r\n', '\n'), '(?d)\\[(.*?)\\]\\((.*?)\\)', '$1'), '`*_#>', ''))"),
    ("md_text_length", "md STRING", "INT", "length(md_visible_text(md))"),
    ("md_paragraph_count", "md STRING", "INT", rf"size(filter(split(md_trim_space(md), '\n\n'), p -> regexp_replace(p, '{_SPACE}++', '') != ''))"),
    ("md_link_labels", "line STRING", "ARRAY<STRING>", r"regexp_extract_all(line, '\\[([^\\]]+)\\]\\([^)]+\\)', 1)"),
    ("md_is_fence", "line STRING", "BOOLEAN", "startswith(md_trim_space(line), '```') OR startswith(md_trim_space(line), '~~~')"),
    ("md_link_density", "links INT, len INT", "DOUBLE", "CASE WHEN len > 0 THEN CAST(links AS DOUBLE) / len ELSE 0.0D END"),
)


def _markdown(html: pa.Array, url: pa.Array) -> pa.Array:
    return pa.array([(guarded(h, u or "", True) or {}).get("md_raw") for h, u in zip(html.to_pylist(), url.to_pylist())], pa.string())


def _resolve(base: pa.Array, ref: pa.Array) -> pa.Array:
    return pa.array([resolve_url(b, r) for b, r in zip(base.to_pylist(), ref.to_pylist())], pa.string())


class _PageLinks:
    def eval(self, html: str, url: str) -> Iterator[tuple[int, str]]:
        if html is not None:
            seen = dict.fromkeys(v for v in (x.strip() for x in guarded(html, url or "", False).get("links") or ()) if v)
            yield from enumerate(seen)


class _Lines:
    def eval(self, md: str) -> Iterator[tuple[int, str]]:
        if md is not None:
            yield from enumerate(md.replace("\r\n", "\n").split("\n"))


def register(spark: SparkSession) -> list[str]:
    """Register everything in the session; returns the names."""
    for name, parameters, kind, body in NATIVE:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udf.register("html_to_markdown", F.arrow_udf(_markdown, "string"))
    spark.udf.register("resolve_url", F.arrow_udf(_resolve, "string"))
    spark.udtf.register("page_links", F.udtf(_PageLinks, returnType="pos int, link string"))
    spark.udtf.register("md_lines", F.udtf(_Lines, returnType="pos int, line string"))
    return [n for n, *_ in NATIVE] + ["html_to_markdown", "resolve_url", "page_links", "md_lines"]
