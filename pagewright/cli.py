"""Command line: ``python -m pagewright convert``. One page to standard output, or a table in bulk."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession

from pagewright.api import convert_html
from pagewright.operators.convert import convert_pages
from pagewright.options import ConvertOptions
from pagewright.sources.pages import read_envelopes, read_html_files, read_pages, read_requests
from pagewright.sources.sinks import write_documents, write_markdown, write_responses

READERS = {"pages": read_pages, "requests": read_requests, "html": read_html_files, "envelopes": read_envelopes}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagewright")
    convert = parser.add_subparsers(dest="command", required=True).add_parser("convert", help="HTML to Markdown")
    convert.add_argument("--html-file", type=Path, help="one page; standard input without it")
    convert.add_argument("--from-capture", action="store_true", help="the input is a JSON capture envelope")
    convert.add_argument("--url", default="")
    convert.add_argument("--final-url", default="")
    convert.add_argument("--content-type", default="")
    convert.add_argument("--output-format", choices=("json", "markdown"), default="json")
    convert.add_argument("--full-content", action="store_true")
    convert.add_argument("--include-selector", action="append", default=[])
    convert.add_argument("--exclude-selector", action="append", default=[])
    convert.add_argument("--input", help="bulk: a table or folder of pages")
    convert.add_argument("--input-kind", choices=sorted(READERS), default="pages")
    convert.add_argument("--output", help="bulk: the folder to write")
    convert.add_argument("--output-kind", choices=("parquet", "json", "markdown"), default="parquet")
    return parser


def _session() -> SparkSession:
    return SparkSession.builder.appName("pagewright").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    options = ConvertOptions(not args.full_content, tuple(args.include_selector), tuple(args.exclude_selector))
    if args.input:
        done = convert_pages(READERS[args.input_kind](spark or _session(), args.input), options)
        {"parquet": write_documents, "json": write_responses, "markdown": write_markdown}[args.output_kind](done, args.output)
        return 0
    text = args.html_file.read_text("utf-8") if args.html_file else sys.stdin.read()
    try:
        envelope = json.loads(text) if args.from_capture else {"html": text}
        if not isinstance(envelope, dict):
            raise ValueError("the capture is not a JSON object")
        told = {k: getattr(args, k) or envelope.get(k) or "" for k in ("url", "final_url", "content_type")}
        response = convert_html(spark or _session(), envelope.get("html") or "", options=options, **told)
    except ValueError as error:
        print(f"conversion failed: {error}", file=sys.stderr)
        return 1
    if args.output_format == "markdown":
        sys.stdout.write(response.markdown + ("\n" if response.markdown and not response.markdown.endswith("\n") else ""))
    else:
        sys.stdout.write(json.dumps(asdict(response), ensure_ascii=False) + "\n")
    return 0
