"""Single documents: dataclasses over the same operators, for callers that have one page in hand."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Row, SparkSession

from pagewright.operators.convert import convert_pages
from pagewright.options import ConvertOptions
from pagewright.schema import REQUEST


@dataclass
class Metadata:
    title: str = ""
    description: str = ""
    canonical_url: str = ""
    language: str = ""
    author: str = ""
    og_title: str = ""
    og_description: str = ""
    extras: dict[str, str] = field(default_factory=dict)


@dataclass
class Quality:
    text_length: int = 0
    paragraph_count: int = 0
    link_count: int = 0
    image_count: int = 0
    title_present: bool = False
    link_density: float = 0.0
    quality_score: float = 0.0
    used_main_content: bool = True
    fallback_used: bool = False


@dataclass
class Response:
    markdown: str = ""
    html_clean: str = ""
    metadata: Metadata = field(default_factory=Metadata)
    links: list[str] = field(default_factory=list)
    images: list[str] = field(default_factory=list)
    quality: Quality = field(default_factory=Quality)

    @classmethod
    def of(cls, row: Row) -> Response:
        r = row.asDict(recursive=True)
        return cls(r["markdown"], r["html_clean"], Metadata(**r["metadata"]), r["links"], r["images"], Quality(**r["quality"]))


def convert_html(spark: SparkSession, html: str, url: str = "", final_url: str = "", content_type: str = "", options: ConvertOptions | None = None) -> Response:
    """Convert one page; blank html raises ValueError."""
    options = options or ConvertOptions()
    row = (url, final_url, content_type, html, (options.only_main_content, list(options.include_selectors), list(options.exclude_selectors)))
    out = convert_pages(spark.createDataFrame([row], REQUEST).drop("options"), options).first()
    if out["error"]:
        raise ValueError(out["error"])
    return Response.of(out)
