"""Writers and their column forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.schema import RESPONSE


def response_json(df: DataFrame) -> Column:
    """The response of a converted row as one JSON object; markup characters stay as they are."""
    return F.to_json(F.struct(*[F.col(f.name) for f in RESPONSE]), {"ignoreNullFields": "false"})


def parse_response(payload: Column) -> Column:
    """JSON back to the response struct with every missing field defaulted; used_main_content defaults to true."""
    r = F.from_json(payload, RESPONSE)
    text = lambda c: F.coalesce(c, F.lit(""))
    meta = F.struct(*[text(r["metadata"][f.name]).alias(f.name) for f in RESPONSE["metadata"].dataType if f.name != "extras"], F.coalesce(r["metadata"]["extras"], F.create_map().cast("map<string,string>")).alias("extras"))
    default = {"int": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False)}
    q = [F.coalesce(r["quality"][f.name], F.lit(True) if f.name == "used_main_content" else default[f.dataType.simpleString()]).alias(f.name) for f in RESPONSE["quality"].dataType]
    lists = [F.coalesce(r[n], F.array().cast("array<string>")).alias(n) for n in ("links", "images")]
    return F.struct(text(r["markdown"]).alias("markdown"), text(r["html_clean"]).alias("html_clean"), meta.alias("metadata"), *lists, F.struct(*q).alias("quality"))


def markdown_text(markdown: Column) -> Column:
    """Markdown with one closing newline; empty stays empty."""
    return F.when((markdown != "") & ~markdown.endswith("\n"), F.concat(markdown, F.lit("\n"))).otherwise(markdown)


def write_responses(df: DataFrame, path: str) -> None:
    df.select(response_json(df).alias("value")).write.text(path)


def write_markdown(df: DataFrame, path: str) -> None:
    """Text files; the writer ends each document with the newline that it needs. Empty documents are left out."""
    df.where("markdown != ''").select(F.regexp_replace("markdown", r"\n\z", "").alias("value")).write.text(path)


def write_documents(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Parquet, partitioned by language or host if asked."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def envelope_json(df: DataFrame) -> Column:
    """Rows as capture envelopes, which ``read_envelopes`` reads: html, url, final_url, content_type and title as text ('' where a row has none), rendered false where it does not say."""
    text = [(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in ("html", "url", "final_url", "content_type", "title")]
    rendered = F.coalesce(F.col("rendered").cast("boolean"), F.lit(False)) if "rendered" in df.columns else F.lit(False)
    return F.to_json(F.struct(*text, rendered.alias("rendered")))


def write_envelopes(df: DataFrame, path: str) -> None:
    """Captured pages as JSON lines of envelopes."""
    df.select(envelope_json(df).alias("value")).write.text(path)
