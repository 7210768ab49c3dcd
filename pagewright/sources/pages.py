"""Readers. All schemas are explicit; reading is ordinary Spark scanning, so pushdown and pruning apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions.text import trim_space
from pagewright.schema import ENVELOPE, REQUEST


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of requests (url, final_url, content_type, html, options)."""
    return with_request_defaults(spark.read.schema(REQUEST).json(path))


def parse_requests(payload: Column) -> Column:
    """A JSON text column to the request struct."""
    return F.from_json(payload, REQUEST)


def with_request_defaults(df: DataFrame) -> DataFrame:
    """Missing only_main_content is true, an explicit false survives; URLs and content type are trimmed."""
    clean = {c: trim_space(F.coalesce(F.col(c), F.lit(""))) for c in ("url", "final_url", "content_type")}
    options = F.struct(F.coalesce("options.only_main_content", F.lit(True)).alias("only_main_content"), F.col("options.include_selectors").alias("include_selectors"), F.col("options.exclude_selectors").alias("exclude_selectors"))
    return df.withColumns(clean | {"options": options})


def read_html_files(spark: SparkSession, path: str, url: str = "") -> DataFrame:
    """One row per file: path, url, html."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lit(url).alias("url"), F.col("value").alias("html"))


def read_envelopes(spark: SparkSession, path: str, url: str = "", final_url: str = "", content_type: str = "") -> DataFrame:
    """Capture envelopes as JSON lines; non-empty arguments override the envelope's fields."""
    df = spark.read.schema(ENVELOPE).json(path)
    told = {"url": url, "final_url": final_url, "content_type": content_type}
    return df.withColumns({"html": F.coalesce("html", F.lit(""))} | {k: F.lit(v) for k, v in told.items() if v})


def request_payload(df: DataFrame) -> Column:
    """The request as JSON: html and options always, empty url, final_url and content_type dropped."""
    optional = [F.when(trim_space(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c)).alias(c) for c in ("url", "final_url", "content_type") if c in df.columns]
    options = F.col("options") if "options" in df.columns else F.struct(F.lit(True).alias("only_main_content"))
    return F.to_json(F.struct(*optional, F.col("html"), options.alias("options")))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet page table, spread over the cluster's cores if its files make fewer tasks."""
    return spread(spark.read.parquet(path))


def spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
