"""Streaming conversion: documents are independent, so the batch operators run on a stream without state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagewright.operators.convert import convert_pages
from pagewright.options import ConvertOptions
from pagewright.schema import ENVELOPE


def stream_envelopes(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New JSON-lines files of capture envelopes in ``folder``."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def stream_convert(pages: DataFrame, options: ConvertOptions | None = None, once_by: str | None = None, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Converted rows of a stream. ``once_by`` with ``watermark`` (column, delay) drops re-crawls inside the delay."""
    if once_by is not None:
        column, delay = watermark or ("captured_at", "1 hour")
        pages = pages.withWatermark(column, delay).dropDuplicatesWithinWatermark([once_by])
    return convert_pages(pages, options)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append Parquet until what is there has been read."""
    return df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
