"""Relational operators over converted pages: roll-ups, link graph, near lines, joins in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import trim_space, unix_lines
from pagewright.operators.lines import is_fence


def quality_rollup(df: DataFrame, keys: list[str], length: str = "text_length", score: str = "quality_score") -> DataFrame:
    """Counts and means by each prefix of ``keys``, with the grand total; partial sums before the shuffle."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.sum(length).alias("total_length"), F.round(F.avg(score), 9).alias("mean_score"))


def quality_cube(df: DataFrame, keys: list[str], length: str = "text_length") -> DataFrame:
    return df.cube(*keys).agg(F.count("*").alias("n"), F.sum(length).alias("total_length"))


def link_edges(df: DataFrame, key: str = "page_id", links: str = "links") -> DataFrame:
    """(key, pos, target): one row per link."""
    return df.select(key, F.posexplode(links).alias("pos", "target"))


def linked_by(edges: DataFrame) -> DataFrame:
    """(target, pages, links): in-degree; pages counts distinct sources."""
    per_page = edges.groupBy("target", "page_id").agg(F.count("*").alias("links"))
    return per_page.groupBy("target").agg(F.count("*").alias("pages"), F.sum("links").alias("links"))


def known_targets(edges: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Edges whose target is one of the pages (semi-join)."""
    return edges.join(pages.select(F.col(url).alias("target")), "target", "left_semi")


def unknown_targets(edges: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Edges that leave the table (anti-join)."""
    return edges.join(pages.select(F.col(url).alias("target")), "target", "left_anti")


def top_by(df: DataFrame, group: str, score: Column, key: str, k: int) -> DataFrame:
    """The k best rows of each group; ties by key. The rank limit is applied before the shuffle too."""
    best = Window.partitionBy(group).orderBy(score.desc(), key)
    return df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def line_windows(lines: DataFrame, key: str, order: list[str], line: str = "line", place: str | None = None) -> DataFrame:
    """Fence parity and the nearest non-blank lines, by window functions over (key, order), linear in the lines of a key.

    Adds fence, inside (in a fence once this line's mark has counted), before and after ('' if none); ``place``: and
    the line's place from 1, by the same window.
    """
    w = Window.partitionBy(key).orderBy(*order)
    text = trim_space(F.col(line))
    fences = F.sum(F.when(is_fence(text), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # a frame that reaches ahead to the end is read anew for every row; lag and lead move on with the row
    quoted = lambda names: ", ".join(f"`{n}`" for n in names)
    near = lambda f: F.coalesce(F.expr(f"{f}(_shown) IGNORE NULLS OVER (PARTITION BY {quoted([key])} ORDER BY {quoted(order)})"), F.lit(""))
    shown = lines.withColumn("_shown", F.when(text != "", text))
    places = {place: F.row_number().over(w).cast("long")} if place else {}
    return shown.withColumns({**places, "fence": is_fence(text), "inside": fences % 2 == 1, "before": near("lag"), "after": near("lead")}).drop("_shown")


def duplicate_documents(df: DataFrame, key: str = "page_id", markdown: str = "markdown") -> DataFrame:
    """(digest, copies, first): groups of equal Markdown."""
    return df.groupBy(F.sha2(unix_lines(F.col(markdown)), 256).alias("digest")).agg(F.count("*").alias("copies"), F.min(key).alias("first")).where("copies > 1")


def length_histogram(df: DataFrame, length: Column, edges: list[int]) -> DataFrame:
    """Documents by range of length: a range join against a small literal table; lengths from the last edge on have a null high."""
    bins = df.sparkSession.createDataFrame([(a, b) for a, b in zip(edges, [*edges[1:], None])], "low int, high int")
    sized = df.select(length.alias("length"))
    return sized.join(F.broadcast(bins), (F.col("length") >= F.col("low")) & (F.col("high").isNull() | (F.col("length") < F.col("high")))).groupBy("low", "high").agg(F.count("*").alias("n"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, tie: str, value: str, out: str) -> DataFrame:
    """Rows of ``left`` with ``out``: ``value`` of the latest row of ``right`` of equal key, at its time or before; null without.

    Of rows at one time the one of largest ``tie`` counts. One sort of both sides by (key, time); no pairs are made.
    """
    told = F.struct(F.col(value).alias("value"))
    both = left.withColumns({"_side": F.lit(1), "_tie": F.lit(None).cast(right.schema[tie].dataType), "_told": F.lit(None).cast(f"struct<value:{right.schema[value].dataType.simpleString()}>")}).unionByName(
        right.select(key, time, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), told.alias("_told")), allowMissingColumns=True
    )
    earlier = Window.partitionBy(key).orderBy(time, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_told", ignorenulls=True).over(earlier)["value"]).where("_side = 1").drop("_side", "_tie", "_told")


def within(left: DataFrame, right: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Pairs (left.*, then right.* with the prefix ``near_``) of equal key, the right at most ``seconds`` before the left or at its time.

    An equi-join on key and time bucket: each row of ``left`` looks into two buckets, so a crowded key is spread over time.
    Times without a zone are read in the session's.
    """
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    bucket = lambda t: F.floor(micros(t) / (seconds * 1_000_000))
    near = right.select(*[F.col(c).alias(f"near_{c}") for c in right.columns], bucket(F.col(time)).alias("_bucket"))
    spread = left.withColumn("_bucket", F.explode(F.array(bucket(F.col(time)) - 1, bucket(F.col(time)))))
    apart = micros(F.col(time)) - micros(F.col(f"near_{time}"))
    return spread.join(near, (F.col(key) == F.col(f"near_{key}")) & (spread["_bucket"] == near["_bucket"]) & apart.between(0, seconds * 1_000_000)).drop("_bucket")
