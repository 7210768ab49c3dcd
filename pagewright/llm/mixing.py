"""Mixing sources to target weights over a time-varying curriculum, in native DataFrame code.

Each source has a piecewise-constant weight schedule over training time 0..1. Its integral says how many
of the source's words are demanded by time t; a document copy whose cumulative place in its source is c is
trained at the time when the demand reaches c. Cumulative places come from a two-level prefix sum: md5
buckets, whose number grows with the rows, are summed map-side, a window runs over the bucket sums of a
source, and a second window runs inside each bucket, so no task holds a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.words import word_count
from pagewright.plans.staging import stage

Schedule = Sequence[tuple[float, Sequence[float]]]
#: Rows in a bucket on average, over all sources, beyond which the key's prefix grows by a digit.
BUCKET_ROWS = 1 << 16


def source_targets(sizes: DataFrame, schedule: Schedule, share: float, repeats: float) -> DataFrame:
    """Targets by source: ``share`` of all words in proportion to weight, none above ``repeats`` x its size.

    ``sizes``: (source, source_size), one row per source. ``schedule``: (end of phase, weights) with times
    up to 1; sources in code point order, null last, take a phase's weights in turn. A source's weight is
    the integral of its schedule; ``paces`` are its weights by phase. The excess of capped sources is reshared until none is above: with sources ordered
    by cap/weight, the level is (total - caps before) / (weights from here on), and the capped sources are
    those whose ratio is below it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")

    def pace(weights: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))

    starts = [0.0, *[float(end) for end, _ in schedule]]
    weight = F.lit(0.0)
    for start, (end, weights) in zip(starts, schedule):
        weight = weight + F.lit(float(end) - start) * pace(weights)
    placed = (
        sizes.withColumn("place", F.row_number().over(order))
        .withColumn("weight", weight)
        .withColumn("paces", F.array(*[pace(w) for _, w in schedule]))
        .withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy()))
    )
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    levels = placed.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    level = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "place", "level"))).over(Window.partitionBy())["level"]
    return levels.withColumn("at", level).select(
        "source", "source_size", "weight", "paces", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight"))).alias("target")
    )


def mix_sources(
    docs: DataFrame, schedule: Schedule = ((1.0, (3, 1, 2)),), share: float = 1.5, repeats: int = 2, text: str = "text", row: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, positions.

    ``row``: a column that is unique by row; it is returned too, so that positions find their own row where
    ids repeat or are null. Further ties then go by the text.

    size: words (null text: 0). taken: copies x size, at most
    ``repeats`` x size. positions: array<double>, one training time in 0..1 per copy.
    Ties in md5(doc_id) go by doc_id and size. Rows equal in both are interchangeable: one of them may be
    taken where another is not. A null doc_id hashes as ''. Runs agree: nothing depends on partitioning.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    own = [] if row is None else [F.col(row), F.xxhash64(text).alias("tie")]
    base = stage(docs.select("doc_id", "source", word_count(F.col(text)).alias("size"), key.alias("key"), *own), "mix")
    digits = 3
    while base.count() > BUCKET_ROWS << 4 * digits:
        digits += 1
    base = base.withColumn("bucket", F.substring("key", 1, digits))
    buckets = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), schedule, share, repeats)
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = buckets.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(running), F.lit(0))).drop("bucket_size")
    places = places.join(targets, places["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    inner = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", *([] if row is None else ["tie"])).rowsBetween(Window.unboundedPreceding, -1)
    inside = base.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    rows = inside.join(places, inside["source"].eqNullSafe(places["source"]) & (inside["bucket"] == places["bucket"])).drop(places["source"]).drop(places["bucket"])
    middle = lambda p: F.col("bucket_start") + F.col("inside") + F.col("size") / 2 + p * F.col("source_size")
    places_taken = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda p: middle(p) / F.col("target")), lambda c: c < 1)
    done = rows.withColumn("share_done", F.when(F.col("target") > 0, places_taken).otherwise(F.array().cast("array<double>")))
    placed = done.withColumn("positions", F.transform("share_done", lambda c: _invert(c, schedule)))
    taken = (F.size("positions") * F.col("size")).alias("taken")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken, "positions", *([] if row is None else [row]))


def _invert(done: Column, schedule: Schedule) -> Column:
    """The time at which the share ``done`` of a source's demand is reached."""
    starts = [0.0, *[float(end) for end, _ in schedule]]
    need, reached, out = done * F.col("weight"), F.col("weight"), F.lit(1.0)
    for k in range(len(schedule) - 1, -1, -1):
        pace = F.col("paces")[k]
        below = reached - F.lit(starts[k + 1] - starts[k]) * pace
        out = F.when((pace > 0) & (need < reached), F.greatest(F.lit(starts[k]), F.lit(starts[k]) + (need - below) / pace)).otherwise(out)
        reached = below
    return out


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training time: doc_id, source, size, copy (from 1), position."""
    rows = mixed.select("doc_id", "source", "size", F.posexplode("positions").alias("copy", "position"))
    return rows.withColumn("copy", F.col("copy") + 1).orderBy("position", "source", "doc_id")
