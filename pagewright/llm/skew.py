"""An equi-join whose hottest keys do not meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast at most.
HOT_KEYS = 4096


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` joined with ``keyed``, which has each key once and in ``count`` how many of ``rows`` hold it.

    Keys that hold more than a 4096th of all counted rows, of which there are fewer than 4096, are broadcast,
    so their rows stay where they are; all others are shuffled. ``count`` is dropped. ``keyed`` should be staged.
    """
    total = keyed.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_hot = F.col(count) > max(64, total // HOT_KEYS)
    hot = keyed.where(is_hot).drop(count)
    if hot.isEmpty():
        return rows.join(keyed.drop(count), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(keyed.where(~is_hot).drop(count), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)
