"""Connected components: a distributed form for edge tables and a numpy form for one block of edges.

The distributed form alternates large-star and small-star steps. Each step is a ``min`` aggregation
(combined map-side, so a hub is one row per task) and a plain equi-join, whose skewed partitions
adaptive execution can split. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.plans.staging import discard, stage


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component) of each node that has an edge; component is the smallest node reachable.

    Null ends and self-loops are ignored; repeated edges count once. Ids may be of any ordered type.
    The result is a staged table with one row per node.
    """
    now = stage(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = stage(small, "edges")
        discard(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b, the smallest node of each node's component; ``root``: of earlier edges."""
    root = np.arange(n) if root is None else root
    while len(a):
        x, y = root[a], root[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        open_ = lo != hi
        if not open_.any():
            break
        a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
        root = root.copy()
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
