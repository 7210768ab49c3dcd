"""Near-duplicate embeddings: int8 tile products with error bounds, exact recomputation near the threshold.

Equal vectors of a label are one class with a weight, so copies never become pairs. A label's classes are
spread over tiles of bounded size, and each pair of tiles is one unit of work. It returns a weighted link
count per class and a spanning forest of the links, at most two rows per vector, however dense a group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.components import connected_components, local_roots
from pagewright.llm.skew import join_counted
from pagewright.llm.tiles import Tile, exact_products, gathered_products, pack_tiles, product_bounds, renamed, rows_of, takes_part, tile_count, tile_number, tile_rows
from pagewright.plans.staging import cleaned, stage

#: Vectors in a tile of a small label; rows and columns of a block of products.
TILE_SIZE, STRIP, BLOCK = 2048, 256, 8192


def link_tiles(a: Tile, b: Tile, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of index pairs of vectors with cosine >= threshold; from one tile with itself, each pair once.

    Pairs whose lower bound passes are links; those that only the upper bound lets pass are decided in doubles.
    """
    norm_a, norm_b = np.sqrt(exact_products(a.vecs, a.vecs)), np.sqrt(exact_products(b.vecs, b.vecs))
    for start in range(0, len(a.ids), STRIP):
        rows = slice(start, min(start + STRIP, len(a.ids)))
        for left in range(start // BLOCK * BLOCK if same else 0, len(b.ids), BLOCK):
            columns = slice(left, min(left + BLOCK, len(b.ids)))
            near, bound = product_bounds(a, b, rows, columns)
            i, j = np.nonzero(near + bound >= threshold)
            linked = (near - bound)[i, j] >= threshold
            i, j = i + start, j + left
            if same:
                once = i < j
                i, j, linked = i[once], j[once], linked[once]
            open_ = np.flatnonzero(~linked)
            cosine = gathered_products(a.vecs, i[open_], b.vecs, j[open_]) / (norm_a[i[open_]] * norm_b[j[open_]])
            linked[open_] = cosine >= threshold
            yield i[linked], j[linked]


@cleaned
def duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept; links join vectors of equal, non-null label.

    n_links counts other rows whose cosine reaches the threshold, copies included; component_id is the
    smallest id reachable, the row's own included; kept marks rows that carry their component's id. Vectors
    that are null, zero or hold null or non-finite components, rows without id or label, and vectors of
    another dimension link with nothing: 0 links. Rows that repeat an id have links of their own, but are one
    node of the components. A row without an id has no component and is kept. An empty table gives none.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("v"), F.col(label).alias("l"))
    part = takes_part(F.col("vec_id"), F.col("v")) & F.col("l").isNotNull()
    grouped = rows.where(part).groupBy("l", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("extra"))
    # a class is named by a number of its own: two classes may share their smallest id
    classes = stage(grouped.withColumns({"d": F.size("v"), "id": F.monotonically_increasing_id()}), "classes")
    counts = classes.groupBy("l", "d").agg(F.count("*").alias("n")).withColumn("tiles", tile_count(F.col("n"), tile_rows(F.col("n"), F.col("d"), TILE_SIZE)))
    tiled = join_counted(classes, stage(counts, "counts"), ["l", "d"], "n").withColumn("i", tile_number(F.col("tiles")))
    tiles = stage(pack_tiles(tiled.select("l", "d", "i", "tiles", "id", "v", "extra"), ["l", "d", "i", "tiles"], "v"), "tiles")
    left = renamed(tiles, "a_").withColumn("j", F.explode(F.sequence(F.col("i"), F.col("tiles") - 1))).drop("tiles")
    right = renamed(tiles, "b_").withColumnRenamed("i", "j").drop("tiles")
    pairs = left.join(right.hint("shuffle_merge"), ["l", "d", "j"])

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in rows_of(batches):
            a, same = Tile.load(row, "a_", unit=True), row["i"] == row["j"]
            b = a if same else Tile.load(row, "b_", unit=True)
            ids = a.ids if same else np.concatenate([a.ids, b.ids])
            links, root = np.zeros(len(ids)), np.arange(len(ids))
            for i, j in link_tiles(a, b, same, threshold):
                at = j if same else j + len(a.ids)
                links += np.bincount(i, b.extra[j], len(ids)) + np.bincount(at, a.extra[i], len(ids))
                root = local_roots(len(ids), i, at, root)
            has = links > 0
            yield pd.DataFrame({"id": ids[has], "links": links[has].astype(np.int64), "root": ids[root[has]]})

    found = stage(pairs.mapInPandas(link, "id long, links long, root long"), "links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("id", "first_id")
    edges = found.where("id != root").select("id", "root").join(named, "id").join(named.toDF("root", "root_id"), "root").select(F.col("first_id").alias("a"), F.col("root_id").alias("b"))
    # an id of several vectors joins their classes
    again = rows.where(part).groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    shared = rows.where(part).join(again, "vec_id").join(classes, ["l", "v"]).select(F.col("vec_id").alias("a"), F.col("first_id").alias("b"))
    component = connected_components(edges.unionByName(shared), "a", "b")
    known = classes.join(linked, "id", "left").join(component.withColumnRenamed("node", "first_id"), "first_id", "left").select(
        "l", "v", (F.coalesce("links", F.lit(0)) + F.col("extra") - 1).alias("n_links"), F.coalesce("component", "first_id").alias("component_id")
    )
    met = rows.where(part).join(known, ["l", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"))
    # a vector that takes no part shares the node of its id, if another row of that id takes part
    node = rows.where(part).join(alone.where("vec_id is not null").select("vec_id").distinct(), "vec_id", "left_semi").join(known, ["l", "v"]).groupBy("vec_id").agg(F.min("component_id").alias("c"))
    alone = alone.join(node, "vec_id", "left").select("vec_id", "n_links", F.coalesce("c", "vec_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
