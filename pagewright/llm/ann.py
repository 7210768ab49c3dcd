"""Nearest neighbours by inner product: a block matrix join over int8 tiles.

The work is a grid of tasks: a tile of queries times a group of base tiles. A task holds its queries and their
bounded heaps and reads the base tiles one after another, so a floor once raised prunes all that follow. In
a pair of tiles, int8 products with error bounds give each query a rigorous floor for its k-th best; only
pairs that can reach it are recomputed in double precision. A ranked window merges the groups. The search is
exact. Its work is queries x vectors, as the measure demands; what moves is the base once per query tile, in
the precision of its table, and a query tile once per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.skew import join_counted
from pagewright.llm.tiles import Tile, gathered_products, pack_tiles, product_bounds, renamed, rows_of, takes_part, tile_count, tile_number, tile_rows
from pagewright.plans.staging import cleaned, stage

#: Vectors in a base tile; queries in a tile of a small table; rows of a strip of products.
BASE_TILE, QUERY_TILE, STRIP = 8192, 1024, 256
#: Base tiles in a group at most, and tasks that the grid should have at least.
GROUP, TASKS = 256, 256
NO_ID = np.iinfo(np.int64).max


class Heaps:
    """The k best (score, id) of each query of a tile; ties go to smaller ids."""

    def __init__(self, k: int, ids: np.ndarray):
        self.k, self.query_ids = k, ids
        self.score, self.id = np.full((len(ids), k), -np.inf), np.full((len(ids), k), NO_ID)

    def merge(self, row: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score[row], score]), np.concatenate([self.id[row], ids])
        best = np.lexsort((ids, -score))[: self.k]
        self.score[row], self.id[row] = score[best], ids[best]

    def rows(self) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": np.repeat(self.query_ids, self.k), "vec_id": self.id.ravel(), "score": self.score.ravel()})
        return out[(self.id != NO_ID).ravel()]


def search_tiles(q: Tile, b: Tile, heaps: Heaps) -> None:
    """Merge into ``heaps`` whatever of ``b`` can be among the k best of each query (never a query's own id)."""
    for start in range(0, len(q.ids), STRIP):
        rows = slice(start, min(start + STRIP, len(q.ids)))
        near, bound = product_bounds(q, b, rows)
        own = q.ids[rows, None] == b.ids[None, :]
        with np.errstate(over="ignore", invalid="ignore"):
            low, high = near - bound, near + bound
        low[own | ~np.isfinite(low)] = -np.inf
        floor = heaps.score[rows, -1]
        if low.shape[1] >= heaps.k:
            floor = np.maximum(floor, np.partition(low, low.shape[1] - heaps.k, axis=1)[:, low.shape[1] - heaps.k])
        # a bound that is not a number excludes nothing
        i, j = np.nonzero(~(high < floor[:, None]) & ~own)
        score = gathered_products(q.vecs[rows], i, b.vecs, j)
        cuts = np.searchsorted(i, np.arange(rows.stop - rows.start + 1))
        for r in range(rows.stop - rows.start):
            if cuts[r] < cuts[r + 1]:
                part = slice(cuts[r], cuts[r + 1])
                heaps.merge(start + r, score[part], b.ids[j[part]])


@cleaned
def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row that ``is_query`` selects.

    Candidates are all rows but those with the query's own id; vectors that are null, zero or hold null or
    non-finite components, and rows without an id, take no part. Vectors meet only those of their own
    dimension. Fewer than k candidates: all of them. Ties go to smaller ids. Rows that repeat id and vector
    count once. A product beyond the range of doubles scores an infinity of its sign. Other columns are
    ignored. An empty table gives no rows.
    """
    every = stage(
        vectors.where(takes_part(F.col(vec_id), F.col(vec))).select(F.col(vec_id).cast("long").alias("id"), F.col(vec).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).distinct()
        .withColumns({"d": F.size("v"), "extra": F.lit(0).cast("long")}),
        "vectors",
    )
    counts = every.groupBy("d").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("m")).where("m > 0")
    grid = counts.select("d", "n", tile_count(F.col("n"), F.lit(BASE_TILE)).alias("bases"), tile_count(F.col("m"), tile_rows(F.col("m"), F.col("d"), QUERY_TILE)).alias("tiles"))
    grid = grid.withColumn("groups", F.greatest(F.ceil(F.col("bases") / GROUP), F.least(F.col("bases"), F.ceil(F.lit(TASKS) / F.col("tiles")))).cast("long"))
    grid = stage(grid, "grid")
    tasks = grid.agg(F.sum(F.col("tiles") * F.col("groups"))).first()[0] or 1
    sized = join_counted(every, grid, ["d"], "n")
    base = renamed(pack_tiles(sized.withColumn("b", tile_number(F.col("bases"))).select("d", "b", "tiles", "groups", "id", "v", "extra"), ["d", "b", "tiles", "groups"], "v"), "v_")
    asking = sized.where("asks").withColumn("q", tile_number(F.col("tiles"))).select("d", "q", "groups", "id", "v", "extra")
    queries = renamed(pack_tiles(asking, ["d", "q", "groups"], "v"), "v_")
    first = F.lit(-1).cast("long")
    held = [c for c in base.columns if c.startswith("v_")]
    met = base.withColumns({"g": F.pmod("b", "groups"), "q": F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))}).select("d", "q", "g", "b", *held)
    met = met.unionByName(queries.withColumns({"b": first, "g": F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))}).select("d", "q", "g", "b", *held))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, heaps = None, None
        for row in rows_of(batches):
            if row["b"] < 0:  # the queries of a task come before its base tiles
                if heaps is not None:
                    yield heaps.rows()
                queries = Tile.load(row, "v_")
                heaps = Heaps(k, queries.ids)
            else:
                search_tiles(queries, Tile.load(row, "v_"), heaps)
        if heaps is not None:
            yield heaps.rows()

    order = ["d", "q", "g"]
    found = met.repartition(min(tasks, 1 << 16), *order).sortWithinPartitions(*order, "b").mapInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
