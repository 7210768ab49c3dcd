"""Int8 quantised tiles of vectors, with rigorous error bounds on their products.

A vector v is stored as codes q = round(v / s), s = max|v| / 127, and the exact norm of what is lost,
e = |v - s q|. For two vectors  |v.w - s_v s_w q_v.q_w| <= |s_v q_v| e_w + e_v |s_w q_w| + e_v e_w.
Code products are computed by a float32 matrix product, which is exact up to 1040 dimensions (127^2 d < 2^24)
and done in float64 beyond.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = "ids binary, vecs binary, extra binary, n int, dim int"
#: Relative slack for the rounding of double arithmetic in the bounds themselves, and absolute slack for products that underflow.
SLACK, TINY = 1e-9, 1e-290
#: Bytes of doubles in a tile at most, and pairs that are gathered at once for exact products.
TILE_BYTES, GATHER = 1 << 24, 1 << 16


def takes_part(vec_id: Column, vec: Column) -> Column:
    """True for vectors without null, NaN or infinite components that are not all zero, with an id."""
    finite = F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vec_id.isNotNull() & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def exponents(vecs: np.ndarray) -> np.ndarray:
    """By row, the power of two that the largest component lies below."""
    return np.frexp(np.abs(vecs).max(axis=1))[1]


def quantise(vecs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, norms of what is lost) of float64 rows; worked out on rows brought near 1, so squares stay finite."""
    power = exponents(vecs)
    near = np.ldexp(vecs, -power[:, None])
    scale = np.abs(near).max(axis=1) / 127.0
    scale[scale == 0] = 1.0
    codes = np.rint(near / scale[:, None]).astype(np.int8)
    lost = np.sqrt(((near - scale[:, None] * codes) ** 2).sum(axis=1))
    return codes, np.ldexp(scale, power), np.ldexp(lost, power)


@dataclass
class Tile:
    ids: np.ndarray
    vecs: np.ndarray
    codes: np.ndarray
    scale: np.ndarray
    lost: np.ndarray
    extra: np.ndarray

    @classmethod
    def load(cls, row, prefix: str = "", unit: bool = False) -> Tile:
        """Codes are made on arrival: what travels is the vectors, in the precision of their table.

        ``unit``: the vectors are scaled by powers of two, which leaves cosines as they are to the last bit,
        and the codes are those of v/|v|.
        """
        n, dim = int(row[prefix + "n"]), int(row[prefix + "dim"])
        raw = row[prefix + "vecs"]
        vecs = np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)
        shape = vecs
        if unit:
            vecs = np.ldexp(vecs, -exponents(vecs)[:, None])
            shape = vecs / np.sqrt(exact_products(vecs, vecs))[:, None]
        codes, scale, lost = quantise(shape)
        kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
        return cls(np.frombuffer(row[prefix + "ids"], np.int64), vecs, codes.astype(kind), scale, lost, np.frombuffer(row[prefix + "extra"], np.int64))

    @cached_property
    def known(self) -> np.ndarray:
        """Norms of the quantised vectors."""
        return self.scale * np.sqrt((self.codes.astype(np.float64) ** 2).sum(axis=1))


def product_bounds(a: Tile, b: Tile, rows: slice, columns: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """(approximate products, error bounds) of rows of ``a`` with columns of ``b``; where either is not finite, nothing is known."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = (a.codes[rows] @ b.codes[columns].T).astype(np.float64)
        near *= a.scale[rows, None]
        near *= b.scale[None, columns]
        known_a, known_b, lost_a, lost_b = a.known[rows], b.known[columns], a.lost[rows], b.lost[columns]
        bound = known_a[:, None] * lost_b[None, :] + (lost_a + SLACK * (known_a + lost_a))[:, None] * (known_b + lost_b)[None, :]
        bound += TINY
    return near, bound


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row-wise inner products in double precision, summed in component order.

    Rows whose sum leaves the range of doubles are worked out again near 1 and scaled back: the result is the
    product, or an infinity of its sign, never NaN.
    """
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(x.shape[1]):
            total += x[:, k] * y[:, k]
        wild = np.flatnonzero(~np.isfinite(total))
        if len(wild):
            power_x, power_y = exponents(x[wild]), exponents(y[wild])
            near = exact_products(np.ldexp(x[wild], -power_x[:, None]), np.ldexp(y[wild], -power_y[:, None]))
            total[wild] = np.ldexp(near, power_x + power_y)
    return total


def gathered_products(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``exact_products`` of rows ``x[i]`` and ``y[j]``, a bounded number at a time."""
    parts = [exact_products(x[i[s : s + GATHER]], y[j[s : s + GATHER]]) for s in range(0, len(i), GATHER)]
    return np.concatenate(parts) if parts else np.zeros(0)


def pack_tiles(vectors: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """One row per group of ``keys`` (each of bounded size) with the group's vectors packed; ids ascend.

    ``vectors`` has id and extra (long) beside ``keys`` and ``vec``. Single precision stays single.
    """
    kinds = dict(vectors.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + TILE
    item = np.float32 if kinds[vec] == "array<float>" else np.float64

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        vecs = np.array(group[vec].tolist(), dtype=item)
        first = {k: [group[k].iloc[0]] for k in keys}
        packed = {"ids": group["id"].to_numpy(np.int64), "vecs": vecs, "extra": group["extra"].to_numpy(np.int64)}
        return pd.DataFrame(first | {k: [v.tobytes()] for k, v in packed.items()} | {"n": [len(vecs)], "dim": [vecs.shape[1]]})

    # dealt by all the keys: rows that are dealt by some of them already would stay together
    return vectors.repartition(*keys).groupBy(*keys).applyInPandas(pack, schema)


def tile_rows(count: Column, dim: Column, least: int) -> Column:
    """Rows of a tile: ``least`` in a small table, a sixteenth of a larger one, and never more than ``TILE_BYTES``."""
    return F.least(F.greatest(F.lit(least), F.ceil(count / 16)), F.greatest(F.floor(F.lit(TILE_BYTES // 8) / F.greatest(dim, F.lit(1))), F.lit(1))).cast("long")


def tile_count(count: Column, rows: Column) -> Column:
    return F.greatest(F.ceil(count / rows), F.lit(1)).cast("long")


def tile_number(tiles: Column) -> Column:
    """An even spread of ids over that many tiles."""
    return F.pmod(F.xxhash64("id"), tiles).cast("long")


def renamed(tiles: DataFrame, prefix: str) -> DataFrame:
    """The packed columns with ``prefix``."""
    packed = [field.split()[0] for field in TILE.split(", ")]
    return tiles.withColumnsRenamed({c: prefix + c for c in packed})


def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_dict("records")
