"""The word rule that the operators share: maximal runs of characters other than space and U+0009-U+000D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def word_list(col: Column) -> Column:
    """Native: the words of ``col``; null text has none."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.size(word_list(col)).cast("long")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Python: the same words as UTF-8 bytes (``bytes.split`` cuts at exactly these six characters)."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()
