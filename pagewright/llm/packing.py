"""Bounded-space online packing of token streams into fixed windows.

Each partition keeps a fixed number of open windows. A piece goes to the fullest window that it fits
(best-fit); when none fits, the fullest is topped up with the piece's head and emitted. Open windows left
at a partition's end are merged by the same rule, first among partitions in groups, then once more over
what the groups leave. The very last tokens form windows whose lengths are powers of two, so nothing is
padded there either. Pieces carry their ids only while they are leftovers.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.words import words_of
from pagewright.plans.staging import cleaned, stage

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Words and units whose ids a worker remembers between chunks, and the longest word that it takes apart.
MEMO_WORDS, MEMO_LENGTH = 1_500_000, 64
#: Documents encoded together.
CHUNK = 64
#: Pieces in one pandas batch of the output.
BATCH = 20_000
#: Sequences that one task may number: the task's number takes the bits above.
TASK_BITS = 36


class WordIds:
    """Texts to ids as little-endian uint32 bytes, by way of their words.

    The tokenizer cuts at white space before it merges, and its normal forms never join across a space, so a
    text's ids are the concatenation of its words' ids (special strings hold no space either). New words are
    encoded many at a time: a plain Latin word is one unit to the tokenizer and its last id is one that ends a
    unit, so their ids can be told apart in one stream; punctuation behind such a word is a unit of its own.
    Whatever is not of that form is encoded alone.
    """

    PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")}
        self.known: dict[bytes, bytes] = {}
        self.units: dict[str, bytes] = {}

    def alone(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: set[bytes]) -> None:
        plain, fresh = [], set()
        for word in words:
            text = word.decode("utf-8", "surrogatepass")
            if len(word) <= MEMO_LENGTH and (m := self.PLAIN.fullmatch(text)):
                base = m[1].lower()
                plain.append((word, base, m[2]))
                if base not in self.units:
                    fresh.add(base)
                if m[2] and m[2] not in self.units:
                    self.units[m[2]] = self.alone(m[2])
            else:
                self.known[word] = self.alone(text)
        order = list(fresh)
        ids = self.tokenizer.encode(" ".join(order), add_special_tokens=False).ids
        cuts = [k for k, i in enumerate(ids, 1) if i in self.ends]
        if len(cuts) == len(order):
            raw = array("I", ids).tobytes()
            for unit, start, stop in zip(order, [0, *cuts], cuts):
                self.units[unit] = raw[4 * start : 4 * stop]
        else:
            self.units.update((unit, self.alone(unit)) for unit in order)
        for word, base, tail in plain:
            self.known[word] = self.units[base] + self.units[tail] if tail else self.units[base]

    def encode_all(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """Ids of each text (null: none), closed by ``end``."""
        if len(self.known) + len(self.units) > MEMO_WORDS:
            self.known, self.units = {}, {}
        split = [words_of(text) for text in texts]
        new = set().union(*split).difference(self.known)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join([*map(get, words), end]) for words in split]


#: One per tokenizer file and worker process, so that tasks of a worker share what it has learnt.
LEARNT: dict[str, WordIds] = {}


def word_stream(path: str, end_id: int) -> Callable[[list[str | None]], list[bytes]]:
    """Texts to ids closed by ``end_id``."""
    if path not in LEARNT:
        LEARNT[path] = WordIds(path)
    ids = LEARNT[path]
    return lambda texts: ids.encode_all(texts, end_id.to_bytes(4, "little"))


class Packer:
    """Open windows of one task. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, window: int, open_windows: int):
        self.window, self.limit = window, open_windows
        self.open: list[tuple[int, int]] = []  # (tokens free, key), ascending: the fullest first
        self.held: dict[int, list[tuple]] = {}
        self.keys = 0
        self.done: list[list[tuple]] = []

    def add(self, piece: tuple) -> None:
        doc_id, start, total, ids = piece
        while len(ids) >= 4 * self.window:
            self.done.append([(doc_id, start, total, ids[: 4 * self.window])])
            start, ids = start + self.window, ids[4 * self.window :]
        if ids:
            self._place((doc_id, start, total, ids))

    def _place(self, piece: tuple) -> None:
        doc_id, start, total, ids = piece
        need = len(ids) // 4
        at = bisect_right(self.open, (need, -1))
        if at < len(self.open):
            free, key = self.open.pop(at)
        elif len(self.open) < self.limit:
            self.keys += 1
            free, key = self.window, self.keys
            self.held[key] = []
        else:
            free, key = self.open.pop(0)
            self.done.append([*self.held.pop(key), (doc_id, start, total, ids[: 4 * free])])
            return self._place((doc_id, start + free, total, ids[4 * free :]))
        self.held[key].append(piece)
        if free == need:
            self.done.append(self.held.pop(key))
        else:
            insort(self.open, (free - need, key))

    def close(self) -> list[tuple]:
        """Merge what is open into full windows; the pieces that remain make less than one window."""
        pieces = [p for _, key in self.open for p in self.held[key]]
        self.open, self.held, self.limit = [], {}, 1
        for piece in pieces:
            self.add(piece)
        return [p for held in self.held.values() for p in held]


def powers(pieces: list[tuple]) -> list[list[tuple]]:
    """Cut pieces of less than a window into windows whose lengths are powers of two, longest first."""
    left = sum(len(p[3]) for p in pieces) // 4
    out, rest = [], list(pieces)
    while left:
        room = 1 << left.bit_length() - 1
        left -= room
        window: list[tuple] = []
        while room:
            doc_id, start, total, ids = rest.pop(0)
            window.append((doc_id, start, total, ids[: 4 * room]))
            if len(ids) > 4 * room:
                rest.insert(0, (doc_id, start + room, total, ids[4 * room :]))
            room -= len(window[-1][3]) // 4
        out.append(window)
    return out


COLUMNS = [c.split()[0] for c in PIECE.split(", ")] + ["ids", "task"]


def _sequences(windows: list[list[tuple]], first: int) -> Iterator[tuple]:
    for k, window in enumerate(windows):
        at = 0
        for doc_id, start, total, ids in window:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, first + k, at, None, None
            at += len(ids) // 4


def _leftover(pieces: list[tuple], task: int) -> list[tuple]:
    return [(doc_id, start, len(ids) // 4, 0, total, 0, k, ids, task) for k, (doc_id, start, total, ids) in enumerate(pieces)]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({"doc_id": "Int64", "task": "Int64"})


@cleaned
def pack_documents(docs: DataFrame, encoder: Callable[[], Callable[[list[str | None]], list[bytes]]], window: int = 2048, open_windows: int = 64, doc_id: str = "doc_id", text: str = "text", order: Sequence[str] = ()) -> DataFrame:
    """One row per piece (schema ``PIECE``) of every row's token stream.

    ``order``: columns to pack by. Rows are range-sorted by them first, and sequence ids then rise in that order,
    but for the windows merged of leftovers, less than one a task, which come last.

    ``encoder`` makes, in a worker, a function from texts to ids as little-endian uint32 bytes. Each id lies in
    exactly one piece. All sequences hold ``window`` tokens but fewer than log2(window) last ones, whose
    lengths are distinct powers of two. Rows that repeat an id are packed as documents of their own, a null
    id stays null, a stream without ids gives no piece, an empty table no rows. The result is staged, so one
    reading of it agrees with the next.
    """
    pieces_schema = PIECE + ", ids binary, task long"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, packer = encoder(), Packer(window, open_windows)
        task = TaskContext.get().partitionId()
        made, rows = 0, []
        for batch in batches:
            texts, row_ids = batch["text"].tolist(), batch["doc_id"].tolist()
            for at in range(0, len(texts), CHUNK):
                for row_id, ids in zip(row_ids[at : at + CHUNK], encode(texts[at : at + CHUNK])):
                    packer.add((None if row_id is None or row_id != row_id else int(row_id), 0, len(ids) // 4, ids))
                if len(packer.done) >= 1000:
                    rows += _sequences(packer.done, (task << TASK_BITS) + made)
                    made += len(packer.done)
                    packer.done = []
                if len(rows) >= BATCH:
                    yield _frame(rows)
                    rows = []
        rest = packer.close()
        rows += _sequences(packer.done, (task << TASK_BITS) + made)
        yield _frame(rows + _leftover(rest, task))

    def merger(level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def merge(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["task", "offset"])
            packer, key = Packer(window, 1), int(group["unit"].iloc[0])
            for d, start, total, ids, size in zip(group["doc_id"], group["start"], group["doc_tokens"], group["ids"], group["length"]):
                packer.add((None if pd.isna(d) else int(d), int(start), int(total), bytes(ids)))
            rest = packer.close()
            windows = packer.done + (powers(rest) if last else [])
            rows = list(_sequences(windows, (level << 58) | (key << 20)))
            return _frame(rows + ([] if last else _leftover(rest, key)))

        return merge


    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *(F.col(c).alias(f"order_{k}") for k, c in enumerate(order)))
    if order:
        by = [f"order_{k}" for k in range(len(order))]
        chosen = chosen.repartitionByRange(max(1, docs.rdd.getNumPartitions()), *by).sortWithinPartitions(*by).select("doc_id", "text")
    first = stage(chosen.mapInPandas(pack, pieces_schema), "packed")
    left = first.where("ids is not null")
    tasks = left.agg(F.countDistinct("task")).first()[0]
    width = max(2, math.isqrt(tasks) + 1)
    second = stage(left.withColumn("unit", F.expr(f"cast(task div {width} as long)")).groupBy("unit").applyInPandas(merger(1, False), pieces_schema), "merged")
    third = second.where("ids is not null").withColumn("unit", F.lit(0).cast("long")).groupBy("unit").applyInPandas(merger(2, True), pieces_schema)
    names = [c.split()[0] for c in PIECE.split(", ")]
    return first.where("ids is null").select(names).unionByName(second.where("ids is null").select(names)).unionByName(third.select(names))
