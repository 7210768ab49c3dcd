"""Substring dedup: repeated word windows, found in FM-indexes of content-addressed shards.

A window of ``window`` words is addressed by its anchor, the smallest hash among its k-word grams: equal
windows have equal anchors, so they meet in one shard. Runs of windows with one anchor are segments. Only
segments whose anchor lies in documents of different ids go on. Segments of the same words are one class: they
are addressed by 128 bits of hashes, and a class whose words turn out to differ stops the job. A shard indexes
the words of its classes in an FM-index, and each class is streamed against it: backward search gives the
matching statistics, and every window learns the smallest id that the index knows to hold it. A member of the
class loses the windows whose smallest id is below its own. Anchors shared by very many different segments
(the rims of a popular passage) are split: there each window is its own anchor, so copies collapse before
anything meets. Anchors and classes that very many documents hold are joined where their rows lie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.fmindex import DEEP, FMIndex
from pagewright.llm.skew import join_counted
from pagewright.llm.words import words_of
from pagewright.plans.staging import cleaned, stage

GRAM = 16
#: Windows in a segment at most; classes of an anchor beyond which it is split; classes in a shard on average.
LONGEST, CROWD, SHARD = 64, 2048, 4096
MEMO = 200_000
NO_ID = (1 << 63) - 1  # a null id comes after all others
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordCodes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 5)
        return found


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of each run of ``width`` values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def segments(words: list[bytes], window: int, memo: WordCodes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, first windows, counts of windows) of a document, in order."""
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams, have = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)), 1
    while have < GRAM:
        grams = (grams[:-have] * A) ^ ((grams[have:] + B) * B)
        grams ^= grams >> np.uint64(31)
        have *= 2
    least = _slide(grams * A, window - GRAM + 1)
    cuts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    sizes = np.diff(np.append(cuts, n))
    if sizes.max() > LONGEST:
        parts = -(-sizes // LONGEST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts, ends = np.repeat(cuts, parts) + inner * LONGEST, np.repeat(cuts + sizes, parts)
        sizes = np.minimum(LONGEST, ends - cuts)
    return least[cuts].view(np.int64), cuts, sizes


def _bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    return np.concatenate([[0], ends[:-1] + 1]), ends


def _first_pass(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordCodes()
        for batch in batches:
            anchors, counts, digests = [], [], []
            for t in batch.column("text"):
                words = words_of(t.as_py())
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                anchors.append(np.unique(segments(words, window, memo)[0]))
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in anchors])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*anchors, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "key", "hash")), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), lists], ["doc_id", "key", "hash", "n_words", "kept_sha256", "anchors"])

    return run


def _second_pass(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordCodes()
        schema = pa.schema([(n, pa.int64()) for n in ("key", "hash", "anchor", "content")] + [("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            for key, own, t, wanted in zip(batch.column("key").to_pylist(), batch.column("hash").to_pylist(), batch.column("text"), batch.column("anchors")):
                words = words_of(t.as_py())
                anchors, first, sizes = segments(words, window, memo)
                keep = np.flatnonzero(np.isin(anchors, np.asarray(wanted.values)))
                if not len(keep):
                    continue
                starts, ends = _bounds(words)
                line = b" ".join(words)
                for k in keep.tolist():
                    s, n = int(first[k]), int(sizes[k])
                    piece = line[starts[s] : ends[s + n + window - 2]]
                    rows.append((key, own, int(anchors[k]), _signed(xxhash.xxh64_intdigest(piece, 6)), s, n, piece))
                if len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def search_shard(pieces: list[bytes], keys: np.ndarray, window: int) -> list[np.ndarray]:
    """For each text, runs (first window, past the last, smallest key, ...) of windows with the smallest key among the texts that hold them."""
    ids: dict[bytes, int] = {}
    texts = [np.array([ids.setdefault(w, len(ids) + 1) for w in p.split()], np.int64) for p in pieces]
    index = FMIndex(texts)
    least = index.least_by_prefix(keys, window)
    text, pos, place = index.matching_statistics(texts, window)
    order = np.lexsort((pos, text))
    text, pos, low = text[order], pos[order], least[place[order]]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for s, e in zip(cuts, cuts[1:]):
        p, k = pos[s:e], low[s:e]
        opens = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(k) != 0)])) if len(p) else np.zeros(0, int)
        closes = np.append(opens[1:], len(p)) - 1
        out.append(np.column_stack([p[opens], p[closes] + 1, k[opens]]).ravel() if len(p) else np.zeros(0, np.int64))
    return out


def _shard_pass(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def search(table: pa.Table) -> pa.RecordBatch:
            keys = table.column("first_key").to_numpy()
            hits = search_shard(table.column("words").to_pylist(), keys, window)
            kept = [table.column(n).combine_chunks() for n in ("anchor", "content", "last_key", "members")]
            return pa.RecordBatch.from_arrays([*kept, pa.array([h.tolist() for h in hits], pa.list_(pa.int64()))], ["anchor", "content", "last_key", "members", "hits"])

        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(shards) != 0, [True]])) if len(shards) else []
            for s, e in zip(cuts, cuts[1:]):
                if held and held[-1].column("shard")[0].as_py() != shards[s]:
                    yield search(pa.Table.from_batches(held))
                    held.clear()
                held.append(batch.slice(s, e - s))
        if held:
            yield search(pa.Table.from_batches(held))

    return run


def _kept(text: str | None, spans: list | None, window: int) -> tuple[list[bytes], list[bytes]]:
    """(all words, those outside the removed windows)."""
    words = words_of(text)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, e in spans or []:
        edge[s] += 1
        edge[e + window - 1] -= 1
    left = np.cumsum(edge[:-1]) == 0
    return words, [w for w, k in zip(words, left.tolist()) if k]


def _removal(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, digests = [], [], []
            for t, spans in zip(batch.column("text"), batch.column("spans")):
                words, kept = _kept(t.as_py(), [(x["s"], x["e"]) for x in spans.as_py()], window)
                counts.append(len(words))
                gone.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with key (the id; null after all others) and hash (of the text), which tell rows apart."""
    return docs.withColumns({"key": F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)), "hash": F.xxhash64(text)})


@cleaned
def repeated_spans(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (doc_id, key, hash, text): every row's counts and digest; the rows with shared anchors; spans by (key, hash).

    spans: array of (s, e), the windows from s up to e that go. All three are staged.
    """
    if not GRAM <= window <= DEEP:
        raise ValueError(f"window must lie between {GRAM} and {DEEP}")
    every = stage(docs.mapInArrow(_first_pass(window), "doc_id long, key long, hash long, n_words long, kept_sha256 string, anchors array<long>"), "anchors")
    places = every.select("key", "hash", F.explode("anchors").alias("anchor"))
    shared = places.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "n")
    wanted = stage(join_counted(places, stage(shared, "shared"), ["anchor"], "n").groupBy("key", "hash").agg(F.collect_set("anchor").alias("anchors")), "wanted")

    met = stage(docs.join(wanted, ["key", "hash"]).select("doc_id", "key", "hash", "text", "anchors"), "met")
    found = stage(met.mapInArrow(_second_pass(window), "key long, hash long, anchor long, content long, start int, n int, words binary"), "segments")
    crowded = found.groupBy("anchor", "content").agg(F.lit(1).alias("one")).groupBy("anchor").agg(F.count("*").alias("classes")).where(F.col("classes") > CROWD).select("anchor")
    crowded = stage(crowded, "crowded")
    split = F.split(F.col("words").cast("string"), " ")
    piece = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct((F.col("start") + i).alias("start"), F.array_join(F.slice(split, i + 1, window), " ").cast("binary").alias("words")))
    alone = (
        found.join(crowded, "anchor").select("key", "hash", F.explode(piece).alias("w"))
        .select("key", "hash", F.xxhash64("w.words").alias("anchor"), F.xxhash64(F.lit(1), "w.words").alias("content"), "w.start", F.lit(1).alias("n"), "w.words")
    )
    members = found.join(crowded, "anchor", "left_anti").select("key", "hash", "anchor", "content", "start", "n", "words").unionByName(alone)

    classes = members.groupBy("anchor", "content").agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count("*").alias("members"), F.min("words").alias("words"), F.max("words").alias("others"))
    alike = F.when(F.col("words") == F.col("others"), F.col("words")).otherwise(F.raise_error(F.lit("segments of one class hold different words")).cast("binary"))
    classes = stage(classes.withColumn("words", alike).drop("others"), "classes")
    shards = max(1, -(-classes.count() // SHARD))
    sharded = classes.withColumn("shard", F.pmod("anchor", F.lit(shards)).cast("int")).repartition(shards, "shard").sortWithinPartitions("shard", "first_key")
    searched = sharded.select("shard", "anchor", "content", "first_key", "last_key", "members", "words").mapInArrow(_shard_pass(window), "anchor long, content long, last_key long, members long, hits array<long>")
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size("hits") / 3).cast("int") - 1), lambda i: F.struct(F.col("hits")[3 * i].cast("int").alias("s"), F.col("hits")[3 * i + 1].cast("int").alias("e"), F.col("hits")[3 * i + 2].alias("low")))
    lost = F.when(F.size("hits") > 0, F.filter(runs, lambda r: r["low"] < F.col("last_key")))
    told = stage(searched.select("anchor", "content", "members", lost.alias("runs")).where(F.size("runs") > 0), "searched")

    own = F.transform(F.filter("runs", lambda r: r["low"] < F.col("key")), lambda r: F.struct((F.col("start") + r["s"]).alias("s"), (F.col("start") + r["e"]).alias("e")))
    gone = (
        join_counted(members.select("key", "hash", "anchor", "content", "start"), told, ["anchor", "content"], "members")
        .select("key", "hash", F.explode(own).alias("span")).groupBy("key", "hash").agg(F.collect_set("span").alias("spans"))
    )
    return every, met, stage(gone, "gone")


@cleaned
def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256 (of the words that stay, joined by single spaces).

    A word goes if some window of ``window`` words that covers it also occurs in a document of smaller id;
    windows are judged on the input. Repeats inside a document, and between rows of equal id, stay. A null id
    comes after all others, and rows without id are no repeats of each other; null, empty and short texts lose
    nothing. ``window`` from 16 to 63. Rows that repeat id and text are judged alike. Other columns are ignored.
    An empty table gives no rows.
    """
    rows = _keyed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    every, met, gone = repeated_spans(rows, window)
    hit = met.join(gone, ["key", "hash"]).select("doc_id", "text", "spans").mapInArrow(_removal(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
    rest = every.join(gone.select("key", "hash"), ["key", "hash"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    return rest.unionByName(hit)


def strip_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` (doc_id, text and any more) with the repeated words gone from text; other texts stay as they are."""
    keyed = docs.withColumns({"repeat_key": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "repeat_hash": F.xxhash64("text")})
    _, _, gone = repeated_spans(_keyed(docs.select("doc_id", "text"), "doc_id", "text"), window)
    gone = gone.select(F.col("key").alias("repeat_key"), F.col("hash").alias("repeat_hash"), F.col("spans").alias("repeat_spans"))
    joined = keyed.join(gone, ["repeat_key", "repeat_hash"], "left").select(*docs.columns, "repeat_spans")

    columns = docs.columns

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("repeat_spans")
            texts = [t.as_py() if s is None else b" ".join(_kept(t.as_py(), [(x["s"], x["e"]) for x in s], window)[1]).decode("utf-8", "surrogatepass") for t, s in zip(batch.column("text"), spans.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(n).type) if n == "text" else batch.column(n) for n in columns], columns)

    return joined.mapInArrow(strip, docs.schema)
