"""N-gram language model: counted, smoothed and queried in shards of an Elias-Fano trie.

Texts become blocks of token ids. First the words are counted in shards of their hashes, and get ids by falling
count. Then each block sends its distinct runs of ``order`` words, with their training counts, to shards chosen
by the first word; all that follows a word lies below it, so one exchange serves every order. A shard adds up
the counts and builds a trie of all levels: words with their probabilities, below them their followers, below
those the next, every inner node with its back-off weight. The trie is written to the shared folder, mapped
into memory, and answers each block by walking down both tries together: pointers bound a node's children and a
successor search finds the word among them. Frequent first words are dealt to several shards by the second.
What moves is each block's distinct n-grams as a small trie, and a code or two per node of it in return.

P1(w) = (c(w) + 1) / (N + V + 1), unknown words included as one type. Above it, absolute discounting:
P(w|h) = max(c(hw) - D, 0) / c(h) + D T(h) / c(h) * P(w|h'), with T(h) the distinct followers of h; a context
that training never saw passes on P(w|h'). Codes round probabilities down by less than 0.06 %.
"""

from __future__ import annotations

import contextlib
import math
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.eliasfano import NgramLevel, NgramTrie, dequantise
from pagewright.llm.words import words_of
from pagewright.plans.staging import cleaned, note, remove, shared_dir, stage

DISCOUNT = 0.75
#: Tokens in a block, in a shard on average, and count of a word beyond which its followers go to several shards.
BLOCK, SHARD, HOT = 1 << 21, 1 << 21, 1 << 19
#: N-grams in a message between a block and a shard at least, as far as larger shards bring that about.
MESSAGE = 128
#: Parts that hot words are cut into at most, over all words; runs that a shard holds before it adds them up.
PARTS, HELD = 1 << 18, 1 << 23
#: What stands in a run for "nothing follows" and for a word that training lacks; words begin at 2.
NONE, UNKNOWN = 0, 1
END = b""  # closes a text and stands before its first word; no word is empty
ANSWER = "block long, shard long, payload binary, tokens long, types long"


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed payload; bytes of equal rank lie together, as the high ones hardly vary."""
    head = np.array([len(arrays), *[v for a in arrays for v in (np.dtype(a.dtype).num, len(a))]], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), np.dtype(a.dtype).itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head.tobytes() + b"".join(planes))


KINDS = {np.dtype(k).num: np.dtype(k) for k in (np.uint8, np.uint16, np.uint32, np.int32, np.int64, np.uint64)}


def loosen(payload: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    spec, at, out = np.frombuffer(raw, np.int64, 2 * n, 8), 8 + 16 * n, []
    for code, length in spec.reshape(-1, 2).tolist():
        kind = KINDS[code]
        planes = np.frombuffer(raw, np.uint8, length * kind.itemsize, at).reshape(kind.itemsize, length)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += length * kind.itemsize
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def _blocks(block_tokens: int):
    return lambda batches: _make_blocks(batches, block_tokens)


def _make_blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, ids, learns, payload, hashes, n).

    payload: token ranks by falling frequency, text lengths, and the rank of each word in order of its hash;
    hashes: the words' hashes, ascending. Shards are ranges of hashes, so answers come back in that order.
    """
    task, made = TaskContext.get().partitionId(), 0
    places, tokens, ids, learns, size = _Places({END: 0}), [], [], [], 0

    def close() -> pa.RecordBatch:
        stream = np.concatenate(tokens)
        often = np.argsort(-np.bincount(stream, minlength=len(places)), kind="stable")
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in places), np.uint64, len(places))
        order = np.argsort(hashes)
        payload = squeeze(narrow(rank[stream]), narrow(np.array([len(t) for t in tokens])), narrow(rank[order]), narrow(rank[:1]))
        columns = [pa.array([(task << 32) + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([learns], pa.list_(pa.bool_())), pa.array([payload], pa.binary()), pa.array([hashes[order].tobytes()], pa.binary()), pa.array([size])]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "learns", "payload", "hashes", "n"])

    for batch in batches:
        for doc_id, t, learn in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("learns").to_pylist()):
            words = words_of(t.as_py(), lower=True)
            words.append(END)
            tokens.append(np.fromiter(map(places.__getitem__, words), np.int64, len(words)))
            ids.append(doc_id)
            learns.append(learn)
            size += len(words)
            if size >= block_tokens:
                yield close()
                made += 1
                places, tokens, ids, learns, size = _Places({END: 0}), [], [], [], 0
    if tokens:
        yield close()


def distinct(columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the distinct rows in their order, which of them each row is); values lie below ``size``."""
    key, top = columns[0].astype(np.int64), size
    for column in columns[1:]:
        if top * size >= 1 << 62:
            values, key = np.unique(key, return_inverse=True)
            top = len(values)
        key, top = key * size + column, top * size
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def depths(columns: list[np.ndarray], group: np.ndarray | None = None) -> np.ndarray:
    """By row of sorted distinct rows, the first column that differs from the row before (0 where ``group`` changes)."""
    out = np.full(len(columns[0]), len(columns), np.uint8)
    for k in range(len(columns) - 1, -1, -1):
        out[1:][columns[k][1:] != columns[k][:-1]] = k
    out[:1] = 0
    if group is not None:
        out[1:][group[1:] != group[:-1]] = 0
    return out


class Block:
    """A block's tokens and what the shards told of them."""

    def __init__(self, row):
        tokens, lengths, order, end = loosen(row["payload"])
        self.tokens, lengths, self.order, self.end = tokens.astype(np.int64), lengths.astype(np.int64), order.astype(np.int64), int(end[0])
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths
        self.learns = np.repeat(np.asarray(row["learns"], bool), lengths)
        self.ids = list(row["ids"])

    def word_queries(self, hashes: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
        counts = np.bincount(self.tokens, self.learns, len(self.order)).astype(np.int64)[self.order]
        shard = ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[s], cuts[s + 1])
            yield s, squeeze(hashes[own], narrow(counts[own]))

    def learn_words(self, answers: dict[int, bytes]) -> None:
        told = [loosen(answers[s]) for s in sorted(answers)]
        self.count, self.word = np.zeros(len(self.order), np.int64), np.full(len(self.order), -1, np.int64)
        self.count[self.order] = np.concatenate([t[0].astype(np.int64) for t in told])
        self.word[self.order] = np.concatenate([t[1].astype(np.int64) for t in told]) - 1

    def runs(self, order: int, shards: int, hot: int) -> None:
        """The distinct runs of words from the word before each token on, sorted within the shards that they go to."""
        known = np.flatnonzero(self.word >= 0)
        known = known[np.argsort(self.word[known])]
        self.names = np.concatenate([[NONE, UNKNOWN], self.word[known] + 2])  # words of the block by their ids
        code = np.full(len(self.word), UNKNOWN, np.int64)
        code[known] = np.arange(len(known)) + 2
        tokens = code[self.tokens]
        before = np.concatenate([[code[self.end]], tokens[:-1]])
        before[self.starts] = code[self.end]
        columns, open_ = [before, tokens], tokens > UNKNOWN
        limit = np.repeat(self.ends, self.ends - self.starts)
        for k in range(1, order - 1):
            at = np.arange(len(tokens)) + k
            open_ &= at < limit
            following = np.where(open_, tokens[np.minimum(at, len(tokens) - 1)], NONE)
            open_ &= following > UNKNOWN
            columns.append(following)
        asks = before > UNKNOWN
        columns = [c[asks] for c in columns]
        first, inverse = distinct(columns, len(self.names))
        counts = np.bincount(inverse, self.learns[asks], len(first)).astype(np.int64)
        columns = [c[first] for c in columns]
        total = np.concatenate([[0, 0], self.count[known]])
        parts = np.maximum(1, total // hot)
        shard = _shard(self.names[columns[0]], self.names[columns[1]] % parts[columns[0]], shards)
        # a word in several parts is named in all of them, so that its weight can be added up
        split = np.unique(columns[0][parts[columns[0]] > 1])
        owner = np.repeat(split, parts[split])
        salt = np.arange(len(owner)) - np.repeat(np.cumsum(parts[split]) - parts[split], parts[split])
        places = np.unique(_shard(self.names[owner], salt, shards) * len(self.names) + owner)
        places = places[~np.isin(places, np.unique(shard * len(self.names) + columns[0]))]
        extra = [places % len(self.names), np.full(len(places), UNKNOWN), *[np.full(len(places), NONE)] * (order - 2)]
        columns = [np.concatenate([c, e]) for c, e in zip(columns, extra)]
        shard, counts = np.concatenate([shard, places // len(self.names)]), np.concatenate([counts, np.zeros(len(places), np.int64)])
        # rows are in order already but for the few that were added
        way = np.lexsort((*columns[::-1], shard)) if len(places) else np.argsort(shard, kind="stable")
        self.columns, self.shard, self.counts = [c[way] for c in columns], shard[way], counts[way]
        at = np.empty(len(way), np.int64)
        at[way] = np.arange(len(way))
        self.row = np.full(len(tokens), -1, np.int64)
        self.row[asks] = at[inverse]
        self.depth = depths(self.columns, self.shard)
        self.split_counts = np.where(parts > 1, total, 0)

    def gram_queries(self) -> Iterator[tuple[int, bytes]]:
        """(shard, payload): depths of the runs, the words of the nodes by level, training counts, split words and their counts."""
        cuts = np.flatnonzero(np.concatenate([[True], self.shard[1:] != self.shard[:-1], [True]])) if len(self.shard) else []
        for s, e in zip(cuts, cuts[1:]):
            depth, part = self.depth[s:e], slice(s, e)
            nodes = [self.names[c[part][depth <= k]] for k, c in enumerate(self.columns)]
            words = np.unique(self.columns[0][part])
            words = words[self.split_counts[words] > 0]
            nodes[0] = np.diff(nodes[0], prepend=0)
            yield int(self.shard[s]), squeeze(depth, *map(narrow, nodes), narrow(self.counts[part]), narrow(self.names[words]), narrow(self.split_counts[words]))

    def chances(self, answers: dict[int, bytes], base: np.ndarray) -> np.ndarray:
        """Probability of each token at the highest order, from unigram chances and the shards' answers."""
        told = [loosen(answers[s]) for s in sorted(answers)]
        if not told:
            return base
        parts = [np.concatenate(p) for p in zip(*told)]  # weights of the first words, then codes and weights by level
        share = lambda codes, none: np.where(codes > 0, 10.0 ** dequantise(codes), none)
        nodes = [np.cumsum(self.depth <= k) - 1 for k in range(len(self.columns))]
        asked = self.row >= 0
        rows = self.row[asked]
        heads = self.columns[0][self.depth == 0]
        weight = np.bincount(heads, share(parts[0], 0.0), len(self.names))
        chance = base.copy()
        chance[asked] = share(parts[1][nodes[1][rows]], 0.0) + weight[self.columns[0][rows]] * base[asked]
        begins = np.repeat(self.starts, self.ends - self.starts)
        for k in range(2, len(self.columns)):
            # the run that begins k - 1 tokens before a token tells of it, if it lies in the same text
            at = np.flatnonzero(np.arange(len(base)) - (k - 1) >= begins)
            at = at[self.row[at - (k - 1)] >= 0]
            rows = self.row[at - (k - 1)]
            reached = self.depth_reached(rows, k)
            at, rows = at[reached], rows[reached]
            chance[at] = share(parts[2 * k - 1][nodes[k][rows]], 0.0) + share(parts[2 * k - 2][nodes[k - 1][rows]], 1.0) * chance[at]
        return chance

    def depth_reached(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Whether all words before the k-th of these runs are known."""
        return self.columns[k - 1][rows] > UNKNOWN


def _shard(context: np.ndarray, salt: np.ndarray, shards: int) -> np.ndarray:
    z = (context.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + salt.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((z ^ (z >> np.uint64(29))) % np.uint64(shards)).astype(np.int64)


def count_words(shard: int, shards: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple]:
    """Answers (counts, ids + 1) by block: ids run by falling count within the shard; 0 for words training lacks."""
    parts = [loosen(p) for _, p in asked]
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(at, np.concatenate([p[1].astype(np.int64) for p in parts]), len(words)).astype(np.int64)
    order = np.lexsort((words, -counts))
    ids = np.empty(len(words), np.int64)
    ids[order] = np.arange(len(words)) * shards + shard + 1
    ids[counts == 0] = 0
    stop = np.cumsum([len(p[0]) for p in parts])
    for k, (block, _) in enumerate(asked):
        own = at[stop[k] - len(parts[k][0]) : stop[k]]
        yield block, shard, squeeze(narrow(counts[own]), narrow(ids[own])), 0, 0
    yield -1, shard, b"", int(counts.sum()), int((counts > 0).sum())


def _nodes(depth: np.ndarray, levels: int) -> list[np.ndarray]:
    """For the levels below the first, the place of each node's parent in the level above."""
    return [(np.cumsum(depth <= k - 1) - 1)[depth <= k] for k in range(1, levels)]


def _added(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Runs (columns, then counts) of several messages as distinct sorted runs with their sums."""
    *columns, counts = (np.concatenate(parts) for parts in zip(*held))
    first, inverse = distinct(columns, 1 + max((int(c.max()) for c in columns if len(c)), default=0))
    return [*(c[first] for c in columns), np.bincount(inverse, counts, len(first)).astype(np.int64)]


def build_trie(columns: list[np.ndarray], counts: np.ndarray, split: dict[int, int], train_tokens: int, types: int) -> NgramTrie:
    """Of distinct sorted runs that training holds; ``split``: counts of words whose followers lie in other shards too."""
    depth, levels = depths(columns), []
    parent = np.zeros(0, np.int64)
    for k, column in enumerate(columns):
        new = np.flatnonzero(depth <= k)
        sums = np.add.reduceat(counts, new) if len(new) else counts
        real = column[new] > UNKNOWN
        place = np.full(len(counts), -1, np.int64)  # of each run's node in this level
        if len(new):
            place = np.where(real, np.cumsum(real) - 1, -1)[np.cumsum(depth <= k) - 1]
        word, sums = column[new][real], sums[real]
        if k == 0:
            for w, n in split.items():
                at = np.searchsorted(word, w)
                if at < len(word) and word[at] == w:
                    sums[at] = n
            levels.append(NgramLevel.build(np.zeros(len(word), np.int64), word, np.log10((sums + 1) / (train_tokens + types + 1))))
            below = sums
        else:
            context = parent[new][real]
            kinds = np.bincount(context, minlength=len(below))
            total = below if k == 1 else np.bincount(context, sums, len(below))
            has = kinds > 0
            levels.append(NgramLevel.build(context, word, np.log10((sums - DISCOUNT) / total[context]), np.log10(DISCOUNT * kinds[has] / total[has])))
            below = sums
        parent = place
    return NgramTrie(levels)


def answer_grams(shard: int, asked: list[tuple[int, bytes]], order: int, train_tokens: int, types: int, folder: str | None, keep: bool) -> Iterator[tuple]:
    """Build the shard's trie, write it, map it, and answer each block: weights of first words, then codes and weights by level.

    Unless it is to be kept, the file goes when the last block has its answer; a repeated task writes it again.
    """
    held, size, split = [], 0, {}
    for _, payload in asked:
        depth, *nodes, counts, words, sums = loosen(payload)
        nodes[0] = np.cumsum(nodes[0].astype(np.int64))
        train = counts > 0
        rows = [n.astype(np.int64)[np.cumsum(depth <= k) - 1][train] for k, n in enumerate(nodes)] + [counts[train].astype(np.int64)]
        held.append(rows)
        size += len(rows[0])
        split.update(zip(words.tolist(), sums.tolist()))
        if size > HELD:
            held = [_added(held)]
            size = len(held[0][0]) // 2  # add up again when half as many have come
    *columns, counts = _added(held)
    image = build_trie(columns, counts, split, train_tokens, types).image()
    del held, columns, counts
    if folder is None:
        trie = NgramTrie.map(memoryview(image))
    else:
        trie = open_shard(folder, shard, image)
    del image
    for block, payload in asked:
        depth, *nodes = loosen(payload)[: order + 1]
        nodes[0] = np.cumsum(nodes[0].astype(np.int64))
        codes, weights = trie.walk([n.astype(np.int64) for n in nodes], _nodes(depth, order))
        told = [weights[0], *(a for k in range(1, order) for a in ([codes[k], weights[k]] if k < order - 1 else [codes[k]]))]
        yield block, shard, squeeze(*(a.astype(np.uint16) for a in told)), 0, 0
    if folder is not None and not keep:
        with contextlib.suppress(FileNotFoundError):  # another attempt of the task may have been first
            os.unlink(f"{folder}/{shard}.trie")


def open_shard(folder: str, shard: int, image: bytes | None = None) -> NgramTrie:
    """A shard's trie, mapped from its file; first written there, whole or not at all, if ``image`` is given."""
    path = f"{folder}/{shard}.trie"
    if image is not None:
        os.makedirs(folder, exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            out.write(image)
        os.replace(part, path)
    return NgramTrie.open(path)


def _stage_bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """Staged in the shared folder in buckets of ``key``, so that grouping by it moves nothing again."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    df.write.format("parquet").option("compression", "none").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    out = spark.table(name)
    out._staged_path, out._staged_table = path, name
    note(out)
    return out


def _local(path: str) -> str | None:
    """The shared folder as a path that Python can open; None if it is not in a file system."""
    scheme, colon, rest = path.partition(":")
    return path if not colon else "/" + rest.lstrip("/") if scheme == "file" else None


@cleaned
def score_corpus(docs: DataFrame, learns: Column, order: int = 2, doc_id: str = "doc_id", text: str = "text", block_tokens: int | None = None, model: str | None = None) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    ``learns``: which rows train the model. Tokens are the lower-cased words and one end. base_score is the
    sum of log10 P1, score that of the model of ``order`` (2 or more). Null text is empty (its end alone); rows
    may repeat ids or lack them, and a null ``learns`` counts as true. An empty table gives no rows. The result
    is staged.

    ``model``: a folder of the shared file system in which the shards' trie files stay; without it each is
    deleted when all blocks have its answers. Where the shared folder is no file system, tries are mapped
    over memory instead. ``block_tokens``: tokens in a block; shards grow with the square root of the corpus so
    that messages keep some size, and beyond about 1 TB blocks should grow with them.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark, block_size = docs.sparkSession, block_tokens or BLOCK
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(learns, F.lit(True)).alias("learns"))
    made = rows.mapInArrow(_blocks(block_size), "block long, ids array<long>, learns array<boolean>, payload binary, hashes binary, n long")
    blocks = _stage_bucketed(made, "blocks", "block")
    total = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = max(SHARD, math.isqrt(MESSAGE * total))
    word_shards, gram_shards, hot = 1 + total // (4 * size), 1 + total // size, max(HOT, total // PARTS)

    def ask_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield pd.DataFrame([(row["block"], s, p) for s, p in Block(row).word_queries(np.frombuffer(row["hashes"], np.uint64), word_shards)], columns=["block", "shard", "payload"])

    columns = [c.split()[0] for c in ANSWER.split(", ")]
    asked_of = lambda group: (int(group["shard"].iloc[0]), list(zip(group["block"].tolist(), group["payload"].tolist())))

    def told_words(group: pd.DataFrame) -> pd.DataFrame:
        shard, asked = asked_of(group)
        return pd.DataFrame(list(count_words(shard, word_shards, asked)), columns=columns)

    queries = blocks.drop("n").mapInPandas(ask_words, "block long, shard long, payload binary")
    words = stage(queries.repartition(word_shards, "shard").groupBy("shard").applyInPandas(told_words, ANSWER), "words", "none")
    sums = words.where("block = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    train_tokens, types = int(sums[0]), int(sums[1])
    told = words.where("block >= 0").select("block", F.lit(1).alias("level"), "shard", "payload")
    slim = blocks.select("block", "ids", "learns", "payload")

    def replay(row, told: pd.DataFrame) -> tuple[Block, dict[int, dict[int, bytes]]]:
        """A block with its words and runs, and the answers by level."""
        block, by_level = Block(row), {level: dict(zip(part["shard"].tolist(), part["payload"].tolist())) for level, part in told.groupby("level")}
        block.learn_words(by_level.get(1, {}))
        block.runs(order, gram_shards, hot)
        return block, by_level

    def ask_grams(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.to_dict("records"):
            out += [(row["block"], s, p) for s, p in replay(row, right)[0].gram_queries()]
        return pd.DataFrame(out, columns=["block", "shard", "payload"])

    shared = f"{shared_dir(spark)}/tries-{uuid.uuid4().hex}"
    folder = model or _local(shared)

    def told_grams(group: pd.DataFrame) -> pd.DataFrame:
        shard, asked = asked_of(group)
        return pd.DataFrame(list(answer_grams(shard, asked, order, train_tokens, types, folder, model is not None)), columns=columns)

    asked = slim.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(ask_grams, "block long, shard long, payload binary")
    grams = asked.repartition(gram_shards, "shard").groupBy("shard").applyInPandas(told_grams, ANSWER)

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.to_dict("records"):
            block, by_level = replay(row, right)
            base = (block.count[block.tokens] + 1) / (train_tokens + types + 1)
            chance = block.chances(by_level.get(2, {}), base)
            known_tokens = (block.count[block.tokens] > 0).astype(np.int64)
            sums = [np.add.reduceat(v, block.starts) for v in (known_tokens, np.log10(base), np.log10(chance))]
            ids = pd.array([None if i is None or i != i else int(i) for i in block.ids], dtype="Int64")
            out.append(pd.DataFrame({"doc_id": ids, "held_out": ~np.asarray(row["learns"], bool), "n_tokens": block.ends - block.starts, "n_known": sums[0], "train_tokens": train_tokens, "base_score": sums[1], "score": sums[2]}))
        return pd.concat(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = told.unionByName(grams.select("block", F.lit(2).alias("level"), "shard", "payload"))
    scored = stage(slim.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, schema), "scores")
    if model is None:
        remove(spark, shared)
    return scored
