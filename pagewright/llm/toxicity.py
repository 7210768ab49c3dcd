"""Toxicity: a convolutional text classifier trained in numpy.

Each word has three hashed embeddings side by side (tables of 2^16 rows): two of the word, so that two words
are confused only if both hashes agree, and one of its first bytes, which inflected forms share. Punctuation
around a word does not count. Filters of several widths slide over the whole text, are max-pooled, and a
logistic layer gives the score. Only words enter the score.

Every labelled row is learnt from, whole, where it lies: the rows are dealt into shards, in each round every shard
goes on from the common net for one epoch, and the net moves by the mean of the shards' moves, rows counting alike
(embeddings: the shards that moved them). Two more nets each leave out one half of the texts; every labelled row is
scored by the net that has not seen it, and thresholds by language follow from all these scores; ``predicted`` is
always score >= 0.5.

A fitted net scores with whole numbers: embeddings are rounded to steps in +-EMBED_STEPS, filters to steps in
+-FILTER_STEPS. Every sum of a filter is then an integer below 2^24, which float32 adds without rounding, so a
text's score depends neither on the texts it is scored with nor on the machine's order of summation.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.words import words_of
from pagewright.plans.staging import discard, stage

TABLE, PART, TABLES, WIDTHS, FILTERS, STEM = 1 << 16, 8, 3, (1, 2, 3), 8, 5
PUNCTUATION = string.punctuation.encode()
#: Words of a piece of a text at most, words scored at once (that caches hold), and words whose hashes a worker remembers.
CHUNK, TOGETHER, MEMO = 1 << 16, 1 << 13, 200_000
#: Bytes of texts hashed at once, and of a text hashed at once at most.
HASHED, LONG = 1 << 16, 1 << 20
GAP = max(WIDTHS) - 1
#: Rows and words of a shard, on average at most; steps by which scores are counted when thresholds are set.
SHARD_ROWS, SHARD_WORDS, SCORE_STEPS = 4096, 1 << 21, 1 << 16
#: Messages of moves that a task sums at once; rows of the tables in a row of a message; pieces, sent one by one, in which the driver gets a mean.
MEET, BLOCK, PIECES = 8, 4096, 8
#: Largest whole numbers of embeddings and filters; their products over the widest filter stay below 2^24.
EMBED_STEPS, FILTER_STEPS = 511, (1 << 24) // (511 * max(WIDTHS) * TABLES * PART + 1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        bare = word.strip(PUNCTUATION) or word
        found = self[word] = xxhash.xxh32_intdigest(bare, 7) | (xxhash.xxh32_intdigest(bare[:STEM], 8) & TABLE - 1) << 32
        return found


def hashed(memo: WordHashes, text: str | None) -> np.ndarray:
    words = words_of(text, lower=True)
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def hashed_all(memo: WordHashes, texts: Iterable[str | None]) -> list[np.ndarray]:
    """``hashed`` of each text; words of texts that are not long are hashed together."""
    out, run, size = [], [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if run and (size + len(raw) > HASHED or len(raw) > LONG):
            out += _hashed_run(memo, run)
            run, size = [], 0
        if len(raw) > LONG:
            out.append(hashed(memo, text))
        else:
            run.append(raw)
            size += len(raw)
    return out + _hashed_run(memo, run) if run else out


def _between(letters: np.ndarray) -> np.ndarray:
    return (letters == 32) | (letters - np.uint8(9) < 5)


def _points(letters: np.ndarray) -> np.ndarray:
    return np.logical_or.reduce([letters - np.uint8(a) < n for a, n in ((33, 15), (58, 7), (91, 6), (123, 4))])


def _hashed_run(memo: WordHashes, run: list[bytes]) -> list[np.ndarray]:
    """Of texts put one after the other; words of 16 bytes and more are hashed one by one."""
    raw = b" ".join([b"", *run, b"   "]).lower()
    letters = np.frombuffer(raw, np.uint8)
    between = _between(letters)
    edges = np.flatnonzero(between[1:] != between[:-1]) + 1
    starts, stops = edges[::2].copy(), edges[1::2].copy()
    ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in run])[:-1])
    points = _points(letters)
    pointed = np.flatnonzero(points[starts] | points[stops - 1])
    if len(pointed):
        bare = np.flatnonzero(~(points | between))
        bounds = np.concatenate([[-1], bare, [len(raw)]])  # position of bare letter i is at i + 1
        left = bounds[np.searchsorted(bare, starts[pointed]) + 1]
        right = bounds[np.searchsorted(bare, stops[pointed])] + 1
        some = left < stops[pointed]  # words of nothing else keep their punctuation
        starts[pointed[some]], stops[pointed[some]] = left[some], right[some]
    sizes = stops - starts
    fours = np.ndarray(len(raw) - 3, "<u4", raw, strides=(1,)).astype(np.uint32)
    found = short_xxh32(fours, starts, np.minimum(sizes, STEM), 8).astype(np.int64) << 32 & (TABLE - 1) << 32
    found |= short_xxh32(fours, starts, np.minimum(sizes, 15), 7)
    for k in np.flatnonzero(sizes > 15).tolist():
        found[k] = memo[raw[starts[k] : stops[k]]]
    return np.split(found, ends)


def short_xxh32(fours: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """XXH32 of runs of fewer than 16 bytes; ``fours``: at each byte, this and the next three as a number, lowest first."""
    one, two, three, four, five = map(np.uint32, (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    h = (sizes + (seed + int(five))).astype(np.uint32)
    for k in range(3):
        g = h + fours.take(starts + 4 * k, mode="clip") * three
        h = np.where(sizes >= 4 * k + 4, (g << 17 | g >> 15) * four, h)
    tails, rest = starts + (sizes & ~3), sizes & 3
    for k in range(3):
        g = h + (fours.take(tails + k, mode="clip") & 255) * five
        h = np.where(rest > k, (g << 11 | g >> 21) * one, h)
    h = (h ^ h >> 15) * two
    h = (h ^ h >> 13) * three
    return h ^ h >> 16


@dataclass
class ConvNet:
    seed: int = 11
    tables: np.ndarray = field(init=False)
    filters: list[np.ndarray] = field(init=False)
    bias: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)
    offset: float = field(init=False, default=0.0)

    def __post_init__(self):
        draw = np.random.default_rng(self.seed)
        n = FILTERS * len(WIDTHS)
        # the last row of each table stands for the gap between texts and stays zero
        self.tables = np.stack([np.vstack([draw.normal(0, 0.1, (TABLE, PART)), np.zeros((1, PART))]).astype(np.float32) for _ in range(TABLES)])
        self.filters = [draw.normal(0, 0.3 / np.sqrt(w), (w * TABLES * PART, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias, self.weight = np.zeros(n, np.float32), draw.normal(0, 0.3, n).astype(np.float32)

    @cached_property
    def whole(self) -> tuple[np.ndarray, float, list[np.ndarray], list[np.ndarray]]:
        """(tables and their step, filters and their steps by filter) in whole numbers; made once, after fitting."""
        step = max(float(max(np.abs(t).max() for t in self.tables)), 1e-30) / EMBED_STEPS
        steps = [np.maximum(np.abs(f).max(axis=0), 1e-30).astype(np.float64) / FILTER_STEPS for f in self.filters]
        return np.rint(self.tables / step).astype(np.float32), step, [np.rint(f / s).astype(np.float32) for f, s in zip(self.filters, steps)], steps

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "whole"}

    def _embed(self, docs: list[np.ndarray], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by word of the tables put one after the other, and embeddings of the texts in a row with gaps, and where each text begins."""
        sizes = np.array([len(d) for d in docs]) + GAP + 1
        stops = np.cumsum(sizes)
        gap = np.zeros(GAP + 1, np.int64)
        words = np.concatenate([p for d in docs for p in (d, gap)] + [gap[:GAP]])
        rows = np.stack([words >> 16 * k & TABLE - 1 for k in range(TABLES)], axis=1)
        rows[(stops[:, None] - np.arange(1, GAP + 2)).ravel()] = TABLE
        rows[len(rows) - GAP :] = TABLE
        rows += np.arange(TABLES) * (TABLE + 1)
        x = np.asarray(tables).reshape(-1, PART).take(rows, axis=0, mode="clip")
        return rows, x.reshape(len(rows), -1), stops - sizes

    @staticmethod
    def _all_responses(x: np.ndarray, filters: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
        """Of each filter, by window; those that begin in a gap and could reach the next text respond like a bare gap."""
        n, deep = len(x) - GAP, x.shape[1]
        # one product for all filters at all places within a window
        parts = np.concatenate([f.reshape(-1, deep, FILTERS).transpose(0, 2, 1).reshape(-1, deep) for f in filters]) @ x.T
        out, at = np.empty((FILTERS * len(filters), n), parts.dtype), 0
        for k, f in enumerate(filters):
            own = out[k * FILTERS : (k + 1) * FILTERS]
            own[...] = parts[at : at + FILTERS, :n]
            for o in range(1, len(f) // deep):
                own += parts[at + o * FILTERS : at + (o + 1) * FILTERS, o : n + o]
            at += len(f) // deep * FILTERS
        stops = np.append(starts[1:], n)
        for k in range(1, GAP + 1):
            out[:, stops - k] = 0
        return out

    def _responses(self, x: np.ndarray, w: int, kernel: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each window of ``w`` words, by filter."""
        return self._all_responses(x, [kernel], starts).T

    def features(self, docs: list[np.ndarray]) -> np.ndarray:
        """Max-pooled responses by text, in double precision; texts longer than a chunk go in overlapping pieces."""
        tables, step, filters, steps = self.whole
        scale = np.concatenate(steps) * step
        pieces, owner, cut = [], [], []
        for i, d in enumerate(docs):
            for s in range(0, max(len(d), 1), CHUNK):
                pieces.append(d[s : s + CHUNK + GAP])
                owner.append(i)
                cut.append(s + CHUNK < len(d))
        out = np.zeros((len(docs), len(self.bias)))
        first = 0
        while first < len(pieces):
            last, total = first + 1, len(pieces[first])
            while last < len(pieces) and total + len(pieces[last]) <= TOGETHER:
                total += len(pieces[last])
                last += 1
            _, x, starts = self._embed(pieces[first:last], tables)
            answers = self._all_responses(x, filters, starts)
            for k in np.flatnonzero(cut[first:last]):  # windows past the cut belong to the next piece
                answers[:, starts[k] + CHUNK : starts[k] + len(pieces[first + k])] = 0
            pooled = np.maximum.reduceat(answers, starts, axis=1).T
            np.maximum.at(out, owner[first:last], np.maximum(pooled * scale + self.bias, 0))
            first = last
        return out

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        z = np.full(len(docs), float(self.offset))
        for value, weight in zip(self.features(docs).T, self.weight.tolist()):  # in one order, whatever the batch
            z += value * weight
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def _pooled(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the tables and embeddings by word; by text and filter: places of the best windows, their responses, whether they begin before the gap)."""
        if len(docs) == 1 and len(docs[0]) > CHUNK:
            return self._pooled_long(docs[0])
        rows, x, starts = self._embed(docs, self.tables)
        r = self._all_responses(x, self.filters, starts)
        stops = np.append(starts[1:], r.shape[1])
        best = np.stack([s + r[:, s:e].argmax(axis=1) for s, e in zip(starts.tolist(), stops.tolist())])
        return rows, x, best, r[np.arange(len(r)), best], best < (stops - GAP)[:, None]

    def _pooled_long(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one text in overlapping pieces; rows and embeddings are those of its best windows only."""
        n = len(doc)
        best, value = np.zeros(len(self.bias), np.int64), np.full(len(self.bias), -np.inf, self.bias.dtype)
        for s in range(0, n, CHUNK):
            _, x, starts = self._embed([doc[s : s + CHUNK + GAP]], self.tables)
            r = self._all_responses(x, self.filters, starts)
            r = r[:, :CHUNK] if s + CHUNK < n else r  # windows past the cut belong to the next piece
            p = r.argmax(axis=1)
            told = r[np.arange(len(r)), p]
            better = told > value
            best[better], value[better] = s + p[better], told[better]
        need = np.unique(best[:, None] + np.arange(GAP + 1))
        rows = np.stack([np.where(need < n, doc[np.minimum(need, n - 1)] >> 16 * k & TABLE - 1, TABLE) + k * (TABLE + 1) for k in range(TABLES)], axis=1)
        x = np.asarray(self.tables).reshape(-1, PART).take(rows, axis=0).reshape(len(rows), -1)
        return rows, x, np.searchsorted(need, best)[None], value[None], (best < n + 1)[None]

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray, share: np.ndarray) -> tuple[list[np.ndarray], float, np.ndarray, np.ndarray]:
        """Of the mean weighted logistic loss: (filters, bias and weight; offset; by table, ids of the words that it reaches; embeddings at those ids).

        A word that several best windows hold comes as often.
        """
        deep = TABLES * PART
        rows, x, best, value, live = self._pooled(docs)
        pooled = value + self.bias
        feats = np.maximum(pooled, 0)
        z = feats @ self.weight + self.offset
        err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * share / len(docs)).astype(x.dtype)
        back = err[:, None] * self.weight * (pooled > 0)
        # a best window in the gap responds like a bare gap, whatever follows it
        reach = back * live
        grads, at, dx = [], [], []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            g, spans = reach[:, own], best[:, own] + np.arange(w)[:, None, None]
            grads.append(np.einsum("bf,obfd->odf", g, x[spans]).reshape(w * deep, FILTERS))
            text, kind = np.nonzero(g)
            at.append(spans[:, text, kind].ravel())
            dx.append((f.reshape(w, deep, FILTERS).transpose(0, 2, 1)[:, kind] * g[text, kind][:, None]).reshape(-1, deep))
        grads += [back.sum(axis=0), err @ feats]
        ids = rows[np.concatenate(at)] - np.arange(TABLES) * (TABLE + 1)
        return grads, float(err.sum()), ids.T, np.concatenate(dx)

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.05, sums: Sums | None = None, counts: tuple[int, int] | None = None, seed: int | None = None) -> ConvNet:
        """AdaGrad on the logistic loss; classes count alike. Gradients reach a filter's best window of each text.

        ``sums``: to go on from; ``counts``: rows of class 0 and 1, if these are part of more; ``seed`` of the order of rows.
        """
        draw = np.random.default_rng(self.seed if seed is None else seed)
        none, some = counts or ((labels == 0).sum(), (labels == 1).sum())
        share = np.where(labels == 1, 0.5 / max(1, some), 0.5 / max(1, none)) * (none + some)
        dense, sums = [*self.filters, self.bias, self.weight], sums or Sums.of(self)
        rows, squares = self.tables.reshape(-1, PART), sums.tables.reshape(-1, 1)
        for _ in range(epochs):
            order = draw.permutation(len(docs))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                grads, total, hits = None, 0.0, []
                for part in in_chunks(pick, docs):
                    part_grads, part_total, ids, dx = self.gradients([docs[i] for i in part], labels[part], share[part])
                    weigh = len(part) / len(pick)
                    grads = [g * weigh for g in part_grads] if grads is None else [a + g * weigh for a, g in zip(grads, part_grads)]
                    total += part_total * weigh
                    hits.append((ids, dx * dx.dtype.type(weigh)))
                grads[-1] += 1e-4 * self.weight
                for value, square, grad in zip(dense, sums.dense, grads):
                    square += grad**2
                    value -= rate * grad / np.sqrt(square)
                sums.offset += total**2
                self.offset -= rate * total / sums.offset**0.5
                ids = np.concatenate([i for i, _ in hits], axis=1)
                moved = np.concatenate([dx for _, dx in hits]).reshape(-1, TABLES, PART).transpose(1, 0, 2)
                learns = ids < TABLE
                hit, g = summed((ids + np.arange(TABLES)[:, None] * (TABLE + 1))[learns], moved[learns])
                squares[hit] += (g**2).mean(axis=1, keepdims=True)
                rows[hit] -= rate * g / np.sqrt(squares[hit])
        self.__dict__.pop("whole", None)
        return self


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``keys`` in order, and for each the sum of its rows of ``values``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(values[order], first, axis=0) if len(first) else values


def in_chunks(pick: np.ndarray, docs: list[np.ndarray]) -> Iterator[np.ndarray]:
    """``pick`` in runs of at most a chunk of words; a longer text comes alone."""
    first, total = 0, 0
    for k, i in enumerate(pick):
        if k > first and total + len(docs[i]) > CHUNK:
            yield pick[first:k]
            first, total = k, 0
        total += len(docs[i])
    if first < len(pick):
        yield pick[first:]


@dataclass
class Sums:
    """AdaGrad's sums of squares: of filters, bias and weight; of the rows of each table; of the offset."""
    dense: list[np.ndarray]
    tables: np.ndarray
    offset: float = 1e-3

    @classmethod
    def of(cls, net: ConvNet) -> Sums:
        return cls([np.full_like(p, 1e-3) for p in (*net.filters, net.bias, net.weight)], np.full((TABLES, TABLE + 1, 1), 1e-3, np.float32))


def flat(net: ConvNet, sums: Sums) -> tuple[np.ndarray, np.ndarray]:
    """(all that is not a table, in double precision; the tables' rows one after the other, each with its sum)."""
    dense = [*net.filters, net.bias, net.weight, *sums.dense, np.array([net.offset, sums.offset])]
    return np.concatenate([p.ravel().astype(np.float64) for p in dense]), np.concatenate([net.tables, sums.tables], axis=2).reshape(-1, PART + 1)


def unflat(dense: np.ndarray, rows: np.ndarray) -> tuple[ConvNet, Sums]:
    net, n = ConvNet.__new__(ConvNet), FILTERS * len(WIDTHS)
    net.seed, net.filters = ConvNet.seed, [np.empty((w * TABLES * PART, FILTERS), np.float32) for w in WIDTHS]
    net.bias, net.weight = np.empty(n, np.float32), np.empty(n, np.float32)
    sums, at = Sums([np.empty_like(p) for p in (*net.filters, net.bias, net.weight)], np.empty(0)), 0
    for p in (*net.filters, net.bias, net.weight, *sums.dense):
        p[...] = dense[at : at + p.size].reshape(p.shape)
        at += p.size
    net.offset, sums.offset = float(dense[at]), float(dense[at + 1])
    parts = rows.reshape(TABLES, TABLE + 1, PART + 1)
    net.tables, sums.tables = parts[..., :PART].astype(np.float32, order="C"), parts[..., PART:].astype(np.float32, order="C")
    return net, sums


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document that has a label: deal and half (by its hash), toxic, lang, words, ids (hashes of all its words, as bytes)."""
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    # always by exchange: as many rows may have labels as there are documents
    chosen = docs.select("doc_id", "text", lang.alias("lang")).join(marks.hint("merge"), "doc_id")
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    chosen = chosen.select(F.xxhash64("doc_id", "text").alias("deal"), half.alias("half"), "toxic", "lang", "text")

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = hashed_all(memo, (t.as_py() for t in part.column("text")))
                told = [pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *told], ["deal", "half", "toxic", "lang", "words", "ids"])

    return chosen.mapInArrow(prepare, "deal long, half int, toxic int, lang string, words long, ids binary")


def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """(shard, words, toxic, half) of each run of rows of one shard, in order of ``deal``."""
    kept, last = [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "deal", "toxic", "half")]
        for shard, deal, toxic, half, ids in zip(*columns, batch.column("ids")):
            if kept and shard != last:
                yield _in_order(last, kept)
                kept = []
            last = shard
            kept.append((deal, toxic, half, np.frombuffer(ids.as_py(), np.int64)))
    if kept:
        yield _in_order(last, kept)


def _in_order(shard: int, kept: list) -> tuple[int, list[np.ndarray], np.ndarray, np.ndarray]:
    kept.sort(key=lambda r: r[0])
    return shard, [r[3] for r in kept], np.array([r[1] for r in kept], np.int64), np.array([r[2] for r in kept], np.int64)


Total = tuple[float, np.ndarray, np.ndarray, np.ndarray]
MOVES = "net int, block int, n double, at binary, touched binary, moved binary"


def messages(totals: dict[int, Total]) -> Iterator[pa.RecordBatch]:
    """Sums of moves in rows of at most a block of the tables; block -1 holds the rows learnt from and all that is not a table."""
    for k, (n, dense, rows, touched) in totals.items():
        told = [(-1, n, b"", b"", dense.tobytes())]
        for s in range(0, len(rows), BLOCK):
            at = s + np.flatnonzero(touched[s : s + BLOCK])
            if len(at):
                told.append((s // BLOCK, 0.0, at.astype(np.int32).tobytes(), touched[at].tobytes(), rows[at].astype(np.float32).tobytes()))
        for block, *values in told:
            kinds = (pa.float64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([block], pa.int32()), *[pa.array([v], kind) for v, kind in zip(values, kinds)]], ["net", "block", "n", "at", "touched", "moved"])


def met(batches: Iterator[pa.RecordBatch]) -> dict[int, Total]:
    """Sums of moves over ``messages``, by net: (rows learnt from, all that is not a table, the tables' rows, rows that touched each of these)."""
    totals = {}
    for batch in batches:
        for row in range(batch.num_rows):
            k, block, n, at, touched, moved = (c[row].as_py() for c in batch.columns)
            so_far, dense, rows, seen = totals.get(k) or (0.0, 0.0, np.zeros((TABLES * (TABLE + 1), PART + 1)), np.zeros(TABLES * (TABLE + 1)))
            if block < 0:
                totals[k] = so_far + n, dense + np.frombuffer(moved), rows, seen
            else:
                at = np.frombuffer(at, np.int32)
                rows[at] += np.frombuffer(moved, np.float32).reshape(-1, PART + 1)
                seen[at] += np.frombuffer(touched)
                totals[k] = so_far, dense, rows, seen
    return totals


def train_nets(shards: DataFrame, counts: list[tuple[int, int]], n_shards: int, epochs: int = 8) -> list[ConvNet]:
    """Nets that learn from the rows outside half 0, outside half 1, and from all; ``counts``: rows of class 0 and 1 of each.

    A net whose rows lack a class stays as drawn. What a task sends is the sum of its shards' moves, at most 10 MB a net.
    Tasks sum these, MEET at a time, until one has the mean: the driver gets moves of one net's size a net, in pieces, however many shards.
    """
    spark = shards.sparkSession
    state = {k: flat(net, Sums.of(net)) for k, net in ((k, ConvNet()) for k in range(len(counts))) if min(counts[k])}
    # a single shard needs no meeting
    for turn, length in enumerate([1] * epochs if n_shards > 1 else [epochs]):
        sent = spark.sparkContext.broadcast(state)

        def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, total = sent.value, {}
            for shard, docs, toxic, half in shards_of(batches):
                for k, (dense, rows) in start.items():
                    seen = np.flatnonzero(half != k)
                    if len(seen):
                        net, sums = unflat(dense, rows)
                        net.fit([docs[i] for i in seen], toxic[seen], length, sums=sums, counts=counts[k], seed=(turn << 40) + shard)
                        ended, moved = flat(net, sums)
                        at = np.flatnonzero((moved != rows).any(axis=1))
                        n, d, r, touched = total.get(k, (0, 0.0, np.zeros(rows.shape), np.zeros(len(rows))))
                        r[at] += len(seen) * (moved[at].astype(np.float64) - rows[at])
                        touched[at] += len(seen)
                        total[k] = n + len(seen), d + len(seen) * (ended - dense), r, touched
            yield from messages(total)

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from messages({k: (n, d / n, r / np.maximum(touched, 1)[:, None], touched) for k, (n, d, r, touched) in met(batches).items()})

        told, files = stage(shards.mapInArrow(moves, MOVES), "moves", "uncompressed"), n_shards
        # counted by files that were written: a reader may split each into many parts, all but one of them empty
        while files > MEET:
            files = -(-files // MEET)
            fewer = stage(told.coalesce(files).mapInArrow(lambda batches: messages(met(batches)), MOVES), "moves", "uncompressed")
            discard(told)
            told = fewer
        pieces = told.coalesce(1).mapInArrow(mean, MOVES).select("net", "block", "at", "moved").repartition(PIECES)
        for row in pieces.toLocalIterator():
            dense, rows = state[row["net"]]
            if row["block"] < 0:
                dense += np.frombuffer(row["moved"])
            else:
                rows[np.frombuffer(row["at"], np.int32)] += np.frombuffer(row["moved"], np.float32).reshape(-1, PART + 1)
        discard(told)
        sent.destroy()
    return [unflat(*state[k])[0] if k in state else ConvNet() for k in range(len(counts))]


def unseen_scores(shards: DataFrame, nets: list[ConvNet]) -> DataFrame:
    """(lang, toxic, step, n): of all rows, counted by step of the score that the net without the row's half gives."""
    sent = shards.sparkSession.sparkContext.broadcast(nets)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                half, out = part.column("half").to_numpy(), np.zeros(part.num_rows)
                for k in (0, 1):
                    own = np.flatnonzero(half == k)
                    out[own] = sent.value[k].scores([np.frombuffer(part.column("ids")[i].as_py(), np.int64) for i in own.tolist()])
                steps = np.minimum((out * SCORE_STEPS).astype(np.int32), SCORE_STEPS - 1)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("toxic"), pa.array(steps)], ["lang", "toxic", "step"])

    told = shards.select("half", "toxic", "lang", "ids").mapInArrow(score, "lang string, toxic int, step int")
    return told.groupBy("lang", "toxic", "step").agg(F.count("*").alias("n"))


@dataclass
class ToxicityModel:
    net: ConvNet
    thresholds: dict[str | None, float]

    @classmethod
    def train(cls, docs: DataFrame, labels: DataFrame) -> ToxicityModel:
        """Fit on every labelled row and calibrate thresholds by language on every labelled row.

        Without labels of both classes the net stays as drawn; where a half lacks one, the thresholds are 0.5.
        """
        rows = stage(labelled_rows(docs, labels), "labelled")
        try:
            found = {(r["half"], r["toxic"]): r for r in rows.groupBy("half", "toxic").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
            n = lambda half, toxic: found[half, toxic]["n"] if (half, toxic) in found else 0
            of_half = [(n(k, 0), n(k, 1)) for k in (0, 1)]
            counts = [of_half[1], of_half[0], tuple(map(sum, zip(*of_half)))]
            if not min(counts[2]):
                return cls(ConvNet(), {})
            n_shards = max(-(-sum(counts[2]) // SHARD_ROWS), -(-sum(r["words"] for r in found.values()) // SHARD_WORDS))
            dealt = rows.withColumn("shard", F.pmod("deal", F.lit(n_shards)).cast("int"))
            shards = stage(dealt.repartitionById(n_shards, "shard").sortWithinPartitions("shard", "deal"), "shards")
        finally:
            discard(rows)
        try:
            nets = train_nets(shards, counts, n_shards)
            lines = {}
            if all(map(min, counts)):
                told = unseen_scores(shards, nets[:2]).toPandas()
                for lang, own in told.groupby("lang"):
                    lines[lang] = best_threshold(own["step"].to_numpy() / SCORE_STEPS, own["toxic"].to_numpy(), counts=own["n"].to_numpy(), step=1 / SCORE_STEPS)
        finally:
            discard(shards)
        return cls(nets[2], lines)


def best_threshold(scores: np.ndarray, labels: np.ndarray, least: int = 5, counts: np.ndarray | None = None, step: float = 0.0) -> float:
    """The middle of the gap that gives the best F1; 0.5 with fewer than ``least`` rows of either class.

    ``counts``: rows that each entry stands for; their scores lie less than ``step`` above.
    """
    n = np.ones(len(scores), np.int64) if counts is None else counts
    positives = n[labels == 1].sum()
    if positives < least or n[labels == 0].sum() < least:
        return 0.5
    order = np.argsort(-scores, kind="stable")
    scores = scores[order]
    f1 = 2 * np.cumsum(n[order] * (labels[order] == 1)) / (np.cumsum(n[order]) + positives)
    f1[:-1][scores[:-1] == scores[1:]] = -1  # equal scores fall on one side
    k = int(f1.argmax())
    below = scores[k + 1] + step if k + 1 < len(scores) else 0.0
    return float((scores[k] + below) / 2)


def score_documents(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """One row per row: doc_id, score (0 to 1), predicted (score >= 0.5), flagged (score >= its language's threshold).

    Texts are read whole; null and empty texts get the score of a text without words. Languages that were not
    calibrated, and null, use 0.5. Ids may repeat or be null; repeated texts score alike. An empty table gives
    no rows. The model has a fixed size (about 6 MB).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = WordHashes(), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = known.net.scores(hashed_all(memo, (t.as_py() for t in part.column("text"))))
                lines = np.array([known.thresholds.get(x or "", 0.5) for x in part.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(scores >= lines)], ["doc_id", "score", "predicted", "flagged"])

    language = F.col(lang) if lang else F.lit(None)
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), language.cast("string").alias("lang"))
    return chosen.mapInArrow(score, "doc_id long, score double, predicted int, flagged boolean")


def drop_flagged(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` (text, lang and any more) that are not flagged; each row by its own score, whatever its id."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, known = WordHashes(), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                scores = known.net.scores(hashed_all(memo, (t.as_py() for t in part.column("text"))))
                lines = np.array([known.thresholds.get(x or "", 0.5) for x in part.column("lang").to_pylist()])
                yield part.filter(pa.array(~(scores >= lines)))

    return docs.mapInArrow(keep, docs.schema)
