"""SimHash near-duplicates: a binary trie self-join over fingerprints.

Equal fingerprints are one class. The trie is cut at its top into units that share a run of leading bits.
With a small error budget the bits are rotated so that each of budget + 1 blocks leads once; two
fingerprints within the budget agree on some block, so no link is lost. With a large budget the leading
bits are drawn at random, in as many views as the wanted recall needs. In a unit, pairs of trie nodes are
traversed together: differing bits accumulate, and a pair of nodes is pruned when they exceed the budget.
A unit returns a spanning forest of its links, at most one row per member, however dense it is. Crowded
units are split into tiles, each pair of which is a unit.

``near_groups`` links by exact similarity of shingle sets: components of fingerprints within a wide budget
are candidates, and every pair inside a component is compared by its shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.components import connected_components, local_roots
from pagewright.llm.words import words_of
from pagewright.plans.staging import cleaned, stage

#: Members of a unit beyond which it is split into tiles.
CROWD = 4096
#: Node pairs with so few leaf pairs are compared directly; leaf pairs compared at once; node pairs advanced at once.
LEAF, LEAF_PAIRS, FRONT = 64, 1 << 19, 1 << 17
#: Exact blocks are used for budgets up to this one.
SMALL_BUDGET = 7
#: Shingles in a tile of a component of candidates.
SHINGLES = 1 << 21
#: Largest chance that a bit differs between fingerprints of two shingle sets of similarity 0.8 (sets of 4 and 5).
DIFFER = 0.1875
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` words joined by spaces; fewer words: of them all; none: empty."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    cuts = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    return np.fromiter((xxhash.xxh64_intdigest(line[s:e], 42) for s, e in cuts), np.uint64, len(words) - size + 1)


def widen(hashes: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Further 64-bit lanes from a shingle's hash."""
    out = [hashes]
    for k in range(1, lanes):
        z = hashes + np.uint64((MIX[0] * k) & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[2])
        out.append(z ^ (z >> np.uint64(31)))
    return out


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; none: zero."""
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    if len(hashes) < 400:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(docs: DataFrame, shingle: int, lanes: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f0, f1, ...) per row; texts are lower-cased A-Z and taken whole; null text is empty."""
    names = [f"f{k}" for k in range(lanes)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column("text"):
                hashes = shingle_hashes(words_of(t.as_py(), lower=True), shingle)
                found.append([majority(lane) for lane in widen(hashes, lanes)])
            lanes_of = np.array(found, np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(lanes_of[:, k]) for k in range(lanes))], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(make, schema)


@dataclass(frozen=True)
class View:
    order: tuple[int, ...]  # the bits, leading ones first
    lead: int  # how many lead


def plan_views(width: int, budget: int, members: int, recall: float = 0.98, differ: float | None = None) -> list[View]:
    """Exact blocks for a small budget; else random leading bits, in views enough for the recall.

    The recall is that of a pair at the budget or, with ``differ``, of a pair whose bits differ with that
    chance each. Bits are drawn without replacement.
    """
    if budget <= SMALL_BUDGET:
        cuts = [width * k // (budget + 1) for k in range(budget + 2)]
        return [View(tuple(range(s, width)) + tuple(range(s)), e - s) for s, e in zip(cuts, cuts[1:])]
    lead = max(8, math.ceil(math.log2(max(members, 2))) - (5 if differ is None else 8))
    agree = np.array([math.comb(width - d, lead) / math.comb(width, lead) for d in range(budget + 1)])
    if differ is None:
        chance = np.eye(budget + 1)[budget]
    else:
        chance = np.array([math.comb(width, d) * differ**d * (1 - differ) ** (width - d) for d in range(budget + 1)])
        if chance.sum() <= recall:
            raise ValueError("the budget is too small for the recall")
    count = 1
    while chance @ (1 - (1 - agree) ** count) < recall:
        count += 1
    draw = np.random.default_rng(17)
    return [View(tuple(draw.permutation(width).tolist()), lead) for _ in range(count)]


def trie_links(bits: np.ndarray, keys: np.ndarray, pairs: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Roots after linking members within ``budget`` bits, by walking pairs of trie nodes.

    bits: (members, width) 0/1, sorted within every range; keys: the same bits as (members, lanes) uint64.
    pairs: rows (a0, a1, b0, b1) of member ranges that share their first ``depth`` bits; equal ranges are
    joined with themselves, each pair of members once.
    """
    root = np.arange(len(bits))
    ones_at: dict[int, np.ndarray] = {}

    def ones(level: int) -> np.ndarray:
        if level not in ones_at:
            ones_at[level] = np.concatenate([np.zeros(1, np.int32), np.cumsum(bits[:, level], dtype=np.int32)])
        return ones_at[level]

    def compare(nodes: np.ndarray) -> None:
        nonlocal root
        a0, a1, b0, b1 = nodes[:, :4].T
        size = (a1 - a0) * (b1 - b0)
        stops = np.cumsum(size)
        first = 0
        while first < len(nodes):
            last = max(first + 1, int(np.searchsorted(stops, (stops[first - 1] if first else 0) + LEAF_PAIRS, "right")))
            part = slice(first, last)
            node = np.repeat(np.arange(first, last), size[part])
            k = np.arange(len(node)) - np.repeat(stops[part] - size[part] - (stops[first - 1] if first else 0), size[part])
            wide = (b1 - b0)[node]
            i, j = a0[node] + k // wide, b0[node] + k % wide
            keep = (a0[node] != b0[node]) | (i < j)
            keep &= root[i] != root[j]  # already joined
            i, j = i[keep], j[keep]
            near = np.bitwise_count(keys[i] ^ keys[j]).sum(axis=1, dtype=np.int64) <= budget
            root = local_roots(len(root), i[near], j[near], root)
            first = last

    width = bits.shape[1]
    stack = [(depth, np.column_stack([pairs, np.zeros(len(pairs), np.int64)]))]
    while stack:
        level, nodes = stack.pop()
        if len(nodes) > FRONT:
            stack += [(level, nodes[k : k + FRONT]) for k in range(0, len(nodes), FRONT)]
            continue
        a0, a1, b0, b1, errors = nodes.T
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (level == width)
        if small.any():
            compare(nodes[small])
            nodes = nodes[~small]
            a0, a1, b0, b1, errors = nodes.T
        if not len(nodes):
            continue
        count, own = ones(level), (a0 == b0) & (a1 == b1)
        a_cut, b_cut = a1 - (count[a1] - count[a0]), b1 - (count[b1] - count[b0])
        down = [
            np.column_stack([a0, a_cut, b0, b_cut, errors]),
            np.column_stack([a_cut, a1, b_cut, b1, errors]),
            np.column_stack([a0, a_cut, b_cut, b1, errors + 1]),
            np.column_stack([a_cut, a1, b0, b_cut, errors + 1])[~own],
        ]
        down = np.concatenate(down)
        down = down[(down[:, 0] < down[:, 1]) & (down[:, 2] < down[:, 3]) & (down[:, 4] <= budget)]
        if len(down):
            stack.append((level + 1, down))
    return root


def link_fingerprints(classes: DataFrame, lanes: int, budget: int, recall: float = 0.98, differ: float | None = None) -> DataFrame:
    """(a, b) ids: per unit, a spanning forest of the links between ``classes`` (id, f0, f1, ...)."""
    width, names = 64 * lanes, [f"f{k}" for k in range(lanes)]
    views = plan_views(width, budget, classes.count(), recall, differ)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes_of = np.column_stack([batch.column(n).to_numpy() for n in names]).astype("<i8")
            bits = np.unpackbits(lanes_of.view(np.uint8), axis=1, bitorder="little")
            for v, view in enumerate(views):
                turned = np.packbits(bits[:, list(view.order)], axis=1)
                lead = np.zeros((len(bits), 8), np.uint8)
                head = np.packbits(bits[:, list(view.order[: view.lead])], axis=1)
                lead[:, : head.shape[1]] = head
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bits), v, np.int32)), pa.array(lead.view(">i8").ravel().astype(np.int64)), pa.array([r.tobytes() for r in turned], pa.binary()), batch.column("id")],
                    ["view", "lead", "key", "id"],
                )

    rows = stage(classes.select("id", *names).mapInArrow(spread, "view int, lead long, key binary, id long"), "views")
    crowds = rows.groupBy("view", "lead").agg(F.count("*").alias("n")).where(F.col("n") > 1).withColumn("tiles", F.ceil(F.col("n") / CROWD).cast("int"))
    told = rows.join(crowds, ["view", "lead"]).withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    units = told.withColumn("o", other).select("view", "lead", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "key", "id")
    order = ["view", "lead", "i", "j"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for table in _whole_units(batches, held):
            view, lead, i, j, t = (table.column(n).to_numpy() for n in ("view", "lead", "i", "j", "t"))
            ids = table.column("id").to_numpy()
            raw = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(len(ids), width // 8)
            bits, keys = np.unpackbits(raw, axis=1), raw.copy().view(np.uint64)
            for start, stop in _runs(view):
                cuts = np.flatnonzero(np.concatenate([[True], (np.diff(lead[start:stop]) != 0) | (np.diff(i[start:stop]) != 0) | (np.diff(j[start:stop]) != 0), [True]]))
                low, high = cuts[:-1], cuts[1:]
                turn = np.concatenate([[0], np.cumsum(np.diff(t[start:stop]) != 0)])
                # where the second tile's members begin, in units of two tiles
                middle = np.searchsorted(turn, turn[low], "right")
                own = i[start + low] == j[start + low]
                middle = np.where(own, low, np.minimum(middle, high))
                pairs = np.column_stack([low, np.where(own, high, middle), middle, high])
                pairs = pairs[pairs[:, 2] < pairs[:, 3]]
                root = trie_links(bits[start:stop], keys[start:stop], pairs, views[view[start]].lead, budget)
                met = np.flatnonzero(root != np.arange(stop - start))
                yield pa.RecordBatch.from_arrays([pa.array(ids[start + met]), pa.array(ids[start + root[met]])], ["a", "b"])

    return units.repartition(*order).sortWithinPartitions(*order, "t", "key").mapInArrow(join, "a long, b long")


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, int)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))


def _whole_units(batches: Iterator[pa.RecordBatch], held: list[pa.RecordBatch], rows: int = 25_000) -> Iterator[pa.Table]:
    """Tables of whole units from sorted batches; a unit is bounded, so what is held is."""
    count = 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = [table.column(n)[-1].as_py() for n in ("view", "lead", "i", "j")]
            same = np.ones(table.num_rows, bool)
            for n, value in zip(("view", "lead", "i", "j"), last):
                same &= table.column(n).to_numpy() == value
            cut = table.num_rows - int(same.sum())
            if cut:
                yield table.slice(0, cut)
                held[:] = table.slice(cut).to_batches()
                count = table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


@cleaned
def simhash_groups(docs: DataFrame, shingle: int = 5, lanes: int = 4, budget: int = 38, recall: float = 0.98, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f0, ..., component_id) of each row of ``docs``; component_id is the smallest doc_id reachable.

    Documents without words have fingerprint zero and link like any other. Rows that repeat an id keep their
    own fingerprints and join their components. A row without an id takes the component of its fingerprint,
    or null, and links nothing. Ties and row order do not matter; an empty table gives no rows.
    """
    names = [f"f{k}" for k in range(lanes)]
    prints = stage(fingerprints(docs, shingle, lanes, doc_id, text), "prints")
    classes = prints.where("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("id"))
    classes = stage(classes, "classes")
    links = link_fingerprints(classes, lanes, budget, recall)
    # one id may have several fingerprints (repeated ids): they are one node
    again = prints.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    shared = prints.join(again, "doc_id").join(classes.select(*names, "id"), names).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    component = connected_components(links.unionByName(shared), "a", "b").withColumnRenamed("node", "id")
    known = classes.join(component, "id", "left").select(*[F.col(n).alias("k_" + n) for n in names], F.coalesce("component", "id").alias("component_id"))
    match = [prints[n] == F.col("k_" + n) for n in names]
    return prints.join(known, match, "left").select("doc_id", *names, "component_id")


def shingle_sets(docs: DataFrame, shingle: int, lanes: int = 0) -> DataFrame:
    """(doc_id, cid, n, f0, f1, ...) per row: digest, size and fingerprint of its set of shingles; without lanes, the set as ``members`` instead."""
    names = [f"f{k}" for k in range(lanes)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(words_of(t.as_py(), lower=True), shingle)) for t in batch.column("text")]
            cids = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            columns = [batch.column("doc_id"), pa.array(cids), pa.array(np.array([len(s) for s in sets], np.int64))]
            if lanes:
                found = np.array([[majority(lane) for lane in widen(s, lanes)] for s in sets], np.int64).reshape(-1, lanes)
                columns += [pa.array(found[:, k]) for k in range(lanes)]
            else:
                columns.append(pa.array([s.tobytes() for s in sets], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "cid", "n", *(names or ["members"])])

    schema = "doc_id long, cid long, n long, " + (", ".join(f"{n} long" for n in names) or "members binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, schema)


def similar_roots(sets: list[np.ndarray], similarity: float, own: np.ndarray) -> np.ndarray:
    """Roots after linking non-empty sets of at least that Jaccard similarity; if ``own`` has both values, only pairs across it are compared.

    Two such sets share one of the rarest shingles of each (as many as a set may lack, and one more), so only
    those are looked up: a passage that many texts hold brings none of them together. What is found that way is
    compared in full, unless it is linked already. Sets of the largest group need not ask: whoever could link to
    it from outside does.
    """
    root, sizes = np.arange(len(sets)), np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2:
        return root
    owner, starts = np.repeat(np.arange(len(sets)), sizes), np.cumsum(sizes) - sizes
    _, name, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    ranked = name[np.lexsort((name, count[name], owner))]  # each set's shingles, the rarest first
    rare = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    first = np.arange(len(ranked)) - starts[owner] < rare[owner]
    by_name = np.argsort(ranked[first], kind="stable")
    holder, opens = owner[first][by_name], np.searchsorted(ranked[first][by_name], np.arange(len(count) + 1))
    across, mine, done = own.any() and not own.all(), np.zeros(len(count), bool), np.zeros(len(sets), bool)
    order = np.argsort(-np.add.reduceat(count[name], starts) / sizes, kind="stable")  # those that share most, first

    def spans(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.arange(length.sum()) + np.repeat(begin - np.cumsum(length) + length, length)

    def ask(i: int) -> None:
        nonlocal root
        keys = ranked[starts[i] : starts[i] + rare[i]]
        found = np.unique(holder[spans(opens[keys], opens[keys + 1] - opens[keys])])
        found = found[(root[found] != root[i]) & (sizes[found] >= similarity * sizes[i] - 1e-9) & (sizes[i] >= similarity * sizes[found] - 1e-9)]
        if across:
            found = found[own[found] != own[i]]
        if not len(found):
            return
        held = ranked[starts[i] : starts[i] + sizes[i]]
        mine[held] = True
        both = np.add.reduceat(mine[ranked[spans(starts[found], sizes[found])]].astype(np.int64), np.cumsum(sizes[found]) - sizes[found])
        mine[held] = False
        near = found[both >= similarity * (sizes[i] + sizes[found] - both) - 1e-9]
        root = local_roots(len(root), np.full(len(near), i), near, root)

    while True:
        largest = int(np.bincount(root).argmax())
        waiting = order[~done[order] & (root[order] != root[largest])]
        if not len(waiting):
            return root
        for i in waiting.tolist():
            if root[i] != root[largest]:
                done[i] = True
                ask(i)


def link_similar(docs: DataFrame, classes: DataFrame, loose: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(a, b) digests: per pair of tiles of a loose component (node, component), a spanning forest of its exact links."""
    inside = classes.join(loose.withColumnRenamed("node", "cid"), "cid").select("cid", "id", "n", "component")
    tiles = inside.groupBy("component").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("tiles"))
    inside = stage(inside.join(tiles, "component"), "suspects")
    wanted = inside.select(F.col("id").alias("wanted_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = shingle_sets(texts.join(wanted, texts["doc_id"] == wanted["wanted_id"], "left_semi"), shingle)
    sets = held.join(inside.select("cid", "id", "component", "tiles"), "cid").where("doc_id = id").dropDuplicates(["cid"])
    told = sets.withColumn("t", F.pmod(F.xxhash64("cid"), F.greatest("tiles", F.lit(1))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.greatest(F.col("tiles") - 1, F.lit(0))))
    order = ["component", "i", "j"]
    units = told.withColumn("o", other).select("component", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "cid", "members")

    def join(group: pa.Table) -> pa.Table:
        cid, first = np.unique(group.column("cid").to_numpy(), return_index=True)
        members = group.column("members").to_pylist()
        sets_of = [np.frombuffer(members[k], np.uint64) for k in first]
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        t = group.column("t").to_numpy()[first]
        if i != j and (t == t[0]).all():
            root = np.arange(len(cid))
        else:
            root = similar_roots(sets_of, similarity, t == i)
        met = np.flatnonzero(root != np.arange(len(cid)))
        return pa.table({"a": cid[met], "b": cid[root[met]]})

    return units.groupBy(*order).applyInArrow(join, "a long, b long")


@cleaned
def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 4, budget: int = 72, recall: float = 0.98) -> DataFrame:
    """(doc_id, cid, component_id) per row of ``docs``: components of rows whose shingle sets have at least that Jaccard similarity.

    A pair is a candidate if it falls into one component of fingerprints within ``budget`` bits; candidates
    are compared exactly, so no pair below ``similarity`` links. The views are planned for ``recall`` of pairs
    at 0.8; equal sets always meet, empty ones too. Rows that repeat an id join their components; a row
    without an id takes the component of its set, or null, and links nothing.
    """
    names = [f"f{k}" for k in range(lanes)]
    prints = stage(shingle_sets(docs, shingle, lanes), "prints")
    classes = stage(prints.where("doc_id is not null").groupBy("cid", "n", *names).agg(F.min("doc_id").alias("id")), "classes")
    links = link_fingerprints(classes.where("n > 0").select(F.col("cid").alias("id"), *names), lanes, budget, recall, DIFFER)
    loose = connected_components(links, "a", "b")
    exact = stage(link_similar(docs, classes, loose, shingle, similarity), "similar")
    key = classes.select("cid", "id")
    links = exact.join(key.toDF("a", "x"), "a").join(key.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    again = prints.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    shared = prints.join(again, "doc_id").join(key, "cid").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    component = connected_components(links.unionByName(shared), "a", "b").withColumnRenamed("node", "id")
    known = key.join(component, "id", "left").select("cid", F.coalesce("component", "id").alias("component_id"))
    return prints.join(known, "cid", "left").select("doc_id", "cid", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, lanes: int = 4, budget: int = 72, recall: float = 0.98) -> DataFrame:
    """``docs`` (doc_id, text and any more) less all but the first document of each group; rows without an id stay."""
    groups = near_groups(docs.select("doc_id", "text"), shingle, similarity, lanes, budget, recall)
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("dropped_doc_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["dropped_doc_id"], "left_anti")
