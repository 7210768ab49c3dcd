"""Operators on texts against brute force: SimHash, substrings, language model, packing, mixing, toxicity."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagewright.llm import lm, mixing, packing, simhash, substring, toxicity
from pagewright.llm.components import connected_components, local_roots
from pagewright.llm.eliasfano import EliasFano, NgramLevel, dequantise, quantise
from pagewright.llm.fmindex import FMIndex
from pagewright.llm.words import words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ID_ string"


def corpus(seed: int = 1, n: int = 120) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty, blank, long and repetitive texts, repeated ids."""
    draw = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["Été", "İx", "a b", "the", "The"]
    text = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    passage, base = text(70), text(200)
    rows = []
    for i in range(n):
        kind = i % 12
        if kind == 0:
            t = base
        elif kind == 1:
            t = base.replace("w1 ", "W1 ", 1) + " tail"
        elif kind == 2:
            t = text(20) + " " + passage + "\n" + text(30)
        elif kind == 3:
            t = None if i % 24 == 3 else ""
        elif kind == 4:
            t = " \t\n\x0b\x0c\r "
        elif kind == 5:
            t = "spam " * draw.choice([3, 60, 400])
        elif kind == 6:
            t = text(draw.choice([1, 2, 3, 49, 50, 51]))
        else:
            t = text(draw.randint(5, 150))
        rows.append((i * 3 % 97 if i > 100 else i * 3, t, draw.choice(["en", "fr", None]), draw.choice(["a", "b", "é", None]), None, "clash"))
    rows.append((7, "\t".join(text(6000).split()), "en", "a", 1, "x"))
    rows.append((None, base, "en", None, 1, "x"))
    rows += rows[2:4]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def of(text, lower=False):
    import re

    t = text or ""
    if lower:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    return re.findall("[^ \t-\r]+", t)


def test_word_rule(rows):
    for _, t, *_ in rows:
        assert [w.decode() for w in words_of(t)] == of(t) and [w.decode() for w in words_of(t, True)] == of(t, True)


# --- components ---


def test_components(spark):
    draw = random.Random(4)
    edges = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(250)] + [(500 + i, 501 + i) for i in range(60)] + [(None, 3), (9, 9)] + [(1000, 1000 + i) for i in range(1, 80)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    clean = [(a, b) for a, b in edges if a is not None and a != b]
    for a, b in clean:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "x int, y int"), "x", "y").collect()}
    assert got == {v: find(v) for e in clean for v in e}
    assert connected_components(spark.createDataFrame([], "x int, y int"), "x", "y").count() == 0
    a, b = np.array([e[0] for e in clean]), np.array([e[1] for e in clean])
    assert all(local_roots(1100, a, b)[v] == find(v) for e in clean for v in e)


# --- SimHash ---


def simhash_of(text, k):
    w = of(text, True)
    runs = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_all_pairs(docs, rows):
    got = simhash.simhash_groups(docs, shingle=3, lanes=1, budget=2).collect()
    prints = [(i, simhash_of(t, 3)) for i, t, *_ in rows]
    ids = sorted({i for i, _ in prints if i is not None})
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in prints:
        for j, g in prints:
            if i is not None and j is not None and (f ^ g).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    want = sorted((i, f) for i, f in prints if i is not None)
    assert sorted((r["doc_id"], r["f0"] & (1 << 64) - 1) for r in got if r["doc_id"] is not None) == want
    assert all(r["component_id"] == find(r["doc_id"]) for r in got if r["doc_id"] is not None)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [0]


@pytest.mark.parametrize(("lanes", "budget", "n", "crowd"), [(1, 2, 1500, 4096), (1, 2, 900, 100), (1, 5, 600, 4096), (4, 38, 500, 4096), (4, 38, 400, 60)])
def test_trie_join_finds_every_link(spark, monkeypatch, lanes, budget, n, crowd):
    """Dense clusters around a few centres and noise; large budgets must reach the promised recall of components."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    draw, width = random.Random(n), 64 * lanes
    centres = [draw.getrandbits(width) for _ in range(5)]
    prints = set()
    while len(prints) < n:
        f = draw.choice(centres) if draw.random() < 0.6 else draw.getrandbits(width)
        for _ in range(draw.randint(0, max(3, budget // 2))):
            f ^= 1 << draw.randrange(width)
        prints.add(f)
    prints = list(prints)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(i, *[signed(f >> 64 * k & (1 << 64) - 1) for k in range(lanes)]) for i, f in enumerate(prints)]
    classes = spark.createDataFrame(rows, "id long, " + ", ".join(f"f{k} long" for k in range(lanes)))
    links = simhash.link_fingerprints(classes, lanes, budget).collect()
    ends = lambda pairs: local_roots(n, np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    want = ends([(i, j) for i in range(n) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= budget])
    got = ends([(r["a"], r["b"]) for r in links])
    if budget <= simhash.SMALL_BUDGET:
        assert (got == want).all()
    else:
        assert (got == want).mean() > 0.97


def test_keep_one(spark):
    draw = random.Random(8)
    base = [f"v{draw.randint(0, 10**6)}" for _ in range(300)]
    near = base.copy()
    near[150] = "changed"
    rows = [(5, " ".join(base), "x"), (3, " ".join(near), "y"), (9, " ".join(base), "z"), (4, " ".join(f"u{draw.randint(0, 10**6)}" for _ in range(300)), "w"), (None, " ".join(base), "n")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, DROPPED_doc_id string")).collect()
    assert sorted((r[0] or -1) for r in kept) == [-1, 3, 4] and len(kept[0]) == 3


@pytest.mark.parametrize("tile", [1 << 21, 3000])
def test_near_groups_by_exact_similarity(spark, monkeypatch, tile):
    """Pairs of known similarity at 0.8 to 0.85 meet, pairs just below do not; one long chain of near copies spans tiles."""
    monkeypatch.setattr(simhash, "SHINGLES", tile)
    draw = random.Random(21)
    word = lambda: f"v{draw.randint(0, 10**9)}"
    rows, alike = [], {}
    for k in range(400):
        n = draw.choice([8, 40, 104, 405])
        a = [word() for _ in range(n)]
        cut = max(1, round((n - 4) * draw.choice([0.07, 0.09, 0.1, 0.11, 0.125, 0.2])))
        b = a[: n - cut] + ([] if n == 8 else [word() for _ in range(cut)])
        s, t = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        alike[2 * k + 1] = len(s & t) / len(s | t)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    chain = [word() for _ in range(300)]
    for k in range(60):
        rows.append((1000 + k, " ".join(chain)))
        chain = chain[20:] + [word() for _ in range(20)]
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    limit = [i for i, j in alike.items() if 0.8 <= j <= 0.85]
    assert len(limit) > 80 and any(0.7 < j < 0.8 for j in alike.values())
    assert all(group[i] == i for i, j in alike.items() if j < 0.8)
    assert sum(group[i] == i - 1 for i in limit) >= 0.97 * len(limit)
    assert {group[1000 + k] for k in range(60)} == {1000}


# --- substrings ---


def brute_removal(rows, window):
    seen = {}
    key = lambda i: math.inf if i is None else i
    for i, t, *_ in rows:
        w = of(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            seen[g] = min(seen.get(g, math.inf), key(i))
    out = []
    for i, t, *_ in rows:
        w = of(t)
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] < key(i):
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("window", "crowd", "shard"), [(50, 2048, 4096), (50, 2, 20), (20, 1, 4096)])
def test_removal_against_brute_force(docs, rows, monkeypatch, window, crowd, shard):
    monkeypatch.setattr(substring, "CROWD", crowd)
    monkeypatch.setattr(substring, "SHARD", shard)
    got = substring.remove_repeats(docs, window).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_removal(rows, window)


def test_strip_keeps_columns_and_other_texts(spark, docs, rows):
    out = substring.strip_repeats(docs).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "ID_"}
    by = collections.Counter((r["doc_id"], r["text"]) for r in out)
    assert by[(0, rows[0][1])] == 1 and by[(36, "")] >= 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert substring.remove_repeats(none).count() == 0
    assert simhash.simhash_groups(none).count() == 0
    assert lm.score_corpus(none, F.lit(True)).count() == 0
    assert mixing.mix_sources(none).count() == 0


def test_matching_statistics():
    draw = np.random.default_rng(5)
    texts = [draw.integers(1, 4, draw.integers(1, 40)) for _ in range(30)]
    index = FMIndex(texts)
    patterns = [draw.integers(1, 6, 30) for _ in range(10)] + [np.zeros(0, int)]
    whole = ["".join(map(str, t)) for t in texts]
    p, at, place = index.matching_statistics(patterns, 4)
    found = set(zip(p.tolist(), at.tolist()))
    for k, pattern in enumerate(patterns):
        line = "".join(map(str, pattern))
        assert {a for q, a in found if q == k} == {a for a in range(len(line) - 3) if any(line[a : a + 4] in w for w in whole)}
    low = index.least_by_prefix(np.arange(len(texts))[::-1].copy(), 4)
    for k, a, s in zip(p.tolist(), at.tolist(), place.tolist()):
        gram = "".join(map(str, patterns[k][a : a + 4]))
        assert low[s] == min(len(texts) - 1 - i for i, w in enumerate(whole) if gram in w)


# --- language model ---


def test_elias_fano():
    draw = np.random.default_rng(2)
    for n, top in [(0, 1), (1, 1), (5, 3), (400, 50), (300, 1 << 40), (1000, 999)]:
        values = np.sort(draw.integers(0, top, n))
        ef = EliasFano.build(values, top)
        ask = np.unique(np.concatenate([values, draw.integers(0, top, 50)]))
        at, same = ef.find(ask)
        assert (at == np.searchsorted(values, ask)).all() and (same == np.isin(ask, values)).all()


def test_trie_level_in_memory_and_mapped(tmp_path):
    draw = np.random.default_rng(3)
    grams = np.unique(draw.integers(0, 60, (500, 2)), axis=0)
    p = np.log10(draw.random(len(grams)))
    level = NgramLevel.build(grams[:, 0], grams[:, 1], p)
    (tmp_path / "level").write_bytes(level.image())
    for trie in (level, NgramLevel.mapped(level.image()), NgramLevel.open(str(tmp_path / "level"))):
        found, place, code = trie.lookup(np.repeat(np.arange(70), 70), np.tile(np.arange(70), 70))
        assert found.sum() == len(grams) and (place[found] == np.arange(len(grams))).all()
        assert np.abs(dequantise(code[found]) - p).max() < 3e-4 and (dequantise(code[found]) <= p + 1e-12).all()
    assert quantise(np.array([-99.0]))[0] == 1
    assert NgramLevel.build(np.zeros(0, int), np.zeros(0, int), np.zeros(0)).lookup(np.array([1]), np.array([1]))[0].sum() == 0


def brute_lm(rows, learns, order):
    docs = [of(t, True) + [""] for _, t, *_ in rows]
    train = [d for d, l in zip(docs, learns) if l]
    count = collections.Counter(w for d in train for w in d)
    n, v = sum(count.values()), len(count)
    grams = [collections.Counter() for _ in range(order + 1)]
    for d in train:
        line = ["", *d]
        for k in range(2, order + 1):
            for i in range(len(d)):
                if i + 2 - k >= 0:
                    grams[k][tuple(line[i + 2 - k : i + 2])] += 1
    kinds, sums = [collections.Counter() for _ in range(order + 1)], [collections.Counter() for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            kinds[k][g[:-1]] += 1
            sums[k][g[:-1]] += c
    for d in docs:
        line, base, score = ["", *d], 0.0, 0.0
        for i in range(len(d)):
            p = (count[d[i]] + 1) / (n + v + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                h = tuple(line[max(0, i + 2 - k) : i + 1])
                if len(h) == k - 1 and i + 2 - k >= 0 and kinds[k][h]:
                    total = sums[k][h]
                    p = max(grams[k][(*h, d[i])] - 0.75, 0) / total + 0.75 * kinds[k][h] / total * p
            score += math.log10(p)
        yield len(d), sum(count[w] > 0 for w in d), n, base, score


@pytest.mark.parametrize("hot", [1 << 19, 40])
def test_bigram_scores_against_plain_counts(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "BLOCK", 700)
    monkeypatch.setattr(lm, "SHARD", 1500)
    learns = toxicity.fold(F.col("doc_id"), 7) != 2
    got = lm.score_corpus(docs, learns, order=2).collect()
    marks = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, *_ in rows]
    want = collections.defaultdict(list)
    for (i, *_), m, x in zip(rows, marks, brute_lm(rows, marks, 2)):
        want[i, not m].append(x)
    for r in got:
        options = want[r["doc_id"], r["held_out"]]
        assert any((r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:3] and abs(r["base_score"] - x[3]) < 1e-6 * x[0] and abs(r["score"] - x[4]) < 1e-3 * x[0] for x in options)
    assert len(got) == len(rows)


@pytest.mark.parametrize(("order", "hot"), [(3, 1 << 19), (3, 30), (4, 200)])
def test_higher_orders_against_plain_counts(docs, rows, monkeypatch, order, hot):
    monkeypatch.setattr(lm, "HOT", hot)
    monkeypatch.setattr(lm, "SHARD", 900)
    monkeypatch.setattr(lm, "MESSAGE", 1)
    monkeypatch.setattr(lm, "HELD", 500)
    got = lm.score_corpus(docs, toxicity.fold(F.col("doc_id"), 7) != 2, order=order, block_tokens=800).collect()
    marks = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i, *_ in rows]
    want = collections.defaultdict(list)
    for (i, *_), m, x in zip(rows, marks, brute_lm(rows, marks, order)):
        want[i, not m].append(x)
    for r in got:
        options = want[r["doc_id"], r["held_out"]]
        assert any((r["n_tokens"], r["n_known"], r["train_tokens"]) == x[:3] and abs(r["base_score"] - x[3]) < 1e-6 * x[0] and abs(r["score"] - x[4]) < 1e-3 * x[0] for x in options)
    assert len(got) == len(rows)


def test_model_files_answer_by_themselves(spark, tmp_path):
    """The shards' files, mapped anew, give the probabilities that plain counts give; staged tables are gone."""
    texts = ["a b a c", "a b", "b c c a b a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    lm.score_corpus(df, F.lit(True), order=3, model=str(tmp_path)).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
    (path,) = tmp_path.iterdir()
    trie = lm.open_shard(str(tmp_path), int(path.stem))
    lines = [["", *t.split(), ""] for t in texts]
    count = collections.Counter(w for line in lines for w in line[1:])
    names = {w: k + 2 for k, w in enumerate(sorted(count, key=lambda w: (-count[w], xxhash.xxh64_intdigest(w.encode()))))}
    grams = [collections.Counter(tuple(line[i : i + k]) for line in lines for i in range(len(line) - k + 1)) for k in (2, 3)]
    total = sum(count.values()) + len(count) + 1
    codes, _ = trie.walk([np.array([names[w] for w in count])], [])
    assert dequantise(codes[0]) == pytest.approx([math.log10((count[w] + 1) / total) for w in count], abs=3e-4)
    for g, n in grams[1].items():
        u, v, w = g
        codes, weights = trie.walk([np.array([names[x]]) for x in g], [np.zeros(1, int)] * 2)
        follow = [x for x in grams[1] if x[:2] == (u, v)]
        own = sum(grams[1][x] for x in follow)
        assert dequantise(codes[2])[0] == pytest.approx(math.log10((n - 0.75) / own), abs=3e-4)
        assert dequantise(weights[1])[0] == pytest.approx(math.log10(0.75 * len(follow) / own), abs=3e-4)
        low = [x for x in grams[0] if x[0] == u]
        assert dequantise(weights[0])[0] == pytest.approx(math.log10(0.75 * len(low) / sum(grams[0][x] for x in low)), abs=3e-4)
        assert dequantise(codes[1])[0] == pytest.approx(math.log10((grams[0][u, v] - 0.75) / sum(grams[0][x] for x in low)), abs=3e-4)
    assert trie.walk([np.array([names["c"]]), np.array([names["c"]]), np.array([names["c"]])], [np.zeros(1, int)] * 2)[0][2][0] == 0


def test_model_is_a_distribution(spark):
    """Probabilities over the known words, the end and one unknown word sum to one, less the rounding."""
    texts = ["a b a c", "a b", "b c c a"]
    words = ["a", "b", "c", ""]
    asks = [(10 + k, "a " + w if w else "a") for k, w in enumerate([*words, "zz"])]
    df = spark.createDataFrame([*enumerate(texts), *asks], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm.score_corpus(df, F.col("doc_id") < 10, order=2).collect()}
    # P(text "a x") = P(a|start) P(x|a) P(end|x); divide by the same model's other factors, taken from "a", "x"
    count = collections.Counter(w for t in texts for w in [*t.split(), ""])
    n, v = sum(count.values()), len(count)
    follow = collections.Counter((h, w) for t in texts for h, w in zip([""] + t.split(), [*t.split(), ""]))

    def p(w, h):
        low = (count[w] + 1) / (n + v + 1)
        total, kinds = sum(c for (x, _), c in follow.items() if x == h), sum(1 for x, _ in follow if x == h)
        return max(follow[h, w] - 0.75, 0) / total + 0.75 * kinds / total * low if total else low

    assert sum(p(w, "a") for w in [*words, "zz"]) == pytest.approx(1)
    for k, w in enumerate([*words, "zz"]):
        line = ["a", w] if w else ["a"]
        want = sum(math.log10(p(x, h)) for h, x in zip(["", *line], [*line, ""]))
        assert got[10 + k]["score"] == pytest.approx(want, abs=2e-3)


@pytest.mark.parametrize("order", [2, 3])
def test_contexts_before_unknown_words_in_any_partitioning(spark, order):
    rows = [(k, t) for k, t in enumerate(["a b rare x", "a b a c", "b c a rare"])] + [(10, "rare zz"), (11, "a rare yy a")]
    marks = [i < 10 for i, _ in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: x[4] for (i, _), x in zip(rows, brute_lm(rows, marks, order))}
    for parts in (df.coalesce(1), df.repartitionByRange(5, "doc_id")):
        got = {r["doc_id"]: r["score"] for r in lm.score_corpus(parts, F.col("doc_id") < 10, order=order).collect()}
        assert got == pytest.approx(want, abs=3e-3)


def test_pointers_bound_the_children():
    draw = np.random.default_rng(5)
    grams = np.unique(draw.integers(0, 90, (2000, 2)) * [7, 1], axis=0)
    level = NgramLevel.build(grams[:, 0], grams[:, 1], np.full(len(grams), -1.0))
    names = np.arange(700)
    assert (level.followers(names) == np.bincount(grams[:, 0], minlength=700)[:700]).all()
    first, last = level.span(np.arange(level.contexts.n))
    assert (np.append(first, last[-1]) == level.pointers.get(np.arange(level.pointers.n))).all() and last[-1] == len(grams)
    found, place, _ = level.lookup(grams[:, 0], grams[:, 1])
    assert found.all() and (place == np.arange(len(grams))).all()
    level.pointers = EliasFano.build(np.zeros(level.pointers.n, int), len(grams) + 1)
    assert not level.lookup(grams[:, 0], grams[:, 1])[0].any()


def test_query_scores_trigrams(monkeypatch):
    from pagewright.llm import queries

    monkeypatch.setattr(queries, "table", lambda *_: None)
    monkeypatch.setattr(queries.lm, "score_corpus", lambda docs, learns, order: order)
    monkeypatch.setattr(queries.toxicity, "fold", lambda *_: 0)
    monkeypatch.setattr(queries.F, "col", lambda name: name)
    assert queries.op3_lm_score(None, "") >= 3


def test_trigrams_beat_bigrams_on_training_text(docs):
    by = {o: lm.score_corpus(docs, F.lit(True), order=o).agg(F.sum("score")).first()[0] for o in (2, 3)}
    assert by[3] > by[2]


# --- packing ---


def test_packer_fills_windows():
    draw = random.Random(2)
    packer, sent = packing.Packer(64, 4), 0
    for k in range(500):
        size = draw.choice([1, 3, 20, 63, 64, 65, 200])
        sent += size
        packer.add((k, 0, size, b"".join((k * 1000 + j).to_bytes(4, "little") for j in range(size))))
        assert len(packer.open) <= 4
    rest = packer.close()
    assert all(sum(len(p[3]) for p in w) == 256 for w in packer.done) and sum(len(p[3]) for p in rest) < 256
    tails = packing.powers(rest)
    lengths = [sum(len(p[3]) for p in w) // 4 for w in tails]
    assert all(n & (n - 1) == 0 for n in lengths) and sum(lengths) + 64 * len(packer.done) == sent


def word_hash_stream():
    end = (1).to_bytes(4, "little")
    return lambda texts: [b"".join([(zlib.crc32(w) % 40_000 + 2).to_bytes(4, "little") for w in words_of(t)] + [end]) for t in texts]


def test_pieces_cover_each_document_once(docs, rows):
    out = packing.pack_documents(docs, word_hash_stream, window=128, open_windows=4)
    got = out.collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, out.collect()), key=repr)
    encode = word_hash_stream()
    streams = collections.defaultdict(list)
    for i, t, *_ in rows:
        streams[i].append(encode([t])[0])
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert any(zlib.crc32(s[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] and len(s) // 4 == r["doc_tokens"] for s in streams[r["doc_id"]])
    assert {i: sum(len(s) // 4 for s in ss) for i, ss in streams.items()} == {i: sum(r["length"] for r in rs) for i, rs in by_doc.items()}
    lengths = []
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        lengths.append(at)
    assert all(n & (n - 1) == 0 and n <= 128 for n in lengths) and sum(n < 128 for n in lengths) <= 7


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], DOCS), word_hash_stream).count() == 0
    ordered = packing.pack_documents(spark.createDataFrame([], DOCS), word_hash_stream, order=["n_chars"])
    assert ordered.count() == 0 and ordered.columns[0] == "doc_id"


def test_word_ids_equal_the_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    whole, stream, draw = Tokenizer.from_file(path), packing.word_stream(path, 1), random.Random(1)
    alphabet = [*"aAbBéÉΣσς Iıß ́  ﬁ'’sS<|>endoftext 0123,.!?\x1c\x85\t\n中👍🏽‍", "<|endoftext|>", "<|startoftext|>", "'ll", " "]
    for _ in range(3000):
        t = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 30)))
        assert np.frombuffer(stream([t])[0], "<u4").tolist() == [*whole.encode(t, add_special_tokens=False).ids, 1], t


# --- mixing ---


def test_mixing_rules(docs, rows):
    got = mixing.mix_sources(docs).collect()
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(of(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, total = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        free -= over
    target = {s: level * weight[s] if s in free else 2.0 * sizes[s] for s in order}
    taken, largest = collections.Counter(), max(len(of(t)) for _, t, *_ in rows)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] == r["size"] * len(r["positions"]) <= 2 * r["size"] and all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= largest for s in order) and len(got) == len(rows)


def test_mixing_does_not_depend_on_partitions(docs):
    a, b = (sorted((tuple(r) for r in mixing.mix_sources(d).collect()), key=repr) for d in (docs, docs.repartition(7)))
    assert a == b


def test_schedule_moves_positions(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_sources(df, schedule=((0.5, (3, 1)), (1.0, (1, 3))), share=1.0, repeats=2)
    half = mixing.training_order(mixed).where("position < 0.5").groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in half}
    assert abs(got["a"] - 150) <= 3 and abs(got["b"] - 50) <= 3
    order = [r["position"] for r in mixing.training_order(mixed).collect()]
    assert order == sorted(order)


def test_mixing_is_native(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# --- toxicity ---


def test_toxicity_learns_and_scores_everything(spark):
    draw = random.Random(6)
    bad, plain = ["vilest", "scumm", "idjit"], [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(400):
        words, toxic = [draw.choice(plain) for _ in range(draw.randint(3, 60))], int(i % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(draw.randrange(len(words)), draw.choice(bad) + draw.choice(["", ",", "."]))
        rows.append((i, " ".join(words), draw.choice(["en", "fr"])))
        labels.append((i, 1, toxic))
    extra = [(900, None, None), (901, "", "xx"), (902, "plain " * 150_000 + "vilest idjit scumm", "en"), (None, "w1 w2", "en"), (1, rows[1][1], "en")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").repartition(4)
    marks = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    held = toxicity.fold(F.col("doc_id"), 5) == 0
    model = toxicity.ToxicityModel.train(docs, marks.where(~held))
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {i: t for i, _, t in labels}
    unseen = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in unseen]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert by[900]["score"] == by[901]["score"] < 0.5 and by[902]["predicted"] == 1 and by[None]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    again = toxicity.score_documents(docs.drop("lang"), toxicity.ToxicityModel.train(docs, marks.where(~held)), lang=None).collect()
    assert {r["doc_id"]: r["score"] for r in again} == pytest.approx({r["doc_id"]: r["score"] for r in got}, abs=1e-5)


def fitted_net():
    draw = np.random.default_rng(4)
    memo = toxicity.WordHashes()
    texts = [" ".join(draw.choice(["vile", "scum", "ok", "fine", "day", "sun", "rain,"], draw.integers(0, 25))) for _ in range(90)]
    docs = [toxicity.hashed(memo, t) for t in texts]
    return toxicity.ConvNet().fit(docs, np.array([int("vile" in t or "scum" in t) for t in texts]), epochs=2), docs


def naive_score(tables, filters, bias, weight, offset, doc):
    """Word by word and window by window, in plain Python sums."""
    rows = [[float(v) for k, t in enumerate(tables) for v in t[(int(d) >> 16 * k) & toxicity.TABLE - 1]] for d in doc]
    deep = toxicity.TABLES * toxicity.PART
    rows += [[0.0] * deep] * toxicity.GAP
    z, at = float(offset), 0
    for w, f in zip(toxicity.WIDTHS, filters):
        for j in range(f.shape[1]):
            best = 0.0  # the bare gap that closes every text
            for s in range(len(doc)):
                best = max(best, sum(rows[s + o][c] * float(f[o * deep + c, j]) for o in range(w) for c in range(deep)))
            z += max(best + float(bias[at]), 0.0) * float(weight[at])
            at += 1
    return 1 / (1 + math.exp(-z))


def test_scores_against_naive_convolution(monkeypatch):
    net, docs = fitted_net()
    tables, step, filters, steps = net.whole
    assert max(np.abs(t).max() for t in tables) <= toxicity.EMBED_STEPS and toxicity.EMBED_STEPS * toxicity.FILTER_STEPS * max(toxicity.WIDTHS) * toxicity.TABLES * toxicity.PART < 1 << 24
    for doc in [*docs[:12], np.zeros(0, np.int64)]:
        scaled = [f * s for f, s in zip(filters, steps)]
        assert net.scores([doc])[0] == pytest.approx(naive_score([t.astype(float) * step for t in tables], scaled, net.bias, net.weight, net.offset, doc), abs=1e-9)
        # whole numbers lose little of what was fitted
        assert net.scores([doc])[0] == pytest.approx(naive_score(net.tables, net.filters, net.bias, net.weight, net.offset, doc), abs=0.02)
    want = net.scores(docs)
    for size in (1, 7, 90):
        assert (np.concatenate([net.scores(docs[k : k + size]) for k in range(0, 90, size)]) == want).all()
    long = np.concatenate(docs * 3)
    whole = net.scores([long])
    monkeypatch.setattr(toxicity, "CHUNK", 10)
    assert (net.scores([*docs, long]) == np.append(want, whole)).all()


def test_gradients_against_differences():
    net, docs = fitted_net()
    docs, labels, share = docs[:6], np.array([0, 1, 0, 1, 1, 0]), np.array([1.0, 2.0, 1.0, 0.5, 1.0, 1.0])
    net.tables, net.filters, net.bias, net.weight = [t.astype(float) for t in net.tables], [f.astype(float) for f in net.filters], net.bias.astype(float), net.weight.astype(float)

    def loss():
        ids, x, starts = net._embed(docs, net.tables)
        pooled = np.concatenate([np.maximum.reduceat(net._responses(x, w, f, starts), starts, axis=0) for w, f in zip(toxicity.WIDTHS, net.filters)], axis=1) + net.bias
        z = np.maximum(pooled, 0) @ net.weight + net.offset
        return float((share * (np.log1p(np.exp(z)) - labels * z)).mean())

    grads, total, ids, dx = net.gradients(docs, labels, share)
    draw, e = np.random.default_rng(1), 1e-6

    def slope(array, place):
        kept = array[place]
        array[place] = kept + e
        up = loss()
        array[place] = kept - e
        down = loss()
        array[place] = kept
        return (up - down) / (2 * e)

    for param, grad in zip([*net.filters, net.bias, net.weight], grads):
        for _ in range(6):
            place = tuple(int(draw.integers(0, n)) for n in param.shape)
            assert grad[place] == pytest.approx(slope(param, place), abs=1e-6)
    net.offset += e
    up = loss()
    net.offset -= 2 * e
    assert total == pytest.approx((up - loss()) / (2 * e), abs=1e-6)
    net.offset += e
    for k in range(toxicity.TABLES):
        rows = [r for r in np.unique(ids[k]) if r != toxicity.TABLE][:4]
        for r in rows:
            want = dx[ids[k] == r, k * toxicity.PART].sum()
            assert want == pytest.approx(slope(net.tables[k], (r, 0)), abs=1e-6)


def test_thresholds_against_every_cut():
    draw = np.random.default_rng(3)
    for n in (12, 40, 200):
        scores, labels = draw.random(n).round(2), draw.integers(0, 2, n)
        scores = np.unique(scores)
        labels = labels[: len(scores)]
        if min(labels.sum(), (1 - labels).sum()) < 5:
            continue
        f1 = lambda line: 2 * ((scores >= line) & (labels == 1)).sum() / ((scores >= line).sum() + labels.sum())
        assert f1(toxicity.best_threshold(scores, labels)) == pytest.approx(max(f1(s) for s in scores))
    assert toxicity.best_threshold(np.array([0.9, 0.1]), np.array([1, 0])) == 0.5


def test_thresholds_of_equal_and_counted_scores(spark):
    scores, labels = np.array([0.9, 0.5, 0.5, 0.2]), np.array([1, 1, 0, 0])
    counts = np.array([5, 6, 40, 9])
    assert toxicity.best_threshold(scores, labels, counts=counts) == toxicity.best_threshold(np.repeat(scores, counts), np.repeat(labels, counts)) == pytest.approx(0.7)
    # every labelled row counts once, scored by the net that has not seen it
    nets = [toxicity.ConvNet(), toxicity.ConvNet()]
    nets[0].offset, nets[1].offset = 50.0, -50.0
    rows = [(k % 2, int(k % 3 == 0), "en", b"") for k in range(60)]
    told = toxicity.unseen_scores(spark.createDataFrame(rows, "half int, toxic int, lang string, ids binary"), nets).collect()
    assert {(r["toxic"], r["step"]): r["n"] for r in told} == {(1, 65535): 10, (0, 65535): 20, (1, 0): 10, (0, 0): 20}


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Also from texts of any length, in shards that meet after every epoch."""
    draw = random.Random(8)
    plain = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(draw.choice(plain) for _ in range(30)) + (" vilest" if i % 5 == 0 else ""), "en") for i in range(600)]
    rows = [(i, t + " plain" * 20_100 if i in (0, 5, 10) else t, lang) for i, t, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    marks = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    assert {r["toxic"]: r["n"] for r in toxicity.labelled_rows(docs, marks).groupBy("toxic").agg(F.count("*").alias("n")).collect()} == {0: 480, 1: 120}
    assert toxicity.labelled_rows(docs, marks).agg(F.sum("words")).first()[0] == sum(len(t.split()) for _, t, _ in rows)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 150)
    learnt, fit = [], toxicity.train_nets
    monkeypatch.setattr(toxicity, "train_nets", lambda shards, counts, n: learnt.append((counts[2], n, shards.count())) or fit(shards, counts, n))
    model = toxicity.ToxicityModel.train(docs, marks)
    assert learnt == [((480, 120), 4, 600)]
    fresh = [" ".join(draw.choice(plain) for _ in range(30)) + (" vilest" if k % 2 else "") for k in range(60)]
    scores = model.net.scores([toxicity.hashed(toxicity.WordHashes(), t) for t in fresh])
    assert np.mean((scores >= 0.5) == np.arange(60) % 2) > 0.95


def test_moves_meet_before_the_driver(spark, monkeypatch):
    """However many tasks learn, the driver gets each row of a net's tables once a round, in rows of bounded size."""
    draw = random.Random(9)
    rows = [(i, " ".join(f"w{draw.randrange(200)}" for _ in range(20)) + (" vilest" if i % 4 == 0 else ""), "en") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 30)
    monkeypatch.setattr(toxicity, "MEET", 2, raising=False)
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a partition a file
    rounds, read, frame = [], type(docs).toLocalIterator, type(docs)

    def spied(df, *args, **kwargs):
        rounds.append([])
        for row in read(df, *args, **kwargs):
            rounds[-1].append(row)
            yield row

    monkeypatch.setattr(frame, "toLocalIterator", spied)
    try:
        model = toxicity.ToxicityModel.train(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rounds) == 8
    for told in rounds:
        for k in range(3):
            at = np.concatenate([np.frombuffer(r["at"], np.int32) for r in told if r["net"] == k])
            assert len(at) == len(np.unique(at)) > 200
        assert max(len(r["moved"]) for r in told) <= 4 * toxicity.BLOCK * (toxicity.PART + 1)
    assert min(model.net.scores([toxicity.hashed(toxicity.WordHashes(), f"w{k} w{k + 1} vilest") for k in range(9)])) > 0.5
    # sums of sums are the sums over all
    draw, size = np.random.default_rng(2), toxicity.TABLES * (toxicity.TABLE + 1)
    totals = [{k: (float(3 + t), draw.normal(size=5), draw.integers(-99, 99, (size, toxicity.PART + 1)).astype(float), draw.integers(1, 9, size).astype(float)) for k in (0, 2)} for t in range(3)]
    sent = [list(toxicity.messages(t)) for t in totals]
    halves = [*toxicity.messages(toxicity.met(iter(sent[0] + sent[1]))), *sent[2]]
    for k, found in toxicity.met(iter(halves)).items():
        for value, *parts in zip(found, *[t[k] for t in totals]):
            assert np.allclose(value, sum(parts))


def two_rounds(spark, monkeypatch):
    """Scores of a model that three shards fitted in two rounds."""
    draw = random.Random(10)
    rows = [(i, " ".join(f"w{draw.randrange(200)}" for _ in range(20)) + (" vilest" if i % 4 == 0 else ""), "en") for i in range(90)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _, _ in rows], "doc_id long, toxic int")
    fit = toxicity.train_nets
    with monkeypatch.context() as patch:
        patch.setattr(toxicity, "SHARD_ROWS", 30)
        patch.setattr(toxicity, "train_nets", lambda shards, counts, n: fit(shards, counts, n, epochs=2))
        model = toxicity.ToxicityModel.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), marks)
    return model.net.scores([toxicity.hashed(toxicity.WordHashes(), t) for _, t, _ in rows])


def test_moves_meet_in_files_that_readers_split(spark, monkeypatch):
    """Also where a file of moves is read in more parts than a task sums at once, the meeting ends and adds up alike."""
    want = two_rounds(spark, monkeypatch)
    write, written = toxicity.stage, []

    def spied(df, label, *args):
        written.append(label)
        assert written.count("moves") <= 4, "two rounds of three files, of which two tasks make two"
        return write(df, label, *args)

    monkeypatch.setattr(toxicity, "stage", spied)
    monkeypatch.setattr(toxicity, "MEET", 2)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = two_rounds(spark, monkeypatch)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert written.count("moves") == 4 and np.allclose(got, want, atol=1e-3)


def test_the_driver_gets_a_mean_in_pieces(spark, monkeypatch):
    """No task sends the driver much of a mean at once."""
    from pyspark.sql.classic.dataframe import DataFrame

    sizes, read = [], DataFrame.toLocalIterator

    def spied(df, *args, **kwargs):
        by = df.groupBy(F.spark_partition_id().alias("piece")).agg(F.sum(F.length("at") + F.length("moved")).alias("size"))
        sizes.append([r["size"] for r in by.collect()])
        return read(df, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "toLocalIterator", spied)
    two_rounds(spark, monkeypatch)
    assert len(sizes) == 2 and all(max(told) < sum(told) / 4 for told in sizes)


def test_toxicity_learns_from_long_texts_alone(spark):
    rows = [(i, "w " * 20_001 + "vilest" if i % 2 else f"w{i} fine day", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = toxicity.ToxicityModel.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int"))
    assert [r["predicted"] for r in toxicity.score_documents(docs, model).orderBy("doc_id").collect()] == [i % 2 for i in range(40)]


def test_gradients_of_long_texts(monkeypatch):
    net, docs = fitted_net()
    long, labels, share = [np.concatenate(docs)], np.array([1]), np.array([1.0])
    net.tables, net.filters, net.bias, net.weight = [t.astype(float) for t in net.tables], [f.astype(float) for f in net.filters], net.bias.astype(float), net.weight.astype(float)

    def moves():
        grads, total, ids, dx = net.gradients(long, labels, share)
        tables = [np.zeros((toxicity.TABLE + 1, toxicity.PART)) for _ in ids]
        for k, (t, i) in enumerate(zip(tables, ids)):
            np.add.at(t, i, dx[:, k * toxicity.PART : (k + 1) * toxicity.PART])
        return [*grads, total, *tables]

    whole = moves()
    monkeypatch.setattr(toxicity, "CHUNK", 10)
    for a, b in zip(whole, moves()):
        assert np.allclose(a, b, atol=1e-12)
    assert [list(p) for p in toxicity.in_chunks(np.array([2, 0, 1, 3]), [np.zeros(n) for n in (4, 5, 6, 30)])] == [[2, 0], [1], [3]]


def test_words_hashed_together_have_the_hashes_of_each(monkeypatch):
    draw = random.Random(12)
    signs = list("aB z.,-!_\t\n\x0b\x0c\r\x1c\x00\x85\xa0\u2003éÉß中😀'\"~{")
    texts = [None, "", "  ", "...", ".a.", "--- x---y ---", "\x7f/:@[`{", *["q" * k for k in range(20)], "a\ud800b c", "y " * 70_000]
    texts += ["".join(draw.choice(signs) for _ in range(draw.randrange(80))) for _ in range(400)]
    want, alone = [toxicity.hashed(toxicity.WordHashes(), t) for t in texts], []
    monkeypatch.setattr(toxicity.WordHashes, "__missing__", lambda self, word, one=toxicity.WordHashes.__missing__: alone.append(word) or one(self, word))
    for size, long in ((toxicity.HASHED, toxicity.LONG), (100, 1000), (40, 40), (1, 1)):
        monkeypatch.setattr(toxicity, "HASHED", size)
        monkeypatch.setattr(toxicity, "LONG", long)
        alone.clear()
        for start in (0, 5):
            found = toxicity.hashed_all(toxicity.WordHashes(), texts[start:])
            assert len(found) == len(texts) - start and all(np.array_equal(a, b) for a, b in zip(found, want[start:]))
        assert long < 1 << 20 or min(map(len, alone)) > 15  # no short word goes alone
    assert toxicity.hashed_all(toxicity.WordHashes(), []) == []


def test_an_epoch_moves_only_words_of_best_windows(monkeypatch):
    """A batch's gradients come for these words, however long its texts, and move the tables like sums over all its words."""
    net, docs = fitted_net()
    docs = [np.tile(d, 40) for d in docs if len(d)][:32]
    labels, share, most = np.arange(32) % 2, np.ones(32), len(docs) * toxicity.FILTERS * sum(toxicity.WIDTHS)
    sums, squares = toxicity.Sums.of(net), np.full((toxicity.TABLE + 1, 1), 1e-3)
    _, _, ids, dx = net.gradients(docs, labels, share)
    assert 0 < len(dx) == len(ids[0]) <= most < sum(map(len, docs))
    before = [t.astype(float) for t in net.tables]
    net.fit(docs, labels, 1, sums=sums)
    for k, (t, moved) in enumerate(zip(before, net.tables)):
        g = np.zeros_like(t)
        np.add.at(g, ids[k], dx[:, k * toxicity.PART : (k + 1) * toxicity.PART])
        g[toxicity.TABLE] = 0
        total = squares + (g**2).mean(axis=1, keepdims=True)
        assert np.allclose(sums.tables[k], total, rtol=1e-3) and np.allclose(moved, t - 0.05 * g / np.sqrt(total), atol=1e-4)
    # texts are scored together as far as caches hold them
    together, embed = [], toxicity.ConvNet._embed
    monkeypatch.setattr(toxicity.ConvNet, "_embed", lambda self, part, tables: together.append(sum(map(len, part))) or embed(self, part, tables))
    net.scores(docs * 4)
    assert sum(together) == 4 * sum(map(len, docs)) and max(together) <= toxicity.TOGETHER


def test_toxicity_of_an_empty_table(spark):
    model = toxicity.ToxicityModel(toxicity.ConvNet(), {})
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert toxicity.score_documents(none, model).count() == 0 and toxicity.drop_flagged(none, model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string")
    model = toxicity.ToxicityModel.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(docs, model).count() == 1
