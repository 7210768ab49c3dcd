"""Each stage of the pipeline, and all in a row, against brute force: nulls and repeats in every column."""

import collections
import importlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import mixing, toxicity
from pagewright.plans.staging import stage
from tests.llm.test_text_ops import naive_score, of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, TEXT_ string"


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def corpus() -> list[tuple]:
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(900)] + ["Été", "The", "the", "😀"]
    words = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    base, passage, other = words(260), words(70), words(260)
    texts = [" ".join(base), " ".join(base), " ".join(base[:130] + ["new"] + base[131:]), "\t".join(base), " ".join(other), " ".join(other[:-3])]
    texts += [" ".join(words(draw.randint(5, 60)) + passage + words(draw.randint(5, 60))) for _ in range(8)]
    texts += [" ".join(words(draw.randint(1, 120)) + ["vilest", "scumm"] * 2) for _ in range(12)]
    texts += [None, "", " \n ", "one", " ".join(passage)] + [" ".join(words(draw.randint(5, 200))) for _ in range(40)]
    draw.shuffle(texts)
    rows = [(5 * k, t, draw.choice(["en", "fr", None]), draw.choice(["a", "b", None]), len(t or ""), "x") for k, t in enumerate(texts)]
    # rows without ids, repeated rows, one id with two texts
    rows += [(None, *r[1:]) for r in rows[::9]] + rows[::11] + rows[3:4] + [(10, "another text of id ten", "en", "a", 1, "x"), (None, " ".join(words(90)), "en", "a", 1, None)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{at}/documents.parquet")
    ids = {r[0]: int("vilest" in (r[1] or "")) for r in rows if r[0] is not None}
    spark.createDataFrame([(i, 1, t) for i, t in ids.items()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def plain(df):
    return collections.Counter(tuple(r) for r in df.collect())


def near_brute(rows):
    """Rows that stay when of documents alike by five-word shingles the smallest id stays; rows without an id stay."""
    sets = []
    for r in rows:
        w = of(r[1], True)
        sets.append(frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r, s in zip(rows, sets):
        for q, t in zip(rows, sets):
            if r[0] is not None and q[0] is not None and (s == t or s and t and len(s & t) >= 0.8 * len(s | t)):
                x, y = find(r[0]), find(q[0])
                root[max(x, y)] = min(x, y)
    return [r for r in rows if r[0] is None or find(r[0]) == r[0]]


def test_stages_against_brute_force(spark, pipeline, folder, monkeypatch):
    steps = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]

    model = toxicity.ToxicityModel.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    monkeypatch.setattr(toxicity.ToxicityModel, "train", lambda *_: model)
    tables, step, filters, scales = model.net.whole
    filters, tables, memo = [f * s for f, s in zip(filters, scales)], [t.astype(float) * step for t in tables], toxicity.WordHashes()
    known = {}

    def score(text):
        if text not in known:
            known[text] = naive_score(tables, filters, model.net.bias, model.net.weight, model.net.offset, toxicity.hashed(memo, text))
        return known[text]

    kept = [r for r in rows if score(r[1]) < model.thresholds.get(r[2] or "", 0.5)]
    clean = stage(steps["toxicity"](spark, docs, folder), "test")
    assert plain(clean) == collections.Counter(kept) and len(rows) - 30 < len(kept) < len(rows) - 8

    rows = near_brute(kept)
    single = stage(steps["simhash near-dedup"](spark, clean, folder), "test")
    assert plain(single) == collections.Counter(rows) and len(rows) < len(kept)

    want = collections.Counter()
    removed = {}
    key = lambda i: float("inf") if i is None else i
    seen = {}
    for r in rows:
        w = of(r[1])
        for k in range(len(w) - 49):
            seen[tuple(w[k : k + 50])] = min(seen.get(tuple(w[k : k + 50]), float("inf")), key(r[0]))
    for r in rows:
        w, gone = of(r[1]), set()
        for k in range(len(w) - 49):
            if seen[tuple(w[k : k + 50])] < key(r[0]):
                gone.update(range(k, k + 50))
        text = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else r[1]
        removed[r] = len(gone)
        if text != "":
            want[(r[0], text, *r[2:4], None if text is None else len(text), r[5])] += 1
    stripped = stage(steps["substring dedup"](spark, single, folder), "test")
    assert plain(stripped) == want and sum(removed.values()) > 300

    mixed = stage(steps["mixing"](spark, stripped, folder), "test")
    copies, sizes = plain(mixed), collections.Counter()
    assert mixed.columns == docs.columns and all(n <= 2 * want[r] for r, n in copies.items()) and set(copies) <= set(want)
    for r, n in want.items():
        sizes[r[3]] += n * len(of(r[1]))
    targets = {r["source"]: r["target"] for r in mixing.mix_sources(stripped, schedule=pipeline.SCHEDULE, share=1.5, repeats=2).select("source", "target").distinct().collect()}
    longest = max(len(of(r[1])) for r in want)
    for source, target in targets.items():
        assert target <= 2 * sizes[source] + 1e-6 and abs(sum(n * len(of(r[1])) for r, n in copies.items() if r[3] == source) - target) <= longest
    assert sum(targets.values()) == pytest.approx(min(1.5, 2) * sum(sizes.values()))

    from tokenizers import Tokenizer

    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = steps["packing"](spark, mixed, folder).collect()
    tokens = collections.Counter()
    for r, n in copies.items():
        tokens[r[0]] += n * (1 + len(whole.encode(r[1] or "", add_special_tokens=False).ids))
    got = collections.Counter()
    for r in packed:
        got[r["doc_id"]] += r["length"]
    assert got == tokens
    lengths = collections.Counter()
    for r in packed:
        lengths[r["sequence_id"]] += r["length"]
    assert all(n & (n - 1) == 0 for n in lengths.values())


def test_packed_rows_follow_the_curriculum(spark, pipeline, folder, monkeypatch, tmp_path):
    """Source a is trained in the first half and b in the second: so are the windows."""
    monkeypatch.setattr(pipeline, "SCHEDULE", ((0.5, (1, 0)), (1.0, (0, 1))))
    rows = [(i, " ".join(f"word{i} x{k}" for k in range(400)), "en", "ab"[i % 2], 1) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    mixed = pipeline.mix(spark, docs, folder)
    mixed.repartitionByRange(9, F.monotonically_increasing_id()).write.parquet(f"{tmp_path}/mixed")
    pieces = pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/mixed"), folder).where(F.col("sequence_id") < 1 << 58).collect()
    halves = [r["doc_id"] % 2 for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"]))]
    cut = halves.index(1)
    # best fit holds windows open across the change, so a few pieces pass it
    assert np.mean(halves[:cut]) == 0 and sum(1 - h for h in halves[cut:]) <= 0.2 * len(halves) and cut > 0.2 * len(halves)


def test_empty_tables_pass_all_stages(spark, pipeline, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_one_table_of_its_stages(spark, pipeline, folder):
    assert pipeline.run(spark, folder).count() > 0


def test_operators_leave_their_results_only(spark, folder):
    """What an operator stages on its way is gone when its result is there."""
    from pagewright.llm import ann, lm, packing, queries, simhash, substring, urlfilter, vecdedup
    from pagewright.plans.staging import shared_dir

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    pages = spark.createDataFrame([(1, "http://a.org/x", "<link rel=canonical href=/y>")], "page_id long, url string, html string")

    def tables():
        from pathlib import Path

        return {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if not p.name.startswith("rdd-")}

    for run in (
        lambda: ann.nearest(vectors, F.col("vec_id") % 20 == 0), lambda: vecdedup.duplicate_vectors(vectors), lambda: simhash.simhash_groups(docs, 3, 1, 2), lambda: simhash.near_groups(docs),
        lambda: substring.remove_repeats(docs), lambda: lm.score_corpus(docs, F.lit(True), order=3), lambda: packing.pack_documents(docs, queries.word_bpe_stream),
        lambda: urlfilter.filter_urls(pages, queries.URL_RULES, urlfilter.html_edges(pages)),
    ):
        before = tables()
        assert run().count() > 0 and len(tables() - before) == 1
