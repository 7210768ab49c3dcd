"""Vector, URL, chat and pipeline operators against brute force."""

import importlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import ann, chat, queries, tiles, urlfilter, vecdedup

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, ids string"


def vectors(seed: int = 3, n: int = 260, dim: int = 12) -> list[tuple]:
    draw = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = draw.normal(size=dim)
        if i % 5 == 1 and out:
            v = np.array(out[i - 1][1], float) * draw.choice([1.0, 3.0]) + draw.normal(size=dim) * draw.choice([0, 0.03, 0.06])
        out.append((i, [float(np.float32(x)) for x in v], int(draw.integers(0, 3)) if i % 5 != 1 else None, "x"))
    out = [(i, v, l if l is not None else out[i - 1][2], x) for i, v, l, x in out]
    out += [(400 + k, out[0][1], out[0][2], "copy") for k in range(30)]
    odd = [None, [], [0.0] * dim, [math.nan] * dim, [math.inf] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0]]
    out += [(500 + 20 * k, v, 1, "odd") for k, v in enumerate(odd)]
    out += [(700, out[0][1], None, "nolabel"), (None, out[0][1], 0, "noid"), (40, out[40][1], out[40][2], "again")]
    return out


def in_order(v, w):
    """Plain double sums; Python's own sum() compensates."""
    total = 0.0
    for a, b in zip(v, w):
        total += a * b
    return total


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize(("base", "query"), [(8192, 1024), (37, 5)])
def test_nearest_against_all_pairs(spark, monkeypatch, base, query):
    monkeypatch.setattr(ann, "BASE_TILE", base)
    monkeypatch.setattr(ann, "QUERY_TILE", query)
    rows = vectors()
    got = ann.nearest(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 20 == 0, k=7).collect()
    usable = {(i, tuple(v)) for i, v, *_ in rows if i is not None and good(v)}
    want = []
    for q, v in usable:
        if q % 20 == 0:
            scores = [(-in_order(v, w), i) for i, w in usable if i != q and len(w) == len(v)]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scores)[:7])]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_bounds_hold():
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=(50, 33)) * 10 ** draw.uniform(-3, 3, (50, 1)), draw.normal(size=(40, 33))
    a[3] = 0
    packed = []
    for v in (a, b):
        codes, scale, lost = tiles.quantise(v)
        packed.append(tiles.Tile(np.arange(len(v)), v, codes.astype(np.float32), scale, lost, np.zeros(len(v))))
    near, bound = tiles.product_bounds(*packed, slice(0, 50))
    assert (np.abs(near - a @ b.T) <= bound).all()


@pytest.mark.parametrize("size", [2048, 29])
def test_vector_groups_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(vecdedup, "TILE_SIZE", size)
    rows = vectors()
    got = vecdedup.duplicate_vectors(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    ok = [k for k, (i, v, l, _) in enumerate(rows) if i is not None and l is not None and good(v)]
    links, root = {k: 0 for k in range(len(rows))}, {i: i for i, *_ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in ok:
        for q in ok:
            a, b = np.array(rows[p][1]), np.array(rows[q][1])
            if p != q and rows[p][2] == rows[q][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98 - 1e-15:
                links[p] += 1
                x, y = find(rows[p][0]), find(rows[q][0])
                root[max(x, y)] = min(x, y)
    want = [(i, links[k], None if i is None else find(i), i is None or i == find(i)) for k, (i, *_) in enumerate(rows)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_huge_and_tiny_vectors(spark):
    """Products beyond the range of doubles keep their place; none of the candidates vanishes."""
    rows = [(0, [1e200, -1e200, 1.0]), (1, [1e200, 1.0, 0.0]), (2, [1e160, 1e160, 1e160]), (3, [-1e300, 0.0, 0.0]), (4, [1e-200, 1e-200, 0.0]), (5, [0.0, 0.0, 5e-324]), (6, [1e170, 1e170, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in ann.nearest(df, F.col("vec_id") == 0, k=7).orderBy("rank").collect()]
    # 6: both sums overflow, with opposite signs
    assert got == [(0, 1, 1, math.inf), (0, 2, 2, 1e160), (0, 3, 5, 5e-324), (0, 4, 4, 0.0), (0, 5, 6, 0.0), (0, 6, 3, -math.inf)]
    tiny = spark.createDataFrame([(1, [1e-200, 0.0], 1), (2, [3e-200, 1e-205], 1), (3, [1e300, 1e295], 1), (4, [0.0, 1e300], 1)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in vecdedup.duplicate_vectors(tiny).collect()) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_links_of_rows_that_repeat_an_id(spark):
    rows = [(7, [1.0, 0.0], 1), (7, [0.0, 1.0], 1), (8, [2.0, 0.0], 1), (9, [0.0, 3.0], 1), (9, [-1.0, 0.0], 1), (3, [-1.0, 0.0], 1), (9, [0.0, 0.0], 1), (5, [0.0, 0.0], 1), (7, [1.0, 0.0], 2)]
    got = vecdedup.duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    # 8 links with one vector of 7, 9 with the other; 9's second vector is a copy of 3's
    assert sorted(tuple(r) for r in got) == sorted([(7, 1, 3, False), (7, 1, 3, False), (8, 1, 3, False), (9, 1, 3, False), (9, 1, 3, False), (3, 1, 3, True), (9, 0, 3, False), (5, 0, 5, True), (7, 0, 3, False)])


def test_vector_operators_on_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert ann.nearest(none, F.lit(True)).count() == 0 and vecdedup.duplicate_vectors(none).count() == 0


# --- URLs ---

URLS = [
    (1, "https://www.Example.com/en/x?q#f"), (2, "http://a.example.com/en/"), (3, "http://example.com/en"), (4, "http://x.net/es/1"), (5, "http://x.net/de/1"), (6, "nohost"), (7, None),
    (8, "ftp://u.org?x"), (9, "https://alias.org/a"), (10, "http://alias.org/a#frag"), (11, "https://both.org/"), (12, "x://"), (13, "https://notexample.com/en/"), (14, "https://com/"), (15, ""), (16, "http://x.net:80/es/"),
]
EDGES = [("alias.org/a", "hop.org/1"), ("hop.org/1", "x.net/es/9"), ("both.org/", "x.net/fr/2"), ("both.org/", "any.com/"), ("selfie.org/", "selfie.org/"), (None, "alias.org/a")]


@pytest.mark.parametrize("literal", [512, 0])
def test_rules_and_propagation(spark, monkeypatch, literal):
    monkeypatch.setattr(urlfilter, "LITERAL_RULES", literal)
    pages = spark.createDataFrame([(i, u, "mine") for i, u in URLS], "page_id long, url string, verdict string")
    out = {r["page_id"]: r for r in urlfilter.filter_urls(pages, queries.URL_RULES, spark.createDataFrame(EDGES, "src string, dst string")).collect()}
    told = {k: (r["rule"], r["verdict"]) for k, r in out.items()}
    assert told[1] == ("www.example.com/en/", "allow") and told[2] == ("example.com/en/", "block") and told[3] == ("com/", "allow")
    assert told[4] == ("net/es/", "block") and told[5] == (None, "allow") and told[6] == told[7] == told[8] == (None, "allow")
    assert told[9] == told[10] == (None, "block") and told[11] == (None, "allow") and told[13] == ("com/", "allow") and told[16] == (None, "allow")
    assert (out[1]["host"], out[1]["path"], out[8]["host"], out[8]["path"], out[12]["host"]) == ("www.example.com", "/en/x", "u.org", "", "")
    assert len(out) == len(URLS)


def test_url_filter_of_empty_and_repeated_rows(spark):
    kind = "page_id long, url string, host int, html string"
    none = spark.createDataFrame([], kind)
    assert urlfilter.filter_urls(none, queries.URL_RULES, urlfilter.html_edges(none)).count() == 0
    twice = spark.createDataFrame([(1, "http://a.net/x", 7, "<link rel=canonical href=/es/1>"), (1, "http://a.net/x", 7, "<link rel=canonical href=/es/1>"), (None, None, None, None)], kind)
    got = urlfilter.filter_urls(twice, queries.URL_RULES, urlfilter.html_edges(twice))
    assert got.columns == ["page_id", "url", "html", "host", "path", "rule", "verdict"]
    assert sorted(((r["page_id"], r["host"], r["verdict"]) for r in got.collect()), key=repr) == [(1, "a.net", "block")] * 2 + [(None, "", "allow")]


def test_edges_from_markup(spark):
    pages = spark.createDataFrame([
        ("https://a.org/x?y", '<link href="/main" rel="canonical">'), ("https://b.org/", "<META HTTP-EQUIV=refresh CONTENT='0; URL=https://c.org/z#q'>"), ("https://d.org/", "<link rel=stylesheet href=/s>"), (None, "<link rel=canonical href=/x>"), ("https://e.org/", None),
    ], "url string, html string")
    assert sorted(tuple(r) for r in urlfilter.html_edges(pages).collect()) == [("a.org/x?y", "a.org/main"), ("b.org/", "c.org/z")]


def test_edges_of_every_reference_form(spark):
    page, link = "https://a.org/d/x?y", '<link rel="{1}" href="{0}">'
    forms = [
        (link.format("//x.net/es/1", "canonical"), "x.net/es/1"), (link.format("page2", "canonical"), "a.org/d/page2"), (link.format("../up", "canonical"), "a.org/up"), (link.format("?z=1", "canonical"), "a.org/d/x?z=1"),
        (link.format("/n", "nofollow canonical"), "a.org/n"), (link.format("/q?a=1&amp;b=2", "canonical"), "a.org/q?a=1&b=2"), ("<meta http-equiv=\"refresh\" content=\"0; url='http://x.net/es/2'\">", "x.net/es/2"),
        ("<meta http-equiv=refresh content=5>", None), (link.format("/no", "noncanonical"), None),
    ]
    for html, want in forms:
        assert urlfilter.alias_targets(f"<html><head>{html}</head><body></body></html>", page) == ([] if want is None else ["https://" + want if want.startswith("a.org") or html.startswith("<link") else "http://" + want]), html
    pages = spark.createDataFrame([(page, h) for h, _ in forms], "url string, html string")
    assert sorted(r["dst"] for r in urlfilter.html_edges(pages).collect()) == sorted(w for _, w in forms if w)


# --- chats ---

TURNS = [
    (1, 0, "user", "a <| b \\ <\\| <|im_end|>"), (1, 1, "assistant", "<|im_start|>user<|im_sep|>\\\\"), (1, 1, "assistant", None), (2, 5, "assistant", "two"), (2, None, "user\n", "first 😀"), (2, 5, "assistant", "two"),
    (None, 0, None, "x"), (3, 0, "assistant", ""), (4, 0, "we<|im_sep|>ird", "\n"),
]


def test_chats_read_back(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").repartition(3)
    made = chat.format_chats(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    by = {}
    for c, t, r, x in TURNS:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for *_, r, x in turns], c
        assert got[c]["loss_text"] == "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["expanded_tokens"] == 0


def test_typed_parts(spark):
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "i.png", 56, 30, None, None), ("audio", None, "a.wav", None, None, 2.5, None), ("odd", "?", None, None, None, None, None)]
    more = [("document", None, "d.pdf", None, None, None, 3), ("image", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", more), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chats(df).first()
    assert "see <\\|<|image:1|><|audio:2|>?<|im_end|>" in r["formatted"] and "<|document:3|><|image:4|><|im_end|>" in r["formatted"]
    assert [(a["place"], a["turn"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(1, 0, "image", "i.png", 4), (2, 0, "audio", "a.wav", 63), (3, 1, "document", "d.pdf", 1536), (4, 1, "image", None, 1)]
    assert r["expanded_tokens"] == 1604 and len(r["loss_spans"]) == 1


def test_adjoining_parts_forge_nothing(spark):
    """Random parts cut from control strings read back exactly, however they adjoin."""
    draw, pieces = random.Random(9), ["<", "|", "im_end|>", "<|im_start|>", "\\", "", None, "a", "|im_sep|>", "<|", "image:1|>"]
    rows, want = [], {}
    part = lambda kind, text: (kind, text, None, None, None, None, None)
    rows.append((0, 0, "user", [part("text", "<"), part("text", "|im_end|>"), part("text", "<|im_start|>assistant<|im_sep|>ok")]))
    want[0] = [("user", "<|im_end|><|im_start|>assistant<|im_sep|>ok")]
    for c in range(1, 150):
        for turn in range(3):
            role = draw.choice(["user", "assistant", "<", "x<|im_sep|>"])
            texts = [draw.choice(pieces) for _ in range(draw.randint(0, 6))]
            rows.append((c, turn, role, [part(draw.choice(["text", "odd", None]), t) for t in texts]))
            want.setdefault(c, []).append((role, "".join(t or "" for t in texts)))
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>").repartition(3)
    for r in chat.read_back(chat.format_chats(df)).collect():
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(x for role, x in turns if role == "assistant") and r["n_turns"] == len(turns)
    mixed = [part("text", "<"), part("image", None), part("text", "|x"), part("text", "<"), part("text", None), part("text", "|"), part("audio", None), part("text", "|")]
    r = chat.format_chats(spark.createDataFrame([(1, 0, "user", mixed)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert r["formatted"] == "<|im_start|>user<|im_sep|><<|image:1|>|x<\\|<|audio:2|>|<|im_end|>"


def test_chats_of_an_empty_table_and_of_one_long_conversation(spark):
    kind = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    assert chat.format_chats(spark.createDataFrame([], kind)).count() == 0
    turns = spark.range(6000).select(F.lit(None).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), chat.text_parts(F.col("id").cast("string")).alias("parts"))
    r = chat.read_back(chat.format_chats(turns)).first()
    assert r["n_turns"] == 6000 and r["loss_text"] == "".join(map(str, range(6000)))


def test_native_operators_run_no_python(spark):
    for name in ("op7_chat_format", "op9_mix_sources"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name


def test_mix_query_sorts_by_training_time(spark):
    plan = queries.op9_mix_sources(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [positions" in plan and "paces" in plan


# --- queries and the pipeline ---


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    done = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in done.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r) for r in df.select(columns).collect()), key=repr) == sorted(done.fetchall(), key=repr)


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_pipeline_stages(spark, pipeline):
    from pagewright.plans.staging import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, columns = {}, docs.columns
    for name, step in pipeline.STAGES:
        before = docs
        docs = stage(step(spark, docs, SF), "test")
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes, name
    first, clean = kept["toxicity"]
    gone = first.join(clean, "doc_id", "left_anti")
    assert 0 < gone.count() < first.count() / 4
    before, deduped = kept["simhash near-dedup"]
    copies = before.groupBy("text").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    assert deduped.groupBy("text").count().where("count > 1").count() == 0
    assert deduped.count() < before.count() and copies.where("n = 1").join(deduped, "doc_id").count() >= 0.85 * copies.where("n = 1").count()
    _, stripped = kept["substring dedup"]
    from pagewright.llm.substring import remove_repeats

    assert remove_repeats(deduped).agg(F.sum("n_removed")).first()[0] >= 0 and stripped.where("text = ''").count() == 0
    _, mixed = kept["mixing"]
    assert mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    _, packed = kept["packing"]
    lengths = [r["n"] for r in packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert all(n & (n - 1) == 0 for n in lengths)


def test_pipeline_run(spark, pipeline):
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(pipeline.run(spark, SF).columns)
    assert pipeline.ORACLE_SQL is None


def test_mix_places_rows_not_ids(spark, pipeline):
    """Rows without an id stay, and none of many rows of one id is taken more than twice."""
    texts = [f"null {k} " + "w " * 9 for k in range(6)] + [f"again {k} " + "w " * 9 for k in range(6)] + ["same text " * 5] * 4 + [f"own {k} " + "w " * 9 for k in range(6)]
    ids = [None] * 6 + [1] * 6 + [2] * 4 + list(range(10, 16))
    docs = spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in zip(ids, texts)], "doc_id long, text string, source string, lang string, n_chars long")
    got = pipeline.mix(spark, docs, SF)
    assert got.columns == docs.columns
    counts = {r["text"]: r["count"] for r in got.groupBy("text").count().collect()}
    # one source: every row once, and half of the words a second time
    assert set(counts) == set(texts) and all(n <= (8 if t == texts[12] else 2) for t, n in counts.items())
    assert 1.3 * len(texts) <= sum(counts.values()) <= 1.7 * len(texts)


def test_toxic_rows_go_by_their_own_flag(spark, pipeline, monkeypatch):
    from pagewright.llm import toxicity

    model = toxicity.ToxicityModel(toxicity.ConvNet(), {"en": 0.0, "fr": 2.0})  # flags all of en, nothing of fr
    monkeypatch.setattr(toxicity.ToxicityModel, "train", lambda *_: model)
    docs = spark.createDataFrame([(None, "a", "en"), (None, "b", "fr"), (1, "c", "en"), (1, "d", "fr"), (2, None, "fr")], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in pipeline.drop_toxic(spark, docs, SF).select("lang", F.coalesce("text", F.lit(""))).collect()) == [("fr", ""), ("fr", "b"), ("fr", "d")]
