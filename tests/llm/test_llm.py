"""The training-data operators against plain versions, and on awkward rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxcohort.llm.chat_format import preference_pairs
from voxcohort.llm.column_bwt import column_bwt
from voxcohort.llm.common import Shelf
from voxcohort.llm.components import components
from voxcohort.llm.decontaminate import banded_distance, contaminated, without_leaks
from voxcohort.llm.exact_search import exact_top_k
from voxcohort.llm.html_text import main_text
from voxcohort.llm.ngram_join import similar_documents
from voxcohort.llm.quality import pool_adjacent, score_quality
from voxcohort.llm.source_mixing import mix_sources, mixed_rows
from voxcohort.llm.substring_dedup import remove_repeated_words
from voxcohort.llm.suffix_dedup import remove_repeated_bytes
from voxcohort.llm.toxicity import flag_toxic

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, label int"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, a shared passage, periodic runs, and rows with nulls, nothing, one long text and a repeated key."""
    rng = random.Random(3)
    passage, base = words(rng, 110), words(rng, 120)
    texts = [" ".join(words(rng, rng.randrange(1, 150))) for _ in range(30)]
    texts += [" ".join(words(rng, 30) + passage + words(rng, 20)) for _ in range(12)]
    texts += [" ".join(base)] * 6
    for _ in range(14):
        near = list(base)
        near[rng.randrange(len(near))] = "edit" + str(rng.randrange(9))
        texts.append(" ".join(near))
    texts += ["x y " * 90, "z " * 200, "", "   \n\t", "one two", " ".join(words(rng, 9000, 10 ** 6)), "été " * 150]
    rows = [(i, t, "en", "ab"[i % 2], len(t), 7, 1) for i, t in enumerate(texts)]
    rows += [(None, texts[3], None, None, None, None, None), (500, None, None, "a", None, None, None), (5, texts[5], "en", "b", 1, 1, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return [r.asDict() for r in df.collect()]


def test_repeated_words_against_windows(corpus, nothing):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    first = {}
    for doc, text in sorted(((d, t) for d, t in rows if d is not None and t), key=lambda r: r[0]):
        w = text.split()
        for p in range(len(w) - 19):
            at = first.setdefault(tuple(w[p:p + 20]), (doc, p))
            first[tuple(w[p:p + 20])] = min(at, (doc, p))
    expected = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for p in range(len(w) - 19 if doc is not None else 0):
            if first[tuple(w[p:p + 20])] != (doc, p):
                gone.update(range(p, p + 20))
        expected.append((doc, len(w), " ".join(x for i, x in enumerate(w) if i not in gone), len(gone)))
    got = [(r["doc_id"], r["n_words"], r["kept"], sum(s["end"] - s["start"] for s in r["removed"])) for r in plain(remove_repeated_words(corpus))]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert remove_repeated_words(nothing).count() == 0


@pytest.mark.parametrize("largest,window", [(20000, 400), (1, 400), (20000, 200), (3, 128)])
def test_repeated_bytes_against_windows(corpus, nothing, largest, window):
    rows = [(r.doc_id, (r.text or "").encode()) for r in corpus.collect()]
    count = {}
    for _, t in rows:
        for p in range(len(t) - window + 1):
            count[t[p:p + window]] = count.get(t[p:p + window], 0) + 1
    expected = []
    for doc, t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            if count[t[p:p + window]] > 1:
                gone[p:p + window] = True
        expected.append((doc, len(t), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    got = [(r["doc_id"], r["n_bytes"], hashlib.sha256(r["kept"]).hexdigest()) for r in plain(remove_repeated_bytes(corpus, largest=largest, window=window))]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert remove_repeated_bytes(nothing).count() == 0


def test_column_bwt_orders_suffixes():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    width = max(map(len, texts))
    rows = np.zeros((len(texts), width), np.uint8)
    for i, t in enumerate(texts):
        rows[i, width - len(t):] = np.frombuffer(t.encode(), np.uint8)
    owner, length, prefix = column_bwt(rows, np.array([len(t) for t in texts]))
    suffixes = [texts[o][len(texts[o]) - n:] for o, n in zip(owner, length)]
    assert suffixes == sorted(suffixes) and len(suffixes) == sum(len(t) + 1 for t in texts)
    for a, b, n in zip(suffixes, suffixes[1:], prefix[1:]):
        assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_similar_documents_against_all_pairs(corpus, nothing):
    rows = [(r.doc_id, (r.text or "").split()) for r in corpus.collect()]
    sets = [(d, {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()) for d, w in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, x) in enumerate(sets):
        for j, (b, y) in enumerate(sets[:i]):
            if x and y and a is not None and b is not None and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    expected = [(d, len(s), None if d is None else low[find(i)]) for i, (d, s) in enumerate(sets)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in plain(similar_documents(corpus))]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert similar_documents(nothing).count() == 0


def test_similar_documents_read_a_set_once(spark, monkeypatch):
    rng = random.Random(9)
    near, far = words(rng, 120, 10 ** 6), words(rng, 250, 10 ** 6)
    # a chain of linked windows, and windows that share much but never enough
    texts = [near[i:i + 60] for i in range(0, 60, 3)] + [far[i:i + 60] for i in range(0, 190, 8)]
    put, read = Shelf.put, []

    def watched(shelf, df):
        out = put(shelf, df)
        if "grams" in out.columns:
            read.append([r["node"] for r in out.select("node").collect()])
        return out

    monkeypatch.setattr(Shelf, "put", watched)
    got = plain(similar_documents(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")))
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == [0] * 20 + list(range(20, len(texts)))
    nodes = sum(read, [])
    assert len(read) > 1 and len(nodes) == len(set(nodes)) > 0


def test_components_against_union_find(spark):
    rng = random.Random(4)
    chain = rng.sample(range(1000, 1200), 200)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + list(zip(chain, chain[1:])) + [(2000, i) for i in range(1990, 2050)]
    root = {x: x for e in edges for x in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = components(spark.createDataFrame(edges, "a long, b long"), Shelf(spark)).collect()
    assert sorted(map(tuple, got)) == [(x, find(x)) for x in sorted(root)]


def test_exact_search_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, rng.normal(0, 0.3, 8).tolist()) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 420)]
    odd = [(None, [0.1] * 8), (901, None), (902, []), (920, [float("nan")] * 8), (940, [None] * 8), (960, [float("inf")] * 8)]
    got = plain(exact_top_k(spark.createDataFrame(vectors + odd + vectors[:3], "vec_id long, embedding array<float>"), lambda k: k % 20 == 0))
    whole = {i: np.floor(64 * np.float32(v).astype(float)).astype(int) for i, v in vectors}
    expected = set()
    for q in range(0, 420, 20):
        best = sorted((-int(whole[q] @ whole[c]), c) for c in whole if c != q)[:20]
        expected |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == expected and len(got) == len(expected)
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda k: k % 20 == 0).count() == 0


def test_main_text():
    page = ('<html><head><title>T</title><script>var a = "</p>";</script></head><body><nav><a href="/">Home</a></nav><div class="ad">Buy this.</div>'
            '<article><h1>Head &amp; more</h1><p>The first of the paragraphs is   about <b>the</b> thing and it was read by us.<br>Next.<p>Short.</p>'
            '<form>Name <input></form><aside>Side</aside></article><div id="comments"><p>I think that this is the best of all of the pages on it.</p></div>'
            '<footer>&copy; us</footer>')
    assert main_text(page) == "Head & more\nThe first of the paragraphs is about the thing and it was read by us. Next.\nShort."
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == ""
    loose = "<div><p>It is the case that the rules of this page are met by the words in it.</p><p>So.</p></div><ul><li><a>One</a><li><a>Two</a></ul>"
    assert main_text(loose) == "It is the case that the rules of this page are met by the words in it.\nSo."


@pytest.mark.parametrize("wrapper", ["class='content has-sidebar'", "class='content-with-sidebar'", "class=nav-layout", "id='main-search'", "class='page layout--sidebar'"])
def test_main_text_within_named_wrappers(wrapper):
    said = "It is the case that the rules of this page are met by the words in it."
    aside = '<div class="sidebar-left"><p>That is what the others have read on the pages of this site.</p></div>'
    for tag in ("article", "main"):
        page = f"<body><div {wrapper}><{tag}><h1>Head</h1><p>{said}</p><div class=ad>{said}</div></{tag}>{aside}</div><footer><article>{said}</article></footer>"
        assert main_text(page) == f"Head\n{said}"
    if "search" not in wrapper:
        assert main_text(f"<body><div {wrapper}><p>{said}</p>{aside}</div>") == said
    assert main_text(f"<main><p>{said}</p><div id=comments><article class=comment-body><p>I think that it is so, and that they are right on it.</p></article></div>") == said


def test_mixing_meets_targets(corpus, nothing):
    got = plain(mix_sources(corpus))
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["target"] <= 3 * r["source_size"] + 1e-6
        mass, target, taken = by.get(r["source"], (0, r["target"], 0))
        by[r["source"]] = mass + r["size"], target, taken + r["size"] * r["copies"]
    assert abs(sum(t for _, t, _ in by.values()) - total) < 1e-6 * total
    for source, (mass, target, taken) in by.items():
        assert abs(taken - target) <= max(20, 0.01 * target), source
    assert got and sorted(map(str, got)) == sorted(map(str, plain(mix_sources(corpus))))
    assert mix_sources(nothing).count() == 0
    # the rows themselves: same copies, all columns, for keys that do not repeat
    clashing = corpus.withColumns({"size": F.lit("old"), "_key": F.lit("k"), "n": F.lit(1), "least": F.lit(2)})
    rows = mixed_rows(clashing)
    assert set(rows.columns) == {*clashing.columns, "source_size", "target", "copies"}
    have = sorted((r["doc_id"] or -1, r["size"], r["copies"]) for r in plain(rows) if r["doc_id"] != 5 and r["_key"] == "k")
    assert have == sorted((r["doc_id"] or -1, r["size"], r["copies"]) for r in got if r["doc_id"] != 5 and r["copies"])
    assert mixed_rows(nothing).count() == 0


def test_decontamination_within_budget(spark, nothing):
    rng = random.Random(9)
    item = " ".join(words(rng, 40, 5000))
    edited = list(item)
    for i in range(0, len(edited), 40):
        edited[i] = "#"
    far = list(item)
    for i in range(0, len(far), 6):
        far[i] = "#"
    around = lambda t: " ".join(words(rng, 60, 5000)) + " " + t + " " + " ".join(words(rng, 60, 5000))
    docs = spark.createDataFrame([(1, around(item.upper())), (2, around("".join(edited))), (3, around("".join(far))), (4, around("")), (5, None), (None, item)],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, " "), (10, "short one")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in plain(contaminated(docs, bench))}
    assert set(got) == {(1, 7), (2, 7), (None, 7)} and got[1, 7] == 0 and 0 < got[2, 7] <= len(item) // 16
    assert contaminated(nothing, bench).count() == 0 and contaminated(docs, bench.where("false")).count() == 0
    assert sorted(r["doc_id"] for r in plain(without_leaks(docs, bench))) == [3, 4, 5]
    assert without_leaks(nothing, bench).count() == 0 and without_leaks(docs, bench.where("false")).count() == 6
    assert banded_distance("kitten", "a sitting b", 9)[0] == 2


def test_preference_pairs(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yo"), (0, 2, "user", "why"), (0, 3, "assistant", "so"),
             (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "why"), (1, 3, "assistant", "no idea"), (2, 0, "user", "alone"),
             (4, 0, None, None), (5, 0, "user", "x"), (6, 0, "user", "same"), (7, 0, "user", "same"), (None, 1, "user", "lost")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in plain(preference_pairs(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0))}
    assert set(got) == {0, 2, 3}
    pair = got[0]
    assert pair["prompt_turns"] == 3 and pair["prompt"].count("<|end|>") == 3 and pair["rejected"] == "<|assistant|>\nno idea<|end|>\n"
    span = pair["rejected_spans"][0]
    assert pair["rejected"][span["start"]:span["end"]] == "no idea<|end|>" and got[3]["chosen"] == got[3]["rejected"] == ""


def test_classifiers(spark, corpus, nothing):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 80, 300)) + (" vile" if i % 5 == 0 else ""), "en") for i in range(400)]
    rows += [(i, "### " * 60, None) for i in range(400, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 400), int(i % 5 == 0 and i < 400)) for i in range(500)], "doc_id long, quality int, toxic int")
    fold = F.col("doc_id") % 4
    good = {r["doc_id"]: r["score"] for r in plain(score_quality(docs, labels, fold < 2, fold == 2))}
    assert all((s >= 0.3) == (i < 400) for i, s in good.items())
    bad = {r["doc_id"]: r["score"] for r in plain(flag_toxic(docs, labels, fold < 2, fold == 2)) if r["doc_id"] % 4 == 3}
    assert np.mean([(s >= 0.3) == (i % 5 == 0 and i < 400) for i, s in bad.items()]) > 0.95
    none = labels.where("false")
    for table in (corpus, nothing):
        assert score_quality(table, none, fold < 2, fold == 2).count() == table.count() == flag_toxic(table, labels, fold < 2, fold == 2).count()
    assert pool_adjacent(np.array([0.0, 2, 1, 3]), np.ones(4)).tolist() == [0, 1.5, 1.5, 3]


def test_pipeline_stages(spark, corpus, nothing, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(69, 0, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, corpus.where("doc_id = 2").first().text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    near = corpus_pipeline.near_duplicates(spark, corpus, str(tmp_path))
    kept = {r.doc_id for r in near.collect()}
    assert near.columns == corpus.columns and kept & set(range(42, 62)) == {42} and set(range(30)) <= kept
    cut = corpus_pipeline.repeated_passages(spark, near, str(tmp_path))
    assert cut.columns == corpus.columns and cut.where("doc_id = 30").first().n_chars < near.where("doc_id = 30").first().n_chars
    assert 2 not in {r.doc_id for r in corpus_pipeline.benchmark_leaks(spark, corpus, str(tmp_path)).collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert set(corpus.columns) <= set(stage(spark, corpus, str(tmp_path)).columns)
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_one_row_of_each_group_passes_deduplication(spark, tmp_path):
    """Keys that repeat or are missing: copies go but for one, and repeated_passages then finds nothing to cut."""
    rng = random.Random(11)
    a, b, c, e, f = (words(rng, 120, 10 ** 6) for _ in range(5))
    near = lambda w: " ".join([*w[:-1], "edit"])
    one, two, three, five, six = (" ".join(w) for w in (a, b, c, e, f))
    rows = [(1, one), (1, one), (1, one), (3, two), (None, two), (None, near(b)), (None, three), (None, three),
            (4, five), (5, near(e)), (5, six), (7, None), (7, None), (None, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t or ""), 7, 1) for i, t in rows], SCHEMA).repartition(4)
    near_free = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    kept = sorted(((r.doc_id, r.text) for r in near_free.collect()), key=str)
    assert near_free.columns == docs.columns
    assert kept == sorted([(1, one), (3, two), (None, three), (4, five), (5, six), (7, None), (7, None), (None, None), (8, ""), (8, "")], key=str)
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.repeated_passages(spark, near_free, str(tmp_path)).collect()), key=str) == kept


def test_pipeline_keeps_columns_with_inner_names(spark, tmp_path):
    """Stages carry every column through, whatever its name, and change none but text and n_chars."""
    rng = random.Random(12)
    inner = ["row", "_row", "_quality", "score", "kept", "removed", "n_bytes", "cut", "left", "one", "two", "stays", "once", "component_id", "n_shingles",
             "_text", "_key", "_hits", "_marks", "_c0", "doc", "n", "x.y"]
    passage = words(rng, 60)
    rows = [(i, " ".join(words(rng, 70, 10 ** 5) + (passage if i % 4 == 0 else [])), "en", "ab"[i % 2], 500, *[100 * i + k for k in range(len(inner))]) for i in range(40)]
    rows += [(100, rows[1][1], *rows[1][2:])]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in inner)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(rng, 30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = {r[0]: r for r in rows}
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = {r[0]: tuple(r) for r in out.collect()}
        assert all(got[i][5:] == before[i][5:] and got[i][2:4] == before[i][2:4] for i in got) and len(got) >= 39
    mixed = corpus_pipeline.source_mix(spark, docs, str(tmp_path))
    assert mixed.columns[: len(docs.columns)] == docs.columns
    cut = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, str(tmp_path)).collect()}
    assert all((" ".join(passage[2:-2]) in before[i][1]) == (len(cut[i].text) < len(before[i][1])) for i in range(2, 40))
    assert all(cut[i].n_chars == len(cut[i].text) for i in range(0, 40, 4))
