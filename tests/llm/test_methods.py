"""Inner steps of the training-data operators against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.llm.decontaminate import HITS, Index, _found, normal
from voxcohort.llm.html_text import extract_text, main_text
from voxcohort.llm.quality import Kernel, _sums
from voxcohort.llm.source_mixing import mix_sources
from voxcohort.llm.toxicity import FILTERS, WIDTHS, Network, word_codes


def sellers(item, text):
    """Least edits between the item and any part of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, a in enumerate(item, 1):
            new.append(min(row[i - 1] + (a != c), row[i] + 1, new[i - 1] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_edits_anywhere_against_the_full_table():
    rng = random.Random(1)
    for _ in range(250):
        item = normal("".join(rng.choice("abcdefgh ij") for _ in range(rng.choice([20, 33, 60, 100])))) or "x"
        index = Index([(1, item)])
        budget, edited = int(index.budget[0]), list(item)
        for _ in range(rng.randrange(budget + 3)):
            at = rng.choice([0, 0, len(edited) - 1, rng.randrange(max(1, len(edited)))])
            kind = rng.random()
            if kind < 0.5 and edited:
                edited.pop(min(at, len(edited) - 1))
            elif kind < 0.75:
                edited.insert(at, rng.choice("abcdefgh"))
            elif edited:
                edited[min(at, len(edited) - 1)] = rng.choice("abcdefgh")
        around = ["".join(rng.choice("abcxyz") for _ in range(rng.choice([0, 0, 1, 3, 50]))) for _ in range(2)]
        text = normal(around[0] + "".join(edited) + around[1])
        want, got = sellers(item, text), min((d for _, d, _ in _found(text, index)), default=None)
        assert got == (want if want <= budget else None), (item, text)


def test_items_without_their_first_characters():
    item = " ".join(f"word{i}x{i * 7}" for i in range(40))
    index = Index([(1, item)])
    for less in range(1, int(index.budget[0]) + 1):
        rest = item[less:].strip()  # texts are compared without white space at their ends
        found = list(_found(rest + " and more text follows here", index))
        assert all(d == len(item) - len(rest) and end == len(rest) for _, d, end in found) and (found or len(item) - len(rest) > index.budget[0])


def test_counts_of_grams_do_not_depend_on_their_parts(monkeypatch):
    item, text = normal("ab c " * 40), normal("x " * 30 + "ab c " * 90)
    whole = list(Index([(1, item)]).regions(text))
    monkeypatch.setattr("voxcohort.llm.decontaminate.HITS", 100)
    assert HITS > 100 and whole and list(Index([(1, item)]).regions(text)) == whole


ENGLISH = ("<p>The first paragraph of the article is about the history of the town and of its people.</p><p><a href=x>Read the whole report</a> here.</p>"
           "<p>The second one is about the river and the bridge that was built over it in the war.</p>")
FIRST, LINK, SECOND = ("The first paragraph of the article is about the history of the town and of its people.", "Read the whole report here.",
                       "The second one is about the river and the bridge that was built over it in the war.")


@pytest.mark.parametrize("page,expected", [
    ("<form id=aspnetForm>%s</form>", [FIRST, SECOND]), ("<form><nav><a>Home</a></nav><article>%s</article></form>", [FIRST, LINK, SECOND]),
    ("<nav><ul><li><a>x</a></li></ul><article>%s</article>", [FIRST, LINK, SECOND]), ("<article>%s</article><form><p>Your name and the mail of you</p></form>", [FIRST, LINK, SECOND]),
    ("<nav><ul><li><a>x</a></li></ul><div>%s</div>", [FIRST, SECOND]), ("<article>%s<ul><li><a href=a>Other news of the day</a></li></ul></article>", [FIRST, LINK, SECOND])])
def test_pages_in_wrappers(page, expected):
    assert main_text("<html><body>" + page % ENGLISH + "<footer>All rights of the page are reserved by the owner of it</footer></body></html>") == "\n".join(expected)


@pytest.mark.parametrize("said", [
    ["To jest pierwszy akapit artykułu w języku polskim, który opisuje coś ważnego i ma kilka zdań.", "Drugi akapit opisuje dalsze szczegóły oraz podaje przykłady, które pokazują, jak to działa."],
    ["这是一篇关于机器学习的文章，介绍了许多重要的概念和方法，并且给出了例子。", "第二段继续讨论这些方法的优点和缺点，以及它们在实践中的应用情况。"]])
def test_pages_in_other_languages(said):
    body = "".join(f"<p>{t}</p>" for t in said)
    assert main_text(f"<body><nav><ul><li><a href=a>Menu</a></li></ul></nav><div>{body}</div><footer>stopka</footer></body>") == "\n".join(said)


def test_extract_text_of_awkward_rows(spark):
    rows = [(1, "u", None, "old"), (2, None, "", "old"), (None, "u", f"<article>{ENGLISH}</article>", "old"), (3, "u", "<", None), (3, "u", "<div " * 300, None), (3, "u", "<div " * 300, None),
            (4, "u", "<p>" * 5000 + "&lt;b&gt; x", None), (5, "u", "<nav><a href=x>Home</a></nav>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_text(pages)
    got = [(r.page_id, r.text) for r in out.collect()]
    assert out.columns == pages.columns and got[:2] == [(1, ""), (2, "")] and got[2][1].startswith(FIRST) and got[-1] == (5, "")
    assert extract_text(pages.where("false")).count() == 0


def water_filled(masses, weights=(5, 2, 1), most=3):
    """Targets of the sources in code-point order, null last, one filling after the other."""
    order = sorted(masses, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, target = sum(masses.values()), set(), {}
    while True:
        left = total - sum(most * masses[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        target = {s: most * masses[s] if s in full else left * weight[s] / open_weight for s in order}
        over = {s for s in order if s not in full and target[s] > most * masses[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"b": 40, "a": 400, None: 9, "é": 100, "Z": 3}, {"x": 5, "y": 5}, {None: 7}, {"a": 1, "b": 1000, "c": 1000, "d": 1, "e": 1, "f": 50}])
def test_targets_by_filling_up(spark, sizes):
    rows = [(i, " ".join(["w"] * (1 + i % 4)), s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    masses = {s: sum(1 + i % 4 for i in range(n)) for s, n in sizes.items()}
    targets = water_filled(masses)
    got = mix_sources(docs).select("source", "source_size", "target").distinct().collect()
    assert {r.source: r.source_size for r in got} == masses
    assert {r.source: r.target for r in got} == pytest.approx(targets)


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 31))
    kernel = Kernel(x.mean(axis=0), x.std(axis=0), 20000)
    z = kernel(x)[:, :-1]
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    exact = np.exp(-((scaled[:, None] - scaled[None]) ** 2).sum(axis=2) / (2 * x.shape[1]))
    assert np.abs(z @ z.T - exact).max() < 0.06


def test_partition_sums_make_the_normal_equations():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 31)), rng.random(40)
    kernel = Kernel(x.mean(axis=0), x.std(axis=0), 16)
    batch = lambda a, b: pa.record_batch([pa.array(x[a:b].tolist()), pa.array(y[a:b])], ["x", "y"])
    total = np.zeros((17, 18))
    for part in ([batch(0, 7), batch(7, 20)], [batch(20, 40)], []):
        for out in _sums(iter(part), kernel):
            total[np.asarray(out["i"]), np.asarray(out["j"])] += np.asarray(out["value"])
    z = kernel(x)
    assert np.allclose(total, z.T @ np.column_stack([z, y]))


def test_pooling_against_every_window():
    """Largest filter answers of each text, for texts shorter than a filter too."""
    network = Network()
    network.known[:] = True
    codes, counts = word_codes([b"a b c d e f", b"", b"one", b"two words", b"z z z z"])
    ends = np.cumsum(counts)
    x = network.embed(codes)
    got, placed = network.pooled(x, ends), network.pooled(x, ends, places=True)
    assert np.allclose(got, placed[0], atol=1e-6)
    for t, (a, b) in enumerate(zip(ends - counts, ends)):
        for f, (width, filters, bias) in enumerate(zip(WIDTHS, network.filters, network.bias)):
            answers = [sum(x[i + k] @ filters[k] for k in range(width)) + bias for i in range(a, b - width + 1)]
            want = np.maximum(np.max(answers, axis=0), 0) if answers else np.zeros(FILTERS)
            assert np.allclose(got[t, f * FILTERS:(f + 1) * FILTERS], want, atol=1e-5)


def test_labels_of_repeated_keys_and_long_texts(spark):
    from voxcohort.llm.quality import score_quality

    rows = [(i, "good words of a plain text " * 30 if i % 2 else "#!%$ " * 40, "en", 1.0) for i in range(80)] + [(500, "word " * 300_000, None, 1.0), (None, None, None, None), (3, "", "en", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] * 2 + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    fold = F.floor(F.col("doc_id") / 2) % 4  # both labels in every fold
    out = score_quality(docs, labels, fold < 2, fold == 2)
    got = out.collect()
    assert out.columns == docs.columns and len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.3) == (r.doc_id % 2 == 1) for r in got if r.doc_id is not None and r.doc_id < 80 and r.text)


def test_anchors_in_steps(monkeypatch):
    """Windows of equal content have the same anchor wherever the words are cut for parsing."""
    from voxcohort.llm import recompression

    rng = np.random.default_rng(5)
    names = rng.integers(1, 60, 900).astype(np.uint64)
    names[500:700] = names[100:300]
    text = np.repeat(np.arange(3), 300)
    whole = recompression.anchors(names, text, 20, 2)
    monkeypatch.setattr(recompression, "STEP", 37)
    cut = recompression.anchors(names, text, 20, 2)
    of = lambda found: {w: (int(a) - w, int(k)) for a, k, f, z in zip(*found) for w in range(f, z + 1)}
    assert of(cut) == of(whole) and len(of(whole)) == 3 * 281


def test_search_leaves_out_vectors_beyond_exact_scores(spark):
    from voxcohort.llm.exact_search import exact_top_k

    rows = [(i, [float(i), 1.0]) for i in range(30)] + [(40 + i, [1e20, float(i)]) for i in range(40)] + [(90, [1e8, 1.0]), (100, [3e5, 1.0])]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda key: key % 20 == 0).collect()
    assert {r.query_id for r in got} == {0, 20, 100} and {r.vec_id for r in got} <= {*range(30), 100}
    assert {r.score for r in got if r.query_id == 100 and r.rank == 1} == {64 * 300_000 * 64 * 29 + 4096}
