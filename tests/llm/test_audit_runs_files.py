"""Filter audit, periodic runs and token files against plain versions, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxcohort.llm import mixing_coder
from voxcohort.llm.common import mix
from voxcohort.llm.filter_audit import audit, failing_ids
from voxcohort.llm.periodic_runs import periodic_runs, runs_of
from voxcohort.llm.queries import op12
from voxcohort.llm.suffix_tree import SuffixTree
from voxcohort.llm.token_files import Encoder, coded_tokens, joined_checksum, pack, read_token_files, unpack, write_token_files

DOCS = "doc_id long, text string, lang string, part string, n long, step int, kept string, runs string, frame binary"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, "k", "r", b"f") for i, t, lang in rows], DOCS).repartition(3)


# --- filter audit -----------------------------------------------------------------------------

def plain_audit(rows, labels):
    """All orders, row by row."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    judged = []
    for i, text, lang in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A"} if len(w) < 100 else set()
        fails |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows) else set()
        judged.append((lang or "", fails, i in good, i in toxic))
    out, shapley = {}, {}
    for part in {p for p, *_ in judged}:
        mine = [r for r in judged if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, stay = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = (len(stay), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine),
                                                   sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_plain_orders(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        text = " ".join(f"w{rng.randrange(rng.choice([60, 900]))}" for _ in range(rng.choice([20, 99, 100, 130])))
        text = text.upper() if rng.random() < 0.2 else text
        rows.append((i, text + rng.choice(["", "", " #"]), rng.choice(["en", "de", "", None])))
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(30)]
    rows += [(3, rows[3][1], rows[3][2])] * 2 + [(None, rows[5][1], "en"), (None, None, None), (300, "", "en"), (301, None, "en"), (302, "\t \n", "en")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 240, 2)] + [(4, 1, 1), (None, 1, 1), (7, None, None)]
    found = failing_ids(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {tuple(r[:3]): tuple(r[3:]) for r in audit(found).collect()}
    assert got == plain_audit(rows, labels)
    assert audit(found).columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    # the relations behind the sums
    total = lambda df: df.agg(F.sum("n")).first()[0] or 0
    failing = total(found.removed([], "E"))
    assert total(found.removed("AB", "E")) + total(found.redundant("AB", "E")) == failing > 0
    assert total(found.survivors("AB")) - total(found.survivors("ABE")) == total(found.removed("AB", "E"))


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(failing_ids(none, labels)).count() == 0
    one = {tuple(r[:3]): r.asDict() for r in audit(failing_ids(table(spark, [(1, "a", None)]), labels)).collect()}
    assert len(one) == 600 and one["", "ABCDE", 1]["removed"] == 1 and one["", "BACDE", 1]["kept"] == 1 and one["", "ABCDE", 5]["shapley"] == 0


# --- periodic runs ----------------------------------------------------------------------------

def plain_runs(w, shortest):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            begin = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > begin and i - begin + q >= max(shortest, 2 * q):
                found.setdefault((begin, i - begin + q), q)
            i += i == begin
    return sorted((s, n, q) for (s, n), q in found.items())


def sequences(rng):
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(0, 70))]
        if len(w) > 5 and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randrange(1, len(w) // 2)
            w[a:] = [w[a + (i - a) % p] for i in range(a, len(w))]
        yield w


def test_runs_against_all_periods():
    rng = random.Random(9)
    for w in sequences(rng):
        other = [rng.randrange(2) for _ in range(rng.randrange(20))]
        for shortest in (2, 5, 12):
            names = mix(np.array(w + other, np.uint64) + np.uint64(5)) if w + other else np.zeros(0, np.uint64)
            got = sorted(zip(*(x.tolist() for x in runs_of(names, np.repeat([0, 1], [len(w), len(other)]), shortest))))
            assert got == plain_runs(w, shortest) + [(s + len(w), n, q) for s, n, q in plain_runs(other, shortest)]


def test_suffix_tree_extensions():
    rng = random.Random(1)
    for _ in range(60):
        w = [1 + rng.randrange(2) for _ in range(rng.randrange(1, 40))] + [0]
        tree = SuffixTree(np.array(w))
        place = tree.prepare()
        assert sorted(range(len(w)), key=lambda i: w[i:]) == np.argsort(place).tolist()
        a, b = (np.array(x) for x in zip(*((i, j) for i in range(len(w)) for j in range(len(w)) if i != j)))
        common = [next(k for k in range(len(w)) if w[i + k:i + k + 1] != w[j + k:j + k + 1]) for i, j in zip(a, b)]
        assert tree.extension(a, b).tolist() == common


def test_runs_of_documents(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{x}" for x in w) for w in itertools.islice(sequences(rng), 40)]
    texts += ["a " * 30000, "\t x\ny  x\ny " * 9, "", None, "été " * 12, "one two", " ".join(f"u{i}" for i in range(60000))]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, "z " * 20, None), (0, "z " * 20, None), (0, "z " * 20, None)]
    got = {}
    for r in periodic_runs(table(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    for key, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(set(w)) < 2 < len(w):
            runs = [(0, len(w), 1)] if len(w) >= 12 else []
        else:
            runs = plain_runs(w, 12) if len(w) < 1000 else []
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert (len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)) in got[key]
    assert periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_runs_query_takes_documents_without_words(spark, tmp_path):
    rng = random.Random(4)
    texts = [None, "", " \t\n", " ".join(f"w{rng.randrange(1000)}" for _ in range(90))]
    rows = [(i, t) for i in range(40) for t in texts] + [(None, t) for t in texts]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def wanted(i, text):
        w, h = (text or "").split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            w[a:] = [w[a + (k - a) % (1 + (n - a) // (3 + g % 8))] for k in range(a, n)]
        runs = plain_runs(w, 12)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {k for s_, n_, q_ in runs for k in range(s_ + q_, s_ + n_)}
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return (i, len(runs), s, n, q, runs and 1000 * n // q or None, digest("".join(f"{x},{y},{z}\n" for x, y, z in runs)),
                digest(" ".join(x for k, x in enumerate(w) if k not in gone)))

    got = sorted((tuple(r) for r in op12(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((wanted(*r) for r in rows), key=str) and any(r[1] for r in got)


# --- token files ------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def blocks(rng):
    yield np.zeros(0, np.int64)
    yield np.array([0])
    yield np.array([2 ** 32 - 1, 0, 2 ** 32 - 1])
    yield np.full(8192, 7)
    yield rng.integers(0, 50257, 8192)
    yield np.resize(rng.integers(0, 50257, 40), 5000)
    for _ in range(20):
        yield rng.zipf(1.3, rng.integers(1, 900)) % 60000


def test_coder_round_trip_and_independence():
    all_blocks = list(blocks(np.random.default_rng(6)))
    coded = mixing_coder.encode(all_blocks)
    for want, got in zip(all_blocks, mixing_coder.decode(coded, [len(b) for b in all_blocks])):
        assert want.tolist() == got.tolist()
    # a block's bytes depend on nothing but the block
    for i in (3, 5, 9):
        alone = mixing_coder.encode([all_blocks[i]])[0]
        assert alone[1] == coded[i][1] and mixing_coder.decode([coded[i]], [len(all_blocks[i])])[0].tolist() == all_blocks[i].tolist()
    assert len(coded[3][1]) < 300 and len(coded[5][1]) < 2500  # a constant and a periodic block


def test_carries_run_back():
    """Near the top of the interval a later part can still raise words already written."""
    rng = np.random.default_rng(8)
    many = [np.concatenate([np.full(rng.integers(1, 40), 9), rng.integers(0, 10, rng.integers(1, 60))]) for _ in range(600)]
    for want, got in zip(many, mixing_coder.decode(mixing_coder.encode(many), [len(b) for b in many])):
        assert want.tolist() == got.tolist()


def test_frames_detect_damage():
    parts = np.zeros(1, [("row", "<i8"), ("key", "<i8"), ("null", "u1"), ("ids", "<u4")])
    alphabet, payload = mixing_coder.encode([np.array([5, 5, 300, 2 ** 32 - 1])])[0]
    frame = pack(17, 4, alphabet, payload, parts)
    first, count, ids, data, table = unpack(frame)
    assert (first, count, ids.tolist(), data, len(table)) == (17, 4, [5, 300, 2 ** 32 - 1], payload, 1)
    for i in range(len(frame)):
        with pytest.raises(ValueError):
            unpack(frame[:i] + bytes([frame[i] ^ 1]) + frame[i + 1:])
    with pytest.raises(ValueError):
        unpack(frame[:-9])


def test_joined_checksum():
    rng = random.Random(5)
    for _ in range(50):
        parts = [rng.randbytes(rng.choice([0, 1, 4, 1000])) for _ in range(rng.randrange(1, 5))] + [bytes(4)]
        assert joined_checksum([zlib.crc32(p) for p in parts], map(len, parts)) == zlib.crc32(b"".join(parts))


def expected(rows, tokenizer):
    from tokenizers import Tokenizer

    plain, start, out = Tokenizer.from_file(tokenizer), 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for key, text, _ in order:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def awkward(rng):
    texts = [" ".join(rng.choice(["été", "don't", "x1", "The", "the", "don't!", "a\tb", "\n", "", " ", "naïve word", "日本", "<|endoftext|>", "\x1c", "9"])
                      for _ in range(rng.randrange(0, 80))) for _ in range(60)]
    texts += ["", None, " lead", "trail ", "  two  spaces ", "\r\n", "a" * 3000, "word " * 4000, "<|endoftext|> <|endoftext|>"]
    return [(7 * i % 101, t, "en") for i, t in enumerate(texts)] + [(None, "no key", None), (None, None, None), (7, "same", None), (7, "same", None)]


def test_pieces_give_the_same_ids(tokenizer):
    texts = [t or "" for _, t, _ in awkward(random.Random(3))]
    maker = Encoder(tokenizer)
    assert maker.cuts
    plain = [e.ids for e in maker.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in maker.encode(texts)] == plain


@pytest.mark.parametrize("block,lanes", [(8192, 1024), (50, 3), (1, 64)])
def test_token_files_round_trip(spark, tokenizer, tmp_path, block, lanes):
    rows = awkward(random.Random(block))[-40 if block == 1 else 0:]
    path = f"{tmp_path}/ids"
    write_token_files(table(spark, rows), path, tokenizer, block=block, lanes=lanes)
    frames = spark.read.parquet(path)
    assert frames.agg(F.max("n")).first()[0] <= block
    got = [tuple(r) for r in read_token_files(frames, lanes).collect()]
    assert sorted(got, key=str) == expected(rows, tokenizer)


def test_token_files_of_nothing(spark, tokenizer):
    assert coded_tokens(spark.createDataFrame([], DOCS), tokenizer).count() == 0
    got = coded_tokens(table(spark, [(4, None, None)]), tokenizer)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and [tuple(r) for r in got.collect()] == [(4, 0, 1, zlib.crc32(bytes(4)))]
