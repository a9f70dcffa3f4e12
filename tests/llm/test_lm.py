"""Corpus scoring by the Kneser-Ney model against plain Python."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.brute import AZ, WORD
from tidemark.llm import lm


def tokens(text):
    return [*WORD.findall((text or "").translate(AZ)), None]


def brute(docs):
    """docs: (doc_id, text) -> rows of the result, by the textbook's formulas."""
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs]
    train = [tokens(t) for (_, t), h in zip(docs, held) if not h]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<", *t], t))
    n, v = sum(count.values()), len(count)
    left = Counter(w for _, w in pairs)
    after = defaultdict(list)
    for (a, _), c in pairs.items():
        after[a].append(c)

    def discount(counts):
        k = [sum(c == i for c in counts) for i in (1, 2, 3, 4)]
        if not all(k):
            return (0, *lm.FALLBACK)
        y = k[0] / (k[0] + 2 * k[1])
        d = [i - (i + 1) * y * k[i] / k[i - 1] for i in (1, 2, 3)]
        return (0, *(x if 0 < x <= i else f for x, i, f in zip(d, (1, 2, 3), lm.FALLBACK)))

    d1, d2 = discount(left.values()), discount(pairs.values())

    def low(w):
        if not pairs:
            return 1 / (v + 1)
        return (left[w] - d1[min(left[w], 3)]) / len(pairs) + sum(d1[min(c, 3)] for c in left.values()) / len(pairs) / (v + 1)

    def prob(a, w):
        if a not in after:
            return low(w)
        den, c = sum(after[a]), pairs[a, w]
        return (c - d2[min(c, 3)]) / den + sum(d2[min(x, 3)] for x in after[a]) / den * low(w)

    out = []
    for (d, t), h in zip(docs, held):
        ws = tokens(t)
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((d, h, len(ws), sum(w in count for w in ws), n, base, sum(math.log10(prob(a, w)) for a, w in zip(["<", *ws], ws))))
    for a in ["<", *list(count)[:5]]:  # a distribution, the unknown word included
        assert abs(sum(prob(a, w) for w in [*count, "never seen"]) - 1) < 1e-9
    return out


def compare(spark, docs, **how):
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, batch int")
    got = lm.score_corpus(df, **how)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got, want = (sorted(map(tuple, rows), key=lambda r: (str(r[0]), *r[1:])) for rows in (got.collect(), brute(docs)))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    return got


def test_scores_against_brute_force(spark):
    r = random.Random(3)
    voc = [f"w{i}" for i in range(60)] + ["The", "the", "THE", "é", "É", "x\x1cy", " ", "<s>", "</s>"]
    heavy = [voc[min(int(r.expovariate(0.2)), len(voc) - 1)] for _ in range(4000)]
    docs = [(d, r.choice(" \n\t\x0b").join(r.choice(heavy) for _ in range(r.randrange(60)))) for d in range(150)]
    docs += [(900, None), (901, ""), (902, " \n "), (None, "the w1 w2"), (None, None), (7, docs[7][1]), (903, "the " * 5000), (904, "words nobody knows"), (50, "unseen " * 3)]
    compare(spark, docs)
    compare(spark, docs, batch_bytes=1000, shard_bytes=3000)


def test_model_stays_in_a_folder_if_asked(spark, tmp_path):
    docs = [(d, f"a b c{d % 5} a b") for d in range(30)]
    compare(spark, docs, model_dir=f"{tmp_path}/model")
    kept = [np.load(f) for f in (tmp_path / "model").glob("*.npy")]
    pairs = {tuple(p) for d, t in docs if zlib.crc32(str(d).encode()) % 10 for p in zip(["<", *tokens(t)], tokens(t))}
    assert kept and len(pairs) in map(len, kept)


def test_odd_corpora(spark):
    assert compare(spark, [(0, None)])
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0)
    rows = compare(spark, [(held, "nothing to learn from")])
    assert rows[0][3:5] == (0, 0) and rows[0][6] == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_corpus(empty).collect() == []


def test_model_beats_the_base_on_held_out_texts(spark):
    r = random.Random(5)
    docs = []
    for d in range(300):
        w = [r.randrange(40)]
        for _ in range(80):
            w.append((w[-1] * 7 + r.randrange(3)) % 40)
        docs.append((d, " ".join(f"t{x}" for x in w)))
    held = [x for x in lm.score_corpus(spark.createDataFrame(docs, "doc_id long, text string")).collect() if x.held_out]
    assert held and all(x.score > 0.6 * x.base_score for x in held)


def test_packing_and_codes():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 48, 1000).astype(np.uint64)
    assert (lm.unpacked(lm.packed(a, 6), 6) == a).all() and not len(lm.unpacked(lm.packed(a[:0])))
    assert lm.code_bytes(0) == 4 and lm.code_bytes(1 << 31) == 5 and lm.code_bytes(1 << 60) == 8
    assert (lm.shard_of(np.array([0, (1 << 64) - 1], np.uint64), 7) == [0, 6]).all()
    assert re.fullmatch(r"\d+", str(int(lm.BEGIN)))


def test_words_never_share_a_code(spark, monkeypatch):
    """With codes of one byte nearly all of 150 words would share one, and the scores are those of whole hashes."""
    r = random.Random(9)
    docs = [(i, " ".join(f"w{r.randrange(150)}" for _ in range(40))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(lm, "code_bytes", lambda n: 8)
    want = {x.doc_id: x for x in lm.score_corpus(df).collect()}
    monkeypatch.setattr(lm, "code_bytes", lambda n: 1)
    got = {x.doc_id: x for x in lm.score_corpus(df).collect()}
    assert all(got[i].score == pytest.approx(x.score, rel=1e-12) and got[i].base_score == x.base_score for i, x in want.items())


def test_codes_of_a_shard_stay_there():
    import numpy as np

    top = np.array([7, 7, 7, 8, (1 << 31) - 1, (1 << 31) - 1, 1 << 31], np.uint64) << np.uint64(32)
    h = top + np.arange(7, dtype=np.uint64)
    mine = h[lm.shard_of(h, 2) == 0]
    hashes, codes = lm.shared_codes(mine, 0, 2, 4)
    assert hashes.tolist() == [int(x) for x in h[[1, 2, 5]]] and codes.tolist() == [9, 10, (1 << 31) - 2]
    assert len(set(lm.coding(mine, 4, (hashes, codes)).tolist())) == len(mine)


def test_a_batch_hashes_each_distinct_word_once(monkeypatch):
    """The words of a batch by Arrow are those of the contract, and only distinct ones reach the hash; each token did before."""
    texts = ["", None, " \t", "a", " A a\x0bb\x0c\r\nb ", "x\x1cy \x85z É é İ", "b  ", "the " * 50]
    hashed, keep = [], lm.hash_words
    monkeypatch.setattr(lm, "hash_words", lambda ws: (hashed.extend(ws), keep(ws))[1])
    trains = np.array([True, False] * 4)
    b = lm.Batch(pa.array(texts, pa.string()), trains)
    want = [tokens(t) for t in texts]
    assert sorted(hashed) == sorted({w.encode() for t in want for w in t[:-1]})
    assert b.sizes.tolist() == list(map(len, want))
    spelled = {int(keep([w.encode()])[0]): w for t in want for w in t[:-1]} | {int(lm.END): None}
    flat = [w for t in want for w in t]
    assert [spelled[int(h)] for h in b.words[b.local]] == flat
    before = [a for t in want for a in ["<", *t[:-1]]]
    spelled[int(lm.BEGIN)] = "<"
    named = [(spelled[int(b.words[p // len(b.words)])], spelled[int(b.words[p % len(b.words)])]) for p in b.pairs]
    assert [named[k] for k in b.at()] == list(zip(before, flat))
    learned = Counter(p for p, o in zip(zip(before, flat), b.owner) if trains[o])
    assert dict(zip(named, b.counts.tolist())) == {p: learned[p] for p in named}


def test_scoring_a_batch_holds_few_numbers_a_token(tmp_path, monkeypatch):
    """Numbers that a step makes for pairs and tokens stand for a slice of them only; 153 bytes a token stood at once before, with some for each."""
    monkeypatch.setattr(lm, "STEP", 1 << 12, raising=False)
    r = np.random.default_rng(4)
    voc = np.array([f"w{i}" for i in range(2000)])
    texts = [" ".join(voc[r.integers(0, len(voc), 1000)]) for _ in range(200)]
    table = pa.table({"doc_id": np.arange(200), "text": texts, "held_out": np.arange(200) % 10 == 0, "batch": np.zeros(200, np.int64)})
    none = (np.empty(0, np.uint64),) * 2
    pairs = lm.pair_shard(lm.pieces(table, 1, 8, none), 1, 8, lm.Shards(f"{tmp_path}/m"))
    kinds = np.asarray(pairs["kind"].combine_chunks().to_numpy(zero_copy_only=False))
    words = lm.word_shard(lm.word_pieces(table, 1), pairs.filter(pa.array(np.isin(kinds, ["first", "second"]))), 8, none, lm.Shards(f"{tmp_path}/m"))
    told = pa.concat_tables([pairs.filter(pa.array(kinds == "pair")), words.filter(pa.array(np.asarray(words["kind"].combine_chunks().to_numpy(zero_copy_only=False)) == "word"))])
    sums = {k: np.zeros(7, object) for k in ("pairs", "words", "left")}
    for kind, value in zip(*(pa.concat_tables([pairs, words])[c].to_pylist() for c in ("kind", "value")), strict=True):
        if kind in ("pairs", "words"):
            x = np.frombuffer(value, "<i8").astype(object)
            sums[kind] = x[:7]
            sums["left"] = x[7:] if kind == "words" else sums["left"]
    tracemalloc.start()
    try:
        out = lm.score_batch(table, told, 1, 8, none, sums)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    tokens_ = sum(out["n_tokens"].to_pylist())
    assert tokens_ == 200 * 1001 and all(x < 0 for x in out["score"].to_pylist())
    assert most / tokens_ < 75


def test_counts_take_the_bytes_they_need():
    a = [np.array(x, np.int64) for x in ([0, 1, 255], [256, 0, 7], [1 << 40, 3, 0])]
    b = lm.leanly(*a)
    assert len(b) == 3 + 3 * (1 + 2 + 6)
    for given in (b, pa.py_buffer(b)):
        assert [x.tolist() for x in lm.columned(given, 3)] == [x.tolist() for x in a]
    assert [len(x) for x in lm.columned(lm.leanly(a[0][:0], a[1][:0]), 2)] == [0, 0]
