import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import common, suffixes


def corpus(seed, n=150):
    r = random.Random(seed)
    abc = "ab" if seed == 1 else "abcdefghij é"
    say = lambda k: "".join(r.choice(abc) for _ in range(k))
    shared = [say(r.randrange(30, 200)) for _ in range(12)]
    docs = []
    for d in range(n):
        t = "".join(say(r.randrange(40)) if r.random() < 0.5 else (lambda s, a: s[a : a + r.randrange(20, 120)])(x := r.choice(shared), r.randrange(len(x))) for _ in range(r.randrange(8)))
        docs.append((d * 7 - 300, t))
    docs += [(9000, docs[5][1] * 3), (9001, "=" * 400), (8999, "=" * 77), (9002, "-=" * 100), (9003, "x" + "-=" * 90), (9004, None), (9005, ""), (9006, "\0" * 60), (9007, "\0" * 49), (9008, "\0" * 120), (9009, "é" * 25), (9010, "é" * 24), (9011, "aé" * 40)]
    docs += [(9020 + k, shared[0] * 2) for k in range(12)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    docs = corpus(seed)
    if seed == 2:
        monkeypatch.setattr(suffixes, "BATCH", 500)
        monkeypatch.setattr(suffixes, "ENTRIES", 30)
        monkeypatch.setattr(suffixes, "SHARD", 2)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, tkey int").repartition(5)
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect())) == brute.op6(docs)


@pytest.mark.parametrize(("sample", "wide", "parts"), [(1, 4, 7), (1 << 30, 4, 40), (1 << 30, 1 << 30, 40)])
def test_common_grams(spark, sample, wide, parts, monkeypatch):
    """One gram in very many contexts: dealt by context, by strings, or in shards that merge."""
    monkeypatch.setattr(suffixes, "SAMPLE", sample)
    monkeypatch.setattr(suffixes, "WIDE", wide)
    monkeypatch.setattr(suffixes, "SHARD", 16)
    monkeypatch.setattr(suffixes, "PART_BYTES", 1000)
    r = random.Random(8)
    say = lambda k: "".join(r.choice("abcdefghijklmnop") for _ in range(k))
    core, ends = say(30), [say(40) for _ in range(20)]
    docs = [(d, say(30) + r.choice(ends)[: r.randrange(41)] + core + r.choice(ends)[-r.randrange(1, 41) :] + say(9)) for d in range(parts * 10)]
    docs += [(500, core * 3), (501, core + ends[0]), (501, core + ends[0]), (501, ends[0] + core), (3, say(3) + core + ends[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, suffixes.remove_repeats(df).collect())) == brute.op6(docs)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.remove_repeats(none).count() == 0
    t, u = "abcdefghij" * 6, "0123456789" * 6
    docs = spark.createDataFrame([(None, t), (1, t), (1, t), (2, u + t), (2, u), (3, u), (None, None)], "doc_id long, text string")
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans) for x in suffixes.remove_repeats(docs).collect())
    assert got == [("1", 60, 0, 0), ("1", 60, 0, 0), ("2", 60, 0, 0), ("2", 120, 60, 1), ("3", 60, 60, 1), ("None", 0, 0, 0), ("None", 60, 0, 0)]


def test_suffix_array_and_common_prefixes():
    rows = np.random.default_rng(0).integers(0, 2, (60, suffixes.CONTEXT)).astype(np.uint8)
    rows[30:] = np.roll(rows[:30], 3, axis=1)
    rows[59] = 0
    flat = rows.tobytes()
    sa = suffixes.suffix_array(rows)
    text = [flat[s : s + suffixes.LEAST] for s in sa.tolist()]
    assert sorted(sa.tolist()) == [m * suffixes.CONTEXT + o for m in range(60) for o in range(suffixes.SIDE + 1)]
    assert text == sorted(text)
    same = [next((k for k in range(suffixes.LEAST) if a[k] != b[k]), suffixes.LEAST) for a, b in zip(text, text[1:], strict=False)]
    assert suffixes.common_prefixes(rows, sa).tolist() == [0, *same]


def test_buckets_are_sparks(spark):
    ids = [0, 1, -1, 7, 10**12, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(i,) for i in ids], "i long")
    assert [x.h for x in df.select(F.xxhash64("i").alias("h")).collect()] == common.long_hash(np.array(ids)).view(np.int64).tolist()
    keys = common.even_keys(50)
    df = spark.createDataFrame([(k,) for k in keys], "k int").select(F.expr("pmod(hash(k), 50)").alias("p"))
    assert [x.p for x in df.collect()] == list(range(50))


def test_scratch_is_deleted(spark):
    before = {x.name for x in spark.catalog.listTables()}
    suffixes.remove_repeats(spark.createDataFrame([(1, "x" * 99), (2, "x" * 99)], "doc_id long, text string")).collect()
    assert {x.name for x in spark.catalog.listTables()} == before
