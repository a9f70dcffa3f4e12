import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tidemark.llm import graph, jaccard


def corpus(seed, n=260):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(300)]
    say = lambda k: [r.choice(voc) for _ in range(k)]
    passage, docs = say(60), []
    bases = [say(r.randrange(1, 150)) for _ in range(40)]
    for d in range(n):
        kind = r.random()
        if kind < 0.5:
            w = list(r.choice(bases[: 5 if r.random() < 0.5 else 40]))
            for _ in range(r.randrange(0, 5)):
                a = r.randrange(len(w) + 1)
                w[a : a + r.randrange(2)] = say(r.randrange(2))
        elif kind < 0.7:
            w = say(r.randrange(0, 20)) + passage + say(r.randrange(0, 20))
        elif kind < 0.8:
            w = say(r.randrange(0, 7))
        else:
            w = say(r.randrange(1, 120))
        docs.append((d * 3 - 100, " ".join(x.upper() if r.random() < 0.2 else x for x in w)))
    r.shuffle(docs)
    return docs + [(5000, None), (5001, " \n"), (5002, "one two"), (5003, "One\ttwo"), (5004, "two one"), (5005, "a b c d e " * 4000), (5006, "a b c d e " * 4001)]


@pytest.mark.parametrize("seed", [0, 1, 2, 3])
def test_against_brute_force(spark, seed, monkeypatch):
    docs = corpus(seed)
    if seed == 2:  # every room of some size is dealt to blocks
        monkeypatch.setattr(jaccard, "ROOM_GRAMS", 300)
        monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 100)
        monkeypatch.setattr(jaccard, "WIDE", 5)
        monkeypatch.setattr(jaccard, "PAIRS", 4)
    if seed == 3:  # what is away meets by prefixes
        monkeypatch.setattr(jaccard, "ROOM_GRAMS", 200)
        monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 60)
        monkeypatch.setattr(jaccard, "PREFIX_COST", 0.0)
        monkeypatch.setattr(jaccard, "PART_ENTRIES", 500)
    if seed == 1:
        monkeypatch.setattr(jaccard, "PAIRS", 4)
        monkeypatch.setattr(jaccard, "ROOM_GRAMS", 800)
        monkeypatch.setattr(jaccard, "BLOCK_GRAMS", 400)
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_shingles int").repartition(5)
    got = sorted(tuple(x)[:3] for x in jaccard.jaccard_components(df).collect())
    want = brute.op1(docs)
    assert got == want
    assert len({w[2] for w in want}) < len(want) - 50
    if seed == 0:
        kept = jaccard.deduplicate(df)
        assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(none).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect())))
    assert got == ["(1, 2, 1)", "(1, 2, 1)", "(2, 0, 2)", "(None, 2, None)"]


def test_prefix_tree_against_intersections():
    r = np.random.default_rng(3)
    for _ in range(200):
        pool = np.unique(r.integers(0, 60, 40).astype(np.uint64))
        sets = [np.sort(r.choice(pool, r.integers(1, len(pool)), replace=False)) for _ in range(12)]
        tree = jaccard.PrefixTree(sets)
        for probe in sets:
            want = [k for k, s in enumerate(sets) if len(np.intersect1d(probe, s)) >= jaccard.needed(len(probe), len(s))]
            assert sorted(tree.similar(probe, [True] * len(sets))) == want


def test_linked_sets_share_neighbours_in_their_prefixes():
    r = np.random.default_rng(5)
    tried = 0
    for _ in range(4000):
        n = int(r.integers(3, 60))
        a = np.sort(r.choice(1 << 20, n, replace=False))
        gone = r.choice(n, int(r.integers(0, n // 4 + 1)), replace=False)
        b = np.unique(np.concatenate([np.delete(a, gone), r.choice(1 << 20, int(r.integers(0, n // 3 + 1)))]))
        o = len(np.intersect1d(a, b))
        if len(b) < 3 or np.array_equal(a, b) or o < jaccard.needed(len(a), len(b)):
            continue
        tried += 1
        firsts = []
        for x in (a, b):
            k = jaccard.breaks(len(x)) + jaccard.least_shared(len(x))
            assert jaccard.least_shared(len(x)) >= 1 and k <= len(x) - 1
            firsts.append({(int(p), int(q)) for p, q in zip(x[:k], x[1 : k + 1], strict=True)})
        assert len(firsts[0] & firsts[1]) >= min(jaccard.least_shared(len(a)), jaccard.least_shared(len(b)))
    assert tried > 500


def test_bitmaps_never_part_linked_sets():
    r = np.random.default_rng(4)
    parted = 0
    for _ in range(400):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        cut = int(r.integers(0, max(1, len(a) // 3)))
        b = np.unique(np.concatenate([a[cut:], r.integers(0, 1 << 62, int(r.integers(0, max(1, len(a) // 3)))).astype(np.uint64)]))
        packed = [np.packbits(jaccard.bitmap(x)).tobytes() for x in (a, b)]
        ok = jaccard.may_link(packed[0], len(a), packed[1], len(b))
        assert ok or len(np.intersect1d(a, b)) < jaccard.needed(len(a), len(b))
        parted += not ok
    assert parted > 50


def test_linked_sets_meet_in_a_group_of_their_prefixes():
    r = np.random.default_rng(6)
    for _ in range(2000):
        n = int(r.integers(1, 60))
        a = np.sort(r.choice(1 << 20, n, replace=False)).astype(np.uint64)
        b = np.unique(np.concatenate([np.delete(a, r.choice(n, int(r.integers(0, n // 4 + 1)), replace=False)), r.choice(1 << 20, int(r.integers(0, n // 3 + 1))).astype(np.uint64)]))
        if len(b) and len(np.intersect1d(a, b)) >= jaccard.needed(len(a), len(b)):
            assert set(jaccard.prefix_groups(a, 1 << 40)) & set(jaccard.prefix_groups(b, 1 << 40))


def test_rooms_with_a_connected_part():
    r = np.random.default_rng(9)
    for _ in range(60):
        pool = np.sort(r.choice(1 << 20, 30, replace=False)).astype(np.uint64)
        sets = [np.sort(r.choice(pool, r.integers(18, 31), replace=False)) for _ in range(25)]
        linked = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= jaccard.needed(len(sets[i]), len(sets[j]))
        home = {0}
        for i in range(1, 25):  # some part of the component of 0
            if i % 3 and any(linked(i, j) for j in home):
                home.add(i)

        def classes(edges):
            root = list(range(25))
            for _ in range(25):
                for i, j in edges:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        known = [(0, i) for i in home]
        want = classes([(i, j) for i in range(25) for j in range(i) if linked(i, j)])
        assert classes(jaccard.link_room(list(range(25)), sets)) == want
        assert classes(jaccard.link_room(list(range(25)), sets, [i not in home for i in range(25)]) + known) == want


@pytest.mark.parametrize("hub", [256, 0])
def test_components(spark, hub, monkeypatch):
    monkeypatch.setattr(graph, "HUB", hub)
    if not hub:  # every node with an edge is a hub
        monkeypatch.setattr(graph, "shuffle_parts", lambda s: 1 << 20)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(50)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}


@pytest.mark.parametrize("kind", ["stars", "chain"])
def test_components_end_when_edges_are_stars(spark, kind, monkeypatch):
    """Stars need no round, and a chain that one task holds becomes one there; such edges took rounds of ten jobs."""
    r, writes = random.Random(2), []
    keep = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: (writes.append(name), keep(df, name))[1])
    if kind == "stars":
        edges = [(k, k // 100 * 100) for k in range(3000) if k % 100]
    else:
        edges = [(k, k + 1) for k in range(3000) if k % 100 != 99]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long")
    got = graph.components(df if kind == "stars" else df.coalesce(1)).collect()
    assert len(got) == 3000 and all(x.root == x.node // 100 * 100 for x in got) and len(writes) == 2


def test_forests_of_a_task_connect_the_same(monkeypatch):
    monkeypatch.setattr(graph, "HELD", 50)
    r = np.random.default_rng(4)
    e = r.integers(-400, 400, (300, 2))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["u", "v"]) for x in np.split(e, 30)]
    got = np.concatenate([np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in graph._forests(iter(batches))])
    assert (got[:, 0] > got[:, 1]).all() and sorted(map(tuple, graph.spanning(got))) == sorted(map(tuple, graph.spanning(e)))
