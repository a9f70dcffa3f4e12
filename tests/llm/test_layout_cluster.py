"""The clustered layout and delta clustering against plain Python."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import cluster, layout

COLUMNS = "doc_id long, text string, lang string, source string, z long, file_bounds string"


def brute_layout(docs, per_file, cells=8):
    """docs: (doc_id, text, lang, source) -> rows of the result."""
    raw = [(None if d is None else zlib.crc32(str(d).encode()) % 365, -1 if t is None else len(t.encode()), None if g is None else g.encode(), None if s is None else s.encode()) for d, t, g, s in docs]
    low = lambda v: (v is not None, v if v is not None else 0)
    coords = [[cells * sum(low(o[i]) < low(x[i]) for o in raw) // len(raw) for i in range(4)] for x in raw]  # date, length, lang, source
    zs = [int("".join(f"{c:03b}"[b] for b in range(3) for c in x), 2) for x in coords]
    order = sorted(range(len(docs)), key=lambda i: (zs[i], docs[i][0] is not None, docs[i][0] or 0))
    file = {i: p // per_file for p, i in enumerate(order)}
    held = {}
    for i, f in file.items():
        held.setdefault(f, []).append(coords[i])
    box = {f: [(min(c), max(c)) for c in zip(*x)] for f, x in held.items()}
    out = []
    for p, i in enumerate(order):
        query = [(c - r, c + r) for c, r in zip(coords[i], (1, 1, 0, 0))]
        touched = sum(all(a <= hi and lo <= b for (a, b), (lo, hi) in zip(query, x)) for x in box.values())
        matching = sum(any(all(a <= c <= b for (a, b), c in zip(query, y)) for y in x) for x in held.values())
        b = box[file[i]]
        out.append((docs[i][0], zs[i], p, file[i], touched, matching, ",".join(f"{lo},{hi}" for lo, hi in (b[3], b[2], b[1], b[0]))))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1])
def test_layout_against_brute_force(spark, seed):
    r = random.Random(seed)
    docs = [(r.choice([d, d, 7, None]) if d % 9 == 0 else d - 50, r.choice([None, "", "é" * r.randrange(9), "x" * r.randrange(3000)]), r.choice(["en", "en", "de", "é", "z😀", "zﬀ", "", None]), "hot" if r.random() < 0.4 else r.choice([None, "", "a", "ab", "b"])) for d in range(400)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], COLUMNS)
    got = layout.document_layout(df, rows_per_file=17)
    assert got.columns == ["doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_layout(docs, 17)
    if seed == 0:
        assert layout.document_layout(df.limit(0)).collect() == []


def test_layout_of_one_value_and_other_cells(spark):
    docs = [(5, None, None, None)] * 30
    got = layout.document_layout(spark.createDataFrame([(*d, 1, "x") for d in docs], COLUMNS), rows_per_file=4)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_layout(docs, 4)
    dims = [layout.Dim("a", layout.F.col("a"), 1), layout.Dim("b", layout.F.col("b"), 0)]
    rows = spark.createDataFrame([(i, i * 37 % 100 - 50, i % 3) for i in range(100)], "id long, a int, b int")
    out = {x.id: x for x in layout.layout(rows, "id", dims, cells=5, rows_per_file=10).collect()}
    assert {out[i].z & 0b111111 for i in out} == {out[i].z for i in out}
    files = {}
    for i, x in out.items():
        files.setdefault(x.file, []).append((i * 37 % 100 // 20, 5 * (-(-100 * (i % 3) // 3)) // 100))
    cell = {i: c for f in files for i, c in zip([j for j in out if out[j].file == f], files[f])}
    for i, x in out.items():
        near = lambda c, d: abs(c[0] - d[0]) <= 1 and c[1] == d[1]
        assert x.files_matching == sum(any(near(cell[i], c) for c in cs) for cs in files.values())


def test_written_layout_holds_every_row_and_its_bounds(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}" * (i % 7), "en" if i % 3 else "de", None) for i in range(100)], "doc_id long, text string, lang string, source string")
    dims = [layout.Dim("length", layout.F.length("text"), 1), layout.Dim("lang", layout.F.col("lang"))]
    files = layout.write_clustered(rows, "doc_id", dims, f"{tmp_path}/out", cells=4, rows_per_file=30)
    assert sorted(x.n_rows for x in files.collect()) == [10, 30, 30, 30]
    back = spark.read.parquet(f"{tmp_path}/out").select(*rows.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        layout.write_clustered(rows.withColumnRenamed("source", "z"), "doc_id", dims, f"{tmp_path}/no")


def brute_kmeans(vectors, k, rounds, dims, scale=1024, seed=3):
    kept = [(i, [max(-cluster.MOST, min(cluster.MOST, math.floor(scale * e))) for e in v]) for i, v in vectors if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)]
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    cents = [x for _, x in named[:k]]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((gap(x, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        owner = [nearest(x)[1] for _, x in kept]
        for j in range(len(cents)):
            mine = [x for (_, x), o in zip(kept, owner) if o == j]
            if mine:
                cents[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, *nearest(x)) for i, x in kept]
    per = [sum(d for _, d, o in last if o == j) for j in range(len(cents))]
    return sorted(((i, j, d, per[j], sum(per), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last), key=str)


@pytest.mark.parametrize(("seed", "spread"), [(0, 1.0), (1, 0.002), (2, 300.0)])
def test_kmeans_against_brute_force(spark, seed, spread, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 16)
    r = np.random.default_rng(seed)
    vs = [(int(i), (r.normal(size=4) * spread).tolist()) for i in range(150)]
    vs += [(900, vs[0][1]), (900, vs[0][1]), (3, vs[1][1]), (None, vs[2][1]), (901, None), (902, []), (903, [1.0] * 3), (904, [1.0, float("nan"), 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [None, 0.0, 0.0, 0.0]), (907, [1e30, -1e30, 0.0, 0.5])]
    df = spark.createDataFrame([(*v, 0) for v in vs], "vec_id long, embedding array<double>, cluster int")
    got = cluster.kmeans(df, k=5, rounds=6, dims=4)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_kmeans(vs, 5, 6, 4)
    if seed == 0:
        few = df.filter("vec_id in (0, 900)")
        assert sorted((tuple(x) for x in cluster.kmeans(few, k=5, rounds=3, dims=4).collect()), key=str) == brute_kmeans([v for v in vs if v[0] in (0, 900)], 5, 3, 4)
        assert cluster.kmeans(df.limit(0), dims=4).collect() == []


def test_delta_rounds_equal_full_ones():
    r = np.random.default_rng(7)
    x = r.integers(-9, 9, (200, 3))
    owner = dist = None
    cents, changed = r.integers(-9, 9, (6, 3)), np.ones(6, bool)
    total = np.zeros(6 * 4, np.int64)
    for _ in range(20):
        owner, dist, net = cluster.reassign(x, cents, changed, owner, dist)
        full = ((x[:, None] - cents) ** 2).sum(2)
        assert (owner == full.argmin(1)).all() and (dist == full.min(1)).all()
        for place, amount in net.items():
            total[place] += amount
        sums = total.reshape(6, 4)
        assert all((sums[j, :3] == x[owner == j].sum(0)).all() and sums[j, 3] == (owner == j).sum() for j in range(6))
        changed = r.random(6) < 0.4  # any change is allowed, not only those to means
        cents = np.where(changed[:, None], cents + r.integers(-2, 3, (6, 3)), cents)
