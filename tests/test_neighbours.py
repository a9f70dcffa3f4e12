"""Neighbours, oversampling against brute force."""

import random

import pytest

from tidemark.operators import neighbours as nb

F3 = ["u", "v", "w"]


def brute(queries, candidates, k, itself=False):
    out = {}
    for i, x in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in candidates if itself or j != i)[:k]
        out[i] = [j for _, j in near], [d**0.5 for d, _ in near]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, *x) for i, x in rows], "id long, u double, v double, w double")


@pytest.mark.parametrize("seed", [0, 1])
def test_neighbours_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(nb, "CELL", 25)
    monkeypatch.setattr(nb, "BLOCK", 40)
    r = random.Random(seed)
    spot = (1.0, 1.0, 1.0)
    rows = [(i, spot if i % 3 == 0 else tuple(float(r.randrange(6)) if seed else r.gauss(i % 4 * 3, 1) for _ in range(3))) for i in range(300)]
    df = table(spark, rows)
    odd = df.union(spark.createDataFrame([(900, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0), (901, float("nan"), 0.0, 0.0)], df.schema))
    for k, itself in ((1, False), (5, False), (4, True)):
        got = {x.id: (x.n, x.d) for x in nb.nearest(odd.filter("id % 2 = 0 or id > 800"), odd, "id", F3, k, itself).collect()}
        want = brute([x for x in rows if x[0] % 2 == 0], rows, k, itself)
        assert set(got) == set(want)
        for i in want:
            assert got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1])


def test_few_candidates(spark):
    df = table(spark, [(1, (0.0, 0.0, 0.0)), (2, (3.0, 4.0, 0.0))])
    got = {x.id: (x.n, x.d) for x in nb.nearest(df, df, "id", F3, 5).collect()}
    assert got == {1: ([2], [5.0]), 2: ([1], [5.0])}
    assert [(x.id, x.n) for x in nb.nearest(df.limit(1), df.limit(0), "id", F3, 5).collect()] == [(1, [])]
    one = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (2, 0, 1.0, 1.0, 1.0), (3, 0, 2.0, 1.0, 1.0)], "id long, y int, u double, v double, w double")
    assert nb.smote(one, "id", "y", F3, 1).count() == 0


def test_oversampling(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL", 20)
    r = random.Random(3)
    rows = [(i, int(i % 7 == 0), *(r.gauss(2 * (i % 7 == 0), 1) for _ in range(3))) for i in range(350)] + [(900, None, 0.0, 0.0, 0.0), (901, 1, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, y int, u double, v double, w double")
    few = {x[0]: x[2:] for x in rows[:350] if x[1] == 1}
    near = brute(list(few.items()), list(few.items()), 5)
    new = nb.smote(df, "id", "y", F3, 1)
    got = new.collect()
    assert len(got) == 300 - 50 and len({x.s for x in got}) == 250 and len({x.base for x in got}) > 40
    for x in got:
        assert x.neighbour in near[x.base][0] and 0 <= x.gap < 1
        for c, a, b in zip(F3, few[x.base], few[x.neighbour]):
            assert x[c] == pytest.approx(a + x.gap * (b - a))
    assert sorted(got) == sorted(nb.smote(df.repartition(5), "id", "y", F3, 1).collect())
    all_ = [(x[0], x[2:]) for x in rows[:350]]
    around = brute(list(few.items()), all_, 5)
    others = {i: sum(j not in few for j in n) / 5 for i, (n, _) in around.items()}
    copies = {i: round(o / sum(others.values()) * 250) for i, o in others.items()}
    shares = {x.id: (x.others, x.copies) for x in nb.adasyn_shares(df, "id", "y", F3, 1).collect()}
    assert {i: s[1] for i, s in shares.items()} == copies and all(shares[i][0] == pytest.approx(o) for i, o in others.items())
    made = nb.adasyn(df, "id", "y", F3, 1).collect()
    assert {i: sum(x.base == i for x in made) for i in copies} == copies and all(x.neighbour in near[x.base][0] for x in made)


@pytest.mark.parametrize("p", [2.0, 3.0])
def test_search_by_products_against_brute_force(spark, p, monkeypatch):
    from tidemark.operators import relational as rl

    monkeypatch.setattr(rl, "NEAR_ROWS", 37)
    monkeypatch.setattr(rl, "NEAR_QUERIES", 5)
    r = random.Random(4)
    far = 1e6  # far from the origin products lose what tells these rows apart
    rows = [(i, [far + r.randrange(3) for _ in range(6 if i % 11 else 4)]) for i in range(200)]
    df = spark.createDataFrame([*rows, (500, None), (501, [1.0, None]), (None, [far] * 6)], "vec_id long, e array<double>").repartition(3)
    got = {(x.query, x.place): (x.vec_id, x.distance) for x in rl.nearest(df.filter("vec_id % 9 = 0"), df, "vec_id", "e", 5, p).collect()}
    want = {}
    for i, x in rows:
        if i % 9 == 0:
            near = sorted((sum(abs(a - b) ** p for a, b in zip(x, y)), j) for j, y in rows if j != i)[:5]
            want |= {(i, n + 1): (j, d ** (1 / p)) for n, (d, j) in enumerate(near)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[1]) for k, v in want.items())


def test_queries_are_packed_not_paired(spark):
    from tidemark.operators import relational as rl

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(300)], "vec_id long, e array<float>")
    plan = rl.nearest(df.filter("vec_id % 50 = 0"), df, "vec_id", "e", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" in plan


def test_cells_grow_in_number_not_in_size():
    import numpy as np

    r = np.random.default_rng(5)
    for n in (2000, 20000):
        x = np.column_stack([r.random(n) * 500, r.integers(0, 17, n), r.integers(0, 3, n)]).astype(float)
        x[: n // 4] = x[0]  # a spot that no cut divides
        tree = tuple(np.array(c) for c in zip(*nb._cut_tree(x, 5)))
        cell = nb._cell_of(x, tree)
        assert sorted(set(cell)) == list(range((len(tree[0]) + 1) // 2))
        assert np.bincount(cell[n // 4 :]).max() < 10
    lo, hi = np.array([[0.0, 0.0], [2.0, 0.0], [9.0, 9.0]]), np.array([[1.0, 1.0], [3.0, 1.0], [9.0, 9.0]])
    boxes = nb._Boxes(lo, hi, np.array([3, 3, 1]))
    sizes, cells = boxes.reached(np.array([[0.5, 0.5], [1.0, 0.0]]), np.array([0.5, 1.0]), 0)
    assert sizes.tolist() == [0, 1] and cells.tolist() == [1]
    assert boxes.bound(np.array([[0.0, 0.0]]), 3)[0] == pytest.approx(2**0.5) and boxes.bound(np.array([[0.0, 0.0]]), 8)[0] == np.inf
