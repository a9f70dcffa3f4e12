"""Additive models from sums, and path-wise explanations, against plain computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import additive as ad
from tidemark.operators import model as md


def planted(spark, n=3000, both=0.0, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.uniform(-2, 2), r.uniform(-2, 2), float(r.randrange(3))
        y = 1.5 * (a > 0.3) + b + 0.5 * c + both * (a > 0) * (b > 0) + r.gauss(0, 0.2)
        rows.append((i, a if i % 50 else None, b, c, y))
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def test_every_round_equals_boosting_on_the_rows(spark):
    """Sums say what a pass over the rows would."""
    rows, df = planted(spark, 400)
    m = ad.fit_additive(df, "id", ["a", "b", "c"], "y", bins=6, rounds=15, held=0.0, patience=99)
    code = np.array([[0 if x[1 + i] is None else 1 + sum(k <= x[1 + i] for k in m.cuts[f]) for i, f in enumerate("abc")] for x in rows])
    y = np.array([x[4] for x in rows])
    score = [np.zeros(len(m.cuts[f]) + 2) for f in "abc"]
    f = np.full(len(y), y.mean())
    for _ in range(15):
        for i in range(3):
            g, n = (np.bincount(code[:, i], w, len(score[i])) for w in (y - f, np.ones(len(y))))
            change = 0.1 * ad.step(g, n)
            score[i] += change
            f = f + change[code[:, i]]
    got = np.array([x.p for x in df.select("id", ad.additive_column(m).alias("p")).orderBy("id").collect()])
    assert got == pytest.approx(f)


def test_planted_effects_and_interaction(spark):
    rows, df = planted(spark, both=3.0)
    m = ad.fit_additive(df, "id", ["a", "b", "c"], "y", bins=16, rounds=400, pairs=1)
    assert 0 < m.rounds <= 400 and max(m.worth, key=m.worth.get) == ("a", "b") and list(m.pairs) == [("a", "b")]
    assert m.worth["a", "b"] > 20 * max(m.worth["a", "c"], m.worth["b", "c"])
    plain = ad.Additive(*m[:4], {}, *m[5:])
    rmse = lambda c: df.agg(F.sqrt(F.avg((F.col("y") - c) ** 2))).first()[0]
    assert rmse(ad.additive_column(m)) < 0.65 * rmse(ad.additive_column(plain)) < rmse(F.lit(float(np.mean([x[4] for x in rows]))))


def test_terms_score_as_the_columns_do(spark):
    _, df = planted(spark, 500)
    m = ad.fit_additive(df, "id", ["a", "b", "c"], "y", bins=8, rounds=60)
    long = df.select("id", F.inline(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).alias("number"), F.lit(None).cast("string").alias("text")) for c in "abc"))))
    got = {x.id: x.raw for x in md.score_terms(long, "id", ad.term_table(spark, m), m.intercept, logit=False).collect()}
    want = {x.id: x.p for x in df.select("id", ad.additive_column(m).alias("p")).collect()}
    assert got == pytest.approx(want)


def test_stop_and_odd_tables(spark):
    r = random.Random(9)
    noise = spark.createDataFrame([(i, r.random(), r.gauss(0, 1)) for i in range(600)], "id long, a double, y double")
    assert ad.fit_additive(noise, "id", ["a"], "y", rounds=500, patience=5).rounds < 300
    flat = spark.createDataFrame([(i, None, 2.0) for i in range(20)], "id long, a double, y double")
    m = ad.fit_additive(flat, "id", ["a"], "y")
    assert flat.select(ad.additive_column(m).alias("p")).first().p == pytest.approx(2.0)
    empty = ad.fit_additive(flat.limit(0), "id", ["a"], "y")
    assert empty.intercept == 0.0


def grown(r, names, depth):
    size = 2 ** (depth + 1) - 1
    t = {"variable": [-1] * size, "cut": [0.0] * size, "value": [0.0] * size, "cover": [0.0] * size}

    def fill(k, d, cover):
        t["cover"][k] = cover
        if d == depth or r.random() < 0.15 and k:
            t["value"][k] = r.gauss(0, 1)
            return
        t["variable"][k], t["cut"][k] = r.randrange(names), r.gauss(0, 0.7)
        part = r.uniform(0.1, 0.9)
        fill(2 * k + 1, d + 1, cover * part)
        fill(2 * k + 2, d + 1, cover * (1 - part))

    fill(0, 0, 100.0)
    return t


def worth(t, x, known, k=0):
    v = t["variable"][k]
    if v < 0:
        return t["value"][k]
    low, high = (worth(t, x, known, 2 * k + s) for s in (1, 2))
    if v in known:
        return low if x[v] is not None and x[v] <= t["cut"][k] else high
    p = t["cover"][2 * k + 1] / t["cover"][k]
    return p * low + (1 - p) * high


def test_path_contributions_equal_all_subsets(spark):
    from itertools import combinations
    from math import comb

    r = random.Random(4)
    rows = [(i, *(r.gauss(0, 1) if r.random() > 0.1 else None for _ in range(4))) for i in range(25)]
    trees = [grown(r, 4, 4) for _ in range(3)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    got = {(x.id, x.variable): x.contribution for x in md.tree_explanation(df, "id", list("abcd"), trees, 0.5).collect()}
    for i, *x in rows:
        for v, name in enumerate("abcd"):
            rest = [u for u in range(4) if u != v]
            want = sum((worth(t, x, {*s, v}) - worth(t, x, set(s))) / (4 * comb(3, len(s))) for t in trees for k in range(4) for s in combinations(rest, k))
            assert got[i, name] == pytest.approx(0.5 * want, abs=1e-9)


def test_twenty_variables(spark):
    r = random.Random(5)
    names = [f"v{i}" for i in range(20)]
    rows = [(i, *(r.gauss(0, 1) for _ in names)) for i in range(40)]
    trees = [grown(r, 20, 7) for _ in range(4)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names))
    got = {}
    for x in md.tree_explanation(df, "id", names, trees).collect():
        got[x.id] = got.get(x.id, 0.0) + x.contribution
    for i, *x in rows:
        assert got[i] == pytest.approx(sum(worth(t, x, set(range(20))) - worth(t, x, set()) for t in trees))
