"""Fits that stop by validation rows and go back to their best state."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.boosting import boost, fit_steps, predict_column


def planted(spark, n=1500, noise=0.5, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.random(), float(r.randrange(5))
        rows.append((i, a, b, 3 * (a > 0.5) + b + (4.0 if r.random() < 0.3 else 0.0) + r.gauss(0, noise)))
    return spark.createDataFrame(rows, "id int, a double, b double, y double").repartition(2)


def test_boosting_goes_back_to_its_best(spark):
    df = planted(spark, 600, 2.0)
    train, watch = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    m = boost(train, ["a", "b"], "y", rounds=60, depth=2, rate=0.5, watch=watch, patience=4)
    n = len(m["trees"])
    assert 0 < n < 56
    longer = boost(train, ["a", "b"], "y", rounds=n + 4, depth=2, rate=0.5)
    assert longer["trees"][:n] == m["trees"]
    error = lambda k: watch.agg(F.avg((F.col("y") - predict_column({**longer, "trees": longer["trees"][:k]})) ** 2)).first()[0]
    assert all(error(n) < error(k) for k in (0, n - 1, n + 1, n + 2, n + 4))


def test_turns_stop_and_steps_are_found(spark):
    df = planted(spark, 1500, 0.1)
    m = fit_steps(df.filter("id % 3 = 0"), df.filter("id % 3 = 1"), ["a", "b"], "y", warm=12, turns=9, rounds=1, validation=df.filter("id % 3 = 2"), warm_patience=3, patience=2, depth=2, rate=0.5)
    assert max(m["c"]) - min(m["c"]) == pytest.approx(4.0, abs=0.3) and m["warm"] <= 12
    best = int(np.argmin(m["history"]))
    assert len(m["history"]) <= 9 and len(m["trees"]) in (m["warm"], m["warm"] + best + 1)
    rest = [x.r for x in df.filter("id % 3 = 2").select((F.col("y") - predict_column(m)).alias("r")).collect()]
    assert math.sqrt(np.mean([min((r - c) ** 2 for c in m["c"]) for r in rest])) <= min(m["history"]) * (1 + 1e-6)


def test_nothing_to_gain(spark):
    flat = spark.createDataFrame([(i, 1.0, 2.0 + i % 2 * 1e-9) for i in range(60)], "id int, a double, y double")
    m = boost(flat, ["a"], "y", rounds=20, watch=flat, patience=2)
    assert len(m["trees"]) <= 2


def test_sets_by_density_against_numpy(spark):
    from tidemark.operators.mixture import calibrated_sets, fit_mixture

    r = random.Random(7)
    v = [(i, r.gauss(-3.0 if r.random() < 0.4 else 2.0, 0.5)) for i in range(1800)] + [(1800, None)]
    df = spark.createDataFrame(v, "id int, r double")
    fit, cal, test = (df.filter(f"id % 3 = {k}") for k in range(3))
    got = {x.nominal: x for x in calibrated_sets(fit, cal, test, "r", [0.5, 0.9, 0.9999], 2).collect()}
    m = fit_mixture(fit, "r", 2).head()
    density = lambda x: sum(p * math.exp(-0.5 * ((x - c) / m.sigma) ** 2) for p, c in zip(m.pi, m.c)) / (m.sigma * math.sqrt(2 * math.pi))
    own = sorted(density(x) for i, x in v if i % 3 == 1)
    there = [density(x) for i, x in v if i % 3 == 2]
    for nominal, x in got.items():
        k = math.floor(round((1 - nominal) * (len(own) + 1), 9))
        assert x.level == pytest.approx(own[k - 1] if k else 0.0)
        assert x.covered == pytest.approx(np.mean([d >= x.level - 1e-15 for d in there]), abs=2 / len(there)) and abs(x.covered - nominal) < 0.06
        grid = np.linspace(-8, 8, 40001)
        if k:
            assert x.length == pytest.approx(np.mean([density(g) >= x.level for g in grid[::10]]) * 16, abs=0.05) and x.pieces == 2


def test_trees_from_cells_are_those_from_rows(spark):
    from tidemark.operators import boosting as bo

    df = planted(spark, 1500).withColumn("a", F.floor(F.col("a") * 8) / 8).union(spark.createDataFrame([(2000 + i, None, 1.0, 9.0) for i in range(30)], "id int, a double, b double, y double"))
    cuts = bo.value_cuts(df, ["a", "b"], 16)
    few = bo.cells(bo.coded(df, ["a", "b"], cuts), ["a", "b"], "y")
    assert few.count() <= 9 * 5 and few.agg(F.sum("__n")).first()[0] == 1530
    m = bo.boost(df, ["a", "b"], "y", rounds=4, depth=2, rate=0.5, bins=16)
    done = F.lit(float(m["intercept"]))
    for tree in m["trees"]:
        rows = bo.fit_tree(df, ["a", "b"], cuts, F.col("y") - done, 2, 20, 1.0)
        assert rows["split"] == tree["split"] and all(rows["value"][k] == pytest.approx(v) for k, v in tree["value"].items())
        done = done + 0.5 * bo.tree_column(tree, ["a", "b"])
    got = {r.id: r["__f"] for r in bo.predicted(df, m | {"cuts": cuts}).collect()}
    assert len(got) == 1530 and all(got[r.id] == pytest.approx(r.f) for r in df.select("id", predict_column(m).alias("f")).collect())
