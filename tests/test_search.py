"""Searches over sums of folds against refits on the rows."""

import math

import numpy as np
import pytest

from tidemark.operators import search as sr


def table(spark, n=400):
    r = np.random.default_rng(2)
    x = r.normal(size=(n, 5))
    y = x @ [2.0, -1.0, 0.0, 0.0, 0.0] + 3 + r.normal(size=n)
    rows = [(i, int(i % 4), *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id long, fold int, a double, b double, c double, d double, e double, y double")


def test_errors_equal_refits(spark):
    from pyspark.sql import functions as F

    from tidemark.functions.columns import dice

    x, y, df = table(spark)
    folds = sr.Folds(df, "id", list("abcde"), "y", shares=(0.25, 1.0), seed=9)
    unit = {r.id: r.u for r in df.select("id", dice(F.col("id"), 9).alias("u")).collect()}
    f = np.arange(len(y)) % 4
    for penalty, used, share in ((0.5, [1, 1, 1, 1, 1], 1.0), (30.0, [1, 0, 1, 0, 0], 1.0), (2.0, [0, 0, 0, 0, 0], 1.0), (5.0, [1, 1, 0, 0, 1], 0.25)):
        here = np.array([unit[i] < share for i in range(len(y))])
        z = np.column_stack([np.ones(len(y)), x[:, np.flatnonzero(used)]])
        wrong = []
        for k in range(4):
            a, b = here & (f != k), here & (f == k)
            pen = penalty * np.eye(z.shape[1])
            pen[0, 0] = 0
            w = np.linalg.solve(z[a].T @ z[a] + pen, z[a].T @ y[a])
            wrong += list((y[b] - z[b] @ w) ** 2)
        assert folds.error(penalty, [bool(u) for u in used], share) == pytest.approx(math.sqrt(np.mean(wrong)))


def test_methods_share_a_budget_and_agree_on_rerun(spark):
    _, _, df = table(spark)
    got = sr.search(df, "id", list("abcde"), "y", budget=50)
    one = got.toPandas()
    assert one.groupby("method").size().to_dict() == dict.fromkeys(sr.METHODS, 50)
    assert one.equals(sr.search(df.repartition(3), "id", list("abcde"), "y", budget=50).toPandas().round(12)) or one.round(9).equals(sr.search(df.repartition(3), "id", list("abcde"), "y", budget=50).toPandas().round(9))
    best = one.groupby("method")["rmse"].min()
    for m in ("parzen", "genetic"):
        rows = one[one["method"] == m]
        late, early = rows[rows["generation"] > 0]["rmse"].mean(), rows[rows["generation"] == 0]["rmse"].mean()
        assert late < early and best[m] <= best["random"] * 1.01
        assert (np.minimum.accumulate(rows["rmse"]) == rows["best"]).all()
        assert rows.loc[rows["rmse"].idxmin(), "used"].startswith("11")


def test_halving_keeps_a_third_and_ends_on_all_rows(spark):
    _, _, df = table(spark)
    got = sr.halving(df, "id", list("abcde"), "y", n=27).toPandas()
    assert got.groupby("rung").size().tolist() == [27, 9, 3, 1] and got["share"].max() == 1.0
    for k in range(3):
        rung = got[got["rung"] == k]
        assert set(rung[rung["kept"]]["config"]) == set(got[got["rung"] == k + 1]["config"])
        assert rung[rung["kept"]]["rmse"].max() <= rung[~rung["kept"]]["rmse"].min()
    assert got.iloc[-1]["used"].startswith("11")
