"""Replicates, parts of one order and what rests on them, against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference as inf
from tidemark.operators import order as od
from tidemark.operators import replicates as rp
from tidemark.operators import series as se


def regression(spark, n=400, seed=1):
    r = random.Random(seed)
    rows = [(i, y := r.gauss(0, 2), y + r.gauss(0, 1), y + r.gauss(0.2, 1.1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, y double, a double, b double")


def test_sums_do_not_depend_on_how_rows_are_dealt(spark):
    rows, df = regression(spark)
    odd = df.union(spark.createDataFrame([(900, None, 1.0, 1.0)], df.schema))
    for draw in ("poisson", "coins"):
        f = lambda d: {x.rep: (x.w, x.s) for x in rp.replicate_sums(d, "id", {"w": F.lit(1.0), "s": F.col("y")}, 130, 3, draw).collect()}  # noqa: B023, E731
        one, two = f(odd), f(odd.repartition(7))
        assert set(one) == set(range(1, 131))
        assert all(one[k] == pytest.approx(two[k]) for k in one)
        weights = [w for w, _ in one.values()]
        share = 1.0 if draw == "poisson" else 0.5
        assert abs(np.mean(weights) / (share * len(rows)) - 1) < 0.02
        assert np.std(weights) == pytest.approx(math.sqrt(len(rows) * (1.0 if draw == "poisson" else 0.25)), rel=0.25)
    assert rp.replicate_sums(df.limit(0), "id", {"w": F.lit(1.0)}, 5, 3).filter("w > 0").count() == 0


def test_weights_are_poisson_and_fair():
    h = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, 2000)
    w = rp.poisson(h, 999, rp.count_table(1.0))
    assert w.shape == (2000, 999)
    for k in range(5):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=2e-3)
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.12
    assert rp.coins(h, 130).mean() == pytest.approx(0.5, abs=3e-3)


def test_bootstrap_moments_against_plain_resampling(spark):
    rows, df = regression(spark)
    got = inf.bootstrap_regression(df, "id", "y", "a", "b", 1500).toPandas()
    y, a, b = (np.array([x[k] for x in rows]) for k in (1, 2, 3))
    draw = np.random.default_rng(5)
    want = []
    for _ in range(1500):
        i = draw.integers(0, len(y), len(y))
        ea, eb = (a - y)[i], (b - y)[i]
        want.append((math.sqrt((eb**2).mean()) - math.sqrt((ea**2).mean()), abs(eb).mean() - abs(ea).mean(), ((ea**2).sum() - (eb**2).sum()) / ((y[i] - y[i].mean()) ** 2).sum()))
    for k, c in enumerate(("rmse", "mae", "r2")):
        w = [x[k] for x in want]
        assert got[c].mean() == pytest.approx(np.mean(w), abs=4 * np.std(w) / math.sqrt(1500) * 2)
        assert got[c].std() == pytest.approx(np.std(w), rel=0.1)


def auc(pos, neg):
    return sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)


@pytest.mark.parametrize("ties", [0, 1, None])
def test_auc_replicates_are_weighted_aucs(spark, ties):
    """Every replicate is the AUC of its own weights; None: two thirds of the rows share a score."""
    r = random.Random(2)
    rows = [(i, int(r.random() < 0.4), 1.0 if ties is None and r.random() < 0.67 else round(r.gauss(0, 1), ties or 6 if ties == 0 else 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, y int, s double")
    n = 20
    got = {x.rep: x.auc for x in inf.bootstrap_auc(df.union(spark.createDataFrame([(901, None, 1.0), (902, 1, None)], df.schema)), "id", "y", "s", n, 9).collect()}
    h = {x.id: x.h for x in df.select("id", rp.hashed("id", 9).alias("h")).collect()}
    w = rp.poisson(np.array([h[i] for i, _, _ in rows], np.int64), n, rp.count_table(1.0)).astype(int)
    for rep in range(n):
        pos = [s for k, (_, y, s) in enumerate(rows) for _ in range(w[k, rep]) if y]
        neg = [s for k, (_, y, s) in enumerate(rows) for _ in range(w[k, rep]) if not y]
        assert got[rep + 1] == pytest.approx(auc(pos, neg))


def test_paired_auc_differences_have_delongs_error(spark):
    r = random.Random(4)
    rows = [(i, y := int(r.random() < 0.4), x := r.gauss(y, 1), 0.7 * x + r.gauss(0, 0.6)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, y int, s double, t double")
    got = inf.paired_bootstrap_auc(df, "id", "y", "s", "t", 800).toPandas()
    want = inf.delong(df, "y", "s", "t").head()
    assert (got["auc_b"] - got["auc_a"] - got["diff"]).abs().max() == 0
    assert got["diff"].mean() == pytest.approx(want["diff"], abs=0.005) and got["diff"].std() == pytest.approx(want["se"], rel=0.12)


def test_permutation_p_against_all_flips(spark):
    d = [0.5, 1.2, -0.3, 0.8, 0.9, 1.1, -0.2, 0.4]
    df = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(d)], "id int, a double, b double")
    flips = [abs(sum(x if k >> i & 1 else -x for i, x in enumerate(d))) >= abs(sum(d)) - 1e-12 for k in range(256)]
    got = inf.permutation_test(df, "id", "a", "b", 8000).head()
    assert got["diff"] == pytest.approx(np.mean(d)) and got.p == pytest.approx(np.mean(flips), abs=0.01)


def test_parts_hold_every_row_and_their_halo(spark, monkeypatch):
    monkeypatch.setattr(se, "PART", 10)
    df = spark.createDataFrame([(i * 7 % 101, float(i)) for i in range(101)], "o int, v double")
    rows, n = se.numbered(df, "o", ["o", "v"])
    assert n == 101 and all(x.place == x.o for x in rows.collect())
    for around in (True, False):
        for ahead in (0, 4, 9, 60, 100):
            parts = {}
            for x in se.in_parts(rows, n, ahead, around).collect():
                parts.setdefault(x.part, []).append((x.pos, x.own, x.o))
            own = sorted(o for p in parts.values() for _, mine, o in p if mine)
            assert own == list(range(101))
            for p in parts.values():
                at = sorted(pos for pos, _, _ in p)
                assert at == list(range(at[0], at[-1] + 1)) and all(pos % 101 == o for pos, _, o in p)
                last = max(pos for pos, mine, _ in p if mine)
                assert sum(not mine for _, mine, _ in p) == (ahead if around or last + ahead <= 100 else max(0, 100 - last))


def test_autocovariance_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(se, "PART", 16)
    r = np.random.default_rng(3)
    v = r.normal(size=120).cumsum()
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    d = v - v.mean()
    for lags in (0, 3, 50, 130):
        got = {x.k: (x.acov, x.acf) for x in od.lag_autocovariance(df, "v", "i", lags).collect()}
        assert set(got) == set(range(lags + 1))
        for k, (acov, acf) in got.items():
            want = float(d[: 120 - k] @ d[k:]) / 120 if k < 120 else 0.0
            assert acov == pytest.approx(want, abs=1e-9) and acf == pytest.approx(want / d.var(), abs=1e-9)
    plan = od.lag_autocovariance(df, "v", "i", 3)._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert od.lag_autocovariance(df.limit(0), "v", "i", 2).count() == 0


@pytest.mark.parametrize("block", [1.0, 4.0])
def test_stationary_bootstrap_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(se, "PART", 64)
    r = np.random.default_rng(8)
    v = np.convolve(r.normal(size=403), [0.6, 0.4, 0.3, 0.2], "valid") + 0.1
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    got = se.stationary_means(df, "i", ["v"], block, 1000, 7).toPandas()["v"]
    want = []
    for _ in range(1000):
        i = np.empty(400, int)
        i[0] = r.integers(400)
        for k in range(1, 400):
            i[k] = r.integers(400) if r.random() < 1 / block else (i[k - 1] + 1) % 400
        want.append(v[i].mean())
    assert got.mean() == pytest.approx(v.mean(), abs=0.01) and got.std() == pytest.approx(np.std(want), rel=0.12)
    again = se.stationary_means(df.repartition(5), "i", ["v"], block, 1000, 7).toPandas()["v"]
    assert sorted(got) == pytest.approx(sorted(again))
    one = inf.stationary_bootstrap(df, "i", "v", block, 300).head()
    assert one.low < v.mean() < one.high and one["mean"] == pytest.approx(v.mean())


def test_confidence_set_keeps_the_best_and_its_equals(spark):
    r = random.Random(6)
    rows = [(i, x := r.random(), x + r.gauss(0, 0.02), x + 0.4 + r.gauss(0, 0.2)) for i in range(200)]
    got = {x.model: x for x in inf.model_confidence_set(spark.createDataFrame(rows, "i int, a double, b double, c double"), "i", ["a", "b", "c"], block=2.0, n=300).collect()}
    assert got["a"].included and got["b"].included and not got["c"].included


def test_tie_breaks_are_hypergeometric(spark):
    r = random.Random(1)
    rows = [(i, int(r.random() < 0.5), float(r.randrange(4)), float(r.randrange(3))) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double")
    got = inf.tie_break_mcnemar(df, "y", "a", "b", 0.25, 1500).toPandas()
    want = []
    for _ in range(1500):
        top = lambda c: {x[0] for x in sorted(rows, key=lambda x: (-x[c], r.random()))[:20]}
        ta, tb = top(2), top(3)
        want.append((sum(((i in ta) == bool(y)) and ((i in tb) != bool(y)) for i, y, _, _ in rows), sum(((i in ta) != bool(y)) and ((i in tb) == bool(y)) for i, y, _, _ in rows)))
    for k, c in enumerate(("only_a", "only_b")):
        w = [x[k] for x in want]
        assert got[c].mean() == pytest.approx(np.mean(w), abs=0.2) and got[c].std() == pytest.approx(np.std(w), rel=0.12)
    assert (got["n"] == 80).all() and len(got) == 1500


def test_battery_for_forecasts(spark):
    r = random.Random(12)
    rows = [(i, i % 10, y := r.gauss(0, 2), y + r.gauss(0, 1), y + r.gauss(0, 1.02), y + r.gauss(0, 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, fold int, y double, m double, same double, worse double")
    got = {(x.benchmark, x.test): x for x in inf.battery_regression(df, "id", "y", "m", ["same", "worse"], n_perm=400, n_boot=300).collect()}
    assert set(got) == {(b, t) for b in ("same", "worse") for t in ("P1", "P2", "P3", "P4")}
    assert all(got["worse", t].rejects and got["worse", t].in_favour for t in ("P1", "P2", "P3", "P4"))
    assert not any(got["same", t].rejects for t in ("P1", "P2", "P3", "P4"))
    mse = [np.mean([(x[k] - x[2]) ** 2 for x in rows]) for k in (3, 5)]
    assert got["worse", "P3"].statistic == pytest.approx(mse[0] - mse[1]) and got["worse", "P4"].statistic == pytest.approx(math.sqrt(mse[0]) - math.sqrt(mse[1]))
