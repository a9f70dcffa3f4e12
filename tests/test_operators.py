"""Operators against plain Python on ties, nulls, single rows, empty and constant input."""

import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators import inference as inf
from tidemark.operators import metrics as mt
from tidemark.operators import mixture as mx
from tidemark.operators import model as md
from tidemark.operators import order as od
from tidemark.operators import profile as pf
from tidemark.operators import relational as rl

TX = [("a", "2023-01-10", 10.0, "Deposit"), ("a", "2023-03-01", 20.0, "Payment"), ("b", "2023-02-01", 5.0, "Deposit"), ("b", "2023-06-15", 15.0, "Deposit"), ("c", "2023-05-01", 7.0, "Payment"), ("c", "2023-12-20", 9.0, "Transfer")]
TYPES = ["Deposit", "Payment", "Transfer", "Withdrawal"]


def tx(spark, rows=TX):
    return spark.createDataFrame([(c, datetime.fromisoformat(d) if d else None, a, t) for c, d, a, t in rows], "customer_id string, date timestamp_ntz, amount double, type string")


def people(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "customer_id string")


def test_cutoff_and_recency(spark):
    t = tx(spark)
    assert fe.cutoff_date(t, people(spark, "a", "b")).head()[0] == datetime(2023, 6, 15)
    assert fe.cutoff_date(t, people(spark, "a", "b", "c")).head()[0] == datetime(2023, 12, 20)
    with pytest.raises(Exception, match="no training customer"):
        fe.cutoff_date(t, people(spark, "z")).collect()
    got = {r.customer_id: r for r in fe.behaviour(t, fe.cutoff_date(t, people(spark, "a", "b")), TYPES).collect()}
    assert [got[k].recency_days for k in "abc"] == [106, 0, 0]
    assert got["a"].share_Withdrawal == 0 and got["a"].active_months == 2


def test_features_odd_rows(spark):
    rows = [("a", "2023-01-01T23:00", 1.0, "Deposit"), ("a", "2023-01-03T22:00", 3.0, None), ("b", "2023-01-05", 2.0, "Payment"), (None, "2023-01-09", 2.0, "Payment")]
    t = tx(spark, rows)
    got = {r.customer_id: r for r in fe.behaviour(t, fe.cutoff_date(t, people(spark, "b")), TYPES).collect()}
    assert set(got) == {"a", "b"} and got["a"].active_days == 1 and got["b"].amount_volatility is None
    assert fe.behaviour(t.limit(0), fe.cutoff_date(t, people(spark, "b")), TYPES).count() == 0
    a = fe.audit(people(spark, "a", "q"), t.union(t.limit(1))).head()
    assert (a.duplicates, a.orphans, a.customers_without_tx) == (1, 2, 1)


def test_split_is_by_key_alone(spark):
    df = spark.range(2000).select(F.col("id").alias("customer_id"))
    a = {r.customer_id: r.split for r in fe.split(df, validation=0.1).collect()}
    b = {r.customer_id: r.split for r in fe.split(df.filter("customer_id % 2 = 0").repartition(3), validation=0.1).collect()}
    assert all(a[k] == v for k, v in b.items())
    assert 330 < sum(v == "test" for v in a.values()) < 470 and {"train", "test", "validation"} == set(a.values())


def brute_rank(values):
    s = sorted(values)
    return {v: (s.index(v) + 1 + len(s) - s[::-1].index(v)) / 2 for v in values}


def scored(seed, n=300, ties=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        y = int(r.random() < 0.4)
        s = r.gauss(y, 1.0)
        out.append((i, y, round(s, 1) if ties else s))
    return out


@pytest.mark.parametrize("ties", [True, False])
def test_ranks_auc_and_precision(spark, ties):
    rows = scored(1, ties=ties)
    df = spark.createDataFrame(rows + [(900, 1, None), (901, None, 0.5)], "id int, y int, s double")
    want = brute_rank([s for _, _, s in rows] + [0.5])
    got = {r.id: r.rank for r in od.average_rank(df, "s").collect()}
    assert all(got[i] == pytest.approx(want[s]) for i, _, s in rows) and got[900] is None
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg)
    assert mt.auc(df, "y", "s").head().auc == pytest.approx(auc)
    tp = fp = ap = 0
    for v in sorted({s for _, _, s in rows}, reverse=True):
        p, n = sum(1 for x in pos if x == v), sum(1 for x in neg if x == v)
        tp, fp = tp + p, fp + n
        ap += p / len(pos) * tp / (tp + fp)
    assert mt.average_precision(df, "y", "s").head()[0] == pytest.approx(ap)
    place = {r.id: r.v for r in inf.placements(df, "y", "s").collect()}
    for i, y, s in rows:
        other = neg if y else pos
        assert place[i] == pytest.approx(sum((s > o) + (s == o) / 2 if y else (o > s) + (o == s) / 2 for o in other) / len(other))


def test_one_class_and_constant_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.7)], "id int, y int, s double")
    assert mt.auc(df, "y", "s").head().auc is None
    flat = spark.createDataFrame([(i, i % 2, 1.0) for i in range(10)], "id int, y int, s double")
    assert mt.auc(flat, "y", "s").head().auc == 0.5
    assert pf.pearson(flat, [("y", "s")]).head().r is None
    assert mt.auc(flat.limit(0), "y", "s").head().auc is None


def test_campaign_fixture(spark):
    df = spark.createDataFrame(list(enumerate([0.9, 0.1, 0.5, 0.5, 0.5, 0.2, 0.8, 0.3])), "k int, s double")
    assert {r.k for r in od.top_fraction(df, "s", 0.25, "k").filter("selected = 1").collect()} == {0, 6}
    flat = spark.range(100).select("id", F.lit(0.0).alias("s"))
    got = od.top_fraction(flat, "s", 0.25, "id")
    assert got.count() == 100 and {r.id for r in got.filter("selected = 1").collect()} == set(range(25))
    seeded = {r.id for r in od.top_fraction(flat, "s", 0.25, "id", seed=3).filter("selected = 1").collect()}
    assert len(seeded) == 25 and seeded != set(range(25))


def test_capture_curve_against_sorting(spark):
    rows = scored(5, 97)
    df = spark.createDataFrame(rows, "id int, y int, s double")
    order = sorted(rows, key=lambda r: (-r[2], r[0]))
    pos = sum(y for _, y, _ in rows)
    for r in mt.capture_curve(df, "y", "s", "id", 21).collect():
        assert r.contacted == round(r.capacity * 97) and r.tp == sum(y for _, y, _ in order[: r.contacted]) and r.capture == pytest.approx(r.tp / pos)


def test_running_totals_by_group(spark):
    r = random.Random(2)
    rows = [(g, v, r.randrange(5)) for g in "xy" for v in r.sample(range(-500, 500), 120)]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    for down in (False, True):
        for x in od.running_totals(df, "v", {"t": "n"}, ["g"], down, ranges=7).collect():
            assert x.t == sum(n for g, v, n in rows if g == x.g and (v >= x.v if down else v <= x.v))


def test_quantile_bins_keep_ties_together(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 50 + list(range(2, 52))], "v double")
    bins = {}
    for r in pf.quantile_bins(df, "v", 4).collect():
        bins.setdefault(r.v, set()).add(r.bin)
    assert all(len(b) == 1 for b in bins.values()) and len(set.union(*bins.values())) == 3


def test_holm_is_monotone(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    df = spark.createDataFrame(list(enumerate(p)), "k int, p double")
    got = {r.k: r.p_adjusted for r in inf.adjust_p(df, "p", "k").collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.04, 0.09, 0.09, 0.025, 0.5])


def test_mcnemar_and_wilcoxon_fixtures(spark):
    y = [1] * 40 + [0] * 60
    rows = [(v, 1 - v if i < 3 else v, 1 - v if 10 <= i < 25 else v) for i, v in enumerate(y)]
    m = inf.mcnemar(spark.createDataFrame(rows, "y int, a int, b int"), "y", "a", "b").head()
    assert (m.only_a, m.only_b) == (15, 3) and m.p == pytest.approx(0.00754, abs=1e-4)
    w = inf.wilcoxon(spark.createDataFrame([(0.5 + i / 100, 0.5) for i in range(1, 16)], "a double, b double"), "a", "b").head()
    assert w.p == pytest.approx(2 / 2**15) and w.wins == 15
    same = inf.wilcoxon(spark.createDataFrame([(1.0, 1.0)] * 4, "a double, b double"), "a", "b").head()
    assert (same.statistic, same.p) == (0.0, 1.0)


def test_dm_with_one_step_is_the_paired_t(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, r.random(), r.random()) for i in range(60)], "i int, a double, b double")
    dm, t = inf.diebold_mariano(df, "i", "a", "b").head(), inf.corrected_t(df, "a", "b", test_train=0.0).head()
    assert dm.statistic == pytest.approx(t.t) and dm.p_two_sided == pytest.approx(t.p)
    back = inf.diebold_mariano(df, "i", "b", "a").head()
    assert back.statistic == pytest.approx(-dm.statistic)


def test_bootstrap_covers_the_estimate(spark):
    rows = scored(7, 400, ties=False)
    df = spark.createDataFrame(rows, "id int, y int, s double")
    reps = [r.auc for r in inf.bootstrap_auc(df, "id", "y", "s", 60).collect()]
    auc = mt.auc(df, "y", "s").head().auc
    assert len(reps) == 60 and min(reps) < auc < max(reps) and abs(sum(reps) / 60 - auc) < 0.02
    assert sorted(reps) == sorted(r.auc for r in inf.bootstrap_auc(df.repartition(5), "id", "y", "s", 60).collect())


def test_kmeans_1d_against_all_cuts():
    from itertools import combinations

    r = random.Random(4)
    x, w = sorted(r.gauss(0, 1) for _ in range(12)), [r.randrange(1, 5) for _ in range(12)]

    def cost(a, b):
        m = sum(w[i] * x[i] for i in range(a, b)) / sum(w[a:b])
        return sum(w[i] * (x[i] - m) ** 2 for i in range(a, b)), m

    for k in (1, 2, 3, 4):
        best = min((sum(cost(a, b)[0] for a, b in zip((0, *c), (*c, 12), strict=True)), [cost(a, b)[1] for a, b in zip((0, *c), (*c, 12), strict=True)]) for c in combinations(range(1, 12), k - 1))
        assert mx.kmeans_1d(x, w, k) == pytest.approx(best[1])


def test_tree_recovers_steps(spark):
    r = random.Random(6)
    rows = [(i, float(r.randrange(6)), r.random()) for i in range(800)]
    df = spark.createDataFrame([(i, a, b, (5.0 if a > 2 else 0.0) + (2.0 if b > 0.5 else 0.0)) for i, a, b in rows], "id int, a double, b double, r double")
    codes = md.encode_bins(df, ["a", "b"], md.bin_cuts(df, ["a", "b"], 8), ["id", "r"])
    tree = md.grow_tree(codes, "id", "r", 2, 10, 0.0)
    top = tree.filter("node = 0").head()
    assert (top.variable, top.code) == ("a", 2)
    pred = {x.id: x.value for x in md.predict_tree(codes, "id", tree).collect()}
    err = [abs(pred[i] - ((5.0 if a > 2 else 0.0) + (2.0 if b > 0.5 else 0.0))) for i, a, b in rows]
    assert sum(err) / len(err) < 0.2


def test_mixture_recovers_centres(spark):
    r = random.Random(8)
    df = spark.createDataFrame([(r.gauss(-0.3 if r.random() < 0.3 else 0.4, 0.03),) for _ in range(3000)], "r double")
    m = mx.fit_mixture(df, "r", 2).head()
    assert sorted(m.c) == pytest.approx([-0.3, 0.4], abs=0.01) and m.sigma == pytest.approx(0.03, abs=0.005)


def test_lookup_align_and_violations(spark):
    df = spark.createDataFrame([(1, "x", "3"), (2, "x", "7.5"), (3, None, "abc")], "k int, c string, v string")
    assert rl.lookup_one(df, k=2).head().k == 2
    for bad in ({"c": "x"}, {}):
        if bad:
            with pytest.raises(Exception, match="not exactly one"):
                rl.lookup_one(df, **bad).collect()
    rules = {"c": {"kind": "category", "levels": ["x"]}, "v": {"kind": "integer", "min": 0, "max": 5}}
    got = {r.k: list(r.violations) for r in rl.violations(df, rules).collect()}
    assert got == {1: [], 2: ["v: not an integer", "v: out of range"], 3: ["c: missing", "v: not a number"]}
    with pytest.raises(Exception, match="repeated key"):
        rl.align(df.union(df), df.select("k"), "k").collect()


def test_replicates_null_and_empty(spark):
    empty = spark.createDataFrame([], "id int, a double, b double")
    assert inf.permutation_test(empty, "id", "a", "b", 10).count() in (0, 1)
    assert pf.outliers(empty, ["a"]).count() == 0
    assert pf.missing(spark.createDataFrame([(None, 1)], "a double, b int")).head().missing == 1


def test_boosting_fits_and_covers(spark):
    from tidemark.operators.boosting import fit_steps, step_outputs

    r = random.Random(11)
    rows = []
    for i in range(1500):
        a, b = r.random(), float(r.randrange(5))
        rows.append((i, a, b, 3 * (a > 0.5) + b + (4.0 if r.random() < 0.3 else 0.0) + r.gauss(0, 0.1)))
    df = spark.createDataFrame(rows, "id int, a double, b double, y double").repartition(4)
    m = fit_steps(df.filter("id % 3 = 0"), df.filter("id % 3 = 1"), ["a", "b"], "y", warm=6, turns=2, rounds=2, depth=2, rate=0.5)
    assert sorted(m["pi"])[0] == pytest.approx(0.3, abs=0.1) and max(m["c"]) - min(m["c"]) == pytest.approx(4.0, abs=0.5)
    out = step_outputs(df.filter("id % 3 = 2"), m, 4.0).collect()
    assert 0.84 < sum(x.low <= x.y <= x.high for x in out) / len(out) < 0.97
    hit = [(x.p_exceeds, x.y > 4.0) for x in out]
    pos, neg = [p for p, h in hit if h], [p for p, h in hit if not h]
    assert sum(pos) / len(pos) > sum(neg) / len(neg) + 0.25  # 0.41 for the true model


def test_nested_ridge_against_refits(spark):
    import numpy as np

    from tidemark.operators.search import grid, nested_ridge

    r = np.random.default_rng(0)
    x = r.normal(size=(90, 2))
    y = x @ [1.0, -2.0] + r.normal(size=90)
    df = spark.createDataFrame([(int(i % 3), float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "fold int, a double, b double, y double")
    got = {g.outer: g for g in nested_ridge(df, ["a", "b"], "y", grid(spark, penalty=[0.1, 100.0])).collect()}
    f = np.arange(90) % 3
    design = np.c_[np.ones(90), x]

    def rmse(train, test, lam):
        w = np.linalg.solve(design[train].T @ design[train] + lam * np.diag([0, 1, 1]), design[train].T @ y[train])
        return float(np.sqrt(((design[test] @ w - y[test]) ** 2).mean()))

    for k in range(3):
        inner = {lam: np.mean([rmse((f != k) & (f != i), f == i, lam) for i in range(3) if i != k]) for lam in (0.1, 100.0)}
        lam = min(inner, key=inner.get)
        assert got[k].penalty == lam and got[k].inner_rmse == pytest.approx(inner[lam]) and got[k].outer_rmse == pytest.approx(rmse(f != k, f == k, lam))


def test_replicates_and_steps_of_the_reference(spark):
    from tidemark.operators.mixture import fit_mixture, useful_steps
    from tidemark.plans import registry

    assert useful_steps([0.5, 0.3, 0.195, 0.005], [0.0, 3.0, 9.0, 30.0], 1.0) == 2
    g = random.Random(1).gauss
    m = fit_mixture(spark.createDataFrame([(c + g(0, 0.3),) for c in [-5.0, 0.0, 7.0] * 300], "r double"), "r").head()
    assert [round(c) for c in m.c] == [-5, 0, 7] and m.pi == pytest.approx([1 / 3] * 3, abs=0.01)
    assert len(fit_mixture(spark.createDataFrame([(g(0, 1),) for _ in range(900)], "r double"), "r").head().c) == 1
    q, sf = registry.queries(), "/root/testdata/sf0.001"
    if os.path.isdir(sf):
        assert q["T9_permutation"](spark, sf).head().n_perm == 10000
        assert q["T4_bootstrap_auc"](spark, sf).count() == q["T5_bootstrap_regression"](spark, sf).count() == 2000


def test_ranges_of_skewed_values_are_even(spark):
    df = spark.range(4000).select(F.exp(F.col("id") / 200.0).alias("v"))
    got = [r["count"] for r in od.with_range(df, "v", 16).groupBy("__range").count().collect()]
    assert len(got) == 16 and max(got) < 400
    assert od.with_range(df.limit(0), "v", 16).count() == 0


def test_quantiles_by_group(spark):
    r = random.Random(3)
    rows = [(k % 3, r.expovariate(1) if k % 7 else None) for k in range(400)]
    got = {x.g: x.q for x in od.quantiles(spark.createDataFrame(rows, "g int, v double"), "v", [0.0, 0.3, 1.0], "q", ["g"]).collect()}
    for g in range(3):
        v = sorted(x for k, x in rows if k == g and x is not None)
        at = 0.3 * (len(v) - 1)
        assert got[g] == pytest.approx([v[0], v[int(at)] + (at - int(at)) * (v[int(at) + 1] - v[int(at)]), v[-1]])


def test_normal_tail_column(spark):
    from tidemark.functions.columns import norm_sf
    from tidemark.functions.dist import norm_sf as exact

    z = [-40.0, -8.0, -2.5, -0.1, 0.0, 0.3, 1.96, 6.9, 7.2, 20.0, 38.0, None]
    got = [x.p for x in spark.createDataFrame([(x,) for x in z], "z double").select(norm_sf("z").alias("p")).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([exact(x) for x in z[:-1]], rel=1e-6, abs=1e-15)


def test_mixture_quantiles_and_level_sets(spark):
    import numpy as np

    m = mx.Mixture(np.array([0.3, 0.7]), np.array([-4.0, 3.0]), 0.5)
    for p in (0.05, 0.3, 0.9):
        assert m.cdf(m.quantile(p)) == pytest.approx(p, abs=1e-9)
    parts = m.level_set(0.9)
    assert len(parts) == 2 and sum(m.cdf(b) - m.cdf(a) for a, b in parts) == pytest.approx(0.9, abs=1e-4)
    ends = m.density(np.array(parts).ravel())
    assert ends == pytest.approx([ends[0]] * 4, rel=1e-2)
    assert sum(b - a for a, b in parts) < m.quantile(0.95) - m.quantile(0.05)
    df = spark.createDataFrame([(0.0, -4.0), (0.0, 0.0), (1.0, 4.0)], "f double, y double")
    out = mx.mixture_outputs(df, "f", m, 2.0)
    assert out.filter("f = 0").head().p_exceeds == pytest.approx(1 - m.cdf(2.0), abs=1e-9)
    assert mx.set_coverage(out, "y").head().set_coverage == pytest.approx(2 / 3)


def test_fit_keeps_degenerate_data(spark):
    one = mx.fit_mixture(spark.createDataFrame([(2.0,)] * 5, "r double"), "r", 2).head()
    assert list(one.c) == [2.0] and one.sigma >= 0


def test_platt_is_the_logistic_fit(spark):
    r = random.Random(5)
    rows = [(x, int(r.random() < 1 / (1 + 2.718281828 ** -(2 * x - 0.5)))) for x in (r.gauss(0, 1) for _ in range(4000))]
    m = mt.platt(spark.createDataFrame(rows, "s double, y int"), "y", "s").head()
    assert m.slope == pytest.approx(2, abs=0.2) and m.intercept == pytest.approx(-0.5, abs=0.15)


def test_logistic_boosting_learns_log_odds(spark):
    from tidemark.functions.columns import sigmoid
    from tidemark.operators.boosting import boost, predict_column

    r = random.Random(5)
    rows = []
    for i in range(3000):
        a, b = r.random(), None if i % 50 == 0 else float(r.randrange(4))
        rows.append((i, a, b, int(r.random() < (0.9 if a > 0.5 else 0.2))))
    df = spark.createDataFrame(rows, "id int, a double, b double, y int").repartition(4)
    m = boost(df, ["a", "b"], "y", rounds=12, depth=1, rate=0.5, logistic=True)
    got = df.withColumn("p", sigmoid(predict_column(m))).groupBy((F.col("a") > 0.5).alias("k")).agg(F.avg("p").alias("p"), F.avg("y").alias("y")).collect()
    for g in got:
        assert g.p == pytest.approx(g.y, abs=0.03)


def test_trees_match_their_leaf_means_with_nulls(spark):
    from tidemark.operators.boosting import fit_tree, tree_column

    r = random.Random(6)
    df = spark.createDataFrame([(None if i % 7 == 0 else r.random(), r.gauss(0, 1) + (i % 7 == 0)) for i in range(400)], "a double, y double")
    t = fit_tree(df, ["a"], {"a": [0.25, 0.5, 0.75]}, F.col("y"), 2, 5, 1.0)
    leaves = df.groupBy(tree_column(t, ["a"], leaf="node").alias("k")).agg((F.sum("y") / (F.count("*") + 1)).alias("v")).collect()
    assert t["split"] and {x.k: x.v for x in leaves} == pytest.approx({x.k: t["value"][x.k] for x in leaves})
    assert fit_tree(df, ["a"], {"a": []}, F.col("y"), 2, 5, 1.0)["value"][0] == pytest.approx(df.agg(F.sum("y")).head()[0] / 401)


def test_bca_p_is_where_an_end_meets_zero(spark):
    r = random.Random(7)
    rows = [(i, y, y + r.gauss(0, 1.0), y + r.gauss(0, 1.08)) for i in range(300) for y in [r.gauss(0, 3)]]
    df = spark.createDataFrame(rows, "id int, y double, a double, b double").repartition(4)
    reps = inf.bootstrap_regression(df, "id", "y", "a", "b", 400).cache()
    seen = inf.regression_differences(df, "y", "a", "b").select(F.col("rmse").alias("estimate"))
    jack = inf.jackknife_regression(df, "y", "a", "b").select("id", F.col("rmse").alias("estimate")).cache()
    rmse = lambda rs, k: (sum((x[k] - x[1]) ** 2 for x in rs) / len(rs)) ** 0.5
    assert seen.head()[0] == pytest.approx(rmse(rows, 3) - rmse(rows, 2))
    left = [x for x in rows if x[0] != 17]
    assert jack.filter("id = 17").head().estimate == pytest.approx(rmse(left, 3) - rmse(left, 2))
    p = inf.bca_p(reps, "rmse", seen, jack).head().p
    assert 0.005 < p < 1
    wide, tight = (inf.bca(reps, "rmse", seen, jack, 1 - q).head() for q in (p * 0.8, min(0.99, p * 1.25)))
    assert wide.low < 0 < wide.high and not tight.low < 0 < tight.high


def test_optimal_block_follows_dependence(spark):
    import numpy as np

    r = np.random.default_rng(3)
    noise, walk = r.normal(size=800), [0.0]
    for e in noise[1:]:
        walk.append(0.8 * walk[-1] + e)
    df = spark.createDataFrame([(i, float(a), float(b), 1.0) for i, (a, b) in enumerate(zip(noise, walk))], "i int, a double, b double, c double")

    def brute(x):  # Politis and White, written out
        x = np.asarray(x) - np.mean(x)
        n = len(x)
        acov = [float(x[k:] @ x[: n - k]) / n for k in range(40)]
        top, m = int(np.ceil(n**0.5)) + 5, 0
        while any(abs(acov[m + k] / acov[0]) >= 2 * (np.log10(n) / n) ** 0.5 for k in range(1, 6) if m + k <= top):
            m += 1
        w = min(2 * max(m, 1), top)
        lam = lambda t: 1.0 if abs(t) <= 0.5 else 2 * (1 - abs(t))
        g = sum(lam(k / w) * abs(k) * acov[abs(k)] for k in range(-w, w + 1))
        d = 2 * sum(lam(k / w) * acov[abs(k)] for k in range(-w, w + 1)) ** 2
        return max(1.0, min((2 * g * g / d) ** (1 / 3) * n ** (1 / 3), np.ceil(min(3 * n**0.5, n / 3))))

    a, b = inf.optimal_block(df, "i", "a"), inf.optimal_block(df, "i", "b")
    assert a == pytest.approx(brute(noise)) and b == pytest.approx(brute(walk)) and b > a
    assert inf.optimal_block(df, "i", "c") == 1.0 and inf.optimal_block(df.limit(3), "i", "a") == 1.0


def test_permutation_explanation_adds_up(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), float(i % 3)) for i in range(40)], "id int, a double, b double, c double")
    score = lambda v: v["a"] * v["b"] + v["c"] * v["c"]
    got = md.permutation_explanation(df, "id", ["a", "b", "c"], score, df, F.col("id"), most=10, turns=3).collect()
    base = sum((i % 7) * (i % 5) + (i % 3) ** 2 for i in range(10)) / 10
    for i in (0, 13, 39):
        assert sum(x.contribution for x in got if x.id == i) == pytest.approx((i % 7) * (i % 5) + (i % 3) ** 2 - base)
    squares = sum((i % 3) ** 2 for i in range(10)) / 10  # c is alone in its term, so its part is known
    assert {x.id: x.contribution for x in got if x.variable == "c"}[13] == pytest.approx(1 - squares)


def test_tree_explanation_adds_up(spark):
    tree = {"variable": [0, 1, 0, -1, -1, -1, -1], "cut": [3, 1, 5, 0, 0, 0, 0], "value": [0, 0, 0, 1.0, 2.0, 4.0, 8.0], "cover": [20, 8, 12, 6, 2, 3, 9]}
    df = spark.createDataFrame([(i, float(i % 7), float(i % 5), 0.0) for i in range(20)], "id int, a double, b double, z double")
    got = md.tree_explanation(df, "id", ["a", "b", "z"], [tree, tree], 0.5).collect()
    mean = (6 * 1 + 2 * 2 + 3 * 4 + 9 * 8) / 20
    for i in range(20):
        want = (1.0 if i % 5 <= 1 else 2.0) if i % 7 <= 3 else (4.0 if i % 7 <= 5 else 8.0)
        assert sum(x.contribution for x in got if x.id == i) == pytest.approx(want - mean)
    assert all(x.contribution == 0 for x in got if x.variable == "z")
