"""Distribution functions against tabulated values; scalar helpers on odd input."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as cf
from tidemark.functions import dist


@pytest.mark.parametrize(
    "got, want",
    [
        (dist.norm_cdf(1.959963985), 0.975),
        (dist.norm_ppf(0.975), 1.959963985),
        (dist.norm_ppf(0.5), 0.0),
        (dist.t_sf(2.228138852, 10), 0.025),
        (dist.t_sf(-1.0, 1), 0.75),
        (dist.chi2_sf(3.841458821, 1), 0.05),
        (dist.chi2_sf(18.30703805, 10), 0.05),
        (dist.chi2_sf(0.5, 6), 0.9978),
        (dist.f_sf(4.9646, 1, 10), 0.05),
        (dist.f_sf(2.9782, 10, 10), 0.05),
        (dist.binom_two_sided(3, 18), 2 * sum(math.comb(18, i) for i in range(4)) / 2**18),
        (dist.binom_two_sided(5, 10), 1.0),
        (dist.signed_rank_two_sided(120, 15), 2 / 2**15),
        (dist.studentized_range_ppf(0.95, 3), 3.3145),
        (dist.studentized_range_ppf(0.95, 10), 4.4741),
    ],
)
def test_tables(got, want):
    assert got == pytest.approx(want, abs=2e-4)


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (2, None, 1.0), (3, 2.5, 0.0), (4, -3.5, 7.0)], "k int, a double, b double")
    r = {x.k: x for x in df.select("k", cf.isclose("a", "b").alias("close"), cf.ratio("a", "b").alias("ratio"), cf.clip("a", 0, 2).alias("clip"), cf.half_even("a").alias("even")).collect()}
    assert [r[k].close for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert r[3].ratio is None and r[2].clip is None and r[4].clip == 0 and r[3].even == 2 and r[4].even == -4
    xs, ys = F.array(*map(F.lit, (0.0, 1.0, 3.0))), F.array(*map(F.lit, (10.0, 20.0, 0.0)))
    got = [x.v for x in spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 3.0, 9.0, None)], "x double").select(cf.interp("x", xs, ys).alias("v")).collect()]
    assert got == [10, 10, 15, 20, 10, 0, 0, None]
    one = spark.createDataFrame([(1.0,)], "x double").agg(cf.skew_g1("x").alias("s"))
    assert one.head().s is None
