"""Property tests against brute force on small random fixtures."""

import bisect

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitalrates.functions import Bins, cut
from vitalrates.operators import counts as C
from vitalrates.operators.contrast import contrast_diff, contrast_ratio
from vitalrates.operators.harmonise import AGE_BREAKS, AGE_GROUPS

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


def brute_interp(values):
    """Row-position linear interpolation; leading/trailing gaps stay None."""
    known = [i for i, v in enumerate(values) if v is not None]
    out = list(values)
    for i, v in enumerate(values):
        if v is None:
            lo = [k for k in known if k < i]
            hi = [k for k in known if k > i]
            if lo and hi:
                a, b = lo[-1], hi[0]
                out[i] = values[a] + (values[b] - values[a]) * ((i - a) / (b - a))
    return out


series = st.lists(st.lists(st.one_of(st.none(), st.integers(0, 500)), min_size=1, max_size=9), min_size=1, max_size=4)


@SETTINGS
@given(series)
def test_interpolation_matches_brute_force(spark, groups):
    rows = [(f"g{g}", 1990 + i, None if v is None else float(v)) for g, vals in enumerate(groups)
            for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "g string, year int, v double")
    got = {(r.g, r.year): r.v for r in C.interpolate(df, "v", ["g"]).collect()}
    for g, vals in enumerate(groups):
        want = brute_interp([None if v is None else float(v) for v in vals])
        for i, w in enumerate(want):
            x = got[(f"g{g}", 1990 + i)]
            assert (x is None and w is None) or abs(x - w) < 1e-9


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.integers(-5, 130)), min_size=1, max_size=30))
def test_cut_matches_bisect(spark, ages):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, a int")
    got = {r.i: r.g for r in df.select("i", cut(F.col("a"), Bins(AGE_BREAKS, AGE_GROUPS)).alias("g")).collect()}
    for i, a in enumerate(ages):
        if a is None or a < AGE_BREAKS[0] or a >= AGE_BREAKS[-1]:
            assert got[i] is None
        else:
            assert got[i] == AGE_GROUPS[bisect.bisect_right(AGE_BREAKS, a) - 1]


@SETTINGS
@given(st.lists(st.tuples(st.floats(0.1, 1e4), st.floats(0.1, 1e4)), min_size=1, max_size=6))
def test_contrasts_antisymmetric_and_inverse(spark, pairs):
    rows = []
    for k, (m, f) in enumerate(pairs):
        rows += [(k, "Male", m, m / 2, m * 2), (k, "Female", f, f / 2, f * 2)]
    df = spark.createDataFrame(rows, "k int, sex string, SMR double, LCI double, UCI double")
    swapped = df.withColumn("sex", F.when(F.col("sex") == "Male", "Female").otherwise("Male"))
    d1 = {r.k: r.x for r in contrast_diff(df, ["k"], "SMR", "x").collect()}
    d2 = {r.k: r.x for r in contrast_diff(swapped, ["k"], "SMR", "x").collect()}
    r1 = {r.k: r.smr_ratio for r in contrast_ratio(df, ["k"]).collect()}
    r2 = {r.k: r.smr_ratio for r in contrast_ratio(swapped, ["k"]).collect()}
    for k in d1:
        assert d1[k] == -d2[k]
        assert abs(r1[k] * r2[k] - 1.0) < 1e-12


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(1, 3), st.integers(0, 40)), max_size=25))
def test_strata_resums_equal_total_and_complete_grid_size(spark, rows):
    df = spark.createDataFrame(rows or [("a", 1, 0)], "k string, year int, n long")
    cube = C.base_cube(df, ["k", "year"])
    total = df.count()
    assert C.count_strata(cube, ["year"]).agg(F.sum("n")).collect()[0][0] == total
    grid = C.grid(spark, {"year": [1, 2, 3], "k": ["a", "b"]})
    full = C.complete(C.count_strata(cube, ["year", "k"]).where(F.col("k").isNotNull()), grid, "n", 0)
    assert full.count() == 6
