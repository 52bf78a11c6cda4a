"""Interpolation, suppression, completion, standardisation, contrasts
(R1-R8, C1, C2) against hand-computed values."""

import math

from pyspark.sql import functions as F

from vitalrates.operators import counts as C
from vitalrates.operators import standardise as S
from vitalrates.operators.contrast import contrast_diff, contrast_ratio


def _series(spark, rows):
    return spark.createDataFrame(rows, "g string, year int, v double")


def test_interpolate_gaps_and_edges(spark):
    rows = [("a", 1990, 10.0), ("a", 1991, None), ("a", 1992, 20.0),           # gap of one
            ("b", 1990, 0.0), ("b", 1991, None), ("b", 1992, None), ("b", 1993, 30.0),  # gap of two
            ("c", 1990, None), ("c", 1991, 5.0), ("c", 1992, None),            # edges stay NULL
            ("d", 1989, 10.0), ("d", 1991, None), ("d", 1993, 40.0)]           # absent years
    out = C.interpolate(_series(spark, rows), "v", ["g"])
    got = {(r.g, r.year): r.v for r in out.collect()}
    assert got[("a", 1991)] == 15.0
    assert got[("b", 1991)] == 10.0 and got[("b", 1992)] == 20.0
    assert got[("c", 1990)] is None and got[("c", 1992)] is None
    assert got[("d", 1991)] == 25.0  # row position, not year distance
    by_year = {(r.g, r.year): r.v for r in C.interpolate(_series(spark, rows), "v", ["g"], x="year").collect()}
    assert by_year[("d", 1991)] == 25.0 and by_year[("a", 1991)] == 15.0


def test_interpolate_year_vs_row_differ(spark):
    rows = [("d", 1989, 10.0), ("d", 1990, None), ("d", 1993, 40.0)]
    row = {r.year: r.v for r in C.interpolate(_series(spark, rows), "v", ["g"]).collect()}
    yr = {r.year: r.v for r in C.interpolate(_series(spark, rows), "v", ["g"], x="year").collect()}
    assert row[1990] == 25.0 and yr[1990] == 17.5


def test_anchor_modes(spark):
    counts = spark.createDataFrame([(1990, "<1", 8), (1991, "<1", 9), (1992, "<1", 30)],
                                   "year int, age_group string, n bigint")
    grid = C.grid(spark, {"year": [1990], "age_group": ["<1", "1-4"]})
    mask = (F.col("year") == 1991)
    anchor = (F.col("year") == 1990)
    over = {(r.year, r.age_group): r.n for r in
            C.mask_and_interpolate(counts, "n", ["age_group"], mask, anchor_grid=grid, anchor_mask=anchor).collect()}
    assert over[(1990, "<1")] == 0.0 and over[(1991, "<1")] == 15.0 and over[(1990, "1-4")] == 0.0
    fill = {(r.year, r.age_group): r.n for r in
            C.mask_and_interpolate(counts, "n", ["age_group"], mask, anchor_grid=grid, anchor_mask=anchor,
                                   anchor="fill_missing").collect()}
    assert fill[(1990, "<1")] == 8.0 and fill[(1991, "<1")] == 19.0 and fill[(1990, "1-4")] == 0.0


def test_suppress_and_complete(spark):
    df = spark.createDataFrame([(1, "x", 0.0), (1, "y", 9.0), (2, "x", 10.0), (2, "y", 11.0), (3, "x", None)],
                               "year int, k string, n double")
    kept = C.suppress_small(df, "n", 10)
    assert sorted((r.year, r.k) for r in kept.collect()) == [(2, "x"), (2, "y")]
    grid = C.grid(spark, {"year": [1, 2, 3], "k": ["x", "y"]})
    full = C.complete(kept, grid, "n", 0.0)
    rows = {(r.year, r.k): r.n for r in full.collect()}
    assert len(rows) == 6 and rows[(1, "x")] == 0.0 and rows[(2, "y")] == 11.0


def test_grid_with_data_domain(spark):
    dom = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    g = C.grid(spark, {"year": [1, 2], "c": dom, "sex": ["M", "F"]})
    assert g.columns == ["year", "c", "sex"] and g.count() == 2 * 3 * 2


def _std(spark):
    return spark.createDataFrame([("<1", 100), ("1-4", 300)], "age_group string, pop_ref bigint") \
        .withColumn("prop_ref", F.col("pop_ref") / F.sum("pop_ref").over(__import__("pyspark.sql").sql.Window.partitionBy()))


def test_standardise_equal_rates(spark):
    std = _std(spark)
    pop = spark.createDataFrame([(2000, "<1", 1000), (2000, "1-4", 4000)], "year int, age_group string, nj bigint")
    cnt = spark.createDataFrame([(2000, "<1", 10.0), (2000, "1-4", 40.0)], "year int, age_group string, dj double")
    r = S.stratum_rates(pop, cnt, std, ["year", "age_group"], "dj", "nj", "rj", "rj_std")
    s = S.standardise(r, ["year"], "rj", "rj_std").collect()[0]
    assert math.isclose(s.r_std, 1000.0) and math.isclose(s.d_std, 4.0)
    assert math.isclose(s.se, 0.5) and math.isclose(s.LCI, 1000 * math.exp(-0.98))
    assert sum(x.prop_ref for x in std.collect()) == 1.0


def test_zero_expected_gives_null_limits(spark):
    std = _std(spark)
    pop = spark.createDataFrame([(2000, "<1", 1000), (2000, "1-4", 4000)], "year int, age_group string, nj bigint")
    cnt = spark.createDataFrame([(2000, "<1", 0.0), (2000, "1-4", 0.0)], "year int, age_group string, dj double")
    r = S.stratum_rates(pop, cnt, std, ["year", "age_group"], "dj", "nj", "rj", "rj_std")
    s = S.standardise(r, ["year"], "rj", "rj_std").collect()[0]
    assert s.r_std == 0.0 and s.se is None and s.LCI is None and s.UCI is None


def test_missing_stratum_propagates(spark):
    std = _std(spark)
    pop = spark.createDataFrame([(2000, "<1", 1000), (2000, "1-4", 4000)], "year int, age_group string, nj bigint")
    cnt = spark.createDataFrame([(2000, "<1", 10.0)], "year int, age_group string, dj double")
    r = S.stratum_rates(pop, cnt, std, ["year", "age_group"], "dj", "nj", "rj", "rj_std")
    assert S.standardise(r, ["year"], "rj", "rj_std").collect()[0].r_std is None


def test_age_distribution(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", None), ("b", 2)], "g string, v bigint")
    got = sorted((r.g, r.v, r.prop) for r in S.age_distribution(df, ["g"], "v").collect() if r.v is not None)
    assert got == [("a", 1, 0.25), ("a", 3, 0.75), ("b", 2, None)]


def test_contrasts(spark):
    df = spark.createDataFrame([(1, "Male", 3.0, 2.0, 4.0), (1, "Female", 1.0, 0.5, 2.0)],
                               "k int, sex string, SMR double, LCI double, UCI double")
    d = contrast_diff(df, ["k"], "SMR", "dsmr").collect()[0]
    assert d.dsmr == 2.0 and "Male" not in d.asDict()
    r = contrast_ratio(df, ["k"]).collect()[0]
    assert (r.smr_ratio, r.LCI, r.UCI) == (3.0, 2.0, 4.0)  # LCI = UCI_M/UCI_F, UCI = LCI_M/LCI_F
    lg = contrast_ratio(df, ["k"], method="log").collect()[0]
    assert lg.LCI < lg.smr_ratio < lg.UCI


def test_report_table_equals_full_outer_join_chain(spark):
    """The one grouping of a report table equals the chain of full outer joins
    of its separately widened parts, missing keys and levels included."""
    from vitalrates.functions import join_ns
    from vitalrates.operators import harmonise as H
    from vitalrates.plans.study import Study
    schema = "regime string, decade int, cause_ext string, sex string, est double, lo double, hi double"
    rows = [("x", 1, c, s, v, v - 0.5, v + 1.0) for c, s, v in (("All", "Male", 3.0), ("All", "Female", 2.0),
            (H.EXTERNAL, "Male", 1.0), (H.NON_EXTERNAL, "Male", 4.0), (H.NON_EXTERNAL, "Female", 5.0))]
    rows += [(None, 1, "All", "Male", 7.0, 6.0, 8.0), (None, 1, "All", "Female", 0.0, 0.0, 0.0),
             ("z", 2, H.EXTERNAL, "Female", 1.0, 0.5, 2.0)]
    df = spark.createDataFrame(rows, schema)
    keys, chain = ["regime", "decade"], None
    for suffix, cause in Study.REPORT_CAUSES:
        part = df.where(F.col("cause_ext") == cause)
        ratio = f"smr_ratio{suffix}" if not suffix else f"smr{suffix}"
        for x in (contrast_diff(part, keys, "est", f"dsmr{suffix}"),
                  contrast_ratio(part, keys, "est", "lo", "hi", ratio, f"LCI{suffix}", f"UCI{suffix}")):
            chain = x if chain is None else join_ns(chain, x, keys, "full")
    got = Study._contrasts([df], keys)
    norm = lambda d: sorted(map(tuple, d.select(*got.columns).collect()), key=str)
    assert norm(got) == norm(chain)
