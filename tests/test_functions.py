"""Missing-value semantics, binning and text helpers."""

from pyspark.sql import functions as F

from vitalrates.functions import (Bins, cut, decade, est_ci_text, if_else, is_in, join_ns,
                                  number_from_header, strict_sum, to_number, zero_pad)
from vitalrates.operators.harmonise import AGE_BREAKS, AGE_GROUPS


def test_is_in_never_null(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "x string")
    got = [r[0] for r in df.select(is_in(F.col("x"), ["a"])).collect()]
    assert got == [True, False, False]
    neg = [r[0] for r in df.select(~is_in(F.col("x"), ["a"])).collect()]
    assert neg == [False, True, True]


def test_if_else_missing_condition_is_missing(spark):
    df = spark.createDataFrame([("External causes",), ("Neoplasms",), (None,)], "c string")
    got = [r[0] for r in df.select(if_else(F.col("c") == "External causes", F.lit("E"), F.lit("N"))).collect()]
    assert got == ["E", "N", None]


def test_strict_sum_propagates_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0), ("c", None)], "k string, v double")
    got = dict(df.groupBy("k").agg(strict_sum("v").alias("s")).collect())
    assert got == {"a": None, "b": 5.0, "c": None}
    plain = dict(df.groupBy("k").agg(F.sum("v").alias("s")).collect())
    assert plain == {"a": 1.0, "b": 5.0, "c": None}


def test_join_ns_matches_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("x", 2), ("y", 3)], "k string, a int")
    right = spark.createDataFrame([(None, 10), ("x", 20), ("z", 30)], "k string, b int")
    full = sorted(join_ns(left, right, ["k"], "full").collect(), key=lambda r: (r.k or "", r.a or 0))
    assert [(r.k, r.a, r.b) for r in full] == [(None, 1, 10), ("x", 2, 20), ("y", 3, None), ("z", None, 30)]
    rj = sorted(join_ns(left, right, ["k"], "right").collect(), key=lambda r: r.b)
    assert [(r.k, r.a, r.b) for r in rj] == [(None, 1, 10), ("x", 2, 20), ("z", None, 30)]


def test_cut_left_closed_at_every_break(spark):
    ages = [-1, 0, 1, 4, 5, 14, 15, 24, 25, 59, 60, 84, 85, 124, 125, None]
    df = spark.createDataFrame([(a,) for a in ages], "a int")
    got = [r[0] for r in df.select(cut(F.col("a"), Bins(AGE_BREAKS, AGE_GROUPS))).collect()]
    assert got == [None, "<1", "1-4", "1-4", "5-14", "5-14", "15-24", "15-24", "25-59", "25-59", "60+", "60+",
                   "60+", "60+", None, None]


def test_midpoints_reference_airp():
    assert [m for _, m in Bins(AGE_BREAKS, AGE_GROUPS).midpoints()] == [0.0, 2.5, 9.5, 19.5, 42.0, 60.0]


def test_decade(spark):
    df = spark.createDataFrame([(1980,), (1989,), (1990,), (2023,)], "y int")
    assert [r[0] for r in df.select(decade(F.col("y"))).collect()] == [1980, 1980, 1990, 2020]


def test_zero_pad_never_truncates(spark):
    df = spark.createDataFrame([("5",), ("05",), ("123456",), ("",), (None,), (" 7 ",), ("0",), ("x1",),
                                ("5.0",), ("12.5",), ("-1",)], "x string")
    got = [r[0] for r in df.select(zero_pad(F.col("x"), 3)).collect()]
    assert got == ["005", "005", "123456", None, None, "007", "000", None, "005", None, None]


def test_to_number_tolerant(spark):
    df = spark.createDataFrame([("12",), ("1.0",), ("1.5",), ("abc",), (None,)], "x string")
    assert [r[0] for r in df.select(to_number(F.col("x"))).collect()] == [12, 1, None, None, None]


def test_age_from_header_unicode():
    assert [number_from_header(h) for h in ("Hombres_85 y más", "Mujeres_0", "Total Hombres")] == [85, 0, None]


def test_report_text(spark):
    df = spark.createDataFrame([(1.234, 1.0, 1.5), (None, 0.5, 2.0)], "e double, l double, u double")
    got = [r[0] for r in df.select(est_ci_text(F.col("e"), F.col("l"), F.col("u"))).collect()]
    assert got == ["1.23 (1.00, 1.50)", "NA (0.50, 2.00)"]
