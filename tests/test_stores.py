"""Sinks that commit (S10, S11) and the quarantine of broken lines."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vitalrates.sources.readers import read_deaths, read_deaths_checked
from vitalrates.sources.sinks import read_results, stored_deaths, write_deaths, write_results


def deaths(spark, rows):
    return spark.createDataFrame(rows, "year int, sex string, cause string")


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/data") for f in fs if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.select("year", "sex", "cause").collect()), key=str)


def test_a_delivery_replaces_its_years_only(spark):
    root = tempfile.mkdtemp(prefix="vr-store-")
    first = [(y, s, "I219") for y in (1998, 1999, 2000) for s in ("Male", "Female")] + [(None, "Male", None)]
    assert write_deaths(deaths(spark, first), root) == 1
    before = files(root)
    again = [(1999, "Female", "X954")]
    assert write_deaths(deaths(spark, again), root) == 2
    assert {k: v for k, v in files(root).items() if k in before} == before        # nothing rewritten
    want = [r for r in first if r[0] != 1999] + again
    assert rows(stored_deaths(spark, root)) == sorted(want, key=str)
    write_deaths(deaths(spark, again), root)                                      # the same delivery again
    assert rows(stored_deaths(spark, root)) == sorted(want, key=str)
    assert rows(stored_deaths(spark, root, version=1)) == sorted(first, key=str)
    assert write_deaths(deaths(spark, []), root) == 3                             # nothing delivered, nothing replaced
    scan = stored_deaths(spark, root).where("year = 1999")
    assert scan.count() == 1 and len(scan.inputFiles()) >= 1
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "Join" not in plan


def test_a_failed_delivery_is_invisible(spark):
    root = tempfile.mkdtemp(prefix="vr-store-")
    good = [(2000, "Male", "I219"), (2001, "Male", "I219")]
    write_deaths(deaths(spark, good), root)
    broken = deaths(spark, [(2000, "Female", "X"), (2001, "Female", "boom")]).repartition(2).withColumn(
        "cause", F.when(F.col("cause") == "boom", F.raise_error(F.lit("disk full"))).otherwise(F.col("cause")))
    with pytest.raises(Exception, match="disk full"):
        write_deaths(broken, root)
    assert rows(stored_deaths(spark, root)) == sorted(good)
    with pytest.raises(ValueError):
        stored_deaths(spark, tempfile.mkdtemp(prefix="vr-none-"))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_a_killed_report_leaves_the_former_one(spark, fmt):
    root = tempfile.mkdtemp(prefix="vr-report-")
    one = spark.createDataFrame([("a", "1.00")], "k string, v string")
    two = spark.createDataFrame([("a", "2.00")], "k string, v string")
    assert write_results({"tab1": one, "tab2": one}, root, fmt) == 1
    fails = two.withColumn("v", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        write_results({"tab1": two, "tab2": fails}, root, fmt)
    assert [read_results(spark, root, t, fmt=fmt).first().v for t in ("tab1", "tab2")] == ["1.00", "1.00"]
    write_results({"tab1": two, "tab2": two}, root, fmt)
    assert [read_results(spark, root, t, fmt=fmt).first().v for t in ("tab1", "tab2")] == ["2.00", "2.00"]
    assert read_results(spark, root, "tab1", version=1, fmt=fmt).first().v == "1.00"
    with pytest.raises(ValueError):
        read_results(spark, root, "tab9", fmt=fmt)


def test_broken_lines_go_to_the_quarantine(spark):
    d = tempfile.mkdtemp(prefix="vr-lines-")
    texts = {"d1998.csv": ["ano,mes,sexo,c_bas1", "1998,1,1,I219", "1998,2,2", "1998,3,1,X954", "1998,4,2,I219,extra,cells"],
             "d1999.csv": ["ANO,SEXO,C_BAS1,SEG_SOCIAL", "1999,1,I219,2", "1999,2,,1"],
             "d2000.csv": ["ANO,SEXO", "only"]}
    for name, lines in texts.items():
        with open(f"{d}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
    got = read_deaths_checked(spark, [f"{d}/{n}" for n in texts])
    counts = {r.file: (r.accepted, r.rejected) for r in got.counts.collect()}
    assert counts == {"d1998.csv": (2, 2), "d1999.csv": (2, 0), "d2000.csv": (0, 1)}
    assert sum(map(sum, counts.values())) == sum(len(x) - 1 for x in texts.values())      # no line is lost
    assert sorted((r.file, r.line) for r in got.rejected.collect()) == [
        ("d1998.csv", "1998,2,2"), ("d1998.csv", "1998,4,2,I219,extra,cells"), ("d2000.csv", "only")]
    good = read_deaths(spark, [f"{d}/d1999.csv"])
    assert got.accepted.columns == good.columns
    assert sorted(map(str, got.accepted.where("ANO = 1999").collect())) == sorted(map(str, good.collect()))
    assert got.accepted.where("MES is null").count() == 2 and got.accepted.count() == 4
