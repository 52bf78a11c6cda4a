"""Steps that grew faster than the records, on rows of their own."""

import tempfile

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from vitalrates.functions.text import pad_number, to_number, with_numbers, zero_pad
from vitalrates.operators import counts as C
from vitalrates.operators import harmonise as H
from vitalrates.operators import population as P
from vitalrates.operators import tally as N
from vitalrates.plans import tpch
from vitalrates.plans.study import CUBE_DIMS, REPORTS, Study

TEXTS = ["5", "05", " 7 ", "5.0", "5.5", "-3", "", "x", None, "999", "12345", "1e3", "NaN", "Infinity", "99999999999", "9223372036854775807", "1e19"]


@pytest.fixture(scope="module")
def tables(spark):
    """Small tables with repeated and null keys and keys without a match."""
    d = tempfile.mkdtemp(prefix="vr-scale-")

    def put(name, schema, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    items = [(i % 9, i % 7, i % 11 if i % 13 else None, i % 7 + 1, None if i % 17 == 0 else float(i % 50 + 1), "O" if i % 3 else "F",
              f"{1995 + i % 7}-0{i % 9 + 1}-11 00:00:00") for i in range(400)]
    spark.createDataFrame(items, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_linestatus string, t string"
                          ).withColumn("l_shipdate", F.col("t").cast("timestamp_ntz")).drop("t").write.parquet(f"{d}/lineitem.parquet")
    put("orders", "o_orderkey bigint, o_custkey bigint", [(1, 1), (1, 1), (2, 2), (3, None), (4, 999), (5, 5), (6, 5), (7, 77)])
    put("customer", "c_custkey bigint, c_nationkey int, c_mktsegment string",
        [(1, 0, "BUILDING"), (2, 3, "FURNITURE"), (2, 4, None), (5, 24, "MACHINERY"), (999, None, "HOUSEHOLD")])
    put("supplier", "s_suppkey bigint, s_nationkey int", [(1, 1), (2, 24), (3, 0), (4, None), (4, 5), (7, 18), (9, 9), (10, 10)])
    put("part", "p_partkey bigint, p_size int", [(0, 5), (1, None), (2, 7), (2, 8), (3, None), (5, 1)])
    put("nation", "n_nationkey int, n_name string, n_regionkey int", [(k, f"n{k}", k % 5) for k in range(25)])
    return d


def _rows(df):
    return sorted(map(str, df.collect()))


def _largest_method(spark, df):
    debug = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))


@pytest.mark.parametrize("spread", [False, True])
def test_methods_over_records_are_small_enough_to_be_compiled(spark, tables, spread):
    """The JVM interprets methods of more than 8 000 bytes."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        st = Study.from_tpch(spark, tables, spread=spread)
        assert _largest_method(spark, C.base_cube(H.attach_region(st.deaths_tot, st._regions), CUBE_DIMS)) < 8000
        for name, columns in REPORTS.items():
            assert _largest_method(spark, N.tally_one(st.raw, st._regions, columns)) < 8000, name
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_numbers_in_two_steps(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    t = F.col("t")
    two = with_numbers(df, {"a": (t, "int"), "b": (t, "bigint"), "c": (t, "double")}).withColumn("p", pad_number(F.col("b"), 3))
    one = df.withColumns({"a": to_number(t, "int"), "b": to_number(t, "bigint"), "c": to_number(t, "double"), "p": zero_pad(t, 3)})
    assert two.columns == one.columns and _rows(two) == _rows(one)
    assert {r.t: r.p for r in two.collect()} | {None: None} == {
        "5": "005", "05": "005", " 7 ": "007", "5.0": "005", "5.5": None, "-3": None, "": None, "x": None, None: None, "999": "999", "12345": "12345",
        "1e3": "1000", "NaN": None, "Infinity": None, "99999999999": "99999999999", "9223372036854775807": one.where("t = '9223372036854775807'").first().p,
        "1e19": None}


@pytest.mark.parametrize("spread", [False, True])
def test_a_set_counted_alone_is_that_of_the_whole_tally(spark, tables, spread):
    st = Study.from_tpch(spark, tables, spread=spread)
    whole = N.tally(N.records(st.raw, st._regions), REPORTS).cache()
    for name, columns in REPORTS.items():
        alone = N.tally_one(st.raw, st._regions, columns)
        assert _rows(alone) == _rows(N.pick(whole, REPORTS, name)) != [], name
        assert "Expand" not in alone._jdf.queryExecution().executedPlan().toString()
    codes = N.tally_one(st.raw, st._regions, REPORTS["occurrence"])._jdf.queryExecution().optimizedPlan().toString()
    assert "n_nationkey" not in codes and "try_cast" not in codes      # neither regions nor harmonised codes
    lazy = st.counted("place")._jdf.queryExecution().withCachedData().toString()
    assert "raw_cause" not in lazy
    whole.unpersist()


def test_items_meet_orders_that_know_their_customer(spark, tables):
    read = lambda n: spark.read.parquet(f"{tables}/{n}.parquet")
    items = tpch.line_items(spark, tables)
    own = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus", "l_shipdate", "c_custkey", "c_nationkey", "c_mktsegment"]
    want = (read("lineitem").join(read("orders"), F.expr("l_orderkey = o_orderkey")).join(read("customer"), F.expr("o_custkey = c_custkey")))
    assert _rows(items.select(*own)) == _rows(want.select(*own)) != []
    joins = [x for x in items._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in x]
    assert "l_orderkey" in joins[0] and "o_custkey" in joins[1]   # line items are joined last, so they move once


def test_populations_are_those_of_the_cells(spark, tables):
    """National and insured populations need no cube by municipality; the
    sheet's rows are dealt before their hundred sums."""
    items = tpch.population_items(spark, tables)
    cells = items.groupBy("COD_MPIO", "ANO", "SEXO", "EDAD", "regime", "sex").agg(F.sum("N").alias("N"))
    cube = tpch.population_cube(items)
    assert "COD_MPIO" not in cube.columns
    assert _rows(tpch.popnac_long(cube)) == _rows(cells.groupBy("ANO", "SEXO", "EDAD").agg(F.sum("N").alias("N"))) != []
    assert _rows(tpch.popbdua_raw(cube)) == _rows(tpch.popbdua_raw(cells)) != []
    mpio = tpch.popmpio_long(items)
    want = cells.groupBy("COD_MPIO", "ANO", "SEXO", "EDAD").agg(F.sum("N").alias("N"))
    assert _rows(mpio) == _rows(want) != [] and any("N=None" in r for r in _rows(mpio))
    wide = tpch.population_wide(mpio)
    old = want.groupBy("COD_MPIO", "ANO")
    ages = sorted(r[0] for r in want.select("EDAD").where("EDAD IS NOT NULL").distinct().collect())
    for sex, label in (("Male", "Hombres"), ("Female", "Mujeres")):
        cols = [F.sum(F.when((F.col("SEXO") == sex) & (F.col("EDAD") == a), F.col("N")).otherwise(0)).alias(f"{label}_{a}") for a in ages]
        assert _rows(wide.select("COD_MPIO", "ANO", *[f"{label}_{a}" for a in ages])) == _rows(old.agg(*cols))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Exchange")[1].startswith(" hashpartitioning(COD_MPIO") and "REPARTITION_BY_COL" in plan.split("Exchange")[1]
    assert P.population_long(wide, ["COD_MPIO", "ANO"]).count() == wide.count() * 2 * len(ages)


def test_tables_are_marked_again_after_the_cache_was_cleared(spark, tables):
    st = Study.from_tpch(spark, tables)
    other = st.with_config(min_count=1)
    st.popnac, st.counted("quality"), st.d_j
    assert other.d_j is not st.d_j and other.cube is st.cube      # derived tables follow their own parameters
    spark.catalog.clearCache()
    assert st.popnac.storageLevel != StorageLevel.NONE and other.cube.storageLevel != StorageLevel.NONE
    assert all(st.__dict__[x].storageLevel != StorageLevel.NONE for x in st._cached)
    st.unpersist()
