"""One pass over the records (O5, D1), exact decimals, whole life tables."""

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.differential import TABLES, digest
from vitalrates.functions.text import fixed2
from vitalrates.operators import harmonise as H
from vitalrates.operators import tally as N
from vitalrates.operators.lifetable import life_table, life_table_e0
from vitalrates.plans import registry
from vitalrates.plans.study import REPORTS, TALLIES, Study

SF = "/root/testdata/sf0.001"
ROW_LEVEL = {"pad_codes": False, "map_cause_range": False, "map_age_codes": False, "map_codes": False, "recode_geo": False,
             "unmatched_codes": False, "unmatched_codes_gaps": False, "quality_counters": False,
             "pad_codes_decimal": True, "map_age_codes_eras": True, "map_cause_eras": True, "recode_geo_department_83": True}
NEW = ["quality_counters", "quality_counters_eras", "life_table_year_sex", "life_table_sex_factors", "format_two_decimals",
       "table_rate_contrasts_regime_log", "table_rate_contrasts_age_log", "map_age_codes_eras", "map_cause_eras"]


def test_tally_has_one_exchange_over_records(spark):
    st = Study.from_tpch(spark, SF)
    for sets in (REPORTS, TALLIES):
        one_exchange(N.tally(N.records(st.raw, st._regions), sets)._jdf.queryExecution().executedPlan().toString())


def one_exchange(p):
    assert "Expand" in p and "Python" not in p and "CartesianProduct" not in p
    dealt = [x for x in p.split("\n") if "Exchange hashpartitioning(raw_year" in x]
    assert len(dealt) == 1
    rest = [x for x in p.split("\n") if "Exchange hashpartitioning" in x and x not in dealt]
    assert all("hashpartitioning(nk" in x or "hashpartitioning(cod_mpio" in x for x in rest), rest


@pytest.mark.parametrize("name", sorted(ROW_LEVEL))
def test_row_level_queries_read_the_tally_only(spark, name):
    """Their plans hold the cached counts and no fact table."""
    spread = ROW_LEVEL[name]
    st = registry._spread_study(spark, SF) if spread else registry.study(spark, SF)
    st.tally, st.regions      # marked for caching
    plan = E.queries()[name](spark, SF)._jdf.queryExecution().withCachedData().toString()
    own = re.split("InMemoryRelation", plan)[0]
    assert "InMemoryRelation" in plan and "lineitem" not in own.lower() and "l_orderkey" not in own


def test_sets_of_a_tally(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", 2), (None, "b", 2), (1, None, None)], "x int, y string, z int")
    sets = {"xy": ("x", "y"), "z": ("z",), "yz": ("y", "z")}
    t = N.tally(df, sets).cache()
    for name, cols in sets.items():
        got = sorted(map(tuple, N.pick(t, sets, name).collect()), key=str)
        assert got == sorted(map(tuple, df.groupBy(*cols).count().collect()), key=str), name


def test_tuples_harmonise_like_records(spark):
    rows = [("5", "1", "27", "493", "1999", "1", "1", "1", "7", "I219"), ("05", "999", None, "1", "1999.0", "x", "3", None, "99", ""),
            ("83", "1", "83", "1", "1981", "2", "2", "9", "1", "0010"), (None,) * 10] * 3
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in H.DEATH_COLUMNS))
    regions = spark.createDataFrame([("27493", "a", "b", "Rural")], "cod_mpio string, dpto string, mpio string, region string")
    t = N.tally(N.records(raw, regions), TALLIES).cache()
    silver = H.clean_deaths(raw)
    for name, cols in (("age", ["year", "sex", "age_group", "age_group5"]), ("cause", ["year", "cause", "ext_cause", "regime"]),
                       ("person", ["year", "month", "sex", "regime"]), ("occurrence", ["cod_dpto", "cod_mpio1", "cod_mpio"]),
                       ("residence", ["cod_dptore", "cod_mpiore1", "cod_mpiore"])):
        got = N.resum(N.harmonised_tuples(N.pick(t, TALLIES, name)), cols).collect()
        want = silver.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)), name
    places = N.pick(t, TALLIES, "place").where("analysed").drop("analysed")
    want = H.analysis_deaths(silver).groupBy("year", "cause_ext", "cod_dptof", "cod_mpiof").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, places.collect())) == sorted(map(str, want.collect()))


def test_counters_fill_while_the_counts_are_written(spark):
    from vitalrates.plans import tpch
    st = Study.from_tpch(spark, SF).materialize()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    q = con.execute(E.oracle_sql()["quality_counters"])
    cols = [c[0] for c in q.description]
    want = dict.fromkeys(cols[1:], 0)
    for r in q.fetchall():
        for c, v in zip(cols[1:], r[1:], strict=True):
            want[c] += v
    assert st.cube.agg(F.sum("n")).first()[0] == want["analysed"]
    lazy = Study.from_tpch(spark, SF).cube
    assert sorted(map(str, st.cube.select(*lazy.columns).collect())) == sorted(map(str, lazy.collect()))
    assert st.counters == want and want["no_cause"] > 0 and want["records"] > want["analysed"]
    assert tpch.raw_deaths(spark, SF).count() == want["records"]


@pytest.mark.parametrize("name", NEW)
def test_new_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rel = con.execute(E.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    got, want = [tuple(r) for r in df.collect()], rel.fetchall()
    assert got and len(got) == len(want) and sorted(df.columns) == sorted(cols)
    assert digest(got, df.columns) == digest(want, cols)


def test_two_decimals_as_c_prints_them(spark):
    rng = random.Random(4)
    x = [1.005, 0.125, 0.375, -0.125, 2.675, 1e15 + 0.125, 4.5e15 + 0.5, 0.995, 0.9949999999999999, 99.995, 0.0, 5e-324, -0.001, 1e-5, 9e18,
         float(2 ** 53 + 2), 0.285, 1.115, 1e22]
    x += [rng.uniform(-1e6, 1e6) for _ in range(400)] + [round(rng.uniform(0, 1000), 3) for _ in range(400)]
    x += [rng.randrange(10 ** 6) / 8 for _ in range(200)] + [math.nextafter(k / 200, k % 3 - 1) for k in range(400)]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(fixed2(F.col("x")).alias("t")).collect()]
    assert [(v, g) for v, g in zip(x, got) if g != "%.2f" % v] == []
    odd = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, float("-inf")), (4, None)], "i int, x double").orderBy("i")
    assert [r.t for r in odd.select(fixed2(F.col("x")).alias("t")).collect()] == ["NaN", "Inf", "-Inf", None]


def test_whole_table_by_series(spark):
    starts = [0, 1, *range(5, 90, 5)]
    rows = [(s, a, f"{a}", (7 + a // 3) * (1 + (s == "Male")), 1000 - 5 * a) for s in ("Male", "Female", "Other") for a in starts]
    df = spark.createDataFrame(rows, "sex string, age_li int, age_group5 string, D bigint, N bigint")
    own = life_table(df, ["sex"], series="sex", labels={"Male": "male", "Female": "female"}).orderBy("sex", "age_li").collect()
    one = life_table(df, ["sex"]).where("age_li = 0").collect()
    e0 = {r.sex: r.LE0 for r in life_table_e0(df, ["sex"]).collect()}
    assert all(abs(r.ex - e0[r.sex]) < 1e-9 for r in one)
    factors = {"Male": (0.045, 2.684, 1.651, -2.816), "Female": (0.053, 2.8, 1.522, -1.518), "Other": (0.049, 2.742, 1.5865, -2.167)}
    for sex, (a, b, c, d) in factors.items():
        t = [r for r in own if r.sex == sex]
        m0 = t[0].m
        assert len(t) == 19 and abs(t[0].ax - (a + b * m0)) < 1e-12 and abs(t[1].ax - (c + d * m0)) < 1e-12
        above = 0.0
        for r in reversed(t):
            above += r.person_years
            assert abs(r.person_years_above - above) < 1e-9 and abs(r.ex - above / r.lx) < 1e-9
        assert abs(sum(r.dx for r in t) - 1) < 1e-9 and t[-1].q == 1.0
