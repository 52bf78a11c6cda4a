"""Physical plan shape: one exchange over row-level deaths for
the cube, broadcast joins only for bounded code tables, no Python in the
plan, no cartesian products."""

import __spark_entry__ as E
from vitalrates.plans.study import Study

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cube_plan(spark):
    from vitalrates.operators import harmonise as H
    from vitalrates.operators.counts import base_cube
    from vitalrates.plans.study import CUBE_DIMS
    spark.catalog.clearCache()     # the plan from the tables, nothing cached
    st = Study.from_tpch(spark, SF)
    p = _plan(base_cube(H.attach_region(st.deaths_tot, st._regions), CUBE_DIMS))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert p.count("BroadcastHashJoin") >= 3   # code tables and the rurality dimension
    hashed = [l for l in p.split("\n") if "Exchange hashpartitioning" in l]
    deaths = [l for l in hashed if "hashpartitioning(year" in l]
    assert len(deaths) == 1   # the cube aggregate; all others are over the bounded rurality rows
    assert all("hashpartitioning(nk" in l or "hashpartitioning(cod_mpio" in l for l in hashed if l not in deaths), hashed


def test_registered_queries_are_lazy_and_start_at_the_tables(spark):
    """No query runs a job while it is built (but for the headers of the
    population sheet), and every analysed plan reaches the given files."""
    from vitalrates.plans.registry import REGISTRY, VARIANTS
    qs, tracker = E.queries(), spark.sparkContext.statusTracker()
    for name in sorted(REGISTRY):
        spark.sparkContext.setJobGroup(f"build-{name}", name)
        df = qs[name](spark, SF)
        if name != "population_long":
            jobs = tracker.getJobIdsForGroup(f"build-{name}")
            first = sorted(REGISTRY)[0], next(n for n in sorted(REGISTRY) if VARIANTS[n].get("spread"))
            scans = 11 if name in first else int(name == "format_two_decimals")
            assert len(jobs) <= scans, (name, len(jobs))   # nothing but the schemas of new scans
        leaves = df._jdf.queryExecution().analyzed().collectLeaves()
        scans = [x.relation().location().rootPaths().mkString(",") for x in map(leaves.apply, range(leaves.size()))
                 if x.getClass().getSimpleName() == "LogicalRelation"]
        assert scans and all(f.startswith(f"file:{SF}/") for f in scans), (name, set(scans))
        p = _plan(df)
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
                    "BatchEvalPython"):
            assert bad not in p, (name, bad)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_report_tables_use_one_grouping(spark):
    """Table 1 unions its sources and groups them once, without a join."""
    st = Study.from_tpch(spark, SF)
    own = st.tab1._jdf.queryExecution().withCachedData().toString().split("InMemoryRelation")[0]
    assert "Join" not in own and own.count("Aggregate") >= 1


def test_totals_over_ages_are_one_expand(spark):
    """Table S2 gets its rows by age and their totals from one grouping."""
    st = Study.from_tpch(spark, SF)
    own = st.tabs2._jdf.queryExecution().withCachedData().toString().split("InMemoryRelation")[0]
    assert "Join" not in own and own.count("Expand") == 1 and own.count("Aggregate") == 2
    got = {r["decade"]: r for r in st.tabs2.where("age_group = 'All ages'").collect()}
    want = {}
    for r in st.ylldec_sex.collect():
        want.setdefault(r["decade"], {})[r["sex"]] = (r["SMR"], r["YLL"])
    assert got.keys() == want.keys() and want
    for decade, w in want.items():
        for i, name in enumerate(("deaths_excess", "yll_excess")):
            a, b = w["Male"][i], w["Female"][i]
            assert got[decade][name] is None if a is None or b is None else abs(got[decade][name] - (a - b)) < 1e-9 * max(abs(a), 1)
