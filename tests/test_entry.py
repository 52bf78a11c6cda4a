"""Driver contract and a differential subset against DuckDB on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tests.differential import TABLES, digest

SF = "/root/testdata/sf0.001"
SUBSET = ["count_strata", "bin_ages", "recode_geo", "map_cause_range", "population_long", "suppress_complete",
          "stratum_rates_region", "std_rate_year_sex", "std_rate_department", "life_expectancy_year_sex",
          "yll_rate_regime", "table_rate_contrasts_regime", "table_excess", "format_report_age", "figure_s2", "unmatched_codes", "unmatched_codes_gaps",
          "pad_codes_decimal", "recode_geo_department_83", "map_cause_eras", "suppress_complete_biting", "strict_sum_mixed"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "sex", "d_std", "r_std", "se", "LCI", "UCI"]
    assert df.count() == 14   # seven years, two sexes


def test_every_query_has_an_oracle():
    from vitalrates.plans.registry import REGISTRY
    assert set(REGISTRY) <= set(E.queries()) and set(REGISTRY) <= set(E.oracle_sql())
    assert len(REGISTRY) >= 95


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", SUBSET)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert len(srows) == len(orows)
    assert sorted(df.columns) == sorted(ocols)
    assert digest(srows, df.columns) == digest(orows, ocols)
