"""Golden miniature: synthetic raw death records of all three
age-code eras through harmonisation and the whole study with the reference
defaults (1980-2023, masked year 1991, anchor 1990), checked for structure
and against direct recomputation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from vitalrates.operators import harmonise as H
from vitalrates.plans.config import StudyConfig
from vitalrates.plans.study import Study

CODES9 = ["0010", "1400", "2500", "2800", "3000", "3500", "4100", "4800", "5300", "6000", "6500", "6900",
          "7200", "7450", "7700", "7900", "8100", "1760"]
CODES10 = ["A09", "C34", "D50", "E11", "F10", "G30", "I21", "J18", "K70", "L89", "M79", "N18", "O99",
           "P07", "Q24", "R99", "V031", "X700", "X954", "U071"]


@pytest.fixture(scope="module")
def study(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(4000):
        year = rnd.randint(1980, 2023)
        era_max = 25 if year <= 1997 else (26 if year <= 2007 else 29)
        code = str(rnd.randint(1, era_max))
        cause = rnd.choice(CODES9 if year <= 1996 else CODES10) if rnd.random() > 0.03 else None
        dpto = rnd.choice(["5", "8", "11", "83" if year <= 1982 else "18"])
        mun = rnd.choice(["1", "2", "999", ""])
        rows.append((dpto, mun, rnd.choice(["1", "5", None]), rnd.choice(["1", "3", None]), str(year),
                     str(rnd.randint(1, 12)), rnd.choice(["1", "2", "2", "1", "3"]),
                     None if year < 1998 else rnd.choice(["1", "2", "9"]), code, cause))
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in
                                ["COD_DPTO", "COD_MUNIC", "CODPTORE", "CODMUNRE", "ANO", "MES", "SEXO",
                                 "SEG_SOCIAL", "GRU_ED1", "C_BAS1"]))
    deaths = H.analysis_deaths(H.clean_deaths(raw))
    pop = [(y, s, a, 200 + a) for y in range(1980, 2024) for s in ("Male", "Female") for a in range(0, 101)]
    popnac = spark.createDataFrame(pop, "ANO int, SEXO string, EDAD int, N bigint")
    mp = [(m, y, s, a, 50 + a) for m in ("05001", "08001", "11001", "18001") for y in range(1985, 2024)
          for s in ("Male", "Female") for a in range(0, 101, 5)]
    popmpio = spark.createDataFrame(mp, "COD_MPIO string, ANO int, SEXO string, EDAD int, N bigint")
    bd = [(str(y), r, s, a, 30 + a) for y in range(2012, 2024) for r in ("CONTRIBUTIVO", "SUBSIDIADO", "OTRO")
          for s in ("MASCULINO", "FEMENINO") for a in range(0, 101, 10)]
    popbdua = spark.createDataFrame(bd, "year string, regime string, sex string, age int, afil bigint")
    rur = spark.createDataFrame([(5001, "a", "A", "Rural"), (8001, "b", "B", "Intermedio"),
                                 (11001, "c", "C", None), (18001, "d", "D", "Rural Disperso")],
                                "Municipaly int, Municipali string, Departam_1 string, Categoria_ string")
    return Study(deaths, popnac, popmpio, popbdua, H.classify_region(rur), StudyConfig()).materialize()


def test_grids_and_tables(study):
    n_ext = study.cube_cause.select("cause_ext").distinct().count()
    assert study.d_ij.count() == 44 * 6 * 2 * n_ext
    assert study.d_regionj.count() == 44 * 6 * 2 * 2
    assert study.lifeexp.count() == 44 and study.lifeexp_sex.count() == 88
    assert {r.decade for r in study.smr.collect()} == {1980, 1990, 2000, 2010, 2020}
    t1 = study.tab1
    assert len(t1.columns) == 14 and t1.count() >= 5
    assert {r.regime for r in t1.collect()} >= {"All people", "Contributory", "Subsidised"}
    assert study.tab2.count() == 5 * 6 and len(study.tabs2.columns) == 8
    assert study.report("tab1").count() == t1.count()


def test_masked_year_interpolated(study):
    d = {(r.year, r.sex, r.cause_ext, r.age_group): r.dij for r in study.ij_interp.collect()}
    for (y, s, c, a), v in d.items():
        if y == 1991 and a in ("<1", "1-4", "5-14") and (1990, s, c, a) in d and (1992, s, c, a) in d:
            assert v == pytest.approx((d[(1990, s, c, a)] + d[(1992, s, c, a)]) / 2)


def test_standardised_rate_recomputed(study):
    rj = study.r_j.toPandas()
    got = {(r.year, r.sex): r.r_std for r in study.mrnac_sex.collect()}
    for (y, s), g in rj.groupby(["year", "sex"]):
        want = None if g["rj_std"].isna().any() else g["rj_std"].sum() * 1e5
        if want is None:
            assert got[(y, s)] is None
        else:
            assert got[(y, s)] == pytest.approx(want, rel=1e-12)


def test_unmatched_and_no_male_maternal(study):
    assert study.d_i2j.where((F.col("sex") == "Male") & (F.col("cause") == "Maternal diseases")).count() == 0
    rep = study.unmatched(1).collect()
    assert all(r.cod_mpiof is None or r.cod_mpiof not in ("05001", "08001", "11001", "18001", "27493") for r in rep)
