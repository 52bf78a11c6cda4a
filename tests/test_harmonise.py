"""Code harmonisation: age-code eras, ICD chapters, geography."""

from pyspark.sql import functions as F

from vitalrates.operators import harmonise as H


def _ages(spark, rows):
    df = spark.createDataFrame(rows, "year int, GRU_ED1 string")
    out = H.map_age_codes(df).collect()
    return {(r.year, r.GRU_ED1): (r.age_group, r.age_group5) for r in out}


def test_age_codes_three_eras(spark):
    rows = [(1985, c) for c in ("1", "5", "6", "7", "8", "9", "18", "19", "24", "25", "26")]
    rows += [(2000, c) for c in ("6", "7", "9", "25", "26")]
    rows += [(2015, c) for c in ("6", "9", "25", "26", "28", "29", None)]
    got = _ages(spark, rows)
    assert got[(1985, "1")] == ("<1", "0") and got[(1985, "5")] == ("<1", "0")
    assert got[(1985, "6")] == ("1-4", "1-4") and got[(1985, "7")] == ("1-4", "1-4")
    assert got[(1985, "8")] == ("5-14", "5-9") and got[(1985, "9")] == ("5-14", "10-14")
    assert got[(1985, "18")] == ("25-59", "55-59") and got[(1985, "19")] == ("60+", "60-64")
    assert got[(1985, "24")] == ("60+", "85+")
    assert got[(1985, "25")] == (None, None) and got[(1985, "26")] == (None, None)
    assert got[(2000, "6")] == ("<1", "0") and got[(2000, "7")] == ("1-4", "1-4")
    assert got[(2000, "9")] == ("5-14", "5-9") and got[(2000, "25")] == ("60+", "85+")
    assert got[(2000, "26")] == (None, None)
    assert got[(2015, "26")] == ("60+", "85+") and got[(2015, "28")] == ("60+", "85+")
    assert got[(2015, "29")] == (None, None) and got[(2015, None)] == (None, None)


def _causes(spark, rows):
    df = spark.createDataFrame(rows, "year int, C_BAS1 string")
    out = H.map_ext_cause(H.map_cause(df)).collect()
    return {(r.year, r.C_BAS1): (r.cause, r.ext_cause) for r in out}


def test_icd_edges(spark):
    y9, y10 = 1990, 2010
    rows = [(y9, c) for c in ("1390", "1400", "1759", "1760", "1790", "6760", "6770", "9990", "0000", "V010")]
    rows += [(y10, c) for c in ("B99", "C00", "C97", "D48", "D49", "D50", "D89", "E88", "E89", "H93", "H94",
                                "V00", "V01", "X59", "X60", "X84", "X85", "Y09", "Y89", "Y90", "U071", "", "1400")]
    rows += [(y10, None)]
    got = _causes(spark, rows)
    assert got[(y9, "1390")][0] == "Infectious and parasitic diseases"
    assert got[(y9, "1400")][0] == "Neoplasms" and got[(y9, "1759")][0] == "Neoplasms"
    assert got[(y9, "1760")][0] is None and got[(y9, "1790")][0] == "Neoplasms"
    assert got[(y9, "6760")][0] == "Maternal diseases" and got[(y9, "6770")][0] is None
    assert got[(y9, "9990")][0] == "External causes" and got[(y9, "0000")][0] is None
    assert got[(y9, "V010")] == (None, None)
    assert got[(y10, "B99")][0] == "Infectious and parasitic diseases"
    assert got[(y10, "C97")][0] == "Neoplasms" and got[(y10, "D48")][0] == "Neoplasms"
    assert got[(y10, "D49")][0] is None and got[(y10, "D50")][0] == "Diseases of the blood"
    assert got[(y10, "E89")][0] is None and got[(y10, "H94")][0] is None
    assert got[(y10, "V00")] == (None, None) and got[(y10, "V01")] == ("External causes", "Accidents")
    assert got[(y10, "X59")][1] == "Accidents" and got[(y10, "X60")][1] == "Intentional self-harm"
    assert got[(y10, "X84")][1] == "Intentional self-harm" and got[(y10, "X85")][1] == "Assault"
    assert got[(y10, "Y09")][1] == "Assault" and got[(y10, "Y89")] == ("External causes", None)
    assert got[(y10, "Y90")][0] is None and got[(y10, "U071")][0] is None
    assert got[(y10, "")] == (None, None) and got[(y10, None)] == (None, None)
    assert got[(y10, "1400")][0] is None  # digits are not ICD-10


def test_icd_dimension_size_bounded(spark):
    assert H.icd_dimension(spark).count() == 3600


def test_geography_and_residence(spark):
    cols = "COD_DPTO string, COD_MUNIC string, CODPTORE string, CODMUNRE string, year int"
    rows = [("5", "1", "5", "2", 2000),        # residence wins
            ("5", "1", "1", "2", 2000),        # residence department 01 → occurrence
            ("5", "1", "75", "2", 2000),       # 75 → occurrence
            ("5", "999", None, None, 2000),    # unknown municipality, department kept
            ("", "", "11", None, 2000),        # blank occurrence, residence department only
            ("83", "5", None, None, 1981),     # department 83 before the split
            ("83", "5", None, None, 1982),
            ("18", "767", None, None, 2000),   # recode 18767 → 18785
            ("11", "102", None, None, 2000),   # Bogota localities → 11001
            ("5", "625", None, None, 2000)]    # 05625 → 05665
    df = spark.createDataFrame(rows, cols)
    out = H.recode_geo(H.resolve_residence(H.build_geo(df))).collect()
    got = [(r.cod_mpiof, r.cod_dptof) for r in out]
    assert got == [("05002", "05"), ("05001", "05"), ("05001", "05"), (None, "05"), (None, "11"),
                   ("18005", "18"), ("83005", "83"), ("18785", "18"), ("11001", "11"), ("05665", "05")]


def test_compose_recodes_is_sequential():
    rules = ((("a",), "b"), (("b",), "c"), (("x",), "a"))
    assert H.compose_recodes(rules) == {"a": "c", "b": "c", "x": "a"}


def test_classify_region_and_unmatched(spark):
    rur = spark.createDataFrame([(5001, "M1", "D", "Rural"), (5002, "M2", "D", "Rural Disperso"),
                                 (5003, "M3", "D", "Intermedio"), (5004, "M4", "D", None)],
                                "Municipaly int, Municipali string, Departam_1 string, Categoria_ string")
    reg = {r.cod_mpio: r.region for r in H.classify_region(rur).collect()}
    assert reg == {"05001": "Rural", "05002": "Rural", "05003": "Urban", "05004": "Urban", "27493": "Rural"}
    deaths = spark.createDataFrame([("05001", "05", 2000)] * 3 + [("09999", "09", 2001)] * 12 +
                                   [("09999", "09", 1999)], "cod_mpiof string, cod_dptof string, year int")
    rep = H.unmatched_report(deaths, H.classify_region(rur), 10).collect()
    assert [(r.cod_mpiof, r.n, r.years) for r in rep] == [("09999", 13, "1999,2001")]


def test_clean_deaths_missing_regime_column(spark):
    raw = spark.createDataFrame([("05", "001", None, None, "1990", "3", "1", "10", "4109")],
                                "COD_DPTO string, COD_MUNIC string, CODPTORE string, CODMUNRE string, ANO string, "
                                "MES string, SEXO string, GRU_ED1 string, C_BAS1 string")
    r = H.clean_deaths(raw).collect()[0]
    assert (r.year, r.month, r.sex, r.regime, r.age_group, r.cause, r.cod_mpio) == \
        (1990, 3, "Male", None, "15-24", "Diseases of the circulatory system", "05001")
