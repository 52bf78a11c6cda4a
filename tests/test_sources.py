"""Sources: yearly files with drifting headers, wide population sheets,
rurality CSV (S1-S8, H8)."""

import os
import tempfile

from vitalrates.operators.population import population_long, population_strata, standard_population
from vitalrates.sources.readers import read_deaths, read_population_sheet, read_rurality


def test_read_deaths_conforms_yearly_files(spark):
    d = tempfile.mkdtemp(prefix="vr-src-")
    a = os.path.join(d, "y1990.csv")
    b = os.path.join(d, "y2010.csv")
    with open(a, "w") as f:
        f.write("cod_dpto,cod_munic,ano,mes,sexo,gru_ed1,c_bas1\n05,001,1990,1,1,10,4109\n")
    with open(b, "w") as f:
        f.write("COD_DPTO,COD_MUNIC,ANO,MES,SEXO,SEG_SOCIAL,GRU_ED1,C_BAS1,EXTRA\n08,001,2010,2,2,1,20,I219,x\n")
    df = read_deaths(spark, [a, b])
    assert df.columns == ["COD_DPTO", "COD_MUNIC", "CODPTORE", "CODMUNRE", "ANO", "MES", "SEXO", "SEG_SOCIAL",
                          "GRU_ED1", "C_BAS1"]
    rows = sorted(df.collect(), key=lambda r: r.ANO)
    assert rows[0].SEG_SOCIAL is None and rows[0].COD_DPTO == "05" and rows[1].SEG_SOCIAL == "1"


def test_population_long_from_wide_sheet(spark):
    cols = ["COD_MPIO", "ANO", "AREA", "Hombres_0", "Mujeres_0", "Hombres_85 y más", "Total Hombres", "Total"]
    rows = [("05001", 2000, "Total", 10, 12, 3, 13, 25), ("05001", 2000, "Cabecera", 1, 1, 1, 1, 2)]
    wide = spark.createDataFrame(rows, cols)
    long = population_long(wide, ["COD_MPIO", "ANO"])
    got = sorted((r.SEXO, r.EDAD, r.N) for r in long.collect())
    assert got == [("Female", 0, 12), ("Male", 0, 10), ("Male", 85, 3)]


def test_standard_population_weights_sum_to_one(spark):
    pop = spark.createDataFrame([(2000, "Male", a, 100 + a) for a in range(0, 100)] +
                                [(2001, "Male", 0, 999)], "ANO int, SEXO string, EDAD int, N bigint")
    strata = population_strata(pop, {"year": "ANO", "sex": "SEXO"}, "EDAD", "N")
    ref = standard_population(strata, 2000).collect()
    assert len(ref) == 6 and abs(sum(r.prop_ref for r in ref) - 1.0) < 1e-12
    assert sum(r.pop_ref for r in ref) == sum(100 + a for a in range(100))


def test_read_rurality_semicolon(spark):
    d = tempfile.mkdtemp(prefix="vr-rur-")
    p = os.path.join(d, "rur.csv")
    with open(p, "w") as f:
        f.write("Municipaly;Municipali;Departam_1;Categoria_\n5001;Medellín;Antioquia;Ciudades y aglomeraciones\n")
    r = read_rurality(spark, p).collect()[0]
    assert r.Municipaly == 5001 and r.Categoria_ == "Ciudades y aglomeraciones"


def test_population_sheet_reader_renames_and_filters(spark):
    d = tempfile.mkdtemp(prefix="vr-sheet-")
    p = os.path.join(d, "sheet.csv")
    with open(p, "w") as f:
        f.write("a,b,c,d,e,f,Hombres_85 y más,Mujeres_0\n05,Antioquia,Medellín,05001,2000,Total,3,4\n,,,,,,,\n")
    df = read_population_sheet(spark, p, rename={0: "COD_DPTO", 1: "DPTO", 2: "MPIO", 3: "COD_MPIO", 4: "ANO",
                                                 5: "AREA"}, required=["COD_MPIO", "ANO"])
    assert df.columns[:6] == ["COD_DPTO", "DPTO", "MPIO", "COD_MPIO", "ANO", "AREA"]
    assert "Hombres_85" in df.columns and df.count() == 1


def test_report_sink_in_order(spark):
    from vitalrates.plans.registry import study
    st = study(spark, "/root/testdata/sf0.001")
    root = tempfile.mkdtemp(prefix="vr-report-")
    st.write_report(root)
    run = [x for x in os.listdir(root) if x.startswith("run=")]
    assert len(run) == 1 and sorted(os.listdir(f"{root}/{run[0]}")) == ["report", "report_age", "tab1", "tab2", "tabs2"]
    from vitalrates.sources.sinks import read_results
    assert read_results(spark, root, "tab1").count() == st.tab1.count()
    regimes = [r.regime for r in st.ordered("tab1").collect()]
    order = {"All people": 0, "Contributory": 1, "Subsidised": 2, None: 3}
    assert regimes == sorted(regimes, key=lambda x: order[x])


def test_population_cells_are_read_as_numbers(spark):
    cols = ["COD_MPIO", "ANO", "AREA", "Hombres_0", "Mujeres_1"]
    wide = spark.createDataFrame([("05001", "2000", "Total", "10.0", "x")], cols)
    long = population_long(wide, ["COD_MPIO", "ANO"])
    assert sorted((r.SEXO, r.EDAD, r.N) for r in long.collect()) == [("Female", 1, None), ("Male", 0, 10)]
    plan = long._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan.lower() and "Exchange" not in plan


def _sheet(path, first, years, codes, swapped=False, national=False, titles=11, open_age="85"):
    ages = [0, 3, 10, 20, 40, 70]
    heads = [f"{s}_{a}" for s in ("Hombres", "Mujeres") for a in ages] + [f"Hombres_{open_age}", f"Mujeres_{open_age}"]
    ids = ["DP", "DPNOM", "AÑO", "ÁREA GEOGRÁFICA"] if national else (
        ["DP", "DPNOM", "DPMP", "MPIO", "AÑO", "ÁREA GEOGRÁFICA"] if swapped else ["DP", "DPNOM", "MPIO", "DPMP", "AÑO", "ÁREA GEOGRÁFICA"])
    with open(path, "w", encoding="utf-8") as f:
        for i in range(titles):
            f.write(["Población por municipio\n", "\n", "Actualización,2020\n"][i % 3])
        f.write(",".join([*ids, *heads, "Total Hombres", "Total Mujeres", "Total"]) + "\n")
        for y in years:
            for area in ("Total", "Cabecera"):
                for c in codes:
                    own = ["0", "Nacional", str(y), area] if national else (
                        ["5", "D", "M", c, f"{y}.0", area] if swapped else ["5", "D", c, "M", str(y), area])
                    cells = [str(first + i) + (".0" if i % 3 == 0 else "") for i in range(len(heads))]
                    f.write(",".join([*own, *cells, "1", "1", "2"]) + "\n")
        f.write("Fuente: proyecciones\n")


def test_population_sheets_to_table_1(spark):
    """Preambles, swapped columns, decimals and an open-age header: sheets of
    four municipal and two national releases through the study to Table 1."""
    from vitalrates.operators import harmonise as H
    from vitalrates.operators.population import stack_sheets
    from vitalrates.plans.config import StudyConfig
    from vitalrates.plans.study import Study
    from vitalrates.sources.readers import MUNICIPAL_SHEET, MUNICIPAL_SHEET_SWAPPED, NATIONAL_SHEET
    d = tempfile.mkdtemp(prefix="vr-sheets-")
    spans = [(range(1998, 2000), False, 11), (range(2000, 2001), False, 11), (range(2001, 2002), True, 11), (range(2002, 2004), False, 8)]
    mun, nat = [], []
    for i, (years, swapped, titles) in enumerate(spans):
        _sheet(f"{d}/m{i}.csv", 100, years, ["5001", "8001"], swapped, titles=titles)
        mun.append(read_population_sheet(spark, f"{d}/m{i}.csv", MUNICIPAL_SHEET_SWAPPED if swapped else MUNICIPAL_SHEET,
                                         required=["COD_MPIO", "ANO"], header="DPNOM"))
    for i, (years, age) in enumerate([(range(1998, 2001), "85"), (range(2001, 2004), "85 y más")]):
        _sheet(f"{d}/n{i}.csv", 1000, years, ["0"], national=True, open_age=age)
        nat.append(read_population_sheet(spark, f"{d}/n{i}.csv", NATIONAL_SHEET, required=["ANO", "AREA"], header="DPNOM"))
    popmpio = stack_sheets(mun, ["COD_MPIO", "ANO"], "COD_MPIO", drop=["COD_DPTO", "DPTO", "MPIO"])
    popnac = stack_sheets(nat, ["ANO"], drop=["DP", "DPNOM"])
    assert dict(popmpio.dtypes)["ANO"] == "int" and dict(popnac.dtypes)["ANO"] == "int"
    assert popmpio.count() == 6 * 2 * 14 and popnac.count() == 6 * 14
    assert {r[0] for r in popmpio.select("COD_MPIO").distinct().collect()} == {"05001", "08001"}
    assert {r[0] for r in popnac.select("EDAD").distinct().collect()} == {0, 3, 10, 20, 40, 70, 85}
    assert popnac.where("N is null").count() == 0 and popnac.agg({"N": "min"}).first()[0] == 1000

    codes = ["1", "7", "10", "12", "15", "22"]     # one code per wide age group of the years 1998-2007
    rows = [("5", "1", "5.0", "1", str(y), "1", s, "1", c, cause) for y in range(1998, 2004) for s in "12" for c in codes
            for cause, n in (("I219", 12 if s == "1" else 10), ("X954", 11)) for _ in range(n)]
    raw = spark.createDataFrame(rows, "COD_DPTO string, COD_MUNIC string, CODPTORE string, CODMUNRE string, ANO string, "
                                      "MES string, SEXO string, SEG_SOCIAL string, GRU_ED1 string, C_BAS1 string")
    rur = spark.createDataFrame([(5001, "a", "A", "Rural"), (5001, "b", "A", "Rural")],
                                "Municipaly int, Municipali string, Departam_1 string, Categoria_ string")
    bdua = spark.createDataFrame([], "year string, regime string, sex string, age int, afil bigint")
    cfg = StudyConfig(years=(1998, 2003), mpio_years=(1998, 2003), regime_years=(1998, 2003), insured_years=(1998, 2003),
                      mask_year=1991, anchor_year=1990)
    root = tempfile.mkdtemp(prefix="vr-study-")
    st = Study.from_raw(raw, popnac, popmpio, bdua, H.classify_region(rur), cfg)
    st.materialize(root)
    assert sorted(os.listdir(root)) == ["cube", "deaths_silver", "tally"]
    from vitalrates.sources.sinks import stored_deaths
    assert stored_deaths(spark, f"{root}/deaths_silver").where("year = 1998").count() == len(rows) // 6
    assert st.counters["records"] == st.counters["analysed"] == len(rows) and st.counters["no_cause"] == 0
    assert st.cube.agg({"n": "sum"}).first()[0] == len(rows)      # the repeated municipality counts nothing twice
    assert dict(st.mrnac_sex.dtypes)["year"] == "int" and dict(st.popnac.dtypes)["year"] == "int"
    t1 = {(r.regime, r.decade): r for r in st.tab1.collect()}
    one = t1["All people", 1990]
    assert one.smr_ratio is not None and 1.0 < one.smr_ratio < 1.2 and one.dsmr > 0 and abs(one.smr_ext - 1.0) < 0.05
