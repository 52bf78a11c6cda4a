"""Code harmonisation of individual death records.

Mappings are Column expressions or broadcast joins with code tables of fixed
size, so they compile into the scan's whole-stage-codegen stage: no shuffle, no
Python at run time. Rule tables are plain data and can be replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalrates.functions.frames import literal_frame
from vitalrates.functions.nulls import if_else, is_in
from vitalrates.functions.text import pad_number, with_numbers, zero_pad
from vitalrates.sources.readers import DEATH_COLUMNS

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference analysis (kept together, in the
# reference's natural order).
# ---------------------------------------------------------------------------

CHAPTERS = (
    "Infectious and parasitic diseases",
    "Neoplasms",
    "Diseases of the blood",
    "Endocrine, nutritional, and metabolic diseases",
    "Mental and behavioural disorders",
    "Diseases of the nervous system",
    "Diseases of the circulatory system",
    "Diseases of the respiratory system",
    "Diseases of the digestive system",
    "Diseases of the skin and subcutaneous tissue",
    "Diseases of the musculoskeletal system",
    "Diseases of the genitourinary system",
    "Maternal diseases",
    "Conditions of the perinatal period",
    "Congenital malformations",
    "Causes of death not elsewhere classified",
    "External causes",
)
EXTERNAL = "External causes"
NON_EXTERNAL = "Non-external causes"

# ICD-9 three-digit ranges (inclusive) → chapter. Codes 176-178 and 677-679
# belong to no chapter.
ICD9_RANGES = (
    (1, 139, "Infectious and parasitic diseases"),
    (140, 175, "Neoplasms"),
    (179, 239, "Neoplasms"),
    (279, 289, "Diseases of the blood"),
    (240, 278, "Endocrine, nutritional, and metabolic diseases"),
    (290, 319, "Mental and behavioural disorders"),
    (320, 389, "Diseases of the nervous system"),
    (390, 459, "Diseases of the circulatory system"),
    (460, 519, "Diseases of the respiratory system"),
    (520, 579, "Diseases of the digestive system"),
    (680, 709, "Diseases of the skin and subcutaneous tissue"),
    (710, 739, "Diseases of the musculoskeletal system"),
    (580, 629, "Diseases of the genitourinary system"),
    (630, 676, "Maternal diseases"),
    (760, 779, "Conditions of the perinatal period"),
    (740, 759, "Congenital malformations"),
    (780, 799, "Causes of death not elsewhere classified"),
    (800, 999, "External causes"),
)

# ICD-10 (letter, first two-digit number, last two-digit number) → chapter.
ICD10_RANGES = (
    ("A", 0, 99, "Infectious and parasitic diseases"),
    ("B", 0, 99, "Infectious and parasitic diseases"),
    ("C", 0, 97, "Neoplasms"),
    ("D", 0, 48, "Neoplasms"),
    ("D", 50, 89, "Diseases of the blood"),
    ("E", 0, 88, "Endocrine, nutritional, and metabolic diseases"),
    ("F", 0, 99, "Mental and behavioural disorders"),
    ("G", 0, 99, "Diseases of the nervous system"),
    ("H", 0, 93, "Diseases of the nervous system"),
    ("I", 0, 99, "Diseases of the circulatory system"),
    ("J", 0, 98, "Diseases of the respiratory system"),
    ("K", 0, 92, "Diseases of the digestive system"),
    ("L", 0, 99, "Diseases of the skin and subcutaneous tissue"),
    ("M", 0, 99, "Diseases of the musculoskeletal system"),
    ("N", 0, 98, "Diseases of the genitourinary system"),
    ("O", 0, 99, "Maternal diseases"),
    ("P", 0, 96, "Conditions of the perinatal period"),
    ("Q", 0, 99, "Congenital malformations"),
    ("R", 0, 99, "Causes of death not elsewhere classified"),
    ("V", 1, 99, "External causes"),
    ("W", 0, 99, "External causes"),
    ("X", 0, 99, "External causes"),
    ("Y", 0, 89, "External causes"),
)

# Last year coded in ICD-9.
ICD9_LAST_YEAR = 1996

# Wide age groups and abridged (5-year) groups.
AGE_GROUPS = ("<1", "1-4", "5-14", "15-24", "25-59", "60+")
AGE_BREAKS = (0, 1, 5, 15, 25, 60, 125)
AGE_GROUPS5 = ("0", "1-4") + tuple(f"{a}-{a + 4}" for a in range(5, 85, 5)) + ("85+",)
AGE_BREAKS5 = (0, 1) + tuple(range(5, 90, 5)) + (125,)

# Age-code eras: (first year, last year, [(code lo, code hi, wide group,
# abridged index of code lo, abridged step)]). An abridged step of 1 means
# consecutive codes map to consecutive abridged groups. Codes outside every
# rule (the "unknown" code included) give NULL.
AGE_CODE_ERAS = (
    (1980, 1997, (
        (1, 5, "<1", 0, 0), (6, 7, "1-4", 1, 0), (8, 9, "5-14", 2, 1),
        (10, 11, "15-24", 4, 1), (12, 18, "25-59", 6, 1), (19, 24, "60+", 13, 1),
    )),
    (1998, 2007, (
        (1, 6, "<1", 0, 0), (7, 8, "1-4", 1, 0), (9, 10, "5-14", 2, 1),
        (11, 12, "15-24", 4, 1), (13, 19, "25-59", 6, 1), (20, 25, "60+", 13, 1),
    )),
    (2008, 9999, (
        (1, 6, "<1", 0, 0), (7, 8, "1-4", 1, 0), (9, 10, "5-14", 2, 1),
        (11, 12, "15-24", 4, 1), (13, 19, "25-59", 6, 1), (20, 25, "60+", 13, 1),
        (26, 28, "60+", 18, 0),
    )),
)

# Departments whose residence code is not used (occurrence code wins).
RESIDENCE_FALLBACK_DEPTS = ("01", "75")

# Ordered municipality recodes: (old codes, new code).
MUNICIPALITY_RECODES = (
    (("18767",), "18785"),
    (("18765",), "18756"),
    (("11102", "11265", "11279", "11769", "11848", "11850"), "11001"),
    (("99572", "99760"), "99773"),
    (("99496",), "99524"),
    (("27086",), "27493"),
    (("05625",), "05665"),
)
# Department 83 was recoded to 18 up to and including this year.
DEPT83_LAST_YEAR = 1981

# Rurality categories counted as rural; every other value (missing included)
# is urban. One municipality is missing from the rurality source.
RURAL_CATEGORIES = ("Rural", "Rural Disperso")
EXTRA_MUNICIPALITY = ("27493", "Chocó", "Nuevo Belén de Bajirá", "Rural")

# ICD-10 external-cause groups used to derive ``ext_cause`` when the input
# lacks it (standard ICD-10 blocks).
EXT_CAUSE_RANGES = (
    ("V", 1, 99, "Accidents"),
    ("W", 0, 99, "Accidents"),
    ("X", 0, 59, "Accidents"),
    ("X", 60, 84, "Intentional self-harm"),
    ("X", 85, 99, "Assault"),
    ("Y", 0, 9, "Assault"),
)
EXT_CAUSES = ("Accidents", "Assault", "Intentional self-harm")

SEX_CODES = (("1", "Male"), ("2", "Female"), ("3", "Indeterminate"))
REGIME_CODES = (("1", "contr"), ("2", "subs"))
REGIME_NAMES = (("CONTRIBUTIVO", "contr"), ("SUBSIDIADO", "subs"))
SEX_NAMES = (("FEMENINO", "Female"), ("MASCULINO", "Male"))


# ---------------------------------------------------------------------------
# Expressions
# ---------------------------------------------------------------------------

def _decode(col: Column, pairs) -> Column:
    """Exact text match → label, anything else → NULL."""
    expr = None
    for code, label in pairs:
        expr = F.when(col == code, label) if expr is None else expr.when(col == code, label)
    return expr


def icd_version(year: Column, last_icd9_year: int = ICD9_LAST_YEAR) -> Column:
    return F.when(year <= last_icd9_year, F.lit("9")).otherwise(F.lit("10"))


def _range_case_sql(num: str, ranges, letter: str | None = None) -> str:
    """CASE text for range rules over an integer column (first match wins)."""
    parts = []
    for r in ranges:
        if letter is None:
            lo, hi, label = r
            cond = f"{num} BETWEEN {lo} AND {hi}"
        else:
            let, lo, hi, label = r
            cond = f"{letter} = '{let}' AND {num} BETWEEN {lo} AND {hi}"
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CAST(NULL AS STRING)" if not parts else "CASE " + " ".join(parts) + " END"


def icd_dimension(spark, icd9=ICD9_RANGES, icd10=ICD10_RANGES, ext=EXT_CAUSE_RANGES) -> DataFrame:
    """Code dimension ``(ver, cod3, cause, ext_cause)`` expanded from the range
    rules inside the JVM: every three-digit ICD-9 code and every
    letter+two-digit ICD-10 code, 1 000 + 2 600 rows whatever the data size,
    so it is always broadcast. First matching rule wins, as in a
    ``case_when``."""
    d9 = spark.range(0, 1000).selectExpr(
        "'9' AS ver", "lpad(CAST(id AS STRING), 3, '0') AS cod3",
        f"{_range_case_sql('CAST(id AS INT)', icd9)} AS cause", "CAST(NULL AS STRING) AS ext_cause")
    d10 = (spark.range(0, 2600)
           .selectExpr("chr(CAST(65 + floor(id / 100) AS INT)) AS let", "CAST(id % 100 AS INT) AS num")
           .selectExpr("'10' AS ver", "concat(let, lpad(CAST(num AS STRING), 2, '0')) AS cod3",
                       f"{_range_case_sql('num', icd10, 'let')} AS cause",
                       f"{_range_case_sql('num', ext, 'let')} AS ext_cause"))
    return d9.unionByName(d10)


def _map_icd(df: DataFrame, code_col: str, year_col: str, picks: dict[str, str], dim: DataFrame | None,
             last_icd9_year: int) -> DataFrame:
    """``picks``: output name → column of the code dimension, all by one join."""
    dim = dim if dim is not None else icd_dimension(df.sparkSession)
    d = F.broadcast(dim.select(F.col("ver").alias("__dver"), F.col("cod3").alias("__dcod"),
                               *[F.col(c).alias(f"__d_{out}") for out, c in picks.items()]))
    staged = df.withColumns({"__ver": icd_version(F.col(year_col), last_icd9_year),
                             "__cod3": F.substring(F.col(code_col), 1, 3)})
    j = staged.join(d, (F.col("__ver") == F.col("__dver")) & (F.col("__cod3") == F.col("__dcod")), "left")
    return (j.withColumns({out: F.col(f"__d_{out}") for out in picks})
             .drop("__ver", "__cod3", "__dver", "__dcod", *[f"__d_{out}" for out in picks]))


def map_cause(df: DataFrame, code_col: str = "C_BAS1", year_col: str = "year",
              out: str = "cause", dim: DataFrame | None = None,
              last_icd9_year: int = ICD9_LAST_YEAR) -> DataFrame:
    """Three-character ICD code → chapter (H2) by a broadcast equi-join on
    (revision, code) with :func:`icd_dimension`. The revision is chosen by
    year, so a code never matches both lists and rows never multiply
    (SURVEY Q11); codes in a gap or a NULL/blank code give NULL."""
    return _map_icd(df, code_col, year_col, {out: "cause"}, dim, last_icd9_year)


def map_ext_cause(df: DataFrame, code_col: str = "C_BAS1", year_col: str = "year",
                  out: str = "ext_cause", dim: DataFrame | None = None,
                  last_icd9_year: int = ICD9_LAST_YEAR) -> DataFrame:
    """External-cause group of an ICD-10 code (the analysis input ``ext_cause``,
    SURVEY Q9); NULL for ICD-9 years and for codes outside the ranges."""
    return _map_icd(df, code_col, year_col, {out: "ext_cause"}, dim, last_icd9_year)


def map_causes(df: DataFrame, code_col: str = "C_BAS1", year_col: str = "year", dim: DataFrame | None = None,
               last_icd9_year: int = ICD9_LAST_YEAR) -> DataFrame:
    """Chapter ``cause`` and external-cause group ``ext_cause`` by one join."""
    return _map_icd(df, code_col, year_col, {"cause": "cause", "ext_cause": "ext_cause"}, dim, last_icd9_year)


def age_code_table(eras=AGE_CODE_ERAS, labels5=AGE_GROUPS5) -> dict:
    """Expand the era rules into ``{(era index, code): (wide, abridged)}``."""
    out = {}
    for i, (_, _, rules) in enumerate(eras):
        for lo, hi, label, first, step in rules:
            for code in range(lo, hi + 1):
                out[(i, code)] = (label, labels5[first + (code - lo) * step])
    return out


def age_code_dimension(spark, eras=AGE_CODE_ERAS, labels5=AGE_GROUPS5) -> DataFrame:
    """``(era, code, age_group, age_group5)`` for every listed code: at most a
    few hundred rows whatever the data size, so it is always broadcast."""
    rows = [(e, c, w, a) for (e, c), (w, a) in sorted(age_code_table(eras, labels5).items())]
    return literal_frame(spark, rows, ["__era", "__code", "age_group", "age_group5"],
                         ["int", "int", "string", "string"])


def map_age_codes(df: DataFrame, code_col: str = "GRU_ED1", year_col: str = "year",
                  eras=AGE_CODE_ERAS, labels5=AGE_GROUPS5) -> DataFrame:
    """Era-specific age code → wide group ``age_group`` and abridged group
    ``age_group5`` (H1), by a broadcast equi-join on (era, code). The era is
    picked by year like the reference's if / else-if chain: every year
    outside the earlier eras (missing too) uses the last one. Unknown or
    unlisted codes give NULL."""
    era = None
    for i, (y0, y1, _) in enumerate(eras[:-1]):
        cond = F.col(year_col).between(y0, y1)
        era = F.when(cond, F.lit(i)) if era is None else era.when(cond, F.lit(i))
    era = F.lit(len(eras) - 1) if era is None else era.otherwise(F.lit(len(eras) - 1))
    dim = F.broadcast(age_code_dimension(df.sparkSession, eras, labels5)
                      .withColumnsRenamed({"__era": "__dera", "__code": "__dcode"}))
    staged = with_numbers(df, {"__code": (F.col(code_col).cast("string"), "int")}).withColumn("__era", era)
    j = staged.join(dim, (F.col("__era") == F.col("__dera")) & (F.col("__code") == F.col("__dcode")), "left")
    return j.drop("__era", "__code", "__dera", "__dcode")


def map_codes(df: DataFrame, sex_col: str = "SEXO", regime_col: str | None = "SEG_SOCIAL") -> DataFrame:
    """Sex 1/2/3 → Male/Female/Indeterminate, regime 1/2 → contr/subs (H3).
    A missing regime column gives a NULL regime (S4)."""
    regime = (_decode(F.col(regime_col), REGIME_CODES) if regime_col and regime_col in df.columns
              else F.lit(None).cast("string"))
    return df.withColumns({"sex": _decode(F.col(sex_col), SEX_CODES), "regime": regime})


def build_geo(df: DataFrame) -> DataFrame:
    """Padded department and municipality codes; municipality ``999`` is
    unknown (H4)."""
    codes = {"cod_dpto": ("COD_DPTO", 2), "cod_dptore": ("CODPTORE", 2), "cod_mpio1": ("COD_MUNIC", 3), "cod_mpiore1": ("CODMUNRE", 3)}
    out = (with_numbers(df, {f"__n_{k}": (F.col(c), "bigint") for k, (c, _) in codes.items()})
           .withColumns({k: pad_number(F.col(f"__n_{k}"), width) for k, (_, width) in codes.items()})
           .drop(*[f"__n_{k}" for k in codes]))

    def mpio(d, m):
        ok = F.col(d).isNotNull() & F.col(m).isNotNull() & (F.col(m) != "999")
        return F.when(ok, F.concat(F.col(d), F.col(m)))
    return out.withColumns({"cod_mpio": mpio("cod_dpto", "cod_mpio1"),
                            "cod_mpiore": mpio("cod_dptore", "cod_mpiore1")})


def clean_deaths(raw: DataFrame, eras=AGE_CODE_ERAS, carry: Sequence[str] = ()) -> DataFrame:
    """Raw all-text death records → silver records (Entry A): numbers, sex,
    regime, age groups, geography codes and cause chapter. ``carry`` names
    further columns that stay."""
    present = [c for c in DEATH_COLUMNS if c in raw.columns]
    y = with_numbers(raw.select(*present, *carry), {"month": (F.col("MES"), "int"), "year": (F.col("ANO"), "int")})
    y = map_codes(y, "SEXO", "SEG_SOCIAL" if "SEG_SOCIAL" in present else None)
    y = map_age_codes(y, "GRU_ED1", "year", eras)
    y = build_geo(y)
    y = map_causes(y, "C_BAS1", "year")
    return y.select("year", "month", "sex", "regime", "age_group", "age_group5",
                    "cod_dpto", "cod_dptore", "cod_mpio1", "cod_mpiore1",
                    "cod_mpio", "cod_mpiore", "C_BAS1", "cause", "ext_cause", *carry)


def classify_external(df: DataFrame, cause_col: str = "cause", out: str = "cause_ext") -> DataFrame:
    """External / non-external flag; a missing cause stays missing (H7, Q1)."""
    c = F.col(cause_col)
    return df.withColumn(out, if_else(c == EXTERNAL, F.lit(EXTERNAL), F.lit(NON_EXTERNAL)))


def resolve_residence(df: DataFrame, fallback_depts: Sequence[str] = RESIDENCE_FALLBACK_DEPTS) -> DataFrame:
    """Final municipality and department (H5): residence when known and not in
    a fallback department, else occurrence; department from the final
    municipality, then the residence department, then the occurrence one."""
    mre, dre, mocc, docc = (F.col(c) for c in ("cod_mpiore", "cod_dptore", "cod_mpio", "cod_dpto"))
    fb = is_in(dre, fallback_depts)
    mpiof = F.when(mre.isNull() | fb, mocc).otherwise(mre)
    out = df.withColumn("cod_mpiof", mpiof)
    mf = F.col("cod_mpiof")
    dptof = (F.when(mf.isNotNull(), F.substring(mf, 1, 2))
              .when(dre.isNotNull() & ~fb, dre)
              .when(docc.isNotNull(), docc))
    return out.withColumn("cod_dptof", dptof)


def recode_geo(df: DataFrame, recodes=MUNICIPALITY_RECODES,
               dept83_last_year: int = DEPT83_LAST_YEAR) -> DataFrame:
    """Ordered geography recodes (H6). A pre-split department-83 death moves to
    department 18; a missing municipality stays missing (SURVEY Q4)."""
    old83 = (F.col("year") <= dept83_last_year) & (F.col("cod_dptof") == "83")
    out = df.withColumns({
        "cod_mpiof": F.when(old83, F.concat(F.lit("18"), F.substring("cod_mpiof", 3, 4))).otherwise(F.col("cod_mpiof")),
        "cod_dptof": F.when(old83, F.lit("18")).otherwise(F.col("cod_dptof"))})
    mapping = compose_recodes(recodes)
    if not mapping:
        return out
    lookup = F.create_map(*[F.lit(x) for kv in sorted(mapping.items()) for x in kv])
    m = F.col("cod_mpiof")
    return out.withColumn("cod_mpiof", F.coalesce(lookup[m], m))


def compose_recodes(recodes) -> dict:
    """Ordered recode rules → one old→new lookup with the same result as
    applying the rules one after another (a code only changes if some rule
    names it, so the composition over those codes is exact)."""
    codes = {c for olds, new in recodes for c in (*olds, new)}
    out = {}
    for code in codes:
        v = code
        for olds, new in recodes:
            if v in olds:
                v = new
        if v != code:
            out[code] = v
    return out


def analysis_deaths(silver: DataFrame, sexes: Sequence[str] = ("Male", "Female")) -> DataFrame:
    """Silver deaths → analysis records (§2.8 row 3): known sex and age,
    external flag, final geography."""
    return final_geography(silver.where(analysed(sexes)))


def analysed(sexes: Sequence[str] = ("Male", "Female")) -> Column:
    """Does a silver record count in the analysis?"""
    return is_in(F.col("sex"), sexes) & F.col("age_group5").isNotNull()


def final_geography(silver: DataFrame) -> DataFrame:
    """External flag and final municipality and department (H5-H7)."""
    return recode_geo(resolve_residence(classify_external(silver)))


def classify_region(rurality: DataFrame, extra=EXTRA_MUNICIPALITY) -> DataFrame:
    """Rurality source (``Municipaly, Municipali, Departam_1, Categoria_``) →
    ``cod_mpio, dpto, mpio, region`` plus the missing municipality (H10, P21)."""
    dim = rurality.select(
        zero_pad(F.col("Municipaly").cast("string"), 5).alias("cod_mpio"),
        F.col("Departam_1").cast("string").alias("dpto"),
        F.col("Municipali").cast("string").alias("mpio"),
        F.when(is_in(F.col("Categoria_"), RURAL_CATEGORIES), F.lit("Rural"))
         .otherwise(F.lit("Urban")).alias("region"),
    )
    add = literal_frame(rurality.sparkSession, [extra], ["cod_mpio", "dpto", "mpio", "region"])
    # a repeated code would count its deaths twice: one row stays, the source's before the added one
    every = dim.withColumn("__added", F.lit(0)).unionByName(add.withColumn("__added", F.lit(1)))
    return first_per_group(every, ["cod_mpio"], ["__added", "region", "mpio", "dpto"]).drop("__added")


def attach_region(deaths: DataFrame, regions: DataFrame) -> DataFrame:
    """Left join of deaths to the municipality dimension (J1, J7). The
    dimension holds one row per municipality, so it is broadcast: its size is
    bounded by the number of municipalities, not by the number of deaths."""
    dim = F.broadcast(regions.select(F.col("cod_mpio").alias("__mp"), "region"))
    return (deaths.join(dim, deaths["cod_mpiof"] == dim["__mp"], "left").drop("__mp"))


def unmatched_report(deaths: DataFrame, regions: DataFrame, min_n: int = 10) -> DataFrame:
    """Data-quality report (D1, G7): final municipality codes with no rurality
    row, with their number of deaths and the sorted list of years."""
    d = attach_region(deaths, regions).where(F.col("region").isNull())
    return (d.groupBy("cod_dptof", "cod_mpiof")
             .agg(F.count(F.lit(1)).alias("n"),
                  F.array_join(F.sort_array(F.collect_set(F.col("year").cast("string"))), ",").alias("years"))
             .where(F.col("n") >= min_n))


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group under an explicit order (W3, ``slice(1)``):
    one window partition per group, so a large group is one sort, never a
    collect."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def department_labels(regions: DataFrame) -> DataFrame:
    """One label row per department: the department name on its first
    municipality row (the map-label table, without geometry)."""
    d = regions.select(F.substring("cod_mpio", 1, 2).alias("cod_dpto"), "cod_mpio", "dpto")
    return first_per_group(d, ["cod_dpto"], ["cod_mpio"]).drop("cod_mpio")
