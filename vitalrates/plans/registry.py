"""Registered queries over the benchmark tables: the Spark plan, the DuckDB
oracle and the output schema both sides are cast to.

Each entry maps a query name to ``(spark builder, SQL source, schema)``.
The builder takes a materialised :class:`Study` (or the session and data
directory for row-level harmonisation queries); the SQL source is a CTE of
:mod:`vitalrates.plans.oracle` or a SELECT over them. The schema is
``"name:type ..."`` with ``i`` INT, ``l`` BIGINT, ``d`` DOUBLE (rounded to 6
decimals on both sides) and ``s`` STRING.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalrates.operators import harmonise as H
from vitalrates.operators import population as P
from vitalrates.operators import tally as N
from vitalrates.plans import oracle as O
from vitalrates.plans.study import Study

_SPARK_T = {"i": "int", "l": "bigint", "d": "double", "s": "string"}
_SQL_T = {"i": "INTEGER", "l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR"}
_STUDIES: dict = {}


def study(spark: SparkSession, sf_dir: str) -> Study:
    """One lazy study per session and data directory: its strata are marked
    for caching, so queries of one session share them; every plan starts at
    the given tables."""
    from vitalrates.plans.config import TPCH
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        _STUDIES[key] = Study.from_tpch(spark, sf_dir, TPCH)
    return _STUDIES[key].remark()


def _schema(spec: str) -> list[tuple[str, str]]:
    return [tuple(x.split(":")) for x in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Select the schema's columns, cast to its types, round doubles."""
    cols = []
    for name, t in _schema(spec):
        c = F.col(name).cast(_SPARK_T[t])
        cols.append((F.round(c, 6) if t == "d" else c).alias(name))
    return df.select(*cols)


def shape_sql(src: str, spec: str, **variant) -> str:
    cols = []
    for name, t in _schema(spec):
        c = f"CAST({name} AS {_SQL_T[t]})"
        cols.append(f"{'round(' + c + ', 6)' if t == 'd' else c} AS {name}")
    src = src if src.lstrip().upper().startswith("SELECT") is False else f"({src})"
    return O.query_sql(f"SELECT {', '.join(cols)} FROM {src} AS q", **variant)


# ----------------------------------------------------------------- schemas
LIM = "se:d LCI:d UCI:d"
RATES = "pop_ref:l prop_ref:d"


def _excess_spec(ids: str, out: str) -> str:
    return f"{ids} Male:d Female:d {out}:d"


# name → (builder(spark, sf_dir) -> DataFrame, SQL source, schema)
REGISTRY: dict[str, tuple[Callable, str, str]] = {}
# oracle variants (spread records, another threshold) of some entries
VARIANTS: dict[str, dict] = {}


def _reg(name, fn, src, spec, **variant):
    REGISTRY[name] = (fn, src, spec)
    VARIANTS[name] = variant


def _st(attr):
    return lambda spark, d: getattr(study(spark, d), attr)


# -- harmonisation: code tuples and strata counted over the records
CODES = {"occurrence": ("cod_dpto", "cod_mpio1", "cod_mpio"), "residence": ("cod_dptore", "cod_mpiore1", "cod_mpiore")}


def _spread_study(spark, d):
    """The study over records of all eras and with special codes."""
    key = (spark.sparkContext.applicationId, d, "spread")
    if key not in _STUDIES:
        from vitalrates.plans.config import TPCH
        _STUDIES[key] = Study.from_tpch(spark, d, TPCH, spread=True)
    return _STUDIES[key].remark()


def _codes(get):
    """Records per code column and code."""
    def build(s, d):
        parts = []
        for name, columns in CODES.items():
            pairs = F.array(*[F.struct(F.lit(c).alias("code_column"), F.col(c).alias("code")) for c in columns])
            parts.append(get(s, d).counted(name).select(F.inline(pairs), "n"))
        return N.resum(parts[0].unionByName(parts[1]), ["code_column", "code"])
    return build


def _counted(get, name, keys, where=None):
    """A set of the tally by some of its columns."""
    def build(s, d):
        own = get(s, d).counted(name)
        return N.resum(own if where is None else own.where(where), keys.split())
    return build


_CODES_SQL = " UNION ALL ".join(f"SELECT '{c}' AS code_column, {c} AS code, count(*) AS n FROM silver GROUP BY ALL"
                                for columns in CODES.values() for c in columns)
_reg("pad_codes", _codes(study), f"SELECT * FROM ({_CODES_SQL})", "code_column:s code:s n:l")
_reg("pad_codes_decimal", _codes(_spread_study), f"SELECT * FROM ({_CODES_SQL})", "code_column:s code:s n:l", spread=True)
_reg("map_age_codes_eras", _counted(_spread_study, "age", "year sex age_group age_group5"),
     "SELECT year, sex, age_group, age_group5, count(*) AS n FROM silver GROUP BY ALL",
     "year:i sex:s age_group:s age_group5:s n:l", spread=True)
_reg("map_cause_eras", _counted(_spread_study, "cause", "year cause ext_cause regime"),
     "SELECT year, cause, ext_cause, regime, count(*) AS n FROM silver GROUP BY ALL",
     "year:i cause:s ext_cause:s regime:s n:l", spread=True)
_reg("recode_geo_department_83",
     _counted(_spread_study, "place", "year cod_dptof cod_mpiof", "analysed AND cod_dptof IN ('18', '83')"),
     "SELECT year, cod_dptof, cod_mpiof, count(*) AS n FROM deaths_tot WHERE cod_dptof IN ('18', '83') GROUP BY ALL",
     "year:i cod_dptof:s cod_mpiof:s n:l", spread=True)
_reg("map_cause_range", _counted(study, "cause", "year cause ext_cause"),
     "SELECT year, cause, ext_cause, count(*) AS n FROM silver GROUP BY ALL",
     "year:i cause:s ext_cause:s n:l")
_reg("map_age_codes", _counted(study, "age", "year sex age_group age_group5"),
     "SELECT year, sex, age_group, age_group5, count(*) AS n FROM silver GROUP BY ALL",
     "year:i sex:s age_group:s age_group5:s n:l")
_reg("map_codes", _counted(study, "person", "year month sex regime"),
     "SELECT year, month, sex, regime, count(*) AS n FROM silver GROUP BY ALL",
     "year:i month:i sex:s regime:s n:l")
_reg("recode_geo", _counted(study, "place", "cause_ext cod_dptof cod_mpiof", "analysed"),
     "SELECT cause_ext, cod_dptof, cod_mpiof, count(*) AS n FROM deaths_tot GROUP BY ALL",
     "cause_ext:s cod_dptof:s cod_mpiof:s n:l")
_reg("classify_region", _st("regions"), "regions", "cod_mpio:s dpto:s mpio:s region:s")

_FLAG_SQL = {"no_year": "year IS NULL", "no_sex": "sex IS NULL", "no_age": "age_group5 IS NULL", "no_cause": "cause IS NULL",
             "no_place": "cod_mpiof IS NULL", "no_region": "cod_mpiof IS NOT NULL AND region IS NULL"}
_QUALITY_SQL = ("SELECT year, count(*) AS records, count(*) FILTER (WHERE sex IN ('Male', 'Female') AND age_group5 IS NOT NULL) AS analysed, "
                + ", ".join(f"count(*) FILTER (WHERE {c}) AS {k}" for k, c in _FLAG_SQL.items())
                + " FROM silver_places p LEFT JOIN regions r ON p.cod_mpiof = r.cod_mpio GROUP BY ALL")
_QUALITY = "year:i records:l analysed:l " + " ".join(f"{k}:l" for k in _FLAG_SQL)
_reg("quality_counters", lambda s, d: study(s, d).quality(), _QUALITY_SQL, _QUALITY)
_reg("quality_counters_eras", lambda s, d: _spread_study(s, d).quality(), _QUALITY_SQL, _QUALITY, spread=True)


def _unmatched_sql(regions):
    return ("SELECT * FROM (SELECT d.cod_dptof, d.cod_mpiof, count(*) AS n, "
            "array_to_string(list_sort(list_distinct(list(CAST(d.year AS VARCHAR)))), ',') AS years "
            f"FROM deaths_tot d LEFT JOIN {regions} r ON d.cod_mpiof = r.cod_mpio "
            "WHERE d.cause IS NOT NULL AND r.region IS NULL GROUP BY ALL) WHERE n >= 10")


_reg("unmatched_codes", lambda s, d: study(s, d).unmatched(10), _unmatched_sql("regions"), "cod_dptof:s cod_mpiof:s n:l years:s")
_reg("unmatched_codes_gaps",
     lambda s, d: N.unmatched(study(s, d).counted("place"), study(s, d).regions.where("CAST(cod_mpio AS INT) % 7 <> 3"), 10),
     _unmatched_sql("(SELECT * FROM regions WHERE CAST(cod_mpio AS INTEGER) % 7 <> 3)"), "cod_dptof:s cod_mpiof:s n:l years:s")


def _population_long(spark, d):
    from vitalrates.plans import tpch
    st = study(spark, d)
    wide = tpch.population_wide(st.popmpio_cells)
    long = P.population_long(wide, ["COD_MPIO", "ANO"])
    return long.groupBy("ANO", "SEXO", "EDAD").agg(F.sum("N").alias("N"))


_reg("population_long", _population_long,
     "SELECT g.ANO, s.SEXO, a.EDAD, CAST(sum(coalesce(x.N, 0)) AS BIGINT) AS N "
     "FROM (SELECT DISTINCT COD_MPIO, ANO FROM pitems) g "
     "CROSS JOIN (SELECT * FROM (VALUES ('Male'), ('Female')) t(SEXO)) s "
     "CROSS JOIN (SELECT DISTINCT EDAD FROM pitems) a "
     "LEFT JOIN (SELECT COD_MPIO, ANO, SEXO, EDAD, sum(N) AS N FROM pitems GROUP BY ALL) x "
     "ON x.COD_MPIO = g.COD_MPIO AND x.ANO = g.ANO AND x.SEXO = s.SEXO AND x.EDAD = a.EDAD GROUP BY ALL",
     "ANO:i SEXO:s EDAD:i N:l")

# -- population strata and counts
_reg("bin_ages", _st("popnac"), "popnac", "year:i sex:s age_group:s age_group5:s pop:l")
_reg("population_municipal", _st("popmpio"), "popmpio", "cod_mpio:s year:i sex:s age_group:s pop:l")
_reg("population_insured", _st("popbdua"), "popbdua", "year:i regime:s sex:s age_group:s afil:l")
_reg("standard_population", _st("popref"), "popref", "age_group:s pop_ref:l prop_ref:d")
_reg("count_strata", _st("cube"), "cube",
     "year:i sex:s age_group:s age_group5:s cause:s cause_ext:s ext_cause:s region:s cod_dptof:s regime:s n:l")


def _strict(spark, d):
    from vitalrates.functions.nulls import strict_sum
    r = study(spark, d).r_dptoj
    return r.groupBy("year", "sex").agg(strict_sum("ddptoj").alias("d_strict"), F.sum("ddptoj").alias("d_skip"),
                                        strict_sum("ndptoj").alias("n_strict"), F.count(F.lit(1)).alias("rows"))


_reg("strict_sum", _strict,
     f"SELECT year, sex, {O._ss('ddptoj')} AS d_strict, sum(ddptoj) AS d_skip, {O._ss('ndptoj')} AS n_strict, "
     "count(*) AS rows FROM r_dptoj GROUP BY ALL",
     "year:i sex:s d_strict:d d_skip:d n_strict:l rows:l")
_reg("mask_interpolate", _st("ij_interp"), "ij_interp", "year:i sex:s cause_ext:s age_group:s dij:d")
_reg("mask_interpolate_anchor", _st("i2j_interp"), "i2j_interp", "year:i sex:s cause:s age_group:s dij:d")
_reg("suppress_complete", _st("d_ij"), "d_ij", "year:i age_group:s sex:s cause_ext:s dij:d")
_reg("suppress_only", _st("d_j"), "d_j", "year:i sex:s age_group:s dj:d")
_reg("suppress_department", _st("d_dptoj"), "d_dptoj", "year:i sex:s cod_dpto:s age_group:s ddptoj:d")
_reg("suppress_complete_region", _st("d_regionj"), "d_regionj", "year:i age_group:s sex:s region:s durj:d")
_reg("suppress_complete_regime", _st("d_regimeij"), "d_regimeij",
     "year:i age_group:s sex:s regime:s cause_ext:s dregij:l")
_reg("suppress_complete_cause", _st("d_i2j"), "d_i2j", "year:i age_group:s sex:s cause:s dij:d")
_reg("suppress_complete_external", _st("d_i3j"), "d_i3j", "year:i age_group:s sex:s ext_cause:s dij:d")

# the same under a threshold that drops and refills cells at the test scale
BITING = 300


def _biting(spark, d):
    key = (spark.sparkContext.applicationId, d, BITING)
    if key not in _STUDIES:
        _STUDIES[key] = study(spark, d).with_config(min_count=BITING)
    study(spark, d)
    return _STUDIES[key].remark()


for _name, _attr, _spec in (("suppress_complete", "d_ij", "year:i age_group:s sex:s cause_ext:s dij:d"),
                            ("suppress_only", "d_j", "year:i sex:s age_group:s dj:d"),
                            ("suppress_complete_region", "d_regionj", "year:i age_group:s sex:s region:s durj:d")):
    _reg(f"{_name}_biting", (lambda a: lambda s, d: getattr(_biting(s, d), a))(_attr), _attr, _spec, min_count=BITING)


def _strict_mixed(spark, d):
    """Missing regimes are missing deaths: groups with and without them."""
    from vitalrates.functions.nulls import strict_sum
    c = study(spark, d).cube.withColumn("known", F.when(F.col("regime").isNotNull() | (F.col("sex") == "Male"), F.col("n")))
    return c.groupBy("year", "sex").agg(strict_sum("known").alias("n_strict"), F.sum("known").alias("n_skip"))


_reg("strict_sum_mixed", _strict_mixed,
     f"SELECT year, sex, {O._ss('known')} AS n_strict, sum(known) AS n_skip FROM (SELECT *, CASE WHEN regime IS NOT NULL "
     "OR sex = 'Male' THEN n END AS known FROM cube) GROUP BY ALL",
     "year:i sex:s n_strict:l n_skip:l")

# -- stratum rates
_reg("stratum_rates", _st("r_ij"), "r_ij",
     f"year:i sex:s age_group:s nj:l cause_ext:s dij:d rij:d {RATES} rij_std:d")
_reg("stratum_rates_total", _st("r_j"), "r_j", f"year:i sex:s age_group:s nj:l dj:d rj:d {RATES} rj_std:d")
_reg("stratum_rates_region", _st("r_regionj"), "r_regionj",
     f"year:i sex:s region:s age_group:s nurj:l durj:d rurj:d {RATES} rurj_std:d")
_reg("stratum_rates_department", _st("r_dptoj"), "r_dptoj",
     f"year:i sex:s cod_dpto:s age_group:s ndptoj:l ddptoj:d rdptoj:d {RATES} rdptoj_std:d")
_reg("stratum_rates_regime", _st("r_regimej"), "r_regimej",
     f"year:i sex:s regime:s age_group:s nregj:l dregj:l rregj:d {RATES} rregj_std:d")
_reg("stratum_rates_regime_cause", _st("r_regimeij"), "r_regimeij",
     f"year:i sex:s age_group:s regime:s nregj:l cause_ext:s dregij:l rregij:d {RATES} rregij_std:d")
_reg("stratum_rates_cause", _st("r_i2j"), "r_i2j",
     f"year:i sex:s age_group:s nj:l cause:s dij:d rij:d {RATES} rij_std:d")
_reg("stratum_rates_external", _st("r_i3j"), "r_i3j",
     f"year:i sex:s age_group:s nj:l ext_cause:s dij:d rij:d {RATES} rij_std:d")
_reg("stratum_rates_regime_chapter", _st("r_regimei2j"), "r_regimei2j",
     f"year:i sex:s age_group:s regime:s nregj:l cause:s dregij:l rregij:d {RATES} rregij_std:d")

# -- yearly standardised rates
_reg("std_rate_year_sex", _st("mrnac_sex"), "mrnac_sex", f"year:i sex:s d_std:d r_std:d {LIM}")
_reg("std_rate_cause", _st("mrnac_sex_ext"), "mrnac_sex_ext", f"year:i sex:s cause_ext:s di_std:d ri_std:d {LIM}")
_reg("std_rate_region", _st("mrur_sex"), "mrur_sex", f"year:i sex:s region:s dur_std:d rur_std:d {LIM}")
_reg("std_rate_regime", _st("mrregime_sex"), "mrregime_sex", f"year:i sex:s regime:s dreg_std:d rreg_std:d {LIM}")

# -- decade standardised rates
_reg("std_rate_decade", _st("smr"), "smr", f"decade:i sex:s SMR:d d_std:d {LIM}")
_reg("std_rate_decade_age", _st("smr_j"), "smr_j",
     f"decade:i sex:s age_group:s {RATES} dj:d nj:l rj:d dj_std:d SMRj:d {LIM}")
_reg("std_rate_decade_cause", _st("smr_i"), "smr_i", f"decade:i sex:s cause_ext:s SMRi:d di_std:d {LIM}")
_reg("std_rate_decade_cause_age", _st("smr_ij"), "smr_ij",
     f"decade:i sex:s cause_ext:s age_group:s {RATES} dij:d nj:l rij:d dij_std:d SMRij:d {LIM}")
_reg("std_rate_decade_regime", _st("smr_regime"), "smr_regime", f"decade:i sex:s regime:s SMRreg:d dreg_std:d {LIM}")
_reg("std_rate_decade_regime_age", _st("smr_regimej"), "smr_regimej",
     f"decade:i sex:s regime:s age_group:s {RATES} dregj:l nregj:l rregj:d dregj_std:d SMRregj:d {LIM}")
_reg("std_rate_decade_regime_cause", _st("smr_regimei"), "smr_regimei",
     f"decade:i sex:s regime:s cause_ext:s SMRregi:d dregi_std:d {LIM}")
_reg("std_rate_decade_regime_cause_age", _st("smr_regimeij"), "smr_regimeij",
     f"decade:i sex:s regime:s cause_ext:s age_group:s {RATES} dregij:l nregj:l rregij:d dregij_std:d SMRregij:d {LIM}")
_reg("std_rate_department", _st("smr_dpto"), "smr_dpto", f"decade:i sex:s cod_dpto:s SMR:d d_std:d {LIM}")
_reg("age_distribution", lambda s, d: study(s, d).figure("props"),
     "SELECT *, dregij / NULLIF(CASE WHEN count(*) OVER w = count(dregij) OVER w THEN sum(dregij) OVER w END, 0) "
     "AS prop FROM r_regimei2j WINDOW w AS (PARTITION BY year, cause, regime, sex)",
     f"year:i sex:s age_group:s regime:s cause:s dregij:l nregj:l rregij:d rregij_std:d prop:d")

# -- life tables
_reg("life_expectancy_year", _st("lifeexp"), "lifeexp", "year:i LE0:d")
_reg("life_expectancy_year_sex", _st("lifeexp_sex"), "lifeexp_sex", "year:i sex:s LE0:d")
LT = "age_group5:s age_li:i nx:d m:d ax:d q:d lx:d dx:d person_years:d person_years_above:d ex:d"


def _lt_sql(by, series=None):
    return O.whole_lifetable(f"({O._lt_strata('popnac', 'cube', by)})", by, series)


_reg("life_table_year", lambda s, d: study(s, d).life_table(["year"]), _lt_sql(["year"]), f"year:i {LT}")
_reg("life_table_year_sex", lambda s, d: study(s, d).life_table(["year", "sex"]), _lt_sql(["year", "sex"]), f"year:i sex:s {LT}")
_reg("life_table_sex_factors", lambda s, d: study(s, d).life_table(["year", "sex"], series="sex"), _lt_sql(["year", "sex"], "sex"),
     f"year:i sex:s {LT}")


def _decimals(spark, d):
    """Prices in thousandths and eighths: many ties and near-ties of two decimals."""
    from vitalrates.functions.text import fixed2
    x = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.explode(F.array(F.col("l_quantity") / 8, -F.col("l_extendedprice") / 1000, F.col("l_extendedprice") * F.col("l_discount") / 16)).alias("x"))
    return x.groupBy(fixed2(F.col("x")).alias("txt")).agg(F.count(F.lit(1)).alias("n"))


_reg("format_two_decimals", _decimals,
     "SELECT printf('%.2f', x) AS txt, count(*) AS n FROM (SELECT unnest([CAST(l_quantity AS DOUBLE) / 8, -CAST(l_extendedprice AS DOUBLE) / 1000, "
     "CAST(l_extendedprice AS DOUBLE) * CAST(l_discount AS DOUBLE) / 16]) AS x FROM lineitem) GROUP BY ALL",
     "txt:s n:l")
_reg("life_expectancy_decade", _st("lifeexp_decade"), "lifeexp_decade", "decade:i LE0:d")

# -- years of life lost
_reg("yll_rate_year_sex", _st("yllnac_sex"), "yllnac_sex", "year:i sex:s YLL:d n:l yll_std:d")
_reg("yll_rate_cause", _st("yllnac_sex_ext"), "yllnac_sex_ext", "year:i sex:s cause_ext:s YLL:d n:l yll_std:d")
_reg("yll_rate_region", _st("yllur_sex"), "yllur_sex", "year:i sex:s region:s YLL:d n:l yll_std:d")
_reg("yll_rate_regime", _st("yllregime_sex"), "yllregime_sex", "year:i sex:s regime:s YLL:d n:l yll_std:d")
_reg("yll_decade_age_sex", _st("ylldec_agesex"), "ylldec_agesex",
     f"decade:i sex:s age_group:s dj:d SMRj:d AIRP:d LE0:d yearsll:d")
_reg("yll_decade_sex", _st("ylldec_sex"), "ylldec_sex", "decade:i sex:s YLL:d SMR:d")
_reg("yll_decade_cause_age", _st("ylldec_agesex_ext"), "ylldec_agesex_ext",
     f"decade:i sex:s cause_ext:s age_group:s dij:d SMRij:d AIRP:d LE0:d yearsll:d")
_reg("yll_decade_cause", _st("ylldec_sex_ext"), "ylldec_sex_ext", "decade:i sex:s cause_ext:s YLL:d SMRi:d")

# -- contrasts
_reg("diff_by_sex", _st("yllnac_sex_excess"), "yllnac_sex_excess", _excess_spec("year:i", "yll_excess"))
_reg("diff_by_sex_cause", _st("yllnac_sex_ext_excess"), "yllnac_sex_ext_excess",
     _excess_spec("year:i cause_ext:s", "yll_excess"))
for _name, _ids, _out in (
        ("deaths_sexage_excess", "decade:i age_group:s", "deaths_excess"),
        ("ylldec_sexage_excess", "decade:i age_group:s", "yll_excess"),
        ("deaths_sex_excess", "decade:i", "deaths_excess"),
        ("ylldec_sex_excess", "decade:i", "yll_excess"),
        ("deaths_sexage_ext_excess", "decade:i age_group:s cause_ext:s", "deaths_excess"),
        ("ylldec_sexage_ext_excess", "decade:i age_group:s cause_ext:s", "yll_excess"),
        ("deaths_sex_ext_excess", "decade:i cause_ext:s", "deaths_excess"),
        ("ylldec_sex_ext_excess", "decade:i cause_ext:s", "yll_excess")):
    _reg(f"excess_{_name}", (lambda n: (lambda s, d: study(s, d).excess(n)))(_name), _name,
         _excess_spec(_ids, _out))


def _ratio_by_sex(spark, d):
    from vitalrates.operators.contrast import contrast_ratio
    return contrast_ratio(study(spark, d).smr_j, ["age_group", "decade"], "SMRj", "LCI", "UCI", "smr_ratio")


_reg("ratio_by_sex", _ratio_by_sex, "t2_smr", "age_group:s decade:i smr_ratio:d LCI:d UCI:d")

# -- result tables
TAB = ("dsmr:d smr_ratio:d LCI:d UCI:d dsmr_next:d smr_next:d LCI_next:d UCI_next:d dsmr_ext:d smr_ext:d "
       "LCI_ext:d UCI_ext:d")
def _log_limits(attr):
    """A table under limits on the log scale."""
    def build(spark, d):
        key = (spark.sparkContext.applicationId, d, "log")
        if key not in _STUDIES:
            _STUDIES[key] = study(spark, d).with_config(ratio_limits="log")
        study(spark, d)
        return getattr(_STUDIES[key].remark(), attr)
    return build


_reg("table_rate_contrasts_regime_log", _log_limits("tab1"), "tab1", f"regime:s decade:i {TAB}", ratio="log")
_reg("table_rate_contrasts_regime", _st("tab1"), "tab1", f"regime:s decade:i {TAB}")
_reg("table_rate_contrasts_age", _st("tab2"), "tab2", f"age_group:s decade:i {TAB}")
_reg("table_rate_contrasts_age_log", _log_limits("tab2"), "tab2", f"age_group:s decade:i {TAB}", ratio="log")
_reg("table_excess", _st("tabs2"), "tabs2",
     "age_group:s decade:i deaths_excess:d yll_excess:d deaths_excess_ext:d yll_excess_ext:d "
     "deaths_excess_next:d yll_excess_next:d")


def _fmt(x):
    return f"coalesce(CASE WHEN {x} IS NOT NULL THEN printf('%.2f', {x}) END, 'NA')"


def _report_sql(ids, table):
    cols = ", ".join(f"{_fmt(e)} || ' (' || {_fmt(lo)} || ', ' || {_fmt(hi)} || ')' AS {e}"
                     for e, lo, hi in (("smr_ratio", "LCI", "UCI"), ("smr_next", "LCI_next", "UCI_next"),
                                       ("smr_ext", "LCI_ext", "UCI_ext")))
    return f"SELECT {ids}, dsmr, dsmr_next, dsmr_ext, {cols} FROM {table}"


_reg("format_report", lambda s, d: study(s, d).report("tab1"), _report_sql("regime, decade", "tab1"),
     "regime:s decade:i dsmr:d smr_ratio:s dsmr_next:d smr_next:s dsmr_ext:d smr_ext:s")
_reg("format_report_age", lambda s, d: study(s, d).report("tab2"), _report_sql("age_group, decade", "tab2"),
     "age_group:s decade:i dsmr:d smr_ratio:s dsmr_next:d smr_next:s dsmr_ext:d smr_ext:s")

# -- figure datasets
_reg("figure_1a", lambda s, d: study(s, d).figure("1a"),
     "SELECT year, sex, d_std, r_std, se, LCI, UCI, 'Overall' AS cause_ext FROM mrnac_sex UNION ALL "
     "SELECT year, sex, di_std, ri_std, NULL, LCI, UCI, cause_ext FROM mrnac_sex_ext",
     f"year:i sex:s cause_ext:s d_std:d r_std:d {LIM}")
_reg("figure_1b", lambda s, d: study(s, d).figure("1b"),
     "SELECT year, 'Overall' AS cause_ext, Male, Female, yll_excess FROM yllnac_sex_excess UNION ALL "
     "SELECT year, cause_ext, Male, Female, yll_excess FROM yllnac_sex_ext_excess",
     _excess_spec("year:i cause_ext:s", "yll_excess"))
_reg("figure_1c", lambda s, d: study(s, d).figure("1c"),
     "SELECT *, CASE WHEN regime IS NULL THEN NULL WHEN regime = 'contr' THEN 'Contributory' ELSE 'Subsidised' END "
     "AS regime2 FROM mrregime_sex",
     f"year:i sex:s regime:s regime2:s dreg_std:d rreg_std:d {LIM}")
_reg("figure_1d", lambda s, d: study(s, d).figure("1d"), "mrur_sex",
     f"year:i sex:s region:s dur_std:d rur_std:d {LIM}")
_reg("figure_2", lambda s, d: study(s, d).figure("2"),
     "SELECT year, sex, cause_ext, age_group, rij_std * 100000.0 AS rate FROM r_ij",
     "year:i sex:s cause_ext:s age_group:s rate:d")
_reg("figure_s1", lambda s, d: study(s, d).figure("s1"),
     "SELECT year, 'Both' AS sex, LE0 FROM lifeexp UNION ALL SELECT year, sex, LE0 FROM lifeexp_sex",
     "year:i sex:s LE0:d")
_reg("figure_s2", lambda s, d: study(s, d).figure("s2"),
     O._diff("(SELECT * FROM r_i2j WHERE cause <> 'External causes')", ["year", "age_group", "cause"], "rij_std",
             "smr_excess", keep=False, scale="100000.0"),
     "year:i age_group:s cause:s smr_excess:d")
_reg("figure_s3", lambda s, d: study(s, d).figure("s3"),
     O._diff("r_i3j", ["year", "age_group", "ext_cause"], "rij_std", "smr_excess", keep=False, scale="100000.0"),
     "year:i age_group:s ext_cause:s smr_excess:d")
_reg("figure_s4", lambda s, d: study(s, d).figure("s4"),
     f"SELECT *, CASE WHEN regime IS NULL THEN NULL WHEN regime = 'contr' THEN 'Contributory' ELSE 'Subsidised' END "
     f"AS regime2 FROM (SELECT year, sex, regime, cause, {O._ss('rregij_std')} * 100000.0 AS SMRregi "
     "FROM r_regimei2j GROUP BY ALL)",
     "year:i sex:s regime:s cause:s SMRregi:d regime2:s")
_reg("figure_s5_s8", lambda s, d: study(s, d).figure("s5_s8"),
     "SELECT * FROM (SELECT *, CASE WHEN sex = 'Male' AND regime = 'subs' THEN 'S5' WHEN sex = 'Male' AND "
     "regime = 'contr' THEN 'S6' WHEN sex = 'Female' AND regime = 'subs' THEN 'S7' WHEN sex = 'Female' AND "
     "regime = 'contr' THEN 'S8' END AS panel, dregij / NULLIF(CASE WHEN count(*) OVER w = count(dregij) OVER w "
     "THEN sum(dregij) OVER w END, 0) AS prop FROM r_regimei2j "
     "WINDOW w AS (PARTITION BY year, cause, regime, sex)) WHERE panel IS NOT NULL",
     "panel:s year:i sex:s age_group:s regime:s cause:s dregij:l prop:d")
_reg("department_labels", lambda s, d: H.department_labels(study(s, d).regions),
     "SELECT cod_dpto, dpto FROM (SELECT substr(cod_mpio, 1, 2) AS cod_dpto, dpto, row_number() OVER "
     "(PARTITION BY substr(cod_mpio, 1, 2) ORDER BY cod_mpio) AS rn FROM regions) WHERE rn = 1",
     "cod_dpto:s dpto:s")
_reg("figure_s9_map", lambda s, d: study(s, d).figure("s9_map"),
     "SELECT l.cod_dpto, l.dpto, f.decade, f.smr_excess FROM (SELECT cod_dpto, dpto FROM (SELECT substr(cod_mpio, 1, 2) "
     "AS cod_dpto, dpto, row_number() OVER (PARTITION BY substr(cod_mpio, 1, 2) ORDER BY cod_mpio) AS rn "
     "FROM regions) WHERE rn = 1) l LEFT JOIN (SELECT decade, cod_dpto, coalesce(Male, 0.0) - coalesce(Female, 0.0) "
     "AS smr_excess FROM (" + O._diff("smr_dpto", ["decade", "cod_dpto"], "SMR", "x") + ")) f "
     "ON l.cod_dpto IS NOT DISTINCT FROM f.cod_dpto",
     "cod_dpto:s dpto:s decade:i smr_excess:d")
_reg("figure_s9", lambda s, d: study(s, d).figure("s9"),
     "SELECT decade, cod_dpto, coalesce(Male, 0.0) - coalesce(Female, 0.0) AS smr_excess FROM ("
     + O._diff("smr_dpto", ["decade", "cod_dpto"], "SMR", "x") + ")",
     "decade:i cod_dpto:s smr_excess:d")


def spark_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    fn, _, spec = REGISTRY[name]
    return lambda spark, sf_dir: shape(fn(spark, sf_dir), spec)


def oracle(name: str) -> str:
    _, src, spec = REGISTRY[name]
    return shape_sql(src, spec, **VARIANTS[name])
