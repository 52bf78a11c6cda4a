"""Population inputs: wide sheets to long rows, age strata, standard weights
(H8, H9, H11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalrates.functions.bins import Bins, cut
from vitalrates.functions.nulls import strict_sum
from vitalrates.functions.text import number_from_header, to_number, zero_pad
from vitalrates.operators.harmonise import AGE_BREAKS, AGE_GROUPS, REGIME_NAMES, SEX_NAMES, _decode

WIDE = Bins(AGE_BREAKS, AGE_GROUPS)


def population_long(wide: DataFrame, keys: Sequence[str], drop: Sequence[str] = (),
                    area_col: str = "AREA", male_marker: str = "Hombres",
                    total_marker: str = "Total") -> DataFrame:
    """Wide projection sheet (one column per sex × single age) → long rows
    ``keys…, SEXO, EDAD, N`` (H8, T1). Only ``AREA == 'Total'`` rows are kept;
    headers holding ``Total`` are dropped; headers holding ``Hombres`` are
    male, every other header female. Sex and age are read from the column
    names once and enter the plan as literals; cells are read as numbers and
    bad text is NULL."""
    ids = list(keys)
    skip = set(ids) | set(drop) | {area_col}
    values = [c for c in wide.columns if c not in skip and total_marker not in c]
    cells = [F.struct(F.lit("Male" if male_marker in c else "Female").alias("SEXO"),
                      F.lit(number_from_header(c)).cast("int").alias("EDAD"),
                      to_number(F.col(f"`{c}`").cast("string"), "bigint").alias("N")) for c in values]
    return (wide.where(F.col(area_col) == total_marker)
                .select(*ids, F.inline(F.array(*cells))))


def stack_sheets(sheets: Sequence[DataFrame], keys: Sequence[str], code_col: str | None = None,
                 drop: Sequence[str] = ()) -> DataFrame:
    """Wide sheets of several releases → one long table with typed keys: the
    year an integer, the municipality code five digits of text."""
    out = None
    for sheet in sheets:
        long = population_long(sheet, keys, [c for c in drop if c in sheet.columns])
        out = long if out is None else out.unionByName(long)
    out = out.withColumn("ANO", to_number(F.col("ANO").cast("string"), "int"))
    return out.withColumn(code_col, zero_pad(F.col(code_col).cast("string"), 5)) if code_col else out


def population_strata(pop: DataFrame, keys: dict, age_col: str, value_col: str,
                      out: str = "pop", bins: Bins = WIDE, extra_bins: dict | None = None,
                      year_col: str | None = None, year_range: tuple | None = None) -> DataFrame:
    """Bin single ages and sum the population per stratum (H9). ``keys`` maps
    output name → input column; the sum propagates missing values (G2)."""
    df = pop.withColumn("age_group", cut(F.col(age_col), bins))
    group = [F.col(src).alias(dst) for dst, src in keys.items()] + [F.col("age_group")]
    for name, b in (extra_bins or {}).items():
        df = df.withColumn(name, cut(F.col(age_col), b))
        group.append(F.col(name))
    res = df.groupBy(*group).agg(strict_sum(F.col(value_col)).alias(out))
    if year_col and year_range:
        lo, hi = year_range
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(year_col) >= lo)
        if hi is not None:
            cond = cond & (F.col(year_col) <= hi)
        res = res.where(cond)
    return res


def insured_population(raw: DataFrame, year_range: tuple | None = None, bins: Bins = WIDE) -> DataFrame:
    """Insured population (``year, regime, sex, age, afil``) → strata by year ×
    regime × sex × age group (table 6). Unknown regime or sex stay as NULL
    strata (SURVEY Q16)."""
    df = (raw.withColumn("year", F.col("year").cast("string").try_cast("double").cast("int"))
             .withColumn("regime", _decode(F.col("regime"), REGIME_NAMES))
             .withColumn("sex", _decode(F.col("sex"), SEX_NAMES)))
    return population_strata(df, {"year": "year", "regime": "regime", "sex": "sex"}, "age", "afil",
                             out="afil", bins=bins, year_col="year", year_range=year_range)


def standard_population(popnac: DataFrame, year: int = 2000, pop_col: str = "pop") -> DataFrame:
    """Standard population weights by wide age group (H11, G4). The frame is at
    most one row per age group, so the grand total is a window over it."""
    ref = (popnac.where(F.col("year") == year)
                 .groupBy("age_group").agg(strict_sum(F.col(pop_col)).alias("pop_ref")))
    tot = F.sum("pop_ref").over(Window.partitionBy())
    return ref.select("age_group", "pop_ref", (F.col("pop_ref") / tot).alias("prop_ref"))
