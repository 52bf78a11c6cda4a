"""Abridged period life table as window expressions (L1).

Ages 0, 1-4, 5-year groups and an open last group. Separation factors for
the first two groups follow the Coale-Demeny formulas as given in Preston,
Heuveline and Guillot, *Demography* (2001); later groups use 2.6 years.
Each life table is one window partition of at most 19 rows, so any number of
tables runs in parallel with no Python.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalrates.functions.frames import literal_frame
from vitalrates.functions.nulls import join_ns, strict_sum

# Infant-rate threshold and separation factors
# (a0 below / above threshold, a1 below / above threshold).
M0_THRESHOLD = 0.107
SEPARATION = {
    "total": ((0.049, 2.742), 0.34, (1.5865, -2.167), 1.3565),
    "male": ((0.045, 2.684), 0.33, (1.651, -2.816), 1.352),
    "female": ((0.053, 2.8), 0.35, (1.522, -1.518), 1.361),
}
A_LATER = 2.6


CONSTANTS = ("a0_base", "a0_slope", "a0_high", "a1_base", "a1_slope", "a1_high")


def separation_table(spark, labels: Mapping[str, str] | None = None) -> DataFrame:
    """The separation factors of each series as a table of a few rows:
    ``labels`` maps a series' label to a key of ``SEPARATION`` (Q21)."""
    rows = []
    for label, kind in (labels or {k: k for k in SEPARATION}).items():
        (a0c, a0k), a0hi, (a1c, a1k), a1hi = SEPARATION[kind]
        rows.append((label, a0c, a0k, a0hi, a1c, a1k, a1hi))
    return literal_frame(spark, rows, ["__series", *[f"__{c}" for c in CONSTANTS]], ["string", *["double"] * 6])


def _rows(strata: DataFrame, by: Sequence[str], d: str, n: str, start_age: str, sex_constants: str,
          series: str | None, labels: Mapping[str, str] | None) -> DataFrame:
    """One row per age group that a table reaches, with its columns."""
    (a0c, a0k), a0hi, (a1c, a1k), a1hi = SEPARATION[sex_constants]
    own = dict(zip(CONSTANTS, (a0c, a0k, a0hi, a1c, a1k, a1hi), strict=True))
    w = Window.partitionBy(*by).orderBy(start_age)
    wall = Window.partitionBy(*by)
    df = strata.where(F.col(start_age).isNotNull()).withColumn("__rn", F.row_number().over(w))
    m = F.try_divide(F.col(d).cast("double"), F.col(n).cast("double"))
    df = df.withColumn("__m", F.when(F.col("__rn") == 1, F.coalesce(m, F.lit(0.0))).otherwise(m))
    df = df.withColumn("__stop", F.min(F.when(F.col("__m").isNull(), F.col("__rn"))).over(wall))
    df = df.where(F.col("__stop").isNull() | (F.col("__rn") < F.col("__stop")))
    df = (df.withColumn("__nn", F.max("__rn").over(wall))
            .withColumn("__m0", F.min(F.when(F.col("__rn") == 1, F.col("__m"))).over(wall))
            .withColumn("__first", F.min(F.when(F.col("__rn") == 1, F.col(start_age))).over(wall)))
    if series is None:
        k = {c: F.lit(v) for c, v in own.items()}
    else:   # a series without factors of its own takes the others
        df = df.join(F.broadcast(separation_table(df.sparkSession, labels)), F.col(series) == F.col("__series"), "left")
        k = {c: F.coalesce(F.col(f"__{c}"), F.lit(v)) for c, v in own.items()}
    m0 = F.col("__m0")
    a0 = F.when(m0 < M0_THRESHOLD, k["a0_base"] + k["a0_slope"] * m0).otherwise(k["a0_high"])
    a1 = F.when(m0 < M0_THRESHOLD, k["a1_base"] + k["a1_slope"] * m0).otherwise(k["a1_high"])
    rn, nn, mm = F.col("__rn"), F.col("__nn"), F.col("__m")
    nx = F.when(rn == 1, F.lit(1.0)).when(rn == 2, F.lit(4.0)).otherwise(F.lit(5.0))
    ax = F.when(rn == 1, a0).when(rn == 2, a1).otherwise(F.lit(A_LATER))
    df = (df.withColumn("__nx", nx).withColumn("__ax", ax)
            .withColumn("__q", F.when(rn == nn, F.lit(1.0)).otherwise(
                F.col("__nx") * mm / (F.lit(1.0) + (F.col("__nx") - F.col("__ax")) * mm))))
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__l", F.coalesce(F.product(F.lit(1.0) - F.col("__q")).over(prev), F.lit(1.0)))
    df = df.withColumn("__d", F.col("__l") - F.coalesce(F.lead("__l").over(w), F.lit(0.0)))
    L = F.when(rn == nn, F.try_divide(F.col("__l"), mm)).otherwise(
        F.col("__nx") * F.col("__l") - F.col("__d") * (F.col("__nx") - F.col("__ax")))
    return df.withColumn("__py", L)


def life_table(strata: DataFrame, by: Sequence[str], d: str = "D", n: str = "N", start_age: str = "age_li",
               label: str = "age_group5", sex_constants: str = "total", series: str | None = None,
               labels: Mapping[str, str] | None = None) -> DataFrame:
    """Whole life tables (W4): per age group the width ``nx``, rate ``m``,
    separation ``ax``, probability ``q``, survivors ``lx`` (of 1), deaths
    ``dx``, person-years, person-years above (a reverse running sum) and
    remaining life expectancy ``ex``. ``series`` names a column whose value
    picks the separation factors row by row. Where the open group has no
    deaths its person-years are unknown, and so are all sums above them."""
    df = _rows(strata, by, d, n, start_age, sex_constants, series, labels).where(F.col("__first") == 0)
    up = Window.partitionBy(*by).orderBy(start_age).rowsBetween(0, Window.unboundedFollowing)
    above = F.when(F.count("__py").over(up) == F.count(F.lit(1)).over(up), F.sum("__py").over(up))
    out = df.withColumn("__T", above)
    names = {"__nx": "nx", "__m": "m", "__ax": "ax", "__q": "q", "__l": "lx", "__d": "dx", "__py": "person_years", "__T": "person_years_above"}
    return out.select(*by, label, start_age, *[F.col(c).alias(v) for c, v in names.items()],
                      F.try_divide(F.col("__T"), F.col("__l")).alias("ex"))


def life_table_e0(strata: DataFrame, by: Sequence[str], d: str = "D", n: str = "N",
                  start_age: str = "age_li", sex_constants: str = "total") -> DataFrame:
    """Life expectancy at birth per group of ``by``.

    ``strata`` holds one row per group × age group with deaths ``d`` (NULL
    when none were recorded) and population ``n``. As in the reference's
    life-table routine, a missing first rate counts as 0 and the table stops
    before the first other missing rate, whose predecessor becomes the open
    group."""
    df = _rows(strata, by, d, n, start_age, sex_constants, None, None)
    return (df.groupBy(*by)
              .agg(strict_sum(F.col("__py")).alias("LE0"), F.min("__first").alias("__a0"))
              .where(F.col("__a0") == 0).drop("__a0"))


def life_table_strata(pop: DataFrame, deaths_cube: DataFrame, by: Sequence[str],
                      ages: DataFrame, pop_col: str = "pop", n_col: str = "n") -> DataFrame:
    """Population and deaths by group × abridged age group (both aggregated
    before the join, O4), with the start age of each group attached."""
    N = pop.groupBy(*by, "age_group5").agg(strict_sum(F.col(pop_col)).alias("N"))
    D = deaths_cube.groupBy(*by, "age_group5").agg(F.sum(n_col).cast("bigint").alias("D"))
    j = join_ns(N, D, [*by, "age_group5"], "left")
    return join_ns(j, ages, ["age_group5"], "left", broadcast_right=True)
