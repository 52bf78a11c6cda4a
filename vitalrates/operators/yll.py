"""Years of life lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.functions.nulls import if_else, join_ns, safe_div, strict_sum


def years_lost(df: DataFrame, deaths: str, airp: DataFrame, le: DataFrame, le_keys: Sequence[str],
               divisor: float | None = None, out: str = "yearsll") -> DataFrame:
    """Per-stratum years lost: deaths × (e0 − mid-age) where e0 exceeds the
    mid-age, else 0; a missing comparison gives a missing value (Q1). The
    both-sex e0 is used for every sex (SURVEY Q20)."""
    j = join_ns(df, airp, ["age_group"], "left", broadcast_right=True)
    j = join_ns(j, le, list(le_keys), "left", broadcast_right=True)
    val = F.col(deaths) * (F.col("LE0") - F.col("AIRP"))
    if divisor is not None:
        val = val / F.lit(divisor)
    return j.withColumn(out, if_else(F.col("LE0") > F.col("AIRP"), val, F.lit(0.0)))


def yll_rate(counts: DataFrame, deaths: str, by: Sequence[str], airp: DataFrame, le: DataFrame,
             pop_totals: DataFrame, how: str = "left", scale: float = 1e5,
             pop_keys: Sequence[str] | None = None) -> DataFrame:
    """YLL per ``scale`` population by year × ``by`` (Y1). The population
    totals ``n`` join on ``pop_keys`` (default: year and ``by``);
    ``how='right'`` keeps every population stratum (J3)."""
    y = years_lost(counts, deaths, airp, le, ["year"])
    g = y.groupBy("year", *by).agg(strict_sum(F.col("yearsll")).alias("YLL"))
    j = join_ns(g, pop_totals, list(pop_keys or ["year", *by]), how)
    return j.withColumn("yll_std", safe_div(F.col("YLL") * F.lit(scale), F.col("n")))
