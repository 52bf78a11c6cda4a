"""Stratum rates and direct standardisation with log-scale limits.

Every frame here is already aggregated to strata (bounded by the product of
the domain sizes), so joins with the 6-row standard population are broadcast
and the remaining joins are small equi-joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalrates.functions.bins import decade
from vitalrates.functions.nulls import join_ns, safe_div, strict_sum

Z = 1.96


def _limits(df: DataFrame, est: str, dstd: str, se: str = "se", lci: str = "LCI",
            uci: str = "UCI") -> DataFrame:
    """SE = 1/√expected; limits = est·exp(∓1.96·SE). Zero expected deaths give
    NULL SE and limits (SURVEY Q15), never infinity or NaN."""
    s = safe_div(F.lit(1.0), F.sqrt(F.col(dstd)))
    return (df.withColumn(se, s)
              .withColumn(lci, F.col(est) * F.exp(F.lit(-Z) * F.col(se)))
              .withColumn(uci, F.col(est) * F.exp(F.lit(Z) * F.col(se))))


def stratum_rates(pop: DataFrame, counts: DataFrame, std: DataFrame, keys: Sequence[str],
                  d: str, n: str, r: str, r_std: str) -> DataFrame:
    """Population ⟗ counts on the strata keys (null-safe), rate = d/n, then
    the standard weights by age group (R4, J4, J1)."""
    j = join_ns(pop, counts, keys, "full")
    j = j.withColumn(r, safe_div(F.col(d), F.col(n)))
    j = join_ns(j, std, ["age_group"], "left", broadcast_right=True)
    return j.withColumn(r_std, F.col(r) * F.col("prop_ref"))


def standardise(rates: DataFrame, by: Sequence[str], r: str, r_std: str,
                d_out: str = "d_std", r_out: str = "r_std", scale: float = 1e5) -> DataFrame:
    """Directly standardised rate per stratum of ``by`` (R5): expected deaths
    in the standard Σ r·pop_ref, rate Σ r·w × scale, SE and limits. Missing
    stratum rates propagate (G2)."""
    g = rates.groupBy(*by).agg(
        strict_sum(F.col(r) * F.col("pop_ref")).alias(d_out),
        (strict_sum(F.col(r_std)) * F.lit(scale)).alias(r_out))
    return _limits(g, r_out, d_out)


def standardise_by_period(rates: DataFrame, by: Sequence[str], d: str, n: str,
                          names: dict, scale: float = 1e5, width: int = 10) -> tuple[DataFrame, DataFrame]:
    """Re-aggregate yearly strata to decades and standardise.

    Returns ``(per_age, total)``. ``names`` gives output names for keys
    ``r, d_std, smr`` (per age group) and ``smr_tot, d_std_tot`` (total)."""
    keys = ["decade", *by, "age_group", "pop_ref", "prop_ref"]
    per_age = (rates.withColumn("decade", decade(F.col("year"), width))
                    .groupBy(*keys)
                    .agg(strict_sum(F.col(d)).alias(d), strict_sum(F.col(n)).alias(n)))
    per_age = (per_age.withColumn(names["r"], safe_div(F.col(d), F.col(n)))
                      .withColumn(names["d_std"], F.col(names["r"]) * F.col("pop_ref"))
                      .withColumn(names["smr"], F.col(names["r"]) * F.col("prop_ref") * F.lit(scale)))
    per_age = _limits(per_age, names["smr"], names["d_std"])
    return standardise_by_period_total(per_age, by, names)


def standardise_by_period_total(per_age: DataFrame, by: Sequence[str], names: dict) -> tuple[DataFrame, DataFrame]:
    """Total over age groups of a per-age decade table (second half of R6)."""
    total = (per_age.groupBy("decade", *by)
                    .agg(strict_sum(F.col(names["smr"])).alias(names["smr_tot"]),
                         strict_sum(F.col(names["d_std"])).alias(names["d_std_tot"])))
    return per_age, _limits(total, names["smr_tot"], names["d_std_tot"])


def standardise_sparse(rates: DataFrame, grid: DataFrame, by: Sequence[str], d: str, n: str,
                       scale: float = 1e5, width: int = 10) -> DataFrame:
    """Decade standardisation over a completed grid that skips missing cells
    (R7): grid-only rows carry NULL weights and so form their own groups
    (SURVEY Q23); deaths are summed ignoring missing, population strictly."""
    keys = list(grid.columns)
    j = join_ns(rates, grid, keys, "full").withColumn("decade", decade(F.col("year"), width))
    g = (j.groupBy("decade", *by, "age_group", "pop_ref", "prop_ref")
          .agg(F.sum(F.col(d)).alias(d), strict_sum(F.col(n)).alias(n)))
    r = safe_div(F.col(d), F.col(n))
    g = (g.withColumn("__r", r)
          .withColumn("__dstd", F.col("__r") * F.col("pop_ref"))
          .withColumn("__smr", F.col("__r") * F.col("prop_ref") * F.lit(scale)))
    t = (g.groupBy("decade", *by)
          .agg(F.sum("__smr").alias("SMR"),
               F.when(F.count("__smr") > 0, F.sum("__dstd")).alias("d_std")))
    return _limits(t, "SMR", "d_std")


def age_distribution(df: DataFrame, group: Sequence[str], value: str, out: str = "prop") -> DataFrame:
    """Share of each row in its group's total (R8, W2); the total propagates
    missing values. Groups are strata, so each window partition is small."""
    w = Window.partitionBy(*group)
    tot = F.when(F.count(F.lit(1)).over(w) == F.count(F.col(value)).over(w), F.sum(F.col(value)).over(w))
    return df.withColumn("__tot", tot).withColumn(out, safe_div(F.col(value), F.col("__tot"))).drop("__tot")
