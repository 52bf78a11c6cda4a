"""Male/female contrasts.

Long → wide with a fixed pair of levels is a conditional aggregation: one
hash aggregate over strata, no extra job to discover pivot values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalrates.functions.nulls import safe_div

LEVELS = ("Male", "Female")


def widen(df: DataFrame, ids: Sequence[str], values: Sequence[str], names_from: str = "sex",
          levels: Sequence[str] = LEVELS, single: bool = False) -> DataFrame:
    """Pivot ``values`` by ``names_from``; columns are ``<value>_<level>``, or
    just ``<level>`` when ``single``."""
    aggs = []
    for v in values:
        for lev in levels:
            name = lev if single else f"{v}_{lev}"
            aggs.append(F.max(F.when(F.col(names_from) == lev, F.col(v))).alias(name))
    return df.groupBy(*ids).agg(*aggs)


def contrast_diff(df: DataFrame, ids: Sequence[str], value: str, out: str,
                  keep_levels: bool = False, scale: float | None = None) -> DataFrame:
    """``Male − Female`` of ``value`` per ``ids``."""
    w = widen(df, ids, [value], single=True)
    diff = F.col("Male") - F.col("Female")
    if scale is not None:
        diff = diff * F.lit(scale)
    w = w.withColumn(out, diff)
    return w if keep_levels else w.drop(*LEVELS)


def ratio_limits(v: dict[str, Column], method: str = "reference") -> tuple[Column, Column]:
    """Limits of a male/female ratio from ``est``, ``lo``, ``hi`` of either
    (keys such as ``hi_Male``). ``"reference"`` divides same-side limits and
    swaps them (LCI = UCI_M/UCI_F, UCI = LCI_M/LCI_F, SURVEY Q8); ``"log"``
    uses √(se_M² + se_F²) on the log scale, each se from its own upper limit."""
    if method == "reference":
        return safe_div(v["hi_Male"], v["hi_Female"]), safe_div(v["lo_Male"], v["lo_Female"])
    if method != "log":
        raise ValueError(f"no limits named {method!r}")

    def se(sex):
        return F.log(safe_div(v[f"hi_{sex}"], v[f"est_{sex}"])) / F.lit(1.96)
    ratio = safe_div(v["est_Male"], v["est_Female"])
    s = F.sqrt(se("Male") * se("Male") + se("Female") * se("Female"))
    return ratio * F.exp(F.lit(-1.96) * s), ratio * F.exp(F.lit(1.96) * s)


def contrast_ratio(df: DataFrame, ids: Sequence[str], est: str = "SMR", lo: str = "LCI", hi: str = "UCI",
                   out: str = "smr_ratio", out_lo: str = "LCI", out_hi: str = "UCI",
                   method: str = "reference") -> DataFrame:
    """Male/female ratio with limits (C2); ``method`` as in :func:`ratio_limits`."""
    w = widen(df, ids, [est, lo, hi])
    v = {f"{k}_{sex}": F.col(f"{c}_{sex}") for k, c in (("est", est), ("lo", lo), ("hi", hi)) for sex in LEVELS}
    low, high = ratio_limits(v, method)
    drop = [f"{c}_{lev}" for c in (est, lo, hi) for lev in LEVELS]
    return (w.withColumn("__r", safe_div(v["est_Male"], v["est_Female"])).withColumn("__lo", low).withColumn("__hi", high)
            .drop(*drop).withColumnsRenamed({"__r": out, "__lo": out_lo, "__hi": out_hi}))
