"""Missing-value semantics the rates pipeline depends on.

Spark's SQL three-valued logic differs from the reference analysis in three
places (SURVEY Q1-Q3): set membership must never be missing, a two-way
conditional with a missing test must give a missing result, and equi-joins
must match missing keys to each other. Sums must propagate missing values
(G2) unless a call site explicitly wants them skipped.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_in(col: Column, values: Iterable) -> Column:
    """Set membership that is FALSE (never NULL) for a missing value (P5)."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def if_else(cond: Column, yes, no) -> Column:
    """Two-way conditional whose result is NULL when ``cond`` is NULL."""
    yes = yes if isinstance(yes, Column) else F.lit(yes)
    no = no if isinstance(no, Column) else F.lit(no)
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def strict_sum(col: Column | str) -> Column:
    """Grouped sum that is NULL as soon as one input is NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(F.count(F.lit(1)) == F.count(c), F.sum(c))


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL (not an error, not infinity) on a zero divisor."""
    return F.try_divide(num, den)


def join_ns(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    right_keys: Sequence[str] | None = None,
    broadcast_right: bool = False,
) -> DataFrame:
    """Equi-join on named keys where NULL matches NULL (J3/J4, SURVEY Q3).

    Key columns come out once, under the left names: from the left side for
    inner/left joins, from the right for right joins and coalesced for full
    outer joins. Spark still plans ``<=>`` keys as an equi-join (hash or
    sort-merge), never a nested loop. ``broadcast_right`` is for right sides
    whose size is bounded by construction (a few strata or a code table).
    """
    right_keys = list(right_keys or keys)
    keys = list(keys)
    lk = [f"__l_{k}" for k in keys]
    rk = [f"__r_{k}" for k in keys]
    l2 = left.withColumnsRenamed(dict(zip(keys, lk)))
    r2 = right.withColumnsRenamed(dict(zip(right_keys, rk)))
    if broadcast_right:
        r2 = F.broadcast(r2)
    clash = (set(l2.columns) & set(r2.columns))
    if clash:
        raise ValueError(f"non-key columns on both sides of join: {sorted(clash)}")
    cond = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(lk, rk)]
    how = {"full_outer": "full", "outer": "full", "left_outer": "left",
           "right_outer": "right"}.get(how, how)
    joined = l2.join(r2, on=cond, how=how)
    if how == "right":
        key_cols = [F.col(b).alias(k) for k, b in zip(keys, rk)]
    elif how == "full":
        key_cols = [F.coalesce(F.col(a), F.col(b)).alias(k) for k, a, b in zip(keys, lk, rk)]
    else:
        key_cols = [F.col(a).alias(k) for k, a in zip(keys, lk)]
    rest_l = [c for c in l2.columns if c not in lk]
    rest_r = [c for c in r2.columns if c not in rk]
    return joined.select(*key_cols, *rest_l, *rest_r)
