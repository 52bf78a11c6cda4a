"""Counting strata and repairing cells (O7 base cube, G1, R1, R2, R3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalrates.functions.nulls import join_ns, strict_sum


def base_cube(deaths: DataFrame, dims: Sequence[str], out: str = "n") -> DataFrame:
    """One grouped count over every dimension the analysis needs (O7). This is
    the only exchange over row-level data: partial aggregation runs before the
    shuffle, so a hot key costs one row per map task, not one row per death.
    Every later count is a re-sum of this cube."""
    return deaths.groupBy(*dims).agg(F.count(F.lit(1)).alias(out))


def count_strata(cube: DataFrame, keys: Sequence[str], n_col: str = "n", out: str = "n",
                 where: Column | None = None) -> DataFrame:
    """Grouped count (G1) re-summed from a base cube."""
    src = cube if where is None else cube.where(where)
    return src.groupBy(*keys).agg(F.sum(n_col).cast("bigint").alias(out))


def mask_cells(df: DataFrame, value: str, mask: Column) -> DataFrame:
    """Blank the cells flagged unreliable (value → NULL)."""
    return df.withColumn(value, F.when(mask, F.lit(None)).otherwise(F.col(value).cast("double")))


def interpolate(df: DataFrame, value: str, partition: Sequence[str], order: str = "year",
                x: str = "row") -> DataFrame:
    """Linear interpolation of NULL cells within each series (W1). ``x='row'``
    uses row positions like the reference (SURVEY Q6); ``x='year'`` uses the
    order column. Leading and trailing gaps stay NULL. Each series is a
    window partition, so the work is spread over series, never one task."""
    w_ord = Window.partitionBy(*partition).orderBy(order)
    pos = F.row_number().over(w_ord).cast("double") if x == "row" else F.col(order).cast("double")
    df = df.withColumn("__pos", pos)
    v = F.col(value)
    known_pos = F.when(v.isNotNull(), F.col("__pos"))
    before = w_ord.rowsBetween(Window.unboundedPreceding, -1)
    after = w_ord.rowsBetween(1, Window.unboundedFollowing)
    df = (df.withColumn("__p0", F.last(known_pos, ignorenulls=True).over(before))
            .withColumn("__v0", F.last(v, ignorenulls=True).over(before))
            .withColumn("__p1", F.first(known_pos, ignorenulls=True).over(after))
            .withColumn("__v1", F.first(v, ignorenulls=True).over(after)))
    p, p0, p1, v0, v1 = (F.col(c) for c in ("__pos", "__p0", "__p1", "__v0", "__v1"))
    filled = v0 + (v1 - v0) * ((p - p0) / (p1 - p0))
    return (df.withColumn(value, F.when(v.isNotNull(), v.cast("double")).otherwise(filled))
              .drop("__pos", "__p0", "__v0", "__p1", "__v1"))


def mask_and_interpolate(counts: DataFrame, value: str, partition: Sequence[str], mask: Column,
                         order: str = "year", x: str = "row", anchor_grid: DataFrame | None = None,
                         anchor_mask: Column | None = None, anchor: str = "overwrite") -> DataFrame:
    """Drop unreliable cells and fill them linearly.

    With ``anchor_grid`` the grid rows are full-joined in first; then
    ``anchor='overwrite'`` sets every cell under ``anchor_mask`` to 0 (matching
    rows included, as the reference does, SURVEY Q7) and ``anchor='fill_missing'``
    only fills absent cells with 0."""
    df = mask_cells(counts, value, mask)
    if anchor_grid is not None:
        keys = [c for c in anchor_grid.columns]
        df = join_ns(df, anchor_grid, keys, "full")
        if anchor == "overwrite":
            df = df.withColumn(value, F.when(anchor_mask, F.lit(0.0)).otherwise(F.col(value)))
        else:
            df = df.withColumn(value, F.when(anchor_mask & F.col(value).isNull(), F.lit(0.0))
                                       .otherwise(F.col(value)))
    return interpolate(df, value, partition, order, x)


def suppress_small(df: DataFrame, value: str, min_count: float = 10) -> DataFrame:
    """Drop cells under the threshold; NULL cells go too (R2)."""
    return df.where(F.col(value) >= min_count)


def complete(df: DataFrame, grid: DataFrame, value: str, fill=0) -> DataFrame:
    """Add every stratum of ``grid`` that is absent and fill the value.
    The grid is a product of small domains; the join is a null-safe full
    outer equi-join, so rows outside the grid are kept as well."""
    keys = list(grid.columns)
    out = join_ns(df, grid, keys, "full")
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(fill).cast(out.schema[value].dataType)))


def grid(spark, domains: dict) -> DataFrame:
    """Dense stratum grid (J9). Each domain is a list of literal values or, for
    at most one domain, a one-column ``DataFrame`` of values seen in the data
    (e.g. the causes present). The grid starts from that data domain (its
    distinct values) or from a one-row frame and multiplies in the literal
    domains with ``explode``: a narrow generator, no cartesian join."""
    frames = {k: v for k, v in domains.items() if isinstance(v, DataFrame)}
    if len(frames) > 1:
        raise ValueError("at most one data-derived domain per grid")
    if frames:
        name, dom = next(iter(frames.items()))
        df = dom.select(F.col(dom.columns[0]).alias(name)).distinct()
    else:
        df = spark.range(1).select()
    for name, dom in domains.items():
        if name in frames:
            continue
        arr = F.array(*[F.lit(v) for v in dom])
        df = df.withColumn(name, F.explode(arr))
    return df.select(*domains.keys())


def resum(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    """Re-aggregate strata with a missing-propagating sum."""
    return df.groupBy(*keys).agg(strict_sum(F.col(value)).alias(out or value))
