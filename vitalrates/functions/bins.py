"""Interval binning, decade buckets and ordered labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bins:
    """Left-closed intervals ``[breaks[i], breaks[i+1])`` labelled ``labels[i]``."""

    breaks: tuple
    labels: tuple

    def __post_init__(self):
        if len(self.breaks) != len(self.labels) + 1:
            raise ValueError("need exactly one more break than labels")
        if list(self.breaks) != sorted(self.breaks):
            raise ValueError("breaks must be increasing")

    @property
    def lower(self) -> tuple:
        return tuple(self.breaks[:-1])

    def midpoints(self) -> list[tuple[str, float]]:
        """Mid-age of each closed group as ``(lo + hi - 1) / 2``; the open
        last group uses its lower bound (the reference's AIRP table)."""
        out = []
        for i, lab in enumerate(self.labels):
            lo, hi = self.breaks[i], self.breaks[i + 1]
            mid = lo if i == len(self.labels) - 1 else (lo + hi - 1) / 2
            out.append((lab, float(mid)))
        return out


def cut(col: Column, bins: Bins) -> Column:
    """Label of the left-closed interval holding ``col``; NULL outside
    ``[first break, last break)`` or for NULL input (R ``cut(right=FALSE)``)."""
    expr = None
    for lo, hi, lab in zip(bins.breaks[:-1], bins.breaks[1:], bins.labels):
        cond = (col >= F.lit(lo)) & (col < F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def label_ordinal(col: Column, labels: Sequence[str]) -> Column:
    """0-based position of ``col`` in ``labels`` (a factor's level order)."""
    m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    return m[col]


def decade(col: Column, width: int = 10) -> Column:
    """``floor(year / width) * width`` as INT."""
    return (F.floor(col / F.lit(width)) * F.lit(width)).cast("int")
