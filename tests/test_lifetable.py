"""Abridged life table (L1) against an independent NumPy evaluation of the
same period-table formulas, plus closed-form checks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalrates.operators.lifetable import life_table_e0

STARTS = [0, 1] + list(range(5, 90, 5))


def brute_e0(D, N):
    """Direct evaluation: missing first rate → 0, stop before the first other
    missing rate, last kept group is open."""
    m = [None if d is None else d / n for d, n in zip(D, N)]
    if m[0] is None:
        m[0] = 0.0
    if None in m:
        m = m[: m.index(None)]
    nn = len(m)
    m = np.array(m, dtype=float)
    nx = np.array([1.0, 4.0] + [5.0] * (nn - 2))
    m0 = m[0]
    a0 = 0.049 + 2.742 * m0 if m0 < 0.107 else 0.34
    a1 = 1.5865 - 2.167 * m0 if m0 < 0.107 else 1.3565
    ax = np.array([a0, a1] + [2.6] * (nn - 2))
    q = nx * m / (1 + (nx - ax) * m)
    q[-1] = 1.0
    lx = np.concatenate([[1.0], np.cumprod(1 - q[:-1])])
    dx = lx - np.concatenate([lx[1:], [0.0]])
    L = nx * lx - dx * (nx - ax)
    L[-1] = lx[-1] / m[-1]
    return float(L.sum())


def _frame(spark, groups):
    rows = []
    for g, (D, N) in groups.items():
        for s, d, n in zip(STARTS, D, N):
            rows.append((g, s, d, n))
    return spark.createDataFrame(rows, "g string, age_li int, D bigint, N bigint")


def test_constant_rate_closed_form(spark):
    groups = {"a": ([20] * 19, [1000] * 19), "b": ([10] * 19, [1000] * 19)}
    got = {r.g: r.LE0 for r in life_table_e0(_frame(spark, groups), ["g"]).collect()}
    assert math.isclose(got["a"], 50.0, rel_tol=1e-9) and math.isclose(got["b"], 100.0, rel_tol=1e-9)


def test_against_brute_force(spark):
    rng = np.random.default_rng(7)
    groups = {}
    for i in range(12):
        N = [int(x) for x in rng.integers(1000, 50000, 19)]
        D = [int(x) for x in rng.integers(1, 900, 19)]
        if i == 3:
            D[7] = None          # missing deaths → table stops before age 30
        if i == 4:
            D[0] = None          # missing infant deaths → rate 0
        if i == 5:
            D[0] = int(N[0] * 0.2)   # infant rate above 0.107
        groups[f"g{i}"] = (D, N)
    got = {r.g: r.LE0 for r in life_table_e0(_frame(spark, groups), ["g"]).collect()}
    for g, (D, N) in groups.items():
        assert got[g] == pytest.approx(brute_e0(D, N), rel=1e-12), g


def test_e0_falls_when_a_rate_rises(spark):
    N = [10000] * 19
    D = [50] * 19
    D2 = list(D)
    D2[10] = 500
    got = {r.g: r.LE0 for r in life_table_e0(_frame(spark, {"a": (D, N), "b": (D2, N)}), ["g"]).collect()}
    assert got["b"] < got["a"]
