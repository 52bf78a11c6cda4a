"""Small literal frames built inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_frame(spark: SparkSession, rows: Sequence[tuple], names: Sequence[str],
                  types: Sequence[str] | None = None) -> DataFrame:
    """A frame of literal rows (code tables, mid-ages, extra rows) from one
    SQL ``VALUES`` list: a local relation planned and executed in the JVM,
    built with a single gateway call, with no Python worker."""
    types = list(types or ["string"] * len(names))
    body = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    raw = [f"__c{i}" for i in range(len(names))]
    cols = ", ".join(f"CAST({r} AS {t}) AS `{n}`" for r, n, t in zip(raw, names, types))
    return spark.sql(f"SELECT {cols} FROM VALUES {body} AS t({', '.join(raw)})")
