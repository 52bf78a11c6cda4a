"""Commit logs: small Parquet tables that say which written folders count.

Data are written first, into a folder of their own that nobody reads yet; one
row per part of it is then appended to the log as a single file, which appears
whole or not at all. A writer that dies before that leaves folders no reader
looks at. Readers take, per key, the row of the highest version. One writer at
a time; of two that race, the larger folder name wins everywhere.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "version long, folder string, part string, n_rows long"


def fresh_folder() -> str:
    return uuid.uuid4().hex


def log(spark: SparkSession, root: str) -> DataFrame:
    """All committed rows; a store without commits has none."""
    try:
        return spark.read.schema(LOG).parquet(f"{root}/_commits")
    except AnalysisException:
        return spark.createDataFrame([], LOG)


def last_version(spark: SparkSession, root: str) -> int:
    return log(spark, root).agg(F.max("version")).first()[0] or 0


def commit(spark: SparkSession, root: str, folder: str, parts: dict[str | None, int]) -> int:
    """Make ``parts`` (name → rows) of a written folder count."""
    version = last_version(spark, root) + 1
    rows = [(version, folder, part, n) for part, n in parts.items()]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{root}/_commits")
    return version


def current(spark: SparkSession, root: str, version: int | None = None) -> dict[str | None, str]:
    """Part → folder, as of a version (default: the newest)."""
    rows = log(spark, root)
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    # as many rows as there are parts: years, or tables of a report
    return {r.part: r.folder for r in rows.groupBy("part").agg(F.max_by("folder", F.struct("version", "folder")).alias("folder")).collect()}
