"""Readers for the study's inputs (S1-S9). Every reader takes an explicit
schema: codes with leading zeros stay text, never inferred numbers."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEATH_COLUMNS = ("COD_DPTO", "COD_MUNIC", "CODPTORE", "CODMUNRE", "ANO", "MES",
                 "SEXO", "SEG_SOCIAL", "GRU_ED1", "C_BAS1")


def normalise_headers(df: DataFrame) -> DataFrame:
    """Upper-case every column name."""
    return df.toDF(*[c.upper() for c in df.columns])


def as_text(df: DataFrame) -> DataFrame:
    """Cast every column to text so yearly files with drifting types stack (S3)."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def conform(df: DataFrame, columns: Sequence[str] = DEATH_COLUMNS) -> DataFrame:
    """Keep the target columns that exist and add the missing ones as NULL
    text (S4)."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_deaths(spark: SparkSession, paths: Sequence[str], fmt: str = "csv",
                columns: Sequence[str] = DEATH_COLUMNS, **options) -> DataFrame:
    """Yearly death exports → one all-text frame (S1-S4). Each path is read
    lazily with every column as text; the yearly frames are conformed to the
    target columns and stacked into a single plan (no per-year action)."""
    frames = []
    for p in paths:
        if fmt == "csv":
            r = spark.read.options(header=True, inferSchema=False, **options).csv(p)
        else:
            r = spark.read.format(fmt).options(**options).load(p)
        frames.append(conform(as_text(normalise_headers(r)), columns))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


class CheckedDeaths(NamedTuple):
    """What :func:`read_deaths_checked` gives; together no line is lost."""
    accepted: DataFrame
    rejected: DataFrame
    counts: DataFrame


BAD_LINE = "_bad_line"


def read_deaths_checked(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] = DEATH_COLUMNS, sep: str = ",",
                        **options) -> CheckedDeaths:
    """Yearly CSV exports with a quarantine (S1, S4): ``accepted`` as from
    :func:`read_deaths`; ``rejected`` has the file and whole text of each line
    whose fields do not fit the file's header; ``counts`` has accepted and
    rejected lines per file. Each path is one file with its own header. The
    header line is read first, all lines lazily, in one scan per frame."""
    ok, bad = [], []
    for p in paths:
        own = spark.read.options(header=True, inferSchema=False, sep=sep, **options).csv(p).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*own, BAD_LINE]])
        df = spark.read.schema(schema).options(
            header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_LINE, columnPruning=False, sep=sep, **options).csv(p)
        df = df.withColumn("_file", F.col("_metadata.file_name"))
        # always true, but Spark refuses plans that read nothing of a line but its being bad
        read = F.length(F.coalesce(F.col(f"`{own[0]}`"), F.lit(""))) >= 0
        fine = F.col(BAD_LINE).isNull()
        ok.append(conform(as_text(normalise_headers(df.where(fine & read).drop(BAD_LINE))), [*columns, "_FILE"]))
        bad.append(df.where(~fine & read).select("_file", F.col(BAD_LINE).alias("line")))
    accepted, rejected = ok[0], bad[0]
    for a, b in zip(ok[1:], bad[1:], strict=True):
        accepted, rejected = accepted.unionByName(a), rejected.unionByName(b)
    n = F.count(F.lit(1))
    each = (accepted.groupBy(F.col("_FILE").alias("file")).agg(n.alias("accepted"), F.lit(0).cast("long").alias("rejected"))
            .unionByName(rejected.groupBy(F.col("_file").alias("file")).agg(F.lit(0).cast("long").alias("accepted"), n.alias("rejected"))))
    counts = each.groupBy("file").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    return CheckedDeaths(accepted.drop("_FILE"), rejected.select(F.col("_file").alias("file"), "line"), counts)


#: positional names of the published sheets (fixed values)
MUNICIPAL_SHEET = {0: "COD_DPTO", 1: "DPTO", 2: "COD_MPIO", 3: "MPIO", 4: "ANO", 5: "AREA"}
MUNICIPAL_SHEET_SWAPPED = MUNICIPAL_SHEET | {2: "MPIO", 3: "COD_MPIO"}
NATIONAL_SHEET = {0: "DP", 1: "DPNOM", 2: "ANO", 3: "AREA"}


def read_population_sheet(spark: SparkSession, path: str, rename: dict | None = None,
                          sep: str = ",", required: Sequence[str] = (), header: str | None = None) -> DataFrame:
    """Wide population export (S5-S7). Header cells are renamed by the
    per-source map (positional names differ between releases) and the
    open-age marker `` y más`` is removed from headers; rows outside the
    table are dropped by predicate (non-missing ``required`` columns), never
    by position. Where title lines stand before the table, ``header`` is a
    text that only the header line holds: that line names the columns, and
    the lines before it fail the predicate (they are too short)."""
    if header is None:
        df = spark.read.options(header=True, inferSchema=False, sep=sep).csv(path)
        own = list(df.columns)
    else:
        line = spark.read.text(path).where(F.col("value").contains(header)).first()
        if line is None:
            raise ValueError(f"no header line with {header!r} in {path}")
        own = [c if c else f"_c{i}" for i, c in enumerate(next(csv.reader([line[0]], delimiter=sep)))]
        schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(own))])
        df = spark.read.schema(schema).options(header=False, sep=sep).csv(path)
    cols = [(rename or {}).get(i, c).replace(" y más", "") for i, c in enumerate(own)]
    df = df.toDF(*cols)
    for c in required:
        df = df.where(F.col(c).isNotNull() & (F.col(c) != own[cols.index(c)]))
    return df


RURALITY_SCHEMA = T.StructType([
    T.StructField("Municipaly", T.IntegerType()),
    T.StructField("Municipali", T.StringType()),
    T.StructField("Departam_1", T.StringType()),
    T.StructField("Categoria_", T.StringType()),
])


def read_rurality(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """Delimited rurality table."""
    return spark.read.options(header=True, sep=sep).schema(RURALITY_SCHEMA).csv(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Serialised analysis input."""
    return spark.read.parquet(path)
