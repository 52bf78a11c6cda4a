"""Sinks (S10, S11) and lineage cuts."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from vitalrates.sources import commits

_LOCAL_ROOT: dict[str, str] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """Shared storage for intermediate tables: the cluster's
    ``spark.checkpoint.dir``. Where none is configured, a session whose driver
    and executors are one process gets a folder of its own; any other session
    must name one, as executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOT:
        import tempfile
        _LOCAL_ROOT[app] = tempfile.mkdtemp(prefix="vitalrates-ckpt-")
    return _LOCAL_ROOT[app]


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None,
                path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint root and read it back:
    later stages restart from storage, not from the raw scan, if an executor
    is lost. ``partition_by`` lays the files out by those columns so later
    filters on them prune whole directories."""
    spark = df.sparkSession
    path = path or os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    out = spark.read.parquet(path)
    return out.select(*df.columns) if partition_by else out


def write_deaths(df: DataFrame, path: str) -> int:
    """Silver deaths by year (S10), as a delivery: the years it holds replace
    those years of earlier deliveries, all others keep their files untouched.
    Delivering the same years again gives the same table. Nothing shows before
    the delivery is committed (:mod:`commits`); returns its version."""
    spark, folder = df.sparkSession, commits.fresh_folder()
    seen = Observation(f"deaths-{folder}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.partitionBy("year").parquet(f"{path}/data/delivery={folder}")
    if not seen.get["n"]:
        return commits.last_version(spark, path)
    years = (spark.read.schema(df.schema).parquet(f"{path}/data/delivery={folder}")
             .groupBy("year").agg(F.count(F.lit(1)).alias("n")).collect())   # from the files' footers
    return commits.commit(spark, path, folder, {None if r.year is None else str(r.year): r.n for r in years})


def stored_deaths(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The committed deaths of :func:`write_deaths`, as of a version. Only the
    folders of committed years are listed as partitions to read."""
    held = commits.current(spark, path, version)
    if not held:
        raise ValueError(f"no committed deaths in {path}")
    df = spark.read.parquet(f"{path}/data")
    own = F.concat_ws("/", "delivery", F.coalesce(F.col("year").cast("string"), F.lit("")))
    return df.where(own.isin([f"{folder}/{year or ''}" for year, folder in held.items()])).drop("delivery")


def write_results(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> int:
    """Result tables as one run (S11). Tables are a few hundred rows, so each
    is one file. The run is committed after its last table: until then, and if
    the writer dies, readers see the run before. Returns the run's version."""
    folder = commits.fresh_folder()
    for name, df in tables.items():
        w = df.coalesce(1).write
        if fmt == "csv":
            w.option("header", True).csv(f"{root}/run={folder}/{name}")
        else:
            w.parquet(f"{root}/run={folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    return commits.commit(spark, root, folder, dict.fromkeys(tables, 0))


def read_results(spark: SparkSession, root: str, name: str, version: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A table of the newest committed run, or of an earlier version."""
    held = commits.current(spark, root, version)
    if name not in held:
        raise ValueError(f"no committed {name} in {root}")
    path = f"{root}/run={held[name]}/{name}"
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)
