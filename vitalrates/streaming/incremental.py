"""Incremental form of the death-records ingestion (S1 → O7).

New yearly exports land in a directory over time. Instead of re-reading all
years, a file-source stream harmonises each new file with the same operators
as the batch path and keeps the base cube as streaming aggregation state;
each micro-batch writes the updated cube to a Parquet sink through
``foreachBatch``. The rurality and code tables are static broadcast sides of
stream-static joins. The cube's key space is bounded by the code domains, so
the state does not grow with the number of records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalrates.operators import harmonise as H
from vitalrates.operators.counts import base_cube
from vitalrates.plans.study import CUBE_DIMS
from vitalrates.sources.readers import DEATH_COLUMNS

RAW_SCHEMA = ", ".join(f"{c} string" for c in DEATH_COLUMNS)


def harmonised_stream(spark: SparkSession, source_dir: str, regions: DataFrame, fmt: str = "csv",
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming death records → analysis-level records with region."""
    r = spark.readStream.schema(RAW_SCHEMA).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.load(source_dir)
    deaths = H.analysis_deaths(H.clean_deaths(raw))
    return H.attach_region(deaths, regions)


def stream_base_cube(spark: SparkSession, source_dir: str, regions: DataFrame, sink_dir: str,
                     checkpoint_dir: str, fmt: str = "csv", available_now: bool = True) -> StreamingQuery:
    """Start the incremental cube: complete-mode aggregation state, each
    micro-batch's full cube written (overwrite) to ``sink_dir``. Progress and
    state live under ``checkpoint_dir`` (shared storage), so a restarted
    query resumes where it stopped."""
    cube = base_cube(harmonised_stream(spark, source_dir, regions, fmt), CUBE_DIMS)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("n", F.col("n").cast("bigint")).write.mode("overwrite").parquet(sink_dir)

    w = (cube.writeStream.outputMode("complete").option("checkpointLocation", checkpoint_dir)
             .foreachBatch(write))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
