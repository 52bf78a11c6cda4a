"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalrates.sources.sinks import checkpoint_root

#: Input column that carries a caller's whole row through an operator.
ROW = "_row"
#: Arrow batches are worked off in slices of at most this many rows and bytes.
SLICE_ROWS, SLICE_BYTES = 10_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: folders made on the way to what :func:`settled` stores
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that driver and executors share."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    made = _MADE.get()
    if made is not None:
        made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to shared storage and read back: work after this restarts from
    the files when an executor is lost, and is not computed twice."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, stored; the folders it made on the way are
    deleted once that is written. If the write fails they stay."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        df = make()
    finally:
        _MADE.reset(token)
    out = stored(df, name)
    for path in made:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


#: Arrow batches that Spark sends to Python hold at most this many rows and bytes
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(6 << 20)}


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with small batches: texts may be very long, and a batch
    lives in the JVM and in Python at once. The settings are the session's and
    stay."""
    for k, v in BATCH.items():
        df.sparkSession.conf.set(k, v)

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()   # the worker process lives on

    return df.mapInArrow(task, schema)


def slices(batch: pa.RecordBatch, text: int | None, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of bounded rows and text bytes (one long text
    may exceed the bytes alone)."""
    n = batch.num_rows
    if text is None or n == 0:
        for i in range(0, n, SLICE_ROWS):
            yield batch.slice(i, SLICE_ROWS)
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).cumsum()
    i = 0
    while i < n:
        base = size[i - 1] if i else 0
        j = int(np.searchsorted(size, base + most, side="right"))
        j = min(max(j, i + 1), i + SLICE_ROWS, n)
        yield batch.slice(i, j - i)
        i = j


def gathered(batches: Iterator[pa.RecordBatch], text: int, most: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined up to about ``most`` text bytes, for work that gains
    from many texts at once."""
    wait, held = [], 0
    for b in batches:
        wait.append(b)
        held += b.column(text).nbytes
        if held >= most:
            yield from pa.Table.from_batches(wait).combine_chunks().to_batches()
            wait, held = [], 0
    if wait:
        yield from pa.Table.from_batches(wait).combine_chunks().to_batches()


def map_texts(df: DataFrame, text: Column, keep: Sequence[Column], out: T.StructType,
              factory: Callable[[], Callable], most: int = SLICE_BYTES) -> DataFrame:
    """One output row per input row: the kept columns, then ``out``.

    ``factory`` runs once a task and returns a function from a list of texts
    (null stays None) to one sequence per field of ``out``."""
    src = df.select(*keep, text.alias("_text"))
    schema = T.StructType(src.schema.fields[:-1] + out.fields)
    names = [f.name for f in schema.fields]
    k = len(src.columns) - 1

    def run(batches):
        work = factory()
        from pyspark.sql.pandas.types import to_arrow_type
        kinds = [to_arrow_type(f.dataType) for f in out.fields]
        for b in batches:
            for s in slices(b, k, most):
                new = work(s.column(k).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [s.column(i) for i in range(k)] + [pa.array(v, t) for v, t in zip(new, kinds, strict=True)],
                    names=names)

    return map_batches(src, run, schema)


_TYPES = {"int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "string": T.StringType,
          "binary": T.BinaryType, "boolean": T.BooleanType}


def fields(spec: str) -> T.StructType:
    """``"name type, ..."`` as a schema, without a session; ``type[]`` is an array."""
    out = []
    for name, kind in (x.split() for x in spec.split(",")):
        one = _TYPES[kind.removesuffix("[]")]()
        out.append(T.StructField(name, T.ArrayType(one) if kind.endswith("[]") else one))
    return T.StructType(out)


def whole_row(df: DataFrame) -> Column:
    """Every column of the input in one struct: names cannot clash with those
    an operator makes."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW)


def unpack(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    return [F.col(f"{ROW}.`{c}`").alias(c) for c in columns]
