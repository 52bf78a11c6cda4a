"""Incremental cube equals the batch cube over the same files."""

import os
import tempfile

from pyspark.sql import functions as F

from vitalrates.operators import harmonise as H
from vitalrates.operators.counts import base_cube
from vitalrates.plans.study import CUBE_DIMS
from vitalrates.sources.readers import read_deaths
from vitalrates.streaming import stream_base_cube

HEADER = "COD_DPTO,COD_MUNIC,CODPTORE,CODMUNRE,ANO,MES,SEXO,SEG_SOCIAL,GRU_ED1,C_BAS1\n"


def _write(path, rows):
    with open(path, "w") as f:
        f.write(HEADER)
        for r in rows:
            f.write(",".join(r) + "\n")


def test_stream_cube_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="vr-stream-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    _write(os.path.join(src, "y1990.csv"), [("05", "001", "05", "002", "1990", "1", "1", "", "10", "4109"),
                                            ("05", "001", "", "", "1990", "2", "2", "", "20", "8100")])
    _write(os.path.join(src, "y2010.csv"), [("08", "001", "01", "003", "2010", "3", "1", "1", "20", "X700"),
                                            ("08", "001", "08", "001", "2010", "3", "1", "2", "29", "I219"),
                                            ("08", "001", "08", "001", "2010", "4", "2", "2", "15", "V031")])
    rur = spark.createDataFrame([(5001, "a", "A", "Rural"), (8001, "b", "B", None)],
                                "Municipaly int, Municipali string, Departam_1 string, Categoria_ string")
    regions = H.classify_region(rur)
    sink = os.path.join(root, "cube")
    q = stream_base_cube(spark, src, regions, sink, os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(sink)
    batch = base_cube(H.attach_region(H.map_ext_cause(H.analysis_deaths(H.clean_deaths(
        read_deaths(spark, [os.path.join(src, "y1990.csv"), os.path.join(src, "y2010.csv")])))), regions), CUBE_DIMS)
    key = list(CUBE_DIMS) + ["n"]
    assert sorted(map(tuple, got.select(*key).collect()), key=str) == \
        sorted(map(tuple, batch.select(*key).collect()), key=str)
    assert got.agg(F.sum("n")).collect()[0][0] == 4   # the unknown-age death is excluded


def test_stream_resumes_from_checkpoint_with_new_file(spark):
    root = tempfile.mkdtemp(prefix="vr-stream2-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    _write(os.path.join(src, "y2010.csv"), [("08", "001", "08", "001", "2010", "3", "1", "2", "20", "I219")])
    rur = spark.createDataFrame([(8001, "b", "B", None)],
                                "Municipaly int, Municipali string, Departam_1 string, Categoria_ string")
    regions = H.classify_region(rur)
    sink, ckpt = os.path.join(root, "cube"), os.path.join(root, "ckpt")
    stream_base_cube(spark, src, regions, sink, ckpt).awaitTermination(120)
    assert spark.read.parquet(sink).agg(F.sum("n")).collect()[0][0] == 1
    _write(os.path.join(src, "y2011.csv"), [("08", "001", "08", "001", "2011", "3", "2", "1", "20", "I219"),
                                            ("08", "001", "08", "001", "2010", "5", "1", "2", "20", "I219")])
    stream_base_cube(spark, src, regions, sink, ckpt).awaitTermination(120)   # restart: only the new file is read
    got = {(r.year, r.sex): r.n for r in spark.read.parquet(sink).collect()}
    assert got == {(2010, "Male"): 2, (2011, "Female"): 1}
