"""Language identification, web archives, nearest neighbours, the pipeline and
the guard of the entry module."""

import hashlib
import os
import random
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA
from vitalrates.llm import langid, neighbours, warc
from vitalrates.llm.common import shared_path, stored

SYLLABLES = {"en": "th he in er an re on at", "de": "sch ein ung ch der au ge lich", "fr": "eau ai ou que men tion el é",
             "es": "ción ado lla ñ os as ez ar"}


def invented(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(s, k=rng.randint(1, 3))) for _ in range(n))


def test_language_query(spark, docs, rows, empty):
    rng = random.Random(2)
    own = [(i, invented(rng, lang := rng.choice("en de fr es".split()), rng.randint(5, 80)), lang, "s", 1) for i in range(1200)]
    own += [(2000, None, "en", "s", 1), (2001, "123 ...", "en", "s", 1), (2002, "", None, "s", 1), (None, invented(rng, "fr", 40), "fr", "s", 1)]
    got = langid.identify(spark.createDataFrame(own, SCHEMA)).collect()
    assert len(got) == len(own)
    lang = {r[0]: r[2] for r in own}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (2000, 2001, 2002))
    held = [r for r in got if r.held_out and r.doc_id < 2000]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held) and len(held) > 150
    assert {r.lang_pred for r in langid.identify(docs).collect()} <= {"en", "de", "und"}
    assert langid.identify(empty).count() == 0
    alone = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)}


def test_predictions_do_not_see_the_other_columns(spark):
    rng = random.Random(4)
    own = [(i, invented(rng, lang := rng.choice(["en", "fr"]), 30), lang, "s", 1) for i in range(300)]
    df = spark.createDataFrame(own, SCHEMA)
    model = langid.fit(df)
    one = df.limit(40).select(F.lit(7).cast("long").alias("doc_id"), "text", F.lit("zz").alias("lang"))
    a = langid.predicted(df.limit(40), model, [F.col("text")]).collect()
    assert a == langid.predicted(one, model, [F.col("text")]).collect()


def test_features_ignore_text_borders():
    x = pa.array(["abc", "", None, "bca", "a"])
    f = langid.features(x, 256)
    assert (f[0] == langid.features(pa.array(["abc"]), 256)[0]).all() and not f[1].any() and not f[2].any() and not f[4].any()


# ---------------------------------------------------------------- archives
PAGES = "page_id long, url string, html string"


def pages(spark):
    big, small, body = "<p>" + "é" * 60, "x" * 99, "y" * 100
    own = [(5, "http://a/ü b\r\nX: y", big), (3, None, big), (9, "http://c", big), (3, "http://d", big), (1, "u", small), (2, "u", small),
           (10, "u", body), (11, "u", body), (4, "u", None), (6, "u", ""), (None, "u", big), (12, "u", "WARC/1.1\r\n\r\nWARC/1.0\r\n" * 9),
           (13, "u", "z" * 300_000), (14, "u", "z" * 300_000)]
    return own, spark.createDataFrame(own, PAGES)


def test_archive_query(spark):
    own, df = pages(spark)
    got = warc.archive_roundtrip(df.withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))).collect()
    least = {}
    for i, _, h in own:
        if h and len(h.encode()) >= 100 and i is not None:
            least[h] = min(i, least.get(h, i))
    want = Counter()
    for i, _, h in own:
        raw = (h or "").encode()
        first = least.get(h)
        again = i is not None and first is not None and first < i
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert sum(k[3] == "revisit" for k in want) == 4
    assert warc.archive_roundtrip(spark.createDataFrame([], PAGES)).count() == 0


def archive(tmp_path, name, parts):
    path = tmp_path / name
    path.write_bytes(b"".join(parts))
    return path


def records(n=4):
    out = []
    for i in range(n):
        body = (f"page {i} " * 50).encode()
        out.append(warc.record("response", i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), len(body), None))
    return out


def read(path):
    with pa.OSFile(str(path)) as source:
        return list(warc.Archive(source, chunk=64).rows())


@pytest.mark.parametrize("gz", [True, False])
def test_salvage_reader_recovers_later_records(tmp_path, gz):
    raw = records()
    whole = [warc.member(r) if gz else r for r in raw]
    clean = read(archive(tmp_path, "clean", whole))
    assert [r["page_id"] for r in clean] == [0, 1, 2, 3] and all(r["gap"] is None for r in clean)
    assert [r["at"] for r in clean] == np.cumsum([0, *map(len, whole[:-1])]).tolist()

    def damaged(how):
        parts = list(whole)
        if how == "flip":
            x = bytearray(parts[1])
            x[len(x) // 2] ^= 0x41
            parts[1] = bytes(x)
        elif how == "cut":
            parts[1] = parts[1][:len(parts[1]) // 2]
        elif how == "junk":
            parts.insert(2, b"\x1f\x8b\x08 not a member WARC/1. neither" * 3)
        elif how == "tail":
            parts[3] = parts[3][:-30]
        elif how == "head":
            parts[0] = parts[0][7:]
        return parts
    for how, lost in (("flip", 1), ("cut", 1), ("junk", None), ("tail", 3), ("head", 0)):
        parts = damaged(how)
        rows = read(archive(tmp_path, how, parts))
        good = [r for r in rows if r["gap"] is None]
        gaps = [r for r in rows if r["gap"] is not None]
        assert [r["page_id"] for r in good] == [i for i in range(4) if i != lost], how
        assert len(gaps) == 1 and gaps[0]["gap"], how
        at = 2 if how == "junk" else lost
        assert (gaps[0]["at"], gaps[0]["size"]) == (sum(map(len, parts[:at])), len(parts[at])), how
        assert sum(r["size"] for r in rows) == sum(map(len, parts))    # records and gaps cover the file


def test_reader_checks_digests_and_lengths(tmp_path):
    a, b, c, d = records()
    wrong = a.replace(b"page 0 page", b"page 9 page", 1)
    longer = b.replace(b"Content-Length: ", b"Content-Length: 1", 1)
    rows = read(archive(tmp_path, "x", [warc.member(wrong), warc.member(longer), warc.member(c), warc.member(d)]))
    assert [(r.get("page_id"), r["gap"]) for r in rows][-2:] == [(2, None), (3, None)]
    assert rows[0]["gap"] == "block digest differs" and rows[0]["at"] == 0
    assert not read(archive(tmp_path, "empty", []))
    only = read(archive(tmp_path, "noise", [b"no archive at all"]))
    assert len(only) == 1 and only[0]["gap"] and only[0]["size"] == 17


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("field, value", [("Content-Length", "²"), ("Content-Length", "9" * 5000), ("Content-Length", "-1"), ("Content-Length", "9" * 17),
                                          ("X-Page-ID", "--5"), ("X-Page-ID", "1" * 30), ("X-Page-ID", "٣"), ("X-Page-ID", str(1 << 63))])
def test_bad_numbers_cost_one_record_only(tmp_path, gz, field, value):
    raw = records()
    line = next(x for x in raw[1].split(b"\r\n") if x.startswith(field.encode()))
    raw[1] = raw[1].replace(line, f"{field}: {value}".encode(), 1)
    parts = [warc.member(r) if gz else r for r in raw]
    rows = read(archive(tmp_path, "n", parts))
    assert [r.get("page_id") for r in rows] == [0, None, 2, 3] and rows[1]["gap"]
    assert (rows[1]["at"], rows[1]["size"]) == (len(parts[0]), len(parts[1]))


def test_page_ids_of_64_bits_and_long_records(spark, tmp_path):
    own = [((1 << 63) - 1, "u", "a" * 200), (-(1 << 63), "u", "b" * 200), (7, "u", "long " * 4_000_000)]
    got = {r.page_id: r.payload_bytes for r in warc.archive_roundtrip(spark.createDataFrame(own, PAGES)).collect()}
    assert got == {i: len(h) for i, _, h in own}
    folder = shared_path(spark, "test-warc")
    files = warc.write_archives(spark.createDataFrame(own, PAGES), folder)
    back = warc.read_archives(files, folder).select("page_id", F.length("payload").alias("n")).collect()
    assert {r.page_id: r.n for r in back} == got


def test_a_gap_in_own_archives_is_an_error(spark, monkeypatch):
    read_back = warc.read_archives
    monkeypatch.setattr(warc, "read_archives", lambda *a, **k: read_back(*a, **k).withColumn("gap", F.lit("torn")))
    with pytest.raises(Exception, match="gap in .*torn"):
        warc.archive_roundtrip(spark.createDataFrame([(1, "u", "x")], PAGES)).collect()


def test_archives_roll_and_read_back_payloads(spark):
    _, df = pages(spark)
    folder = shared_path(spark, "roll")
    manifest = warc.write_archives(df.coalesce(1), folder, roll=500)
    assert manifest.count() > 2 and manifest.agg(F.sum("n_records")).first()[0] == 14
    back = {r.page_id: r.payload for r in warc.read_archives(manifest, folder).collect() if r.type == "response" and r.page_id}
    assert bytes(back[12]).decode() == "WARC/1.1\r\n\r\nWARC/1.0\r\n" * 9 and bytes(back[4]) == b""


# ---------------------------------------------------------------- neighbours
def brute(ids, x, k=5, every=50):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<float>")


def test_forest_equals_brute_force_on_small_tables(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[100:160] = x[100]                     # copies, a query among them
    x[300:420] = x[300] + 0.01 * rng.standard_normal((120, 16))
    ids = rng.permutation(600)
    bad = [(50_000, None), (50_050, []), (50_100, [0.0] * 16), (50_150, [None] + [1.0] * 15), (50_200, [float("nan")] * 16),
           (50_250, [float("inf")] * 16), (None, [1.0] * 16), (50_300, [1.0, 2.0])]
    df = frame(spark, ids, x).union(spark.createDataFrame(bad, "vec_id long, embedding array<float>"))
    got = {}
    for r in neighbours.nearest(df.union(df.limit(3)).withColumn("tree", F.lit(1))).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(ids, x.astype(np.float64))
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in w], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in w], atol=1e-12)


def test_forest_with_few_or_no_rows(spark):
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    two = neighbours.nearest(frame(spark, [0, 7], np.eye(4)[:2])).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in two] == [(0, 1, 7)]


@pytest.mark.parametrize("candidates", [40, 400])
def test_deep_buckets_find_the_near_ones(spark, candidates):
    """With little room the trees are several symbols deep and prefixes both
    shorter and longer than the buckets' are used."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((60, 24)).repeat(40, 0) + 0.15 * rng.standard_normal((2400, 24)),
                        rng.standard_normal((600, 24))]).astype(np.float32)
    ids = rng.permutation(len(x))
    forest = neighbours.Forest(frame(spark, ids, x), candidates=candidates, recall=0.97)
    assert forest.depth >= 1
    got = {}
    for r in forest.search(F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(ids, x.astype(np.float64))
    hits = [len({i for i, _ in w} & got.get(q, set())) for q, w in want.items()]
    assert sum(hits) >= 0.9 * 5 * len(want)


def test_vectors_of_doubles_are_scored_as_they_are(spark):
    """Doubles are not rounded to floats, nor lost beyond their range."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((120, 12))
    x[60:90] = x[0] * (1 + 1e-9 * rng.standard_normal((30, 12)))       # equal as floats, nearly
    big = x.copy()
    big[::3] *= 2.0 ** 900
    big[1::3] *= 2.0 ** -900
    ids = rng.permutation(120)
    df = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, big)], "vec_id long, embedding array<double>")
    want = brute(ids, x, every=10)
    got = {}
    for r in neighbours.nearest(df, every=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert np.allclose([s for _, s in got[q]], [s for _, s in w], atol=1e-14, rtol=0)
    whole = spark.createDataFrame([(0, [2**53 - 1, 1]), (1, [2**53 - 1, 1]), (2, [1, 0])], "vec_id long, embedding array<long>")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(whole).orderBy("rank").collect()] == [(0, 1), (0, 2)]


def test_a_dense_cluster_is_no_group_of_its_own(spark, monkeypatch):
    """Rows and queries of a cluster that all trees keep in one bucket are
    cut, in the count and in the scoring, and nothing is lost."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 16))
    x[:700] = x[0] + 1e-3 * rng.standard_normal((700, 16))
    df = frame(spark, rng.permutation(900), x.astype(np.float32))
    whole = neighbours.nearest(df, every=5).collect()
    monkeypatch.setattr(neighbours, "CHUNK", 50)
    monkeypatch.setattr(neighbours, "PART", 10)
    sizes, plain = [], neighbours.grouped_map

    def watched(df, key, work, schema):
        sizes.append(df.groupBy(key).agg(F.count("probe").alias("asks"), (F.count(F.lit(1)) - F.count("probe")).alias("rows"))
                     .agg(F.max("asks"), F.max("rows")).first())
        return plain(df, key, work, schema)

    monkeypatch.setattr(neighbours, "grouped_map", watched)
    assert sorted(neighbours.nearest(df, every=5).collect()) == sorted(whole) and len(whole) == 5 * 180
    assert len(sizes) == 2 and all(asks <= 25 and rows <= 90 for asks, rows in sizes), sizes


# ---------------------------------------------------------------- pipeline
def test_folders_made_on_the_way_go_once_the_result_is_stored(spark, tmp_path, docs):
    import os

    from vitalrates.llm import simhash
    from vitalrates.llm.common import settled
    from vitalrates.sources.sinks import checkpoint_root
    root = checkpoint_root(spark).removeprefix("file:")
    now = lambda: set(os.listdir(root)) if os.path.isdir(root) else set()      # noqa: E731
    before = now()
    want = simhash.keep_one(docs, shingle=3, bits=3)
    between = now()
    got = settled(spark, lambda: simhash.keep_one(docs, shingle=3, bits=3), "settled-test")
    left = now() - between
    assert len(between - before) > 3 and [x.rsplit("-", 1)[0] for x in left] == ["settled-test"]
    assert got.count() == want.count() and got.columns == want.columns
    with pytest.raises(ValueError):
        settled(spark, lambda: frame(spark, [1], np.eye(1)) and int("x"), "settled-test")


def test_pipeline_stages_follow_each_other(spark, tmp_path, docs, rows):
    import corpus_pipeline
    labels = spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "secret scans",
                                                      "best-fit packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [now.count()]
    for name, stage in corpus_pipeline.STAGES:
        now = stored(stage(spark, now, str(tmp_path)), "test-stage")
        counts.append(now.count())
        if name != "best-fit packing":
            assert now.schema == plain.schema
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4] <= counts[5]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids)
    assert sorted(map(key, whole.collect())) == sorted(map(key, now.collect()))
    for name, stage in corpus_pipeline.STAGES:      # empty input
        assert stage(spark, plain.limit(0), str(tmp_path)).count() == 0, name


@pytest.mark.parametrize("name", ["op3_warc_salvage", "op5_substring_dedup", "op12_line_runs"])
def test_sql_of_queries_agrees(spark, name):
    import duckdb

    import __spark_entry__ as entry
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(cols)
    assert Counter(map(tuple, got.select(*cols).collect())) == Counter(want.fetchall())


def test_entry_registers_the_operators_and_works_without_them(tmp_path):
    import __spark_entry__ as entry
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    root = os.path.dirname(entry.__file__)
    for part in ("__spark_entry__.py", "vitalrates"):
        subprocess.run(["cp", "-r", f"{root}/{part}", tmp_path], check=True)
    os.rename(tmp_path / "vitalrates/llm", tmp_path / "elsewhere")
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 86 and not [n for n in e.queries() if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    import __spark_entry__ as entry
    root = os.path.dirname(entry.__file__)
    for folder, _, files in os.walk(f"{root}/vitalrates"):
        for f in files:
            if f.endswith(".py") and "/llm" not in folder:
                assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f


