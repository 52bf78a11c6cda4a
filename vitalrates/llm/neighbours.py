"""Nearest neighbours by cosine from a hash-prefix forest.

Every tree gives a vector a long string of symbols: the nearest signed axis
after a random rotation, one rotation per symbol. A tree is the sorted array
of these strings, kept in buckets of a common prefix; a bucket with many rows
is cut into chunks by a hash of the row, and many queries of one bucket into
parts, so no group holds more than a chunk and a part. A query
descends to its longest matching prefix in each tree and then goes up in all
trees at once, symbol by symbol, until the trees together hold enough
candidates; every row under that prefix is a candidate and is scored by its
exact cosine in double precision. Where even the shortest prefix holds too
few, all rows are candidates. How many are enough is measured: a bounded
sample of the queries is compared with all rows, and the smallest number that
finds the wanted share of their true neighbours is used for all queries.

Identical vectors are one entry with the least ``k + 1`` of their ids: no
other copy can be among the nearest ``k``. Queries with identical vectors are
searched once.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor rows without id; of rows with one id the least
vector counts; vectors of floats are taken as they are, all others as doubles;
components of any finite size are scored; of several dimensions the most common one takes part (of
equally common ones the largest); ties go to the smaller id; other columns are
not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalrates.llm.common import fields, map_batches, stored

TREES, SYMBOLS, WIDTH = 36, 5, 64
#: rows of a chunk and queries of a part of a bucket
CHUNK, PART = 8192, 4096


def rotations(dims: int, trees: int, symbols: int, seed: int) -> np.ndarray:
    """One random projection per tree and symbol onto at most WIDTH axes."""
    m = min(dims, WIDTH)
    return np.random.default_rng(seed).standard_normal((trees * symbols, m, dims)).astype(np.float32)


def bits_per_symbol(dims: int) -> int:
    return (2 * min(dims, WIDTH) - 1).bit_length()


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, the largest component below one: no
    square leaves the range of doubles, and cosines keep every bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def codes(x: np.ndarray, rotation: np.ndarray, trees: int, symbols: int) -> np.ndarray:
    """Strings as integers, first symbol highest: rows x trees."""
    bits = bits_per_symbol(x.shape[1])
    out = np.zeros((len(x), trees), np.int64)
    x = scaled(x)
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for t in range(trees):
        for s in range(symbols):
            y = unit @ rotation[t * symbols + s].T
            axis = np.abs(y).argmax(axis=1)
            sign = y[np.arange(len(y)), axis] < 0
            out[:, t] = (out[:, t] << bits) | (2 * axis + sign)
    return out


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(f"`{embedding}`")
    kind = vectors.select(v).schema[0].dataType
    floats = not isinstance(kind, T.ArrayType) or isinstance(kind.elementType, T.FloatType)
    v = v.cast("array<float>" if floats else "array<double>")
    good = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists(v, lambda e: e != 0)
    return (vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"))
            .where(F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))).groupBy("vec_id").agg(F.min("v").alias("v")))


def grouped_map(df: DataFrame, key: str, work: Callable, schema: T.StructType) -> DataFrame:
    """Rows of one key together in a task, key by key: ``work`` gets a table
    of them and gives record batches. Keys must be of bounded size."""
    ready = df.repartition(F.col(key)).sortWithinPartitions(key)

    def run(batches) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for i, j in zip(cut, cut[1:]):
                if last is not None and k[i] != last and wait:
                    yield from work(pa.Table.from_batches(wait))
                    wait = []
                last = k[i]
                wait.append(b.slice(i, j - i))
        if wait:
            yield from work(pa.Table.from_batches(wait))

    return map_batches(ready, run, schema)


def _matrix(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    own = column.combine_chunks().take(pa.array(rows))
    flat = own.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.float32)


def _prefix(column: Column, drop: int) -> Column:
    return F.shiftright(column, drop) if drop else column


class Forest:
    """The stored index of a table of vectors."""

    def __init__(self, vectors: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding",
                 trees: int = TREES, symbols: int = SYMBOLS, candidates: int = 6000, seed: int = 7,
                 recall: float = 0.95, sample: int = 100):
        self.recall, self.sample = recall, sample
        self.k, self.trees, self.symbols, self.candidates = k, trees, symbols, candidates
        rows = stored(usable(vectors, vec_id, embedding), "forest-rows")
        sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        self.dims = sizes[0]["d"] if sizes else 0
        self.rows = rows.where(F.size("v") == self.dims)
        # the least k + 1 ids of each distinct vector; Spark limits groups before the shuffle
        w = Window.partitionBy("v").orderBy("vec_id")
        few = self.rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
        classes = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        self.bits = bits_per_symbol(self.dims) if self.dims else 1
        self.index = stored(self._coded(classes, trees, symbols, seed), "forest") if self.dims else None
        self.n = n = self.index.count() if self.dims else 0
        # buckets are as deep as the trees together are expected to hold twice the candidates below them
        room = n * trees / (2 * candidates)
        self.depth = min(symbols, max(0, int(math.log(room) / math.log(2 * min(self.dims, WIDTH))))) if room > 1 else 0

    def _coded(self, classes: DataFrame, trees: int, symbols: int, seed: int) -> DataFrame:
        dims = self.dims
        schema = T.StructType([*fields("cid long, ids long[]").fields, classes.schema["v"],
                               *fields("codes long[]").fields])
        src = classes.select(F.col("ids")[0].alias("cid"), "ids", "v")

        def run(batches):
            rotation = rotations(dims, trees, symbols, seed)
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    s = b.slice(i, 4096)
                    x = s.column(2).flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, dims).astype(np.float64)
                    c = codes(x, rotation, trees, symbols)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, trees, dtype=np.int32)), pa.array(c.ravel()))
                    yield pa.RecordBatch.from_arrays([*s.columns, lists], names=schema.names)

        return map_batches(src, run, schema)

    def _enough(self, probes: DataFrame, per: DataFrame) -> int:
        """Candidates that find ``recall`` of the true neighbours of a sample
        of at most ``sample`` probes, which are compared with every row."""
        few = probes.join(per, "cid").orderBy(F.xxhash64("cid"), "cid").limit(self.sample).collect()
        if not few:
            return self.candidates
        q = scaled(np.array([r["v"] for r in few], np.float64))
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        own, code = np.array([r["cid"] for r in few]), np.array([r["codes"] for r in few], np.int64)
        bits, total, k, dims = self.bits, self.symbols, self.k, self.dims

        def run(batches):
            best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))     # probe, score, shared symbols
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    s = b.slice(i, 4096)
                    x = scaled(s.column(0).flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, dims).astype(np.float64))
                    cid, have = s.column(1).to_numpy(), s.column(2).flatten().to_numpy().reshape(s.num_rows, -1)
                    near = q @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                    near[own[:, None] == cid[None, :]] = -np.inf
                    top = np.argpartition(-near, min(k, near.shape[1]) - 1, axis=1)[:, :k]
                    who, at = np.repeat(np.arange(len(q)), top.shape[1]), top.ravel()
                    deep = np.zeros(len(who), np.int64)
                    for level in range(1, total + 1):
                        cut = bits * (total - level)
                        deep += ((code[who] >> cut) == (have[at] >> cut)).any(axis=1)
                    best = tuple(np.concatenate(z) for z in zip(best, (who, near[who, at], deep)))
                    order = np.lexsort((-best[1], best[0]))
                    rank = np.arange(len(order)) - np.searchsorted(best[0][order], best[0][order])
                    best = tuple(z[order[rank < k]] for z in best)
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in best], names=["probe", "score", "deep"])

        true = map_batches(self.index.select("v", "cid", "codes"), run, "probe long, score double, deep long")
        true = true.where(F.col("score") > float("-inf")).withColumn("tie", F.col("deep"))
        rows = _top(true, "probe", "tie", k).collect()       # at most k times the sample
        counts = [{0: math.inf} | {x: r[f"n{x}"] for x in range(1, total + 1) if f"n{x}" in per.columns} for r in few]
        enough = 500
        while rows:
            level = [max(x for x, n in c.items() if n >= enough) for c in counts]
            if sum(r["deep"] >= level[r["probe"]] for r in rows) >= self.recall * len(rows):
                break
            enough = int(enough * 1.5)
        return enough

    def search(self, queries: Column) -> DataFrame:
        """query_id, rank, vec_id, score for the rows whose ``vec_id`` meets
        the condition."""
        schema = "query_id long, rank int, vec_id long, score double"
        spark = self.rows.sparkSession
        if not self.dims:
            return spark.createDataFrame([], schema)
        bits, depth, total = self.bits, self.depth, self.symbols
        asked = self.rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
        asked = stored(asked.join(self.index, F.col("qv") == F.col("v")).select("query_id", "cid"), "forest-asked")
        probes = stored(asked.select("cid").distinct().join(self.index, "cid").select("cid", "v", "codes"), "forest-probes")

        tree = lambda df, *c: df.select(*c, F.posexplode("codes").alias("tree", "code"))
        bucket = _prefix(F.col("code"), bits * (total - depth))
        sizes = stored(tree(self.index).groupBy("tree", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
                       .withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int")), "forest-buckets")
        group = F.xxhash64("tree", "bucket", "chunk", "part")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))      # noqa: E731

        def parted(sent: DataFrame, name: str) -> DataFrame:
            """The buckets that get probes, and into how many parts these are cut."""
            asks = sent.groupBy("tree", "bucket").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
            return stored(sizes.join(asks, ["tree", "bucket"]), name)

        def rows_of(to: DataFrame, *columns: str) -> DataFrame:
            """Each row in one chunk of its bucket in every tree, once a part."""
            rows = tree(self.index, "cid", *columns).withColumn("bucket", bucket).join(to, ["tree", "bucket"])
            return rows.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).withColumn("part", each("parts"))

        def probes_of(sent: DataFrame, to: DataFrame) -> DataFrame:
            """Each probe in one part, once a chunk."""
            rows = sent.join(to, ["tree", "bucket"])
            return rows.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")).withColumn("chunk", each("chunks"))

        # how many rows each tree holds below each prefix of the query's string, summed over the trees
        sent = tree(probes, "cid").withColumn("bucket", bucket)
        to = parted(sent, "forest-asks")
        narrow = rows_of(to).select(group.alias("g"), "code", F.lit(None).cast("long").alias("probe"))
        near = probes_of(sent, to).select(group.alias("g"), "code", F.col("cid").alias("probe"))
        levels = list(range(depth, total + 1))

        def count(t: pa.Table):
            probe = t.column("probe")
            ask = np.asarray(probe.is_valid())
            if not ask.any():
                return
            code = t.column("code").to_numpy()
            have, want = np.sort(code[~ask]), code[ask]
            found = [np.searchsorted(have, ((want >> s) + 1) << s) - np.searchsorted(have, (want >> s) << s)
                     for s in (bits * (total - x) for x in levels)]
            own = probe.combine_chunks().filter(pa.array(ask))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(f.astype(np.int64)) for f in found)],
                                             names=["cid", *(f"n{x}" for x in levels)])

        counted = grouped_map(narrow.unionByName(near), "g", count, fields(", ".join(["cid long", *(f"n{x} long" for x in levels)])))
        per = counted.groupBy("cid").agg(*[F.sum(f"n{x}").alias(f"n{x}") for x in levels])
        for x in range(1, depth):       # prefixes shorter than the buckets'
            short = sizes.groupBy("tree", _prefix(F.col("bucket"), bits * (depth - x)).alias("p")).agg(F.sum("n").alias("n"))
            up = (tree(probes, "cid").withColumn("p", _prefix(F.col("code"), bits * (total - x))).join(short, ["tree", "p"])
                  .groupBy("cid").agg(F.sum("n").alias(f"n{x}")))
            per = per.join(up, "cid")
        per = stored(per, "forest-counts")
        enough = self._enough(probes, per)
        level = F.coalesce(*[F.when(F.col(f"n{x}") >= enough, F.lit(x)) for x in range(total, 0, -1) if f"n{x}" in per.columns], F.lit(0))
        levelled = stored(probes.join(per.select("cid", level.alias("level")), "cid"), "forest-levels")

        # every row below the chosen prefix is scored
        sent = tree(levelled.where(F.col("level") >= max(depth, 1)), "cid", "v", "level").withColumn("bucket", bucket)
        for x in range(depth):          # a prefix shorter than the buckets' is several buckets, the empty one all of one tree
            above, below = levelled.where(F.col("level") == x), sizes.select("tree", "bucket")
            above = tree(above, "cid", "v", "level").withColumn("p", _prefix(F.col("code"), bits * (total - x)))
            below = below.withColumn("p", _prefix(F.col("bucket"), bits * (depth - x)))
            sent = sent.unionByName((above if x else above.where("tree = 0")).join(below, ["tree", "p"]).drop("p"))
        if not depth:                   # one bucket a tree, all rows
            sent = sent.unionByName(tree(levelled.where("level = 0"), "cid", "v", "level").where("tree = 0").withColumn("bucket", bucket))
        to = parted(sent, "forest-sent")
        asks = probes_of(sent, to).select(group.alias("g"), "code", "v", F.lit(None).cast("long").alias("cid"), F.col("cid").alias("probe"), "level")
        both = asks.unionByName(rows_of(to, "v").select(group.alias("g"), "code", "v", "cid", F.lit(None).cast("long").alias("probe"),
                                                        F.lit(None).cast("int").alias("level")))
        keep = self.k + 1

        def score(t: pa.Table):
            ask = np.asarray(t.column("probe").is_valid())
            if not ask.any() or ask.all():
                return
            code = t.column("code").to_numpy()
            at = np.flatnonzero(~ask)
            at = at[np.argsort(code[at], kind="stable")]
            have, cid = code[at], t.column("cid").to_numpy()[at].astype(np.int64)
            x = scaled(_matrix(t.column("v"), at).astype(np.float64))
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            who = np.flatnonzero(ask)
            q = scaled(_matrix(t.column("v"), who).astype(np.float64))
            shift = bits * (total - t.column("level").to_numpy()[who].astype(np.int64))
            want = code[who]
            lo = np.searchsorted(have, (want >> shift) << shift)
            hi = np.searchsorted(have, ((want >> shift) + 1) << shift)
            probe = t.column("probe").to_numpy()[who].astype(np.int64)
            out = ([], [], [])
            for i in range(len(who)):
                a, b = int(lo[i]), int(hi[i])
                if a == b:
                    continue
                rough = (x[a:b] @ q[i]) / norm[a:b]
                if b - a > 4 * keep:
                    edge = np.partition(rough, b - a - keep)[b - a - keep]
                    pick = np.flatnonzero(rough >= edge - 1e-9 * abs(edge) - 1e-12) + a
                else:
                    pick = np.arange(a, b)
                exact = np.array([float(np.dot(x[j], q[i])) for j in pick]) / (norm[pick] * math.sqrt(float(np.dot(q[i], q[i]))))
                best = np.lexsort((cid[pick], -exact))[:keep]
                out[0].append(np.full(len(best), probe[i]))
                out[1].append(cid[pick][best])
                out[2].append(exact[best])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["probe", "cid", "score"])

        found = grouped_map(both, "g", score, fields("probe long, cid long, score double"))
        best = stored(_top(found.groupBy("probe", "cid").agg(F.max("score").alias("score")), "probe", "cid", keep), "forest-found")
        named = best.join(self.index.select("cid", "ids"), "cid").select("probe", F.explode("ids").alias("vec_id"), "score")
        pairs = asked.join(named, asked["cid"] == named["probe"]).where("query_id <> vec_id").select("query_id", "vec_id", "score")
        return _top(pairs, "query_id", "vec_id", self.k).select("query_id", "rank", "vec_id", "score")


def _top(pairs: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("score"), tie)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """Query view: the nearest ``k`` of each row whose id ``every`` divides."""
    return Forest(vectors, k).search(F.col("vec_id") % every == 0)
