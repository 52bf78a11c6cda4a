"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, A to Z in
lower case, named by 96 bits of hash. A run is a table of distinct keys with
the number of documents that hold each and the largest document id, bucketed
and sorted by the hash. Documents arrive in batches, largest ids first. A
batch is grouped by key and merge-anti-joined with every run: a key that a run
already holds in enough documents, one of them larger than any here, is
settled and not stored again. What is left becomes a run of the lowest level;
when a level has ``fanout`` runs they are merged into one of the next. Runs
and batches are dealt by the same hash, so these merges move no run.

At the end the runs give the frequent keys. The few that hold at least one
``hot``-th of all lines (so at most ``hot`` keys, whatever the data) meet the
lines by broadcast; all others by a merge join, where no key has more than
that share of rows. Lines to drop gather per document as positions, and texts
are cut to the others. DataFrame functions only.

Defined cases: null and empty text are one empty line; rows of one id count as
one document, so none of them loses its lines to the others, and rows without
id count as no document and lose every frequent line; equal rows get equal
results; very long texts are split like any other; an empty table gives no
rows; other columns are kept, ``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalrates.llm.common import shared_path, unpack, whole_row

SPACES = "\x20\t\n\x0b\x0c\r"
KEY = ["h1", "h2"]


def low(text: Column) -> Column:
    """A to Z in lower case, nothing else."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def line_keys(docs: DataFrame, least: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line whose key has ``least`` code points: document (with a
    hash of the row's text, as ids may repeat), position, key."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(body).alias("th"),
                       F.posexplode(F.split(low(body), "\n", -1)).alias("pos", "line"))
    rows = rows.select("doc", "th", "pos", F.btrim("line", F.lit(SPACES)).alias("line")).where(F.char_length("line") >= least)
    return rows.select("doc", "th", "pos", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


class LineRuns:
    """Levelled sorted runs ``h1, h2, n, top`` on shared storage. A document
    (all its lines) belongs to one batch."""

    def __init__(self, spark: SparkSession, copies: int = 3, fanout: int = 2, buckets: int | None = None):
        self.spark, self.copies, self.fanout = spark, copies, max(2, fanout)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.read.table(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        (rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
         .option("path", shared_path(self.spark, "line-run")).saveAsTable(name))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """The batch's keys that no run has settled, with documents and largest id."""
        own = lines.groupBy(*KEY).agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("top")).where("n > 0")
        for run in self.runs():
            done = run.where(F.col("n") >= self.copies).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"), F.col("top").alias("r_top"))
            same = (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")) & (F.col("r_top") >= F.col("top"))
            own = own.join(done.hint("merge"), same, "left_anti")
        return own

    def add(self, lines: DataFrame) -> None:
        """Add a batch (``doc, h1, h2``) as a run; full levels are merged."""
        self._write(self.unsettled(lines), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names = self.levels[level]
            self._write(self.merged([self.spark.read.table(n) for n in names]), level + 1)
            self.levels[level] = []
            for n in names:
                self.spark.sql(f"DROP TABLE {n}")
            level += 1

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """Merge of sorted runs: documents add up, the largest id stays."""
        out = runs[0]
        for run in runs[1:]:
            other = run.select(*KEY, F.col("n").alias("n2"), F.col("top").alias("top2")).hint("merge")
            out = out.join(other, KEY, "full_outer").select(
                *KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n"), F.greatest("top", "top2").alias("top"))
        return out

    def frequent(self) -> DataFrame:
        """Keys held by enough documents: ``h1, h2, n, top``."""
        return self.merged(self.runs()).where(F.col("n") >= self.copies)


def lines_to_drop(lines: DataFrame, frequent: DataFrame, hot: int = 10_000) -> DataFrame:
    """Positions to drop per row of a document: ``doc, th, gone``. ``hot``
    bounds the keys that are broadcast: at most so many can each hold a
    ``hot``-th of all lines."""
    share = max(1, -(-lines.count() // hot))
    often = F.broadcast(frequent.where(F.col("n") >= share).select(*KEY, "top"))
    rest = frequent.where(F.col("n") < share).select(*KEY, "top").hint("merge")
    gone = lines.join(often, KEY).unionByName(lines.join(often.drop("top"), KEY, "left_anti").join(rest, KEY))
    gone = gone.where(~F.col("doc").eqNullSafe(F.col("top")))
    return gone.groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))


def deduplicated(docs: DataFrame, least: int = 20, copies: int = 3, batches: int = 4, fanout: int = 2, hot: int = 10_000,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without lines that ``copies`` documents hold,
    except in the largest document that holds them, and ``n_lines`` (before),
    ``n_dropped``."""
    spark, doc = docs.sparkSession, F.col(f"`{doc_id}`")
    # cuts[0] is null for a table without ids; then all is one batch
    cuts = docs.agg(F.percentile_approx(doc, [i / batches for i in range(batches - 1, 0, -1)])).first()[0] if batches > 1 else None
    number = F.lit(batches - 1)
    for i, at in reversed(list(enumerate(cuts or []))):
        number = F.when(F.col("doc") > F.lit(at), i).otherwise(number)
    path = shared_path(spark, "lines")
    keys = line_keys(docs, least, doc_id, text).withColumn("batch", number)
    keys.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(keys.schema).parquet(path)
    runs = LineRuns(spark, copies, fanout)
    for i in range(batches):
        runs.add(lines.where(F.col("batch") == i))
    gone = lines_to_drop(lines.drop("batch"), runs.frequent(), hot)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = whole_row(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text]))
    # the text travels as its lines, so that none is split again for each line kept
    left = docs.select(row, doc.alias("doc"), F.xxhash64(body).alias("th"), F.col(f"`{text}`").isNull().alias("none"),
                       F.split(body, "\n", -1).alias("lines"))
    right = gone.select(F.col("doc").alias("doc2"), F.col("th").alias("th2"), "gone").hint("shuffle_hash")
    j = left.join(right, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("th") == F.col("th2")), "left")
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    cut = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(keep, lambda i: F.get("lines", i)))
    other = [c for c in docs.columns if c not in (text, "n_lines", "n_dropped")]
    return j.select(*unpack(docs, other), F.when(~F.col("none"), F.array_join(cut, "\n")).alias(text),
                    F.size("lines").cast("long").alias("n_lines"),
                    F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """Query view: a digest of what is left of each text."""
    out = deduplicated(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
