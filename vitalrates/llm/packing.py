"""Best-fit packing of token sequences by a configuration linear program.

Rows matter only by their length, so the problem is its histogram (at most
``capacity`` numbers, counted by Spark). A configuration is a multiset of
lengths that fits one sequence. The covering program (fewest configurations
such that every length is covered as often as it occurs) is solved by
multiplicative weights: a round prices all lengths, a knapsack dynamic
program finds the configurations of highest price, all within a small factor
of the best are taken a step, and the weights of what they cover shrink.
Rounding takes each configuration its rounded number of times, never beyond
what is left; the rest is placed best fit, longest first, again by counts.
Rows then find their place from their rank within their length: the rank is a
running number per task plus the tasks' offsets, so no length gathers its rows
in one place.

Defined cases: null text counts as empty; an empty text is the end id alone;
equal rows and ties are placed in any order; rows whose length is null, below
1 or above the capacity get null placements; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalrates.llm.common import fields, gathered, map_batches, shared_path, slices, stored, unpack, whole_row
from vitalrates.llm.tokenfile import _filesystem
from vitalrates.llm.tokens import encoder

Pattern = tuple[tuple[int, int], ...]


def price(size: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack with repeats: highest worth per capacity, and the item taken
    last there (-1: none, nothing fits). ``size`` is ascending. Capacities the
    last item leaves are looked up in one step, so rows are worked off in
    blocks as wide as the smallest item."""
    best, item = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    wide = int(size[0])
    for c in range(wide, capacity + 1, wide):
        top = np.arange(c, min(c + wide, capacity + 1))
        k = int(np.searchsorted(size, top[-1], side="right"))
        rest = top[None, :] - size[:k, None]
        v = np.where(rest >= 0, best[np.maximum(rest, 0)] + worth[:k, None], -1.0)
        i = v.argmax(axis=0)
        best[top], item[top] = v[i, np.arange(len(top))], i
    return best, item


def taken(item: list[int], size: list[int], c: int) -> Iterator[int]:
    while c >= size[0]:
        yield item[c]
        c -= size[item[c]]


def configurations(histogram: dict[int, int], capacity: int, rounds: int = 24, near: float = 0.02,
                   step: float = 0.25) -> dict[Pattern, float]:
    """Fractional solution: configuration → times, by multiplicative weights."""
    size = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(s)] for s in size], float)
    weight, cover = size / capacity, np.zeros(len(size))
    x: dict[Pattern, float] = {}
    for _ in range(rounds if len(size) else 0):
        best, item = price(size, weight, capacity)
        value = weight + best[capacity - size]
        gained, last, sizes = np.zeros(len(size)), item.tolist(), size.tolist()
        for i in np.argsort(cover, kind="stable"):
            if value[i] < (1 - near) * best[capacity] or gained[i] >= step:
                continue
            count: dict[int, int] = {int(i): 1}
            for k in taken(last, sizes, capacity - sizes[i]):
                count[k] = count.get(k, 0) + 1
            if any(a > need[k] for k, a in count.items()):
                continue
            times = step * min(need[k] / a for k, a in count.items())
            key = tuple(sorted((int(size[k]), a) for k, a in count.items()))
            x[key] = x.get(key, 0.0) + times
            for k, a in count.items():
                gained[k] += times * a / need[k]
        if not gained.any():
            near = min(1.0, near * 4)
        cover += gained
        weight = weight * np.exp(-step * gained / 4)
        weight /= (weight * need).sum() / (size / capacity * need).sum()
    full = np.average(cover, weights=need * size) if len(size) else 1.0
    return {p: t / max(full, 1e-9) for p, t in x.items()}


def plan(histogram: dict[int, int], capacity: int, shares: tuple[float, ...] = (1.0, 0.9, 0.6, 0.3),
         **lp) -> list[tuple[Pattern, int]]:
    """Integer configurations and how often each is used; together they hold
    exactly the lengths of the histogram. Lengths below a 64th of the capacity
    stay out of the program and fill gaps by best fit. It is solved once and
    rounded at several shares of its solution; the fewest sequences win."""
    left = dict(histogram)
    whole = [(((capacity, 1),), left.pop(capacity))] if left.get(capacity) else []
    x = configurations({s: n for s, n in left.items() if s >= capacity / 64}, capacity, **lp)
    tries = [rounded(x, left, capacity, s, s == shares[0]) for s in (shares if x else shares[:1])]
    return whole + min(tries, key=lambda u: sum(m for _, m in u))


def rounded(x: dict[Pattern, float], histogram: dict[int, int], capacity: int, share: float,
            up: bool) -> list[tuple[Pattern, int]]:
    """Each configuration its share of times, rounded up or down, fullest
    first, as far as the lengths last; what is left is placed best fit."""
    left, out = dict(histogram), []
    for p in sorted(x, key=lambda p: (-sum(s * a for s, a in p), -x[p], p)):
        m = min([left[s] // a for s, a in p] + [-int(-x[p] * share // 1) if up else int(x[p] * share)])
        if m > 0:
            out.append((p, m))
            for s, a in p:
                left[s] -= a * m
    return out + best_fit({s: n for s, n in left.items() if n}, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, on counts: equal sequences stay one group."""
    groups: dict[int, list[tuple[Pattern, int]]] = {capacity: []}
    rooms = [capacity]

    def put(room: int, p: Pattern, m: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((p, m))

    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        at = bisect_left(rooms, s)
        while n:
            while at < len(rooms) and not groups[rooms[at]] and rooms[at] != capacity:
                del groups[rooms[at]], rooms[at]
            room = rooms[at]
            p, m = groups[room].pop() if groups[room] else ((), n)
            each = min(room // s, n)
            use = min(m, n // each)
            if use < m and p:
                put(room, p, m - use)
            put(room - each * s, (*p, (s, each)), use)
            n -= use * each
            at = bisect_left(rooms, s)
    return [(p, m) for g in groups.values() for p, m in g if p]


def slots(used: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For each length in ascending order, the ranges of ranks that each
    configuration takes: first rank, copies per sequence, first sequence and
    place in it."""
    rows, first = [], 0
    for p, m in used:
        at = 0
        for s, a in p:
            rows.append((s, m * a, a, first, at))
            at += s * a
        first += m
    rows.sort(key=lambda r: (r[0], r[3]))
    t = np.array(rows, np.int64).reshape(-1, 5)
    begin = np.zeros(len(t), np.int64)
    for i in range(1, len(t)):
        begin[i] = begin[i - 1] + t[i - 1, 1] if t[i, 0] == t[i - 1, 0] else 0
    return {"length": t[:, 0], "begin": begin, "ends": begin + t[:, 1], "copies": t[:, 2], "sequence": t[:, 3],
            "offset": t[:, 4]}


def ranked(batches: Iterator[pa.RecordBatch], at: int, capacity: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Appends the task's number and each row's rank among its task's rows of
    the same length (column ``at``)."""
    from pyspark import TaskContext
    part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    for b in batches:
        for s in slices(b, None):
            size = s.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.where((size < 1) | (size > capacity), 0, size)
            order = np.argsort(size, kind="stable")
            by, n = size[order], np.bincount(size, minlength=capacity + 1)
            rank = np.empty(len(size), np.int64)
            rank[order] = np.arange(len(size)) - (np.cumsum(n) - n)[by] + seen[by]
            seen += n
            yield pa.RecordBatch.from_arrays(
                [*s.columns, pa.array(np.full(len(size), part, np.int32)), pa.array(rank)], names=names)


RANK = fields("_part int, _rank long").fields
#: tasks whose numbers share one folder of offsets
PARTS = 32


def numbered(df: DataFrame, capacity: int, length: str = "length") -> DataFrame:
    """Adds the task's number and the row's rank among its task's rows of the
    same length. Store the result before reading it twice."""
    schema, at = T.StructType(df.schema.fields + RANK), df.columns.index(length)
    return map_batches(df, lambda batches: ranked(batches, at, capacity, schema.names), schema)


def pack(df: DataFrame, capacity: int = 4096, length: str = "length", **lp) -> DataFrame:
    """The rows of ``df`` with ``sequence_id`` and ``offset``, placed into few
    sequences of at most ``capacity``; each is gapless from offset 0. Columns
    of these two names in the input are replaced."""
    size = F.col(f"`{length}`").cast("long")
    rows = df.select(whole_row(df), F.when(size.between(1, capacity), size).alias("_len"))
    out = placed(stored(numbered(rows, capacity, "_len"), "pack"), capacity, **lp)
    return out.select(*unpack(df, [c for c in df.columns if c not in ("sequence_id", "offset")]), "sequence_id", "offset")


def placed(rows: DataFrame, capacity: int, length: str = "_len", **lp) -> DataFrame:
    """Stored, numbered rows with their places. The rows do not move: how many
    rows of each length earlier tasks hold is written to shared storage by
    task, and a task reads what concerns the rows it meets."""
    spark = rows.sparkSession
    per = rows.where(F.col(length).isNotNull()).groupBy(F.col(length).alias("_len"), "_part").agg(F.count(F.lit(1)).alias("_n"))
    per = stored(per, "pack-parts")
    w = Window.partitionBy("_len").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_len", "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"),
                        F.floor(F.col("_part") / PARTS).alias("_folder"))
    folder = shared_path(spark, "pack-offsets")
    before.repartition("_folder").sortWithinPartitions("_folder", "_part", "_len").write.partitionBy("_folder").parquet(folder)
    histogram = {int(r[0]): int(r[1]) for r in per.groupBy("_len").agg(F.sum("_n")).collect()}
    spread = spark.sparkContext.broadcast(slots(plan(histogram, capacity, **lp)))   # bounded by the capacity
    keep = [i for i, c in enumerate(rows.columns) if c not in ("_len", "_part", "_rank")]
    schema = T.StructType([rows.schema.fields[i] for i in keep] + fields("sequence_id long, offset long").fields)

    def run(batches):
        t, earlier = spread.value, Earlier(folder, capacity)
        wide = 1 + int(max([*t["ends"], 0]))
        first = t["length"] * wide + t["begin"]      # ascending
        for b in batches:
            for s in slices(b, None):
                none = np.asarray(s.column(length).is_null())
                rank, of, part = (s.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                                  for c in ("_rank", length, "_part"))
                if len(first):
                    rank = np.where(none, 0, rank + earlier(part, of, ~none))
                    at = np.maximum(np.searchsorted(first, of * wide + rank, side="right") - 1, 0)
                    k = rank - t["begin"][at]
                    seq, off = t["sequence"][at] + k // t["copies"][at], t["offset"][at] + (k % t["copies"][at]) * of
                else:
                    seq = off = np.zeros(len(rank), np.int64)
                yield pa.RecordBatch.from_arrays([*(s.column(i) for i in keep), pa.array(seq, mask=none), pa.array(off, mask=none)],
                                                 names=schema.names)

    return map_batches(rows, run, schema)


class Earlier:
    """Rows of a length in the tasks before a task, read from the folders that
    hold the tasks met; one folder is kept."""

    def __init__(self, folder: str, capacity: int):
        self.system, self.root = _filesystem(folder)
        self.wide, self.folder = capacity + 1, None

    def load(self, folder: int) -> None:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq
        files = [f.path for f in self.system.get_file_info(fs.FileSelector(f"{self.root}/_folder={folder}"))
                 if f.path.endswith(".parquet")]
        t = pa.concat_tables([pq.ParquetFile(self.system.open_input_file(f)).read() for f in files])
        key = t.column("_part").to_numpy().astype(np.int64) * self.wide + t.column("_len").to_numpy()
        order = np.argsort(key)
        self.key, self.before, self.folder = key[order], t.column("_before").to_numpy()[order], folder

    def __call__(self, part: np.ndarray, size: np.ndarray, use: np.ndarray) -> np.ndarray:
        out = np.zeros(len(part), np.int64)
        for folder in np.unique(part[use] // PARTS).tolist():
            if folder != self.folder:
                self.load(folder)
            own = use & (part // PARTS == folder)
            out[own] = self.before[np.searchsorted(self.key, part[own] * self.wide + size[own])]
        return out


def cut(docs: DataFrame, path: str, end: int = 1, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text",
        digest: bool = False) -> DataFrame:
    """Whole texts as ids and the end id, cut into pieces of ``capacity``, in
    one pass and numbered for packing: the document's id, piece, start, length,
    ids (binary; ``digest``: their crc32 instead), the task and the rank."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    kind = "ids_crc32 long" if digest else "ids binary"
    schema = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType),
                           *fields(f"piece int, start long, length long, {kind}").fields])

    def run(batches):
        enc = encoder(path)
        last = end.to_bytes(4, "little")
        for b in gathered(batches, 1):
            for s in slices(b, 1, 16 << 20):
                ids, bound = enc.encode(s.column(1))
                row, piece, blob, size = [], [], [], []
                for i, (a, z) in enumerate(zip(bound.tolist(), bound.tolist()[1:])):
                    own = ids[a:z].astype("<u4").tobytes() + last
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[at:at + 4 * capacity]
                        row.append(i)
                        piece.append(k)
                        blob.append(zlib.crc32(part) if digest else part)
                        size.append(len(part) // 4)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                     pa.array([k * capacity for k in piece], pa.int64()), pa.array(size, pa.int64()),
                     pa.array(blob, pa.int64() if digest else pa.binary())], names=schema.names)

    whole = T.StructType(schema.fields + RANK)
    return map_batches(src, lambda batches: ranked(run(batches), 3, capacity, whole.names), whole)


def packed_texts(docs: DataFrame, path: str, capacity: int = 4096, digest: bool = False) -> DataFrame:
    """Every piece with its ids and its place in the packed sequences. One
    Python pass writes the pieces, one reads them and adds the places."""
    return placed(stored(cut(docs, path, capacity=capacity, digest=digest), "pieces"), capacity, "length")


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Query view: a digest of each piece's ids and its place."""
    return packed_texts(docs, path, digest=True)
