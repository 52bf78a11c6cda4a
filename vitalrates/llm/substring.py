"""Removal of long repeats across documents by recompression.

A text is a string of word names (hashes, so equal words have one name
everywhere). Rounds shorten it: a run round names maximal runs of one symbol,
a pair round splits all symbols by a hash bit into left and right ones and
names every adjacent (left, right) pair. Both depend on the symbols alone, so
equal substrings get the same symbols inside, whatever stands around them;
only symbols at the ends can differ. Those are exactly known: a run round may
change the first and last run of a window, a pair round a first symbol that is
a right one and a last symbol that is a left one. What is left after dropping
them is the window's interior, and its first symbol at the highest level that
has any is the window's anchor. Equal windows have equal anchors, always.

So windows can only be equal where anchors are. Consecutive windows with one
anchor form a block. Spark counts anchors over all documents; blocks whose
anchor occurs in one document only are done. Of the others, blocks that are
equal as a whole to one in an earlier document are covered; only where an
anchor has several different blocks are their windows compared one by one,
and only for the first document of each block. Every comparison of contents
is by two 64-bit names (anchor and polynomial hash of the words).

Defined cases: null text has no words; texts shorter than a window lose
nothing; windows within one document do not repeat each other; a null document
id is later than any other; rows with equal document id are not smaller than
each other; equal rows get equal results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalrates.llm.common import ROW, fields, map_batches, slices, stored, unpack, whole_row
from vitalrates.llm.words import words

#: rounds; those that also name runs; longest symbol in words
ROUNDS, RUN_ROUNDS, LONGEST = 8, (0,), 40
_M1, _M2, _ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
LAST = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def salt(k: int) -> np.uint64:
    return np.uint64(k * int(_ODD) & 0xFFFFFFFFFFFFFFFF)


def named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of symbols."""
    return mix(mix(a) + (b * _ODD ^ (b >> np.uint64(29))))


class Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            inverse = pow(_BASE, -1, 1 << 64)
            one = [np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]) for b in (_BASE, inverse)]
            self.up, self.down = (np.cumprod(x, dtype=np.uint64) for x in one)


_POWERS = Powers()


class Names:
    """Word names of a slice of texts and hashes of any range of them."""

    def __init__(self, texts: pa.Array):
        import xxhash
        own, self.count = words(texts)
        coded = own.dictionary_encode()
        digest = xxhash.xxh3_64_intdigest
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        name = np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct))
        self.name = name[np.asarray(coded.indices)] if len(own) else np.zeros(0, np.uint64)
        self.at = np.concatenate([[0], np.cumsum(self.count)])
        _POWERS.grow(len(self.name) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64),
                                    np.cumsum(mix(self.name) * _POWERS.up[:len(self.name)], dtype=np.uint64)])

    def digest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words from a to b (not included), by content alone."""
        return mix((self.sums[b] - self.sums[a]) * _POWERS.down[a] + (b - a).astype(np.uint64) * _ODD)


def anchors(name: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, and each window's anchor: place and name."""
    n = len(name)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    begin = np.flatnonzero(np.arange(n) + window <= at[1:][doc])
    place, key = begin.copy(), name[begin]
    live, lo, hi = np.arange(len(begin)), begin.copy(), begin + window
    start, own = np.arange(n), name.copy()

    def index() -> np.ndarray:
        flag = np.zeros(n, np.int32)
        flag[start] = 1
        return np.cumsum(flag, dtype=np.int32) - 1

    def shorten(level: int) -> None:
        nonlocal live, lo, hi
        ok = lo < hi
        if not ok.all():
            live, lo, hi = live[ok], lo[ok], hi[ok]
        place[live] = lo
        key[live] = own[index_of[lo]] + salt(level)

    index_of = index()
    for t in range(ROUNDS if len(begin) else 0):
        if t in RUN_ROUNDS:
            same = (own[1:] == own[:-1]) & (doc[start[1:]] == doc[start[:-1]])
            head = np.concatenate([[True], ~same])
            first, run = np.flatnonzero(head), np.cumsum(head) - 1
            run_at = np.append(start[first], n)
            a, b = run[index_of[lo]], run[index_of[hi - 1]]
            lo = np.minimum(run_at[a + 1], hi)
            hi = np.maximum(run_at[b], lo)
            k = np.diff(np.append(first, len(own)))
            joined = (k > 1) & (run_at[1:] - run_at[:-1] <= LONGEST)
            own[first[joined]] = named(own[first[joined]], k[joined].astype(np.uint64))
            keep = head | ~joined[run]
            own, start = own[keep], start[keep]
            index_of = index()
            shorten(2 * t + 1)
        left = (mix(own + salt(2 * t + 1)) >> np.uint64(63)).astype(bool)
        size = np.diff(np.append(start, n))
        a, b = index_of[lo], index_of[hi - 1]
        lo = np.where(~left[a] & (size[a] < LONGEST), lo + size[a], lo)
        hi = np.maximum(np.where(left[b] & (size[b] < LONGEST), hi - size[b], hi), lo)
        pair = left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= LONGEST) & (doc[start[1:]] == doc[start[:-1]])
        p = np.flatnonzero(pair)
        own[p] = named(own[p], own[p + 1])
        keep = np.ones(len(own), bool)
        keep[p + 1] = False
        own, start = own[keep], start[keep]
        index_of = index()
        shorten(2 * t + 2)
    return begin, place, key


def blocks(names: Names, window: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of one document with one anchor: document,
    first window in it, windows, anchor name, hash of all their words."""
    begin, place, key = anchors(names.name, names.at, window)
    if not len(begin):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    new = np.concatenate([[True], (np.diff(begin) != 1) | (place[1:] != place[:-1]) | (key[1:] != key[:-1])])
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(begin)))
    a = begin[head]
    doc = np.searchsorted(names.at, a, side="right") - 1
    return doc, a - names.at[doc], many, key[head], names.digest(a, a + many + window - 1)


def _row_key(docs: DataFrame, doc_id: str, text: str) -> list[Column]:
    """Order of the document and hash of its text: equal for equal rows only."""
    return [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("th")]


def parsed(docs: DataFrame, window: int, doc_id: str, text: str) -> DataFrame:
    """A row per block and, with ``key`` null, one per document (``place``: its
    words, ``digest``: SHA-256 of all its words)."""
    src = docs.select(*_row_key(docs, doc_id, text), F.col(f"`{text}`").alias("_text"))
    schema = fields("doc long, th long, place long, many int, key long, hash long, digest string")

    def run(batches):
        for b in batches:
            for s in slices(b, 2, 2 << 20):
                names = Names(s.column(2))
                doc, at, many, key, h = blocks(names, window)
                n = s.num_rows
                whole = [hashlib.sha256(b" ".join((x or "").encode().split())).hexdigest() for x in s.column(2).to_pylist()]
                of = pa.array(np.concatenate([doc, np.arange(n)]))
                none = np.concatenate([np.zeros(len(doc), bool), np.ones(n, bool)])
                zero = np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(of), s.column(1).take(of), pa.array(np.concatenate([at, names.count])),
                     pa.array(np.concatenate([many, zero]).astype(np.int32)),
                     pa.array(np.concatenate([key.view(np.int64), zero]), mask=none),
                     pa.array(np.concatenate([h.view(np.int64), zero]), mask=none),
                     pa.array([None] * len(doc) + whole, pa.string())], names=schema.names)

    return map_batches(src, run, schema)


def _packed_texts(docs: DataFrame, doc_id: str, text: str, keep: list[Column]) -> DataFrame:
    """Texts as zstandard frames: they are shuffled at a third of their size."""
    src = docs.select(*keep, *_row_key(docs, doc_id, text), F.col(f"`{text}`").alias("_text"))
    schema = T.StructType(src.schema.fields[:-1] + fields("packed binary").fields)
    k = len(src.columns) - 1

    def run(batches):
        import zstandard
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [None if t is None else zip_.compress(t.encode()) for t in b.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(z, pa.binary())], names=schema.names)

    return map_batches(src, run, schema)


def _unpacked(column: pa.Array) -> pa.Array:
    import zstandard
    unzip = zstandard.ZstdDecompressor()
    return pa.array([None if z is None else unzip.decompress(z).decode() for z in column.to_pylist()], pa.string())


def _windows(texts: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """A row per window of the wanted blocks: doc, th, key, place, hash."""
    per = wanted.groupBy("doc", "th").agg(F.collect_set(F.struct("place", "many", "key")).alias("own"))   # one document's
    both = texts.join(per, ["doc", "th"]).select("doc", "th", "own", "packed").dropDuplicates(["doc", "th"])
    schema = fields("doc long, th long, key long, place long, hash long")

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                names = Names(_unpacked(s.column(3)))
                own = s.column(2)
                size = np.diff(own.offsets.to_numpy())
                flat = own.flatten()
                place, many = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                of = np.repeat(np.arange(s.num_rows), size)
                each = np.repeat(np.arange(len(place)), many)
                step = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
                at = place[each] + step
                begin = names.at[of[each]] + at
                rows = pa.array(of[each])
                yield pa.RecordBatch.from_arrays(
                    [s.column(0).take(rows), s.column(1).take(rows), flat.field(2).take(pa.array(each)), pa.array(at),
                     pa.array(names.digest(begin, begin + window).view(np.int64))], names=schema.names)

    return map_batches(both, run, schema)


def repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stored tables: every document row (doc, th, n_words, digest), and the
    repeated windows as ranges (doc, th, place, many)."""
    rows = stored(parsed(docs, window, doc_id, text), "repeat-blocks")
    own = rows.where("key is not null").select("doc", "th", "place", "many", "key", "hash")
    shared = stored(own.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key"),
                    "repeat-anchors")
    common = stored(own.join(shared, "key"), "repeat-common")
    first = stored(common.groupBy("key", "hash").agg(F.min("doc").alias("first")), "repeat-first")
    several = stored(first.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeat-several")
    placed = stored(common.join(first, ["key", "hash"]), "repeat-placed")
    whole = placed.where("doc > first").select("doc", "th", "place", "many")
    wanted = placed.where("doc = first").join(several, "key").select("doc", "th", "place", "many", "key")
    texts = _packed_texts(docs, doc_id, text, [])
    single = stored(_windows(texts, wanted, window), "repeat-windows")
    least = stored(single.groupBy("key", "hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                   .where("first < last").select("key", "hash", "first"), "repeat-least")
    later = (single.join(least, ["key", "hash"]).where("doc > first")
             .select("doc", "th", "place", F.lit(1).alias("many")))
    ranges = stored(whole.union(later), "repeat-ranges")
    return rows.where("key is null").select("doc", "th", F.col("place").alias("n_words"), "digest"), ranges


def trimmed(docs: DataFrame, ranges: DataFrame, window: int, keep: list[Column], doc_id: str, text: str) -> DataFrame:
    """Rows that lose words: the kept columns, doc, th, n_words, n_removed and
    the kept words joined by single blanks."""
    per = ranges.groupBy("doc", "th").agg(F.collect_set(F.struct("place", "many")).alias("own"))   # one document's
    src = _packed_texts(docs, doc_id, text, keep).join(per, ["doc", "th"])
    src = src.select(*[c for c in src.columns if c not in ("own", "packed")], "own", "packed")
    k = len(src.columns) - 2
    schema = T.StructType(src.schema.fields[:k] + fields("n_words long, n_removed long, kept string").fields)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                s = b.slice(i, 256)
                count, gone, out = [], [], []
                for t, own in zip(_unpacked(s.column(k + 1)).to_pylist(), s.column(k), strict=True):
                    w = t.encode().split()
                    place, many = (own.values.field(j).to_numpy(zero_copy_only=False).astype(np.int64) for j in (0, 1))
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + many - 1 + window, -1)
                    stay = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    count.append(len(w))
                    gone.append(len(w) - len(stay))
                    out.append(b" ".join([w[j] for j in stay.tolist()]).decode())
                yield pa.RecordBatch.from_arrays([*s.columns[:k], pa.array(count, pa.int64()), pa.array(gone, pa.int64()),
                                                  pa.array(out, pa.string())], names=schema.names)

    return map_batches(src, run, schema)


def substring_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """Query view: words, removed words and digest of the kept ones."""
    every, ranges = repeats(docs, window)
    cut = trimmed(docs.select("doc_id", "text"), ranges, window, [F.col("doc_id")], "doc_id", "text")
    cut = cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    touched = ranges.select("doc", "th").distinct()
    rest = every.join(touched, ["doc", "th"], "left_anti")
    null_last = F.when(F.col("doc") != LAST, F.col("doc"))
    return rest.select(null_last.alias("doc_id"), "n_words", F.lit(0).cast("long").alias("n_removed"),
                       F.col("digest").alias("kept_sha256")).union(cut.select(F.col("doc_id").cast("long"), "n_words", "n_removed", "kept_sha256"))


def remove_repeats(docs: DataFrame, window: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without repeated windows: a text that loses words is its
    kept words joined by single blanks, any other stays as it is; ``n_chars``
    follows the text."""
    _, ranges = repeats(docs, window, doc_id, text)
    cut = trimmed(docs, ranges, window, [whole_row(docs.drop(text))], doc_id, text)
    touched = ranges.select("doc", "th").distinct()
    same = docs.select(whole_row(docs), *_row_key(docs, doc_id, text)).join(touched, ["doc", "th"], "left_anti")
    new = []
    for c in docs.columns:
        old = F.col(f"{ROW}.`{c}`") if c != text else F.col("kept")
        new.append((F.char_length("kept").cast(docs.schema[c].dataType) if c == "n_chars" else old).alias(c))
    return same.select(*unpack(docs, docs.columns)).union(cut.select(*new))
