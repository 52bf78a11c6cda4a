"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set when it is set in over half of the 64-bit hashes
of the text's word shingles. Equal fingerprints are one entry. Two
fingerprints at most ``bits`` apart differ, in one of two 32-bit segments, by
no more than half of it: every entry is stored under both its segments, and
probes with the small Hamming ball around each of them. A match on a segment
is a candidate; it becomes a link when the whole distance is small enough.
Groups are the connected components of the links. Copies are never paired:
the work depends on distinct fingerprints.

Defined cases: null or empty text (no word) has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle; repeated
rows share a fingerprint; a group's id is its least document id, rows without
an id get their group's, and a group of such rows alone has a null id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalrates.llm.common import fields, map_batches, slices, stored, unpack, whole_row
from vitalrates.llm.components import components
from vitalrates.llm.words import words

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    import xxhash
    own, count = words(texts, lower=True)
    n = len(own)
    size = np.diff(np.frombuffer(own.buffers()[1], np.int32)) if n else np.zeros(0, np.int64)
    # words in a row, one blank after each
    end = np.cumsum(size + 1, dtype=np.int64)
    row = np.full(int(end[-1]) if n else 0, 32, np.uint8)
    if n:
        blank = np.zeros(len(row), bool)
        blank[end - 1] = True
        row[~blank] = np.frombuffer(own.buffers()[2], np.uint8)
    raw, begin, stop = row.tobytes(), end - size - 1, end - 1
    last = np.cumsum(count)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(n)
    width = np.minimum(shingle, count)[text]          # short texts: all their words
    ok = at + width <= last[text]
    if shingle > 1:
        ok &= (count[text] >= shingle) | (at == (last - count)[text])
    lo, hi = begin[ok].tolist(), stop[(at + width - 1)[ok]].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(raw[a:b], seed) for a, b in zip(lo, hi)), np.uint64, len(lo))
    of, k = text[ok], len(count)
    total = np.bincount(of, minlength=k)
    out = np.zeros(k, np.uint64)
    column = h.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        seen = np.bincount(of * 256 + column[:, byte], minlength=256 * k).reshape(k, 256) @ _BITS
        for bit in range(8):
            out |= (2 * seen[:, bit] > total).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def fingerprinted(docs: DataFrame, shingle: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``fp`` (signed 64-bit) and ``th`` (hash of the text) of every row."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("th"),
                      F.col(f"`{text}`").alias("_text"))
    schema = T.StructType([src.schema["doc_id"], *fields("th long, fp long").fields])

    def run(batches):
        for b in batches:
            for s in slices(b, 2):
                fp = fingerprints(s.column(2), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(fp)], names=schema.names)

    return map_batches(src, run, schema)


def ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` bits set."""
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def near_links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Pairs ``a`` < ``b`` of distinct fingerprints (column ``fp``) that differ
    in at most ``bits`` bits."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    # the segment goes into bit 32 of the key
    segments = F.array(low, high.bitwiseOR(F.lit(1 << 32)))
    stored_side = prints.select(F.col("fp").alias("b"), F.explode(segments).alias("key"))
    masks = F.array(*[F.lit(m) for m in ball(32, bits // 2)])
    probes = (prints.select(F.col("fp").alias("a"), F.explode(segments).alias("seg"))
              .select("a", F.explode(F.transform(masks, lambda m: F.col("seg").bitwiseXOR(m.cast("long")))).alias("key")))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return probes.join(stored_side, "key").where(near).select("a", "b")


def grouped(docs: DataFrame, shingle: int = 3, bits: int = 3, seed: int = 42, doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """``doc_id``, ``th``, ``fp``, ``root`` (one per group) and
    ``component_id`` of every row."""
    rows = stored(fingerprinted(docs, shingle, seed, doc_id, text), "simhash")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    roots = components(near_links(prints, bits), "simhash")
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = stored(placed.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    named = stored(placed.join(ids, "root").select("fp", "root", "component_id"), "simhash-named")
    return rows.join(named, "fp")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """Query view: fingerprint and group of every document."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the input's columns: the row of the
    least document id, no id being the last (of equal ids, the one of least
    text hash)."""
    rows = grouped(docs, shingle, bits, doc_id=doc_id, text=text)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = rows.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.doc_id").alias("_id"), F.col("m.th").alias("_th"))
    first = stored(first, "simhash-kept")
    own = docs.select(whole_row(docs), F.col(f"`{doc_id}`").alias("_key"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"))
    kept = own.join(first, own["_key"].eqNullSafe(first["_id"]) & (own["_hash"] == first["_th"]), "left_semi")
    return kept.dropDuplicates(["_key", "_hash"]).select(*unpack(docs, docs.columns))
