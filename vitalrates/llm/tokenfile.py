"""Token files: ids in ascending document order, as compressed planes.

One file holds the documents of one range of document ids:

    "VRTOKEN1"
    chunks        each the planes of up to 65 536 ids, one zstandard frame a plane
    documents     int64 document ids and uint32 id counts, one zstandard frame
    chunk index   per chunk: offset uint64, ids uint32, planes uint32, then the
                  byte size of each plane uint32
    footer        offsets of documents and chunk index uint64, documents uint64,
                  chunks uint64, "VRTOKEN1"

All integers are little-endian. A plane holds one bit (``bits=1``) or byte
(``bits=8``) of every id of the chunk, least significant plane first; planes
above the highest used one are left out. The index gives any chunk by itself.

Files are written by tasks to a folder that all executors share, each under
the name of its attempt; the list of files that Spark committed is the
manifest, so a repeated attempt leaves at most a file that nobody reads.

Defined cases: null text is empty and holds the end id alone; null document
ids come first and are marked as such; rows of one document id are ordered by
text; an empty table makes no files and reads back as no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalrates.llm.common import fields, gathered, map_batches, shared_path, slices, stored
from vitalrates.llm.tokens import encoder

MAGIC = b"VRTOKEN1"
CHUNK = 65_536
NO_ID = -(1 << 63)      # marks a null document id in a file
FOOTER = struct.Struct("<QQQQ8s")


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Transpose ids into planes of ``bits`` bits each."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    planes = 32 if bits == 1 else 4
    top = int(ids.max()).bit_length() if len(ids) else 0
    used = min(planes, -(-top // bits))
    if bits == 8:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(used)]
    flags = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(flags[:, k]), bitorder="little").tobytes() for k in range(used)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    if bits == 8:
        raw = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            raw[:, k] = np.frombuffer(p, np.uint8)
        return raw.view("<u4").reshape(-1)
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return out


class Writer:
    def __init__(self, sink, bits: int = 8, level: int = 1, chunk: int = CHUNK):
        import zstandard
        self.sink, self.bits, self.chunk, self.at = sink, bits, chunk, len(MAGIC)
        self.zip = zstandard.ZstdCompressor(level=level)
        self.wait, self.held, self.index, self.docs, self.counts = [], 0, [], [], []
        sink.write(MAGIC)

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.counts.append(counts.astype("<u4"))
        self.wait.append(ids)
        self.held += len(ids)
        if self.held >= self.chunk:
            rest = np.concatenate(self.wait)
            end = len(rest) // self.chunk * self.chunk
            for i in range(0, end, self.chunk):
                self._chunk(rest[i:i + self.chunk])
            self.wait, self.held = [rest[end:].copy()], len(rest) - end

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.index.append((self.at, len(ids), [len(p) for p in planes]))
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> tuple[int, int, int]:
        """Ids, documents and bytes of the finished file."""
        if self.held:
            self._chunk(np.concatenate(self.wait))
        docs = np.concatenate([*self.docs, np.zeros(0, "<i8")]).astype("<i8")
        counts = np.concatenate([*self.counts, np.zeros(0, "<u4")]).astype("<u4")
        table = self.zip.compress(bytes([self.bits]) + docs.tobytes() + counts.tobytes())
        index = b"".join(struct.pack(f"<QII{len(p)}I", at, n, len(p), *p) for at, n, p in self.index)
        tail = FOOTER.pack(self.at, self.at + len(table), len(docs), len(self.index), MAGIC)
        self.sink.write(table + index + tail)
        return int(counts.sum(dtype=np.int64)), len(docs), self.at + len(table) + len(index) + len(tail)


class Reader:
    """Reads the index first, then any chunk by its place."""

    def __init__(self, source):
        import zstandard
        self.unzip = zstandard.ZstdDecompressor()
        self.source = source
        end = source.size()
        source.seek(end - FOOTER.size)
        at, index, n_docs, n_chunks, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(at)
        table = self.unzip.decompress(source.read(index - at), max_output_size=1 + 12 * n_docs)
        self.bits = table[0]
        self.docs = np.frombuffer(table, "<i8", n_docs, 1)
        self.counts = np.frombuffer(table, "<u4", n_docs, 1 + 8 * n_docs)
        raw, p, self.chunks = source.read(end - FOOTER.size - index), 0, []
        for _ in range(n_chunks):
            at, n, k = struct.unpack_from("<QII", raw, p)
            self.chunks.append((at, n, struct.unpack_from(f"<{k}I", raw, p + 16)))
            p += 16 + 4 * k

    def chunk(self, i: int) -> np.ndarray:
        at, n, sizes = self.chunks[i]
        self.source.seek(at)
        raw, planes, p = self.source.read(sum(sizes)), [], 0
        most = n if self.bits == 8 else -(-n // 8)
        for s in sizes:
            planes.append(self.unzip.decompress(raw[p:p + s], max_output_size=most))
            p += s
        return from_planes(planes, n, self.bits)

    def documents(self) -> Iterator[np.ndarray]:
        """Each document's ids, one chunk in memory at a time beside them."""
        left, i = np.zeros(0, np.uint32), 0
        for n in self.counts.tolist():
            parts, have = [left], len(left)
            while have < n:
                parts.append(self.chunk(i))
                have += len(parts[-1])
                i += 1
            all_ = np.concatenate(parts) if len(parts) > 1 else left
            yield all_[:n]
            left = all_[n:]


def _filesystem(uri: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = 2, bits: int = 8, doc_id: str = "doc_id",
                 text: str = "text", cache: int = 800_000) -> DataFrame:
    """Encode whole texts, append ``end`` and write one file per range of
    document ids into ``folder``. Returns the stored manifest: file number in
    document order, name, ids, documents, bytes."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("_text"))
    tie = F.xxhash64("_text")   # rows of one document id may be many: a range can end between them
    ordered = src.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "_text")

    def run(batches):
        from pyspark import TaskContext
        task, enc, writer, sink = TaskContext.get(), encoder(path, cache=cache), None, None
        system, root = _filesystem(folder)
        name = f"tokens-{task.partitionId():07d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.vrt"
        for b in gathered(batches, 1):
            for s in slices(b, 1, 16 << 20):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(f"{root}/{name}")
                    writer = Writer(sink, bits)
                ids, bound = enc.encode(s.column(1))
                n = len(bound) - 1
                own = np.insert(ids, bound[1:], end).astype(np.uint32)
                keys = s.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                writer.add(keys, np.diff(bound) + 1, own) if n else None
        if writer is not None:
            n_ids, n_docs, size = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "file": name, "n_ids": n_ids, "n_docs": n_docs,
                                               "n_bytes": size}])

    manifest = map_batches(ordered, run, "part long, file string, n_ids long, n_docs long, n_bytes long")
    return stored(manifest, "token-manifest")


def read_tokens(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """Every document of the files in a manifest: doc_id, start (ids of all
    documents before it), n_tokens and its ids (or their crc32)."""
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("before"))
    kind = T.LongType() if digest else T.BinaryType()
    schema = T.StructType([*fields("doc_id long, start long, n_tokens long").fields,
                           T.StructField("ids_crc32" if digest else "ids", kind)])
    files = files.repartition(max(1, manifest.count()), "file")     # a stated number is not merged into fewer tasks

    def run(batches):
        system, root = _filesystem(folder)
        for b in batches:
            for name, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}") as source:
                    r = Reader(source)
                    starts = at + np.concatenate([[0], np.cumsum(r.counts, dtype=np.int64)])
                    rows, held, first = [], 0, 0
                    for i, ids in enumerate(r.documents()):
                        raw = ids.astype("<u4").tobytes()
                        rows.append(zlib.crc32(raw) if digest else raw)
                        held += 8 if digest else len(raw)
                        if held >= 4 << 20 or i + 1 == len(r.counts):
                            own = slice(first, i + 1)
                            docs = r.docs[own]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(starts[own]),
                                 pa.array(r.counts[own].astype(np.int64)),
                                 pa.array(rows, pa.int64() if digest else pa.binary())], names=schema.names)
                            rows, held, first = [], 0, i + 1

    return map_batches(files, run, schema)


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Query view: write, read back, digest per document."""
    folder = shared_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, folder), folder, digest=True)
