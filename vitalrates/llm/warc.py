"""Web archives: a writer with deduplicated payloads and a salvage reader.

Records are WARC/1.1, one gzip member each. Of equal payloads of at least
``least`` bytes the page with the smallest id is written as a response, the
others as revisits that refer to it. Tasks write files to a folder that all
executors share, each named by its attempt; the manifest lists those that
Spark committed.

The reader checks every record: gzip trailer, version line, header lines,
Content-Length, the record's end, and its digests. After a failed check it
searches for the next place where a whole valid record begins (a gzip member,
or a version line in a plain archive), goes on there, and reports the bytes in
between as a quarantined gap with the reason. Files are read in pieces; one
record is held at a time.

Defined cases: null html is an empty payload; null url leaves the target out;
a page without id is always a response and refers or is referred to by none;
rows of the smallest id that occur repeatedly are all responses; line breaks
in a url are percent-encoded; an empty table writes no file.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalrates.llm.common import SLICE_ROWS, fields, map_batches, shared_path, slices, stored
from vitalrates.llm.tokenfile import _filesystem

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.\d\r\n")
GZIP = b"\x1f\x8b\x08"
RECORD = fields("file string, at long, size long, type string, page_id long, refers_to long, uri string, "
                "payload_bytes long, payload_digest string, payload binary, gap string")


def record(kind: str, page_id: int | None, uri: str | None, payload: bytes, digest: str, size: int,
           refers_to: int | None) -> bytes:
    """One uncompressed record."""
    block = HTTP + (payload if kind == "response" else b"")
    name = lambda i: f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}').urn}>"
    own = name(page_id) if page_id is not None else f"<{uuid.uuid4().urn}>"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + quote(uri, safe="%/:=&?~#+!$,;'@()*[]"))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"X-Payload-Length: {size}", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def deduplicated(pages: DataFrame, least: int = 100, page_id: str = "page_id", url: str = "url",
                 html: str = "html") -> DataFrame:
    """Pages with digest, size, record type and the page referred to."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("uri"),
                       body.alias("payload"))
    own = own.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    first = stored(own.where((F.col("size") >= least) & F.col("page_id").isNotNull()).groupBy("digest")
                   .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"),
                   "warc-first")
    again = F.col("page_id").isNotNull() & (F.col("first") < F.col("page_id"))
    j = own.join(first, "digest", "left")
    return j.select("page_id", "uri", "digest", "size", F.when(again, F.col("first")).alias("refers_to"),
                    F.when(again, F.lit(None).cast("binary")).otherwise(F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, folder: str, roll: int = 256 << 20, **columns) -> DataFrame:
    """Write archives into ``folder``; the stored manifest: file, bytes, records."""
    def run(batches):
        from pyspark import TaskContext
        task, number, sink, done, size = TaskContext.get(), 0, None, 0, 0
        system, root = _filesystem(folder)
        stem = f"pages-{task.partitionId():07d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for b in batches:
            for s in slices(b, 5):
                for r in zip(*(c.to_pylist() for c in s.columns), strict=True):
                    page, uri, digest, n, refers, payload = r
                    if sink is None:
                        system.create_dir(root, recursive=True)
                        name = f"{stem}-{number:04d}.warc.gz"
                        sink, done, size = system.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                    raw = member(record("response" if refers is None else "revisit", page, uri, payload or b"", digest, n, refers))
                    sink.write(raw)
                    done, size = done + 1, size + len(raw)
                    if size >= roll:
                        sink.close()
                        yield pa.RecordBatch.from_pylist([{"file": name, "n_bytes": size, "n_records": done}])
                        sink, number = None, number + 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "n_bytes": size, "n_records": done}])

    return stored(map_batches(deduplicated(pages, **columns), run, "file string, n_bytes long, n_records long"), "warc-manifest")


class Bad(Exception):
    """A failed check; the message is the gap's reason."""


NUMBER = re.compile(r"-?[0-9]{1,19}")


def number(text: str, least: int | None = None) -> int:
    """A header's number: ASCII digits that fit 64 bits, else a failed check."""
    if not NUMBER.fullmatch(text) or not (-1 << 63 if least is None else least) <= int(text) < 1 << 63:
        raise Bad("no usable number")
    return int(text)


class Archive:
    """Records and gaps of one archive, read by random access. A record is
    held whole, however long it is."""

    def __init__(self, source, chunk: int = 1 << 20):
        self.source, self.chunk = source, chunk
        self.size = source.size()
        self.gz = self._at(0, 2) == GZIP[:2] or (self._at(0, 5) != b"WARC/" and self._next_magic(0, GZIP) is not None
                                                 and self._next_plain(0) is None)

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(min(n, self.size - at)) if at < self.size else b""

    def _member(self, at: int, most: int | None = None) -> tuple[bytes, int]:
        """Content of the gzip member at ``at`` and where it ends; with
        ``most``, only that many first bytes."""
        if self._at(at, 3) != GZIP:
            raise Bad("no gzip member")
        z, out, n, pos = zlib.decompressobj(31), [], 0, at
        step = 4096 if most else self.chunk
        while not z.eof:
            raw = self._at(pos, step)
            if not raw:
                raise Bad("member is cut off")
            pos += len(raw)
            try:
                out.append(z.decompress(raw))
            except zlib.error as e:
                raise Bad("gzip check failed") from e
            n += len(out[-1])
            if most and n >= most:
                break
        return b"".join(out), pos - len(z.unused_data)

    def _plain(self, at: int) -> tuple[bytes, int]:
        """The plain record at ``at`` by its Content-Length."""
        head, n = b"", 4096
        while b"\r\n\r\n" not in head:
            head = self._at(at, n)
            if not head.startswith(b"WARC/1."):
                raise Bad("no version line")
            if n > 1 << 20 or (len(head) < n and b"\r\n\r\n" not in head):
                raise Bad("header does not end")
            n *= 4
        end = head.index(b"\r\n\r\n") + 4
        length = next((x[15:].strip() for x in head[:end].lower().split(b"\r\n") if x.startswith(b"content-length:")), b"")
        size = number(length.decode("latin-1"), 0)
        if at + end + size > self.size:
            raise Bad("record is cut off")
        whole = self._at(at, end + size + 4)
        return whole, at + len(whole)

    def parse(self, at: int) -> tuple[dict, int]:
        """The checked record at ``at`` and where it ends."""
        raw, end = self._member(at) if self.gz else self._plain(at)
        if not VERSION.match(raw):
            raise Bad("no version line")
        cut = raw.find(b"\r\n\r\n")
        if cut < 0:
            raise Bad("header does not end")
        head = {}
        for line in raw[:cut].split(b"\r\n")[1:]:
            k, colon, v = line.partition(b":")
            if not colon or not k.strip():
                raise Bad("bad header line")
            head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        n = number(head.get("content-length", ""), 0)
        if "warc-type" not in head:
            raise Bad("no record type")
        block = raw[cut + 4:cut + 4 + n]
        if len(block) != n or raw[cut + 4 + n:] != b"\r\n\r\n":
            raise Bad("Content-Length does not meet the record's end")
        if (d := head.get("warc-block-digest", "")).startswith("sha256:") and hashlib.sha256(block).hexdigest() != d[7:]:
            raise Bad("block digest differs")
        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
        said = head.get("warc-payload-digest", "").removeprefix("sha256:")
        if head["warc-type"] == "revisit":
            digest, size = said, number(head["x-payload-length"], 0) if "x-payload-length" in head else None
        elif said and head["warc-payload-digest"].startswith("sha256:") and said != digest:
            raise Bad("payload digest differs")
        given = lambda k: number(head[k]) if k in head else None
        return {"at": at, "size": end - at, "type": head["warc-type"], "page_id": given("x-page-id"),
                "refers_to": given("x-refers-to-page"), "uri": head.get("warc-target-uri"), "payload_bytes": size,
                "payload_digest": digest, "payload": payload, "gap": None}, end

    def _next_magic(self, at: int, magic: bytes) -> int | None:
        """First place from ``at`` on where ``magic`` stands."""
        while at < self.size:
            raw = self._at(at, self.chunk + len(magic) - 1)
            k = raw.find(magic)
            if k >= 0:
                return at + k
            at += self.chunk
        return None

    def _next_plain(self, at: int) -> int | None:
        """First version line from ``at`` on; a record cut off in mid-line may
        stand before it."""
        return self._next_magic(at, b"WARC/1.")

    def _next_valid(self, at: int) -> int:
        """Where the next valid record begins, else the archive's end."""
        while (k := self._next_magic(at, GZIP) if self.gz else self._next_plain(at)) is not None:
            try:
                if not self.gz or self._member(k, 7)[0].startswith(b"WARC/1."):
                    self.parse(k)
                    return k
            except Bad:
                pass
            at = k + 1
        return self.size

    def rows(self) -> Iterator[dict]:
        at = 0
        while at < self.size:
            try:
                row, at = self.parse(at)
                yield row
            except Bad as e:
                to = self._next_valid(at + 1)
                yield {"at": at, "size": to - at, "gap": str(e)}
                at = to


def read_archives(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Records and quarantined gaps (``gap`` holds the reason, null for
    records) of the archives named in column ``file``."""
    spread = files.select("file").repartition(max(1, files.count()), "file")    # a stated number is not merged into fewer tasks

    def run(batches):
        system, root = _filesystem(folder)
        blank = dict.fromkeys(RECORD.names)
        for b in batches:
            for name in b.column(0).to_pylist():
                with system.open_input_file(f"{root}/{name}") as source:
                    rows, held = [], 0
                    for r in Archive(source).rows():
                        if not payload:
                            r["payload"] = None
                        rows.append(blank | r | {"file": name})
                        held += len(r.get("payload") or b"")
                        if len(rows) >= SLICE_ROWS or held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in RECORD.fields])
    return map_batches(spread, run, RECORD)


def archive_roundtrip(pages: DataFrame) -> DataFrame:
    """Query view: write all pages, read the archives back. A gap in them is
    an error, never a page less."""
    folder = shared_path(pages.sparkSession, "warc")
    back = read_archives(write_archives(pages, folder), folder, payload=False)
    fail = F.raise_error(F.concat(F.lit("gap in "), "file", F.lit(": "), "gap")).cast("long")
    return back.select(F.when(F.col("gap").isNull(), F.col("page_id")).otherwise(fail).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")
