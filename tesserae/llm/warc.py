"""WARC archives through a chunked record table.

A payload travels as rows (record, chunk number, chunk) of at most
``CHUNK_BYTES`` bytes, cut by Spark in the task that scans it and streamed by the
writer into one gzip member a record; the writer carries the digest from chunk
to chunk and fails if it ends elsewhere than the header says. The reader streams
the members back into chunk rows that carry the digest and the byte count up
to and with each chunk. The scan decodes a value whole, as Parquet holds it;
from there on neither Spark nor a Python worker holds more than a chunk.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with
the largest id is a response and the others are revisits that refer to it.
Equal means the same SHA-1 and length. This is settled on slim rows (id, URL,
digest, length), and no digest is a key of payloads: payloads with a large part
of all copies are told by a broadcast of fewer than 1,024 digests, the other
revisits by a broadcast of their ids up to ``SENT_BYTES``, and beyond that by a
join of chunk rows on id and digest, which is even.

Each archive begins with a ``warcinfo`` record. Record ids hold the page id and
the head of the digest. Archives are written by the tasks under names of their
own attempt into a shared folder, and a manifest that Spark commits names those
that count.

Defined cases: a null payload is empty; a null id is written as ``null`` and
never the largest, and is read back as null; rows that share the largest id
and the payload are all responses; rows that agree in id and payload have one
record id; a null URL gives no target line; line ends in URLs are
percent-encoded; an empty table gives no archive; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm._common import HOT_SHARE, emitted, schema_of, shared_dir, stored

CHUNK_BYTES = 1 << 20
ARCHIVE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
#: Revisits are sent to all executors up to this size, at ``REVISIT_BYTES`` a row and its URL.
SENT_BYTES, REVISIT_BYTES = 64 << 20, 160


def record_table(pages: DataFrame, min_bytes: int = 1000, id_col: str = "page_id", url: str = "url", payload: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows ``id, url, payload_bytes, payload_digest, refers_to, refers_url, chunk_no, chunk`` of all pages.

    ``refers_to`` is null for responses; a revisit has one empty chunk. Chunks
    of a record follow each other in one partition.
    """
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rec = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).cast("string").alias("url") if url in pages.columns else F.lit(None).cast("string").alias("url"), data.alias("payload"))
    rec = rec.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    keys = ["payload_digest", "payload_bytes"]
    slim = stored(rec.where(F.col("payload_bytes") >= min_bytes).select("id", "url", *keys), "warc-slim")
    copies = slim.groupBy(*keys).agg(F.max(F.struct("id", "url")).alias("last"), F.count("*").alias("n_rows")).where("n_rows > 1")
    copies = stored(copies.select(*keys, F.col("last.id").alias("last_id"), F.col("last.url").alias("last_url"), "n_rows"), "warc-copies")
    total = copies.agg(F.sum("n_rows")).first()[0] or 0
    hot = F.col("n_rows") > F.lit(total * HOT_SHARE)
    own = F.broadcast(copies.where(hot).select(*keys, F.col("last_id").alias("hot_id"), F.col("last_url").alias("hot_url"), F.lit(True).alias("hot")))
    rec = rec.join(own, keys, "left")
    again = F.col("hot") & ~F.col("id").eqNullSafe(F.col("hot_id"))
    rec = rec.select("id", "url", "payload", *keys, F.when(again, F.col("hot_id")).alias("hot_id"), F.when(again, F.col("hot_url")).alias("hot_url"))

    cold = slim.join(copies.where(~hot), keys).where(~F.col("id").eqNullSafe(F.col("last_id")))
    revisits = stored(cold.select("id", *keys, "last_id", "last_url").distinct(), "warc-revisits")
    r = revisits.agg(F.count("*"), F.sum(F.octet_length("last_url"))).first()
    if REVISIT_BYTES * r[0] + (r[1] or 0) <= SENT_BYTES:
        return _chunks(_referring(rec, F.broadcast(revisits)), chunk_bytes).drop("row")
    # Chunks first: what is shuffled and sorted are chunk rows.
    rows = _referring(_chunks(rec.withColumns({"refers_to": F.col("hot_id"), "refers_url": F.col("hot_url")}), chunk_bytes, "hot_id", "hot_url"), revisits)
    rows = rows.where((F.col("chunk_no") == 0) | F.col("refers_to").isNull()).withColumn("chunk", F.when(F.col("refers_to").isNull(), F.col("chunk")).otherwise(F.lit(b"")))
    return rows.sortWithinPartitions("row", "chunk_no").drop("row")


def _referring(rec: DataFrame, revisits: DataFrame) -> DataFrame:
    """Add ``refers_to, refers_url`` from ``revisits``, or where a hot digest gave them already."""
    told = revisits.select(F.col("id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_bytes"), "last_id", "last_url")
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") == F.col("_bytes"))
    out = rec.join(told, on, "left").drop("_id", "_digest", "_bytes")
    return out.withColumns({"refers_to": F.coalesce("hot_id", "last_id"), "refers_url": F.coalesce("hot_url", "last_url")}).drop("hot_id", "hot_url", "last_id", "last_url")


def _chunks(records: DataFrame, chunk_bytes: int, *more: str) -> DataFrame:
    """Chunk rows of records: a ``row`` number, all but the payload, ``chunk_no`` from 0 and ``chunk``; a revisit has one empty chunk."""
    size = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    last = F.greatest(F.ceil(size / chunk_bytes) - 1, F.lit(0)).cast("long")
    rows = records.withColumn("row", F.monotonically_increasing_id()).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    chunk = F.when(F.col("refers_to").isNull(), F.substring("payload", (F.col("chunk_no") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))).otherwise(F.lit(b""))
    return rows.select("row", "id", "url", "payload_bytes", "payload_digest", "refers_to", "refers_url", "chunk_no", chunk.alias("chunk"), *more)


def _urn(key: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if key is None else key}:{digest[:16]}>"


def _key(urn: str | None) -> int | None:
    name = (urn or "").strip("<>").split(":")[2:3]
    return int(name[0]) if name and name[0] != "null" else None


def _escaped(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _head(key: int | None, url: str | None, size: int, digest: str, refers: int | None, refers_url: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_urn(key, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _escaped(url))
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers, digest)}", f"WARC-Refers-To-Date: {date}"]
        if refers_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + _escaped(refers_url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (size if refers is None else 0)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode("utf-8", "surrogatepass")


def _info(name: str, date: str) -> bytes:
    """The record that opens an archive."""
    body = "software: tesserae\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + body + "\r\n\r\n").encode()


class ArchiveWriter:
    """Streams chunk rows into gzip members of one file."""

    def __init__(self, uri: str, date: str = DATE) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        folder, name = path.rsplit("/", 1)
        store.create_dir(folder, recursive=True)
        self.uri, self.out, self.records, self.written, self.date = uri, store.open_output_stream(path, compression=None), 0, 0, date
        self._put(gzip.compress(_info(name, date), 1, mtime=0))

    def begin(self, key: int | None, url: str | None, size: int, digest: str, refers: int | None, refers_url: str | None) -> None:
        self.zip, self.sha, self.digest, self.left = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1(), digest, size if refers is None else 0
        self.response = refers is None
        self._put(self.zip.compress(_head(key, url, size, digest, refers, refers_url, self.date)))

    def chunk(self, data: pa.Buffer) -> None:
        self.sha.update(data)
        self.left -= len(data)
        self._put(self.zip.compress(data))
        if not self.left:
            if self.response and self.sha.hexdigest() != self.digest:
                raise ValueError("the chunks of a record do not give its digest")
            self._put(self.zip.compress(b"\r\n\r\n") + self.zip.flush())
            self.records += 1

    def _put(self, data: bytes) -> None:
        self.written += self.out.write(data)


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 1000, chunk_bytes: int = CHUNK_BYTES, date: str = DATE, **columns: str) -> DataFrame:
    """Write one record a row, dated ``date``; returns the manifest ``path, n_records``. ``columns``: as of ``record_table``."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    fields = [("path", "string"), ("n_records", "long")]
    rows = record_table(pages, min_bytes, chunk_bytes=chunk_bytes, **columns).select("id", "url", "payload_bytes", "payload_digest", "refers_to", "refers_url", "chunk_no", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, writer = TaskContext.get().partitionId(), [], None
        for b in batches:
            heads, chunks = [c.to_pylist() for c in b.columns[:7]], b.column(7)
            for k, (*head, number) in enumerate(zip(*heads)):
                if number == 0:
                    if writer and writer.written >= ARCHIVE_BYTES:
                        writer.out.close()
                        done.append((writer.uri, writer.records))
                        writer = None
                    writer = writer or ArchiveWriter(f"{folder}/{part:06d}-{uuid.uuid4().hex}.warc.gz", date)
                    writer.begin(*head)
                writer.chunk(chunks[k].as_buffer())
        if writer:
            writer.out.close()
            done.append((writer.uri, writer.records))
        yield from emitted(iter(done), fields)

    return stored(rows.mapInArrow(run, schema_of(fields)), "warc-manifest")


class _Member:
    """A gzip file of records as one stream of bytes, read and inflated in small steps."""

    def __init__(self, uri: str, step: int = 1 << 16) -> None:
        store, path = fs.FileSystem.from_uri(uri)
        self.file, self.step, self.zip, self.have = store.open_input_stream(path, compression=None), step, zlib.decompressobj(31), b""
        self.raw = b""

    def more(self) -> bool:
        """Inflate another step; false at the end of the file."""
        while True:
            if self.zip.eof:
                self.raw, self.zip = self.zip.unused_data, zlib.decompressobj(31)
            data = self.zip.unconsumed_tail or self.raw or self.file.read(self.step)
            self.raw = b""
            if not data:
                return False
            new = self.zip.decompress(data, self.step * 4)
            if new:
                self.have += new
                return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.have:
            if not self.more():
                return None
        line, _, self.have = self.have.partition(b"\r\n")
        return line

    def head(self) -> tuple[bytes, dict[str, str], int] | None:
        """First line, fields and length of a header; None at the end."""
        first = self.line()
        while first == b"":
            first = self.line()
        if first is None:
            return None
        fields, size = {}, len(first) + 2
        while True:
            line = self.line()
            if line is None:
                raise ValueError("the archive is cut short")
            size += len(line) + 2
            if not line:
                return first, fields, size
            name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
            fields[name.lower()] = value

    def take(self, n: int, most: int) -> Iterator[bytes]:
        """The next ``n`` bytes in chunks of ``most``, but for the last."""
        while n:
            while len(self.have) < min(n, most):
                if not self.more():
                    raise ValueError("the archive is cut short")
            data, self.have = self.have[: min(n, most)], self.have[min(n, most) :]
            n -= len(data)
            yield data


CHUNKS = [("id", "long"), ("record_type", "string"), ("refers_to", "long"), ("payload_bytes", "long"), ("header_digest", "string"), ("chunk_no", "long"), ("bytes_so_far", "long"), ("digest_so_far", "string"), ("last", "boolean")]


def read_archives(manifest: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunk rows of the archives in ``manifest``.

    ``payload_bytes`` and ``header_digest`` are of the full payload, from the
    record's headers; ``bytes_so_far`` and ``digest_so_far`` of the payload
    read up to and with the chunk; ``chunk`` is there if ``with_data``. A
    record whose payload does not give its digest is an error.
    """
    fields = CHUNKS + ([("chunk", "binary")] if with_data else [])

    def records(uri: str) -> Iterator[tuple]:
        stream = _Member(uri)
        while head := stream.head():
            _, warc, _ = head
            if warc["warc-type"] == "warcinfo":
                for _ in stream.take(int(warc["content-length"]), chunk_bytes):
                    pass
                continue
            _, http, used = stream.head()
            block, kind, digest = int(warc["content-length"]) - used, warc["warc-type"], warc["warc-payload-digest"].rpartition(":")[2]
            fixed, sha, at, number = (_key(warc["warc-record-id"]), kind, _key(warc.get("warc-refers-to")), int(http["content-length"]), digest), hashlib.sha1(), 0, 0
            for data in stream.take(block, chunk_bytes) if block else (b"",):
                sha.update(data)
                at += len(data)
                row = (*fixed, number, at, sha.hexdigest(), at == block)
                yield (*row, data) if with_data else row
                number += 1
            if kind == "response" and sha.hexdigest() != digest:
                raise ValueError(f"{uri}: {fixed[0]}: the payload does not give its digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return emitted((row for b in batches for uri in b.column(0).to_pylist() for row in records(uri)), fields, 16 if with_data else 4096)

    paths = [(r.path,) for r in manifest.select("path").orderBy("path").collect()]  # a row for each archive
    frame = manifest.sparkSession.createDataFrame(paths, T.StructType([T.StructField("path", T.StringType())]))
    return frame.repartition(max(1, len(paths))).mapInArrow(run, schema_of(fields))
