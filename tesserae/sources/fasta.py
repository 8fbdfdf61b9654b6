"""FASTA records as a DataFrame, and back.

Files are read through a data source of byte ranges: a task reads the records
whose header begins in its range, wherever they end. A record's number is made of
its file and the byte at which it begins, so it needs no counting, and rereads
with other ranges give the same numbers. Nothing is shuffled, and a task holds one
record and one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tesserae.sources.shared import shipped

#: Bits of a record number that hold the byte offset in its file.
FILE_BITS = 40
#: Bytes of a range, of one read, and of an Arrow batch.
RANGE_BYTES, READ_BYTES, BATCH_BYTES = 128 << 20, 4 << 20, 8 << 20
_SCHEMA = "rec_no long, header string, seq string"


@dataclass
class ByteRange(InputPartition):
    """Bytes [start, stop) of the file number ``file``; compressed files are one range."""

    file: int
    path: str
    start: int
    stop: int


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def _uri(folder: str, path: str) -> str:
    """The name by which tasks open ``path``, a file found below ``folder``."""
    scheme, mark, rest = folder.partition("://")
    if not mark:
        return path
    return f"{scheme}://{rest.split('/')[0]}{path}" if path.startswith("/") else f"{scheme}://{path}"


def _compressed(path: str) -> bool:
    return path.endswith((".gz", ".bz2", ".zst"))


def record_bytes(f: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of each record whose ``>`` stands in [start, stop) at the start of a line.

    ``f`` stands at the byte before ``start``, or at 0.
    """
    # ``base``: the place in the file of the first byte held; a line break is put before the first line.
    base, held, ended = (start - 1, bytearray(), False) if start else (-1, bytearray(b"\n"), False)

    def more() -> bool:
        nonlocal ended
        new = b"" if ended else f.read(READ_BYTES)
        ended = not new
        held.extend(new)
        return not ended

    def header(begin: int) -> int:
        """Where the next line break before a ``>`` stands, or -1."""
        while True:
            found = held.find(b"\n>", begin)
            if found >= 0:
                return found
            begin = max(len(held) - 1, begin)
            if not more():
                return -1

    at = -1
    while base + len(held) <= stop or not held:  # up to the first header of the range, forgetting what lies before
        at = held.find(b"\n>")
        if at >= 0 or not more():
            break
        if (at := held.find(b"\n>")) >= 0:
            break
        base += len(held) - 1
        del held[:-1]
    while at >= 0 and base + at + 1 < stop:
        end = header(at + 1)
        yield base + at + 1, bytes(held[at + 2 : end if end >= 0 else len(held)])
        if end < 0:
            return
        if end > READ_BYTES:  # what was read already goes
            del held[:end]
            base, end = base + end, 0
        at = end


class FastaReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        found: list[tuple[str, int]] = []
        system, path = _opened(self.paths)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.paths)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        for x in files:
            if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")):
                found.append((_uri(self.paths, x.path), x.size))
        out = []
        for k, (path, size) in enumerate(sorted(found)):
            step = max(size, 1) if _compressed(path) else self.range_bytes
            out += [ByteRange(k, path, at, 1 << FILE_BITS if _compressed(path) else min(at + step, size)) for at in range(0, size, step)]
        return out or [ByteRange(0, "", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, str, str]] = []
        if not part.path:
            return
        system, path = _opened(part.path)
        with (system.open_input_stream(path) if _compressed(path) else system.open_input_file(path)) as f:
            if part.start:
                f.seek(part.start - 1)
            weight = 0
            for offset, raw in record_bytes(f, part.start, part.stop):
                head, _, body = raw.replace(b"\r", b"").partition(b"\n")
                rows.append(((part.file << FILE_BITS) + offset, head.decode(), body.replace(b"\n", b"").decode()))
                weight += len(raw)
                if weight > BATCH_BYTES:
                    yield _batch(rows)
                    rows, weight = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[int, str, str]]) -> pa.RecordBatch:
    numbers, headers, seqs = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(headers, pa.string()), pa.array(seqs, pa.string())], names=["rec_no", "header", "seq"])


class FastaSource(DataSource):
    """``spark.read.format("fasta").load(path)``; option ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: object) -> FastaReader:
        return FastaReader({k.lower(): v for k, v in self.options.items()})


def read_fasta(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records ``rec_no, header, seq`` of a file or folder: the header without its line end, the sequence lines joined.

    ``rec_no`` is the file's number in the order of paths times 2^40, plus the
    byte of its (uncompressed) text at which the record begins. Lines before a
    file's first header are dropped, as are carriage returns.
    """
    shipped(spark)
    spark.dataSource.register(FastaSource)
    return spark.read.format("fasta").option("rangeBytes", range_bytes).load(path)


def write_fasta(records: DataFrame, path: str) -> None:
    """Write ``header`` and ``seq`` as two-line records; an existing ``path`` is an error."""
    records.select(F.concat(F.lit(">"), F.regexp_replace("header", "^>", ""), F.lit("\n"), F.col("seq")).alias("value")).write.text(path)
