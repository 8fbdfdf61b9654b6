"""Token-id shards: one zstandard frame a document, a shared dictionary, an offset index.

Layout of a shard: magic, SHA-256 of the dictionary, frames in row order, the
index as an Arrow stream (id, offset, length, tokens), its length as 8 bytes,
magic. A frame holds a document's ids as little-endian 16-bit integers. A short
document is read by its index row alone. The dictionary is trained on the
serialized ids of at most ``SAMPLE_ROWS`` documents, drawn by hash over the whole
table from those of at most 64 KiB; it lies beside the shards and a reader
refuses a shard that was written with another. A shard is closed at
``SHARD_TOKENS`` ids or ``shard_docs`` documents, so shards and their indexes don't grow with the data.

Shards are written by the tasks under names of their own attempt into a shared
folder; a manifest written and committed by Spark names those that count, so a
lost or repeated attempt leaves no trace in what is read.

Defined cases: null and empty texts hold the end id alone; rows are ordered by
id, nulls first, then by a hash of the text, and repeated rows are all kept; an
empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm._common import emitted, schema_of, shared_dir, stored, text_sample
from tesserae.llm.tokenization import encoder, public_path

MAGIC = b"TESSIDS1"
SAMPLE_ROWS, DICTIONARY_BYTES, LEVEL = 400, 64 << 10, 3
SHARD_TOKENS, SHARD_DOCS = 1 << 28, 1 << 20
_DICTIONARIES: dict[str, bytes] = {}


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for frames of such bytes; empty if the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _dictionary(folder: str) -> bytes:
    if folder not in _DICTIONARIES:
        _DICTIONARIES.clear()
        store, path = _open(f"{folder}/dictionary")
        with store.open_input_stream(path) as f:
            _DICTIONARIES[folder] = f.read()
    return _DICTIONARIES[folder]


class ShardWriter:
    def __init__(self, uri: str, dictionary: bytes) -> None:
        store, path = _open(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.uri, self.out, self.rows, self.tokens = uri, store.open_output_stream(path), [], 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        self.at = self.out.write(MAGIC + hashlib.sha256(dictionary).digest())

    def add(self, key: int | None, ids: bytes) -> None:
        frame = self.zip.compress(ids)
        self.out.write(frame)
        self.rows.append((key, self.at, len(frame), len(ids) // 2))
        self.at += len(frame)
        self.tokens += len(ids) // 2


    def close(self) -> None:
        key, offset, length, tokens = zip(*self.rows)
        index = pa.record_batch({"id": pa.array(key, pa.int64()), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64()), "tokens": pa.array(tokens, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, index.schema) as w:
            w.write_batch(index)
        data = sink.getvalue().to_pybytes()
        self.out.write(data + struct.pack("<Q", len(data)) + MAGIC)
        self.out.close()


class ShardReader:
    """Random access to one shard: ``reader.ids(row)`` reads that document's frame alone."""

    def __init__(self, uri: str, dictionary: bytes) -> None:
        store, path = _open(uri)
        self.file = store.open_input_file(path)
        end = self.file.size()
        if self.file.read_at(len(MAGIC) + 32, 0) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: not a shard written with this dictionary")
        tail = self.file.read_at(8 + len(MAGIC), end - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri}: the shard is cut short")
        size = struct.unpack("<Q", tail[:8])[0]
        self.index = pa.ipc.open_stream(self.file.read_at(size, end - 8 - len(MAGIC) - size)).read_all()
        self.offset, self.length, self.tokens = (self.index[c].to_numpy() for c in ("offset", "length", "tokens"))
        self.zip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, row: int) -> np.ndarray:
        return np.frombuffer(self.zip.decompress(self.file.read_at(int(self.length[row]), int(self.offset[row])), max_output_size=2 * int(self.tokens[row])), "<u2")


def write_ids(df: DataFrame, folder: str | None = None, tokenizer: str = "word_bpe_49k.json", kind: str = "word", end_id: int = 2, id_col: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS) -> tuple[str, DataFrame]:
    """Encode ``text``, append ``end_id`` and write shards in ascending ``id_col`` order.

    Returns the folder and the manifest: ``task, shard, path, n_docs, n_tokens``, in the order of the first two.
    """
    spark = df.sparkSession
    folder = folder or shared_dir(spark, "ids")
    docs, tail = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), struct.pack("<H", end_id)
    dictionary = train_dictionary([encoder(public_path(tokenizer), kind).ids(t) + tail for t in text_sample(docs, "text", SAMPLE_ROWS)])
    store, path = _open(folder)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/dictionary") as f:
        f.write(dictionary)
    fields = [("task", "long"), ("shard", "long"), ("path", "string"), ("n_docs", "long"), ("n_tokens", "long")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, writer, done = encoder(public_path(tokenizer), kind).ids, TaskContext.get().partitionId(), None, []

        def closed() -> None:
            writer.close()
            done.append((task, len(done), writer.uri, len(writer.rows), writer.tokens))

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                writer = writer or ShardWriter(f"{folder}/shards/{task:06d}-{len(done):04d}-{uuid.uuid4().hex}.ids", _dictionary(folder))
                writer.add(key, encode(t or "") + tail)
                if writer.tokens >= SHARD_TOKENS or len(writer.rows) >= shard_docs:
                    closed()
                    writer = None
        if writer:
            closed()
        yield from emitted(iter(done), fields)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return folder, stored(dealt.mapInArrow(run, schema_of(fields)), "ids-manifest")


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents of the shards: id, ``start`` (ids before it), ``n_tokens``, ``ids`` (32-bit little-endian)."""
    shards, start = [], 0
    for r in manifest.orderBy("task", "shard").collect():  # a row for each shard
        shards.append((r.path, start))
        start += r.n_tokens
    fields = [(id_col, "long"), ("start", "long"), ("n_tokens", "long"), ("ids", "binary")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for uri, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    shard = ShardReader(uri, _dictionary(folder))
                    for k, key in enumerate(shard.index["id"].to_pylist()):
                        ids = shard.ids(k)
                        yield key, at, len(ids), ids.astype("<u4").tobytes()
                        at += len(ids)

        return emitted(rows(), fields, 256)

    frame = spark.createDataFrame(shards, T.StructType([T.StructField("path", T.StringType()), T.StructField("start", T.LongType())]))
    return frame.repartition(max(1, len(shards))).mapInArrow(run, schema_of(fields))
