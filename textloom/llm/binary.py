"""Token-ID / binary output: token ids in patched frame-of-reference files.

Documents are range-partitioned and sorted by id, encoded, and written by each task as files
of about ``SHARD`` ids.  A file (little-endian):

====================  =====================================================================
``TLPF`` u16 u16      magic, version 1, ids per block
u32 u64 u32           documents, ids, blocks
i64[docs] u8[docs]    document ids; 1 where the document id is not null
u32[docs]             ids of each document, its end id included
u64[blocks]           index: where each block starts in the body
body                  per block: u32 minimum, u8 width, u8 0, u16 exceptions; ``width`` bits for
                      each id less the minimum; u16 places and u32 values of the exceptions
====================  =====================================================================

The width covers the ``PERCENTILE`` of a block's values; larger ones are exceptions whose slots
hold 0.  Files lie in the shared folder; the manifest, one row a file, is written by Spark, so
files of failed or repeated attempts are never read.

Defined cases: a null or empty text is its end id alone; a null document id comes first; repeated
rows are all written; other columns are ignored; an empty table gives no file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.encoding import encoder
from textloom.llm.storage import new_path
from textloom.llm.words import pieces

BLOCK = 1024
SHARD = 1 << 20
PERCENTILE = 95
_HEAD = struct.Struct("<4sHHIQI")
_MANIFEST = "part int, shard int, file string, first_doc long, n_docs long, n_ids long"


def pack(values: np.ndarray, width: int) -> bytes:
    """``width`` low bits of each value, one after the other."""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width], bitorder="little").tobytes()


def unpack(data: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> tuple[list[int], bytes]:
    """Where each block starts, and the blocks."""
    starts, body, size = [], [], 0
    for at in range(0, len(ids), block):
        own = ids[at : at + block]
        low = int(own.min())
        rest = (own - np.uint32(low)).astype(np.uint32)
        rank = min(len(rest) - 1, len(rest) * percentile // 100)
        width = int(np.partition(rest, rank)[rank]).bit_length()
        out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
        large = rest[out]
        rest[out] = 0
        part = struct.pack("<IBBH", low, width, 0, len(out)) + pack(rest, width) + out.astype("<u2").tobytes() + large.astype("<u4").tobytes()
        starts.append(size)
        body.append(part)
        size += len(part)
    return starts, b"".join(body)


def decode_block(body: memoryview, n: int) -> np.ndarray:
    low, width, _, large = struct.unpack_from("<IBBH", body)
    packed = (n * width + 7) // 8
    ids = unpack(np.frombuffer(body, np.uint8, packed, 8), n, width)
    if large:
        places = np.frombuffer(body, "<u2", large, 8 + packed)
        ids[places] = np.frombuffer(body, "<u4", large, 8 + packed + 2 * large)
    return ids + np.uint32(low)


def to_file(doc_ids: np.ndarray, valid: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    starts, body = encode_blocks(ids)
    return b"".join([
        _HEAD.pack(b"TLPF", 1, BLOCK, len(doc_ids), len(ids), len(starts)),
        doc_ids.astype("<i8").tobytes(), valid.astype(np.uint8).tobytes(), lengths.astype("<u4").tobytes(),
        np.array(starts, "<u8").tobytes(), body,
    ])


def from_file(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them aren't null, ids of each document, all ids."""
    magic, version, block, docs, n, blocks = _HEAD.unpack_from(data)
    if magic != b"TLPF" or version != 1:
        raise ValueError("not a token file")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    valid = np.frombuffer(data, np.uint8, docs, at := at + 8 * docs).astype(bool)
    lengths = np.frombuffer(data, "<u4", docs, at := at + docs)
    starts = np.frombuffer(data, "<u8", blocks, at := at + 4 * docs)
    body = memoryview(data)[at + 8 * blocks :]
    parts = [decode_block(body[int(s) :], min(block, n - k * block)) for k, s in enumerate(starts)]
    return doc_ids, valid, lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, partitions: int | None = None) -> str:
    """Writes the ids of all ``docs`` (doc_id, text) in ascending document order; returns the folder."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(f"{folder}/data", recursive=True)
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            doc_ids, valid, lengths, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            file = f"part-{part:06d}-{shard:05d}-{uuid.uuid4().hex}.tlpf"
            with store.open_output_stream(f"{folder}/data/{file}") as out:
                out.write(to_file(doc_ids, valid, lengths, ids))
            row = [part, shard, file, int(doc_ids[0]), len(doc_ids), len(ids)]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "shard", "file", "first_doc", "n_docs", "n_ids"])

        for batch in pieces(batches, "text", 4 << 20, keep=True):
            bounds, ids = encoder(tokenizer).encode(batch.column("text"))
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            key = batch.column("doc_id")
            held.append((key.fill_null(0).to_numpy(), np.asarray(key.is_valid()), np.diff(bounds) + 1, ids))
            if sum(len(x[3]) for x in held) >= SHARD:
                yield flush()
                held, shard = [], shard + 1
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if partitions > 1:
        rows = rows.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(task, _MANIFEST).write.parquet(f"{path}/manifest")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of token files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids."""
    manifest = spark.read.parquet(f"{path}/manifest")
    # one row for each writing task
    sizes = {r["part"]: r["n"] for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    bases, total = {}, 0
    for part in sorted(sizes):
        bases[part], total = total, total + sizes[part]
    before = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("part", "shard", "file", before.cast("long").alias("before"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{folder}/data/{row['file']}") as source:
                    doc_ids, valid, lengths, ids = from_file(source.read())
                ends = np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [pa.array(doc_ids, mask=~valid), pa.array(starts + (bases[row["part"]] + row["before"])), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(partitions, "file").mapInArrow(task, schema)


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Writes ``docs`` as token files and reads them back."""
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, end_id), with_ids)


__all__ = ["decode_block", "encode_blocks", "from_file", "read_tokens", "to_file", "token_output", "write_tokens"]
