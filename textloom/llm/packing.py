"""Packing along a space-filling curve.

Each document's vector of hashed byte trigrams is projected to ``DIMS`` dimensions; the Hilbert
key of the projection orders the documents.  Spark range-partitions and sorts them by that key
(ties by id, so that copies spread over partitions), and each partition's ids, one document after
the other, are cut into sequences of ``length``.  Neighbours in a sequence are alike, only a
partition's last sequence is short, and no id is dropped or repeated.

Defined cases: a null or empty text is its end id alone; null document ids and repeated rows are
packed like any other; other columns are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.curves import hilbert_keys
from textloom.llm.encoding import encoder
from textloom.llm.words import CACHES, give_back, pieces, raw

DIMS, BITS, SPREAD = 4, 15, 24.0
#: Bytes of text that a worker projects or encodes at once; each takes some 25 bytes there.
_PIECE = 1 << 20
_SIGNS = np.where(np.random.default_rng(7).random((DIMS, 1 << 16)) < 0.5, -1, 1).astype(np.int8)
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def projections(texts: pa.Array) -> np.ndarray:
    """A row of DIMS coordinates for each text: the mean sign vector of its hashed trigrams."""
    bounds, data = raw(texts)
    n = len(bounds) - 1
    out = np.zeros((n, DIMS))
    if len(data) < 3:
        return out
    d = data.astype(np.uint16)
    grams = d[:-2] * np.uint16(40503) + d[1:-1] * np.uint16(24317) + d[2:] * np.uint16(9973)
    grams = np.append(grams ^ (grams >> np.uint16(7)), np.zeros(2, np.uint16))
    full = np.flatnonzero(np.diff(bounds) > 0)
    for k in range(DIMS):
        sums = np.add.reduceat(_SIGNS[k][grams], bounds[full], dtype=np.int64)
        out[full, k] = sums / np.diff(bounds)[full]
    return out


def curve_key(texts: pa.Array) -> np.ndarray:
    """Hilbert key of each text."""
    cells = (np.arctan(projections(texts) * SPREAD) / np.pi + 0.5) * (1 << BITS)
    return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)


def key_column(text: Column) -> Column:
    @F.arrow_udf("long")
    def key(texts: pa.Array) -> pa.Array:
        for drop in CACHES:
            drop()
        bounds, _ = raw(texts)
        out, at = [], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _PIECE, "right")) - 1)
            out.append(curve_key(texts.slice(at, to - at)))
            at = to
        give_back()
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))

    return key(text)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = 2048, partitions: int | None = None) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text): which ids of a document stand where in which sequence."""
    partitions = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stream = 0  # ids of this partition so far
        base = TaskContext.get().partitionId() << 36
        for batch in pieces(batches, "text", _PIECE, keep=True):
            bounds, ids = encoder(tokenizer).encode(batch.column("text"))
            ids = np.insert(ids, bounds[1:], np.uint32(end_id))
            bounds = bounds + np.arange(len(bounds))
            cuts = np.arange(-(-stream // length) * length, stream + len(ids), length) - stream
            edges = np.union1d(bounds, cuts)
            starts, ends = edges[:-1], edges[1:]
            doc = np.searchsorted(bounds, starts, "right") - 1
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            at = starts + stream
            columns = [starts - bounds[doc], ends - starts, np.array(crc, np.int64), np.diff(bounds)[doc], base + at // length, at % length]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *map(pa.array, columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            stream += len(ids)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("curve", key_column(F.col("text")))
    if partitions > 1:
        rows = rows.repartitionByRange(partitions, "curve", "doc_id", F.xxhash64("text"))
    return rows.sortWithinPartitions("curve", "doc_id", "text").mapInArrow(task, _SCHEMA)
