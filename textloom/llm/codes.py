"""Vector codes of a product quantiser whose nearest entries are found by a VA-file.

A vector's components become integers, ``floor(SCALE * x)``, and are cut into ``PARTS`` consecutive
parts.  Each part position has a codebook, which starts as that part of the vectors of smallest
ids and is moved in rounds: every part goes to its nearest entry, then each entry becomes the
floor of its parts' mean.  A code is the parts' entries, two hex digits each.

Nearest entries come from a VA-file of the codebook: each coordinate of an entry is kept as the
number of one of ``2**BITS`` cells.  For a query, a table by dimension and cell holds the least and
the greatest squared distance to a point of the cell; their sums over an entry's cells bound its
distance from both sides.  Only entries whose lower bound is within the smallest upper bound are
compared, in integers; ties go to the lower index.

Each round is one scan of the table: a task adds up its own parts by entry, and the driver gets
the sums of a codebook's entries, whatever the number of vectors.

Defined cases: vectors that are null or empty or hold null or non-finite components are dropped, as
are those of another length than the most common one (ties: the shorter); a length that is no
multiple of ``PARTS`` is filled up with zeros.  Components beyond plus or minus ``MOST`` count as
``MOST``, so that sums of squares fit in 64 bits; sums over a label stop at the largest long.  Rows
without an id are coded, but start a codebook only where ids are lacking; of different vectors under
one id the smallest starts it; repeated rows are coded and weigh as often as they stand.  With fewer
ids than entries the codebooks are shorter.  Null labels are one label; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import small, temporary

SCALE, PARTS, ENTRIES, ROUNDS, BITS, MOST = 4096, 8, 16, 6, 4, 1 << 27
#: Labels with a larger share of the rows than one in so many get their sums by broadcast.
COMMON = 200
_LARGEST = (1 << 63) - 1


@dataclass
class Cells:
    """The VA-file of some entries: each coordinate's cell, and the cells' inclusive ranges by dimension."""

    entries: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = BITS) -> Cells:
        first, n = entries.min(0), 1 << bits
        width = np.maximum(1, -(-(entries.max(0) - first + 1) // n))
        cell = (entries - first) // width
        low = first[:, None] + width[:, None] * np.arange(n)
        return cls(entries, cell, low, low + width[:, None] - 1)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each query's squared distance to each entry."""
        lower = np.zeros((len(queries), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(queries.shape[1]):
            q = queries[:, d, None]
            below, above = self.low[d] - q, q - self.high[d]
            lower += (np.maximum(0, np.maximum(below, above)) ** 2)[:, self.cell[:, d]]
            upper += (np.maximum(np.abs(below), np.abs(above)) ** 2)[:, self.cell[:, d]]
        return lower, upper

    def candidates(self, queries: np.ndarray) -> np.ndarray:
        lower, upper = self.bounds(queries)
        return lower <= upper.min(1, keepdims=True)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nearest entry and the squared distance to it."""
        if not queries.shape[1]:
            return np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        row, entry = np.nonzero(self.candidates(queries))
        gap = queries[row] - self.entries[entry]
        far = np.full((len(queries), len(self.entries)), _LARGEST, np.int64)
        far[row, entry] = np.einsum("ij,ij->i", gap, gap)
        at = far.argmin(1)
        return at, far[np.arange(len(queries)), at]


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, x (array of int) of the vectors that are coded."""
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where(F.size("v") > 0)
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "n").limit(1).collect()
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x * SCALE))).cast("int"))
    return rows.where(F.size("v") == (common[0]["n"] if common else 0)).select("vec_id", "label", whole.alias("x"))


def _parts(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    """The integers of a batch as vectors by parts by components."""
    x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % parts))).reshape(batch.num_rows, parts, -1)


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over all rows."""
    parts, entries, size = books.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells.of(b) for b in books]
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _parts(batch, parts)
                for p in range(parts):
                    at, _ = cells[p].nearest(x[:, p])
                    np.add.at(total[p], at, x[:, p])
                    count[p] += np.bincount(at, minlength=entries)
        part, entry = np.nonzero(count)
        sums = [total[part, entry, d] for d in range(size)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (part, entry, count[part, entry], *sums)], names)

    names = ["part", "entry", "n", *(f"s{d}" for d in range(size))]
    sums = rows.mapInArrow(task, ", ".join(f"{c} long" for c in names))
    moved = books.copy()
    for r in sums.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in names[2:])).collect():  # parts * entries rows
        moved[r["part"], r["entry"]] = [r[c] // r["n"] for c in names[3:]]
    return moved


def _start(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks of the vectors of smallest ids, by part, entry and component."""
    ids = [r["vec_id"] for r in rows.select("vec_id").where("vec_id is not null").distinct().orderBy("vec_id").limit(entries).collect()]
    found = rows.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id")
    batches = found.select("x").toArrow().to_batches()
    if len(ids) < entries:
        batches += rows.where("vec_id is null").orderBy("x").select("x").limit(entries - len(ids)).toArrow().to_batches()
    vectors = [_parts(b, parts) for b in batches if b.num_rows]
    return np.concatenate(vectors).transpose(1, 0, 2).copy() if vectors else np.zeros((parts, 0, 0), np.int64)


def _digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of ``embeddings`` (vec_id, embedding, label)."""
    rows, drop = temporary(integers(embeddings), "integers")
    books = _start(rows, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = _moved(rows, books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells.of(b) for b in books] if books.size else []
        for batch in batches:
            if batch.num_rows:
                x = _parts(batch, parts)
                found = [cells[p].nearest(x[:, p]) for p in range(parts)]
                at = np.stack([f[0] for f in found], 1)
                code = [bytes(r).hex() for r in at.astype(np.uint8)]
                error = np.sum([f[1] for f in found], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = small(rows.mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    drop()
    return _with_sums(out).select("vec_id", "code", "error", "label_error", F.lit(_digest(books)).alias("codebooks_sha256"))


def _with_sums(coded: DataFrame) -> DataFrame:
    """``label_error``: a common label's sum is sent to its rows, the others are joined."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error")
    sums = small(coded.groupBy("label").agg(total, F.count(F.lit(1)).alias("n")).withColumnRenamed("label", "of"))
    common = sums.where(F.col("n") * COMMON > F.lit(coded.count()))  # fewer than COMMON rows
    same = F.col("label").eqNullSafe(F.col("of"))
    sent = coded.join(F.broadcast(common), same)
    return sent.unionByName(coded.join(F.broadcast(common), same, "left_anti").join(sums, same))
