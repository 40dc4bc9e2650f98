"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to ``DIMS`` dimensions, a different slice of the sample's principal axes for
each of ``CURVES`` curves, shifted and put in Hilbert order.  A curve's keys are placed by the
sample's key quantiles, so a place is the share of all rows before it, and the places are cut into
blocks.  Each query meets, on every curve, the blocks within a window around its own place;
crowded blocks are dealt over several groups by id, each of which the queries visit.  A group gives
each query its nearest rows by exact distance; those of all groups and curves are merged.

The window comes from calibration: for ``PROBES`` queries the true neighbours are found by brute
force over all rows, and the narrowest window that holds ``TARGET`` of them on some curve is used.
Where even that asks for as much work as one full scan, as for vectors without structure, one
curve with a full window does the same exactly.

Only the fit has a bound: the axes, shifts and quantiles come from the ``SAMPLE`` vectors of
smallest hash.  Every row is indexed.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another
length than the most common one (ties: the smaller) take no part, nor do rows without an id; rows that
share id and vector are one, and of different vectors under one id the nearest counts; ties in distance
go to the smaller id; with fewer candidates than k all are returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.curves import hilbert_keys
from textloom.llm.storage import small, written

CURVES, DIMS, BITS, SAMPLE, PROBES, TARGET = 4, 6, 10, 4096, 32, 0.95
BLOCK_ROWS, GROUP_QUERIES = 8192, 20_000
_WINDOWS = (0.002, 0.005, 0.01, 0.02, 0.04, 0.08)


def usable(embeddings: DataFrame) -> DataFrame:
    """id, v (array of double) of the vectors that take part."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(sound)
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), "n").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass
class Curves:
    """The fitted curves: ``places`` gives each vector's place on each."""

    mean: np.ndarray
    axes: list[np.ndarray]
    low: list[np.ndarray]
    span: list[np.ndarray]
    keys: list[np.ndarray]

    def key(self, curve: int, x: np.ndarray) -> np.ndarray:
        cells = ((x - self.mean) @ self.axes[curve] - self.low[curve]) / self.span[curve] * (1 << BITS)
        return hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1).astype(np.int64), BITS)

    def places(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(k, self.key(c, x), "left") / max(1, len(k)) for c, k in enumerate(self.keys)], axis=1)


def fit(sample: np.ndarray, curves: int = CURVES) -> Curves:
    mean = sample.mean(0)
    _, _, turn = np.linalg.svd(sample - mean, full_matrices=False)
    dims, rng = min(DIMS, sample.shape[1]), np.random.default_rng(11)
    axes, low, span = [], [], []
    for c in range(curves):
        own = turn[[(c * dims + k) % len(turn) for k in range(dims)]] if c else turn[:dims]
        own = np.pad(own, ((0, dims - len(own)), (0, 0)))
        p = (sample - mean) @ own.T
        a, b = p.min(0), p.max(0)
        room = max(float((b - a).max()), 1e-12)  # of all axes alike, so that a cell is as wide on each and narrow axes don't split neighbours
        axes.append(own.T)
        span.append(np.full(dims, room * 1.5))
        low.append(a - room * (0.05 + 0.4 * rng.random(dims)))  # the shift
    out = Curves(mean, axes, low, span, [])
    out.keys = [np.sort(out.key(c, sample)) for c in range(curves)]
    return out


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row id and distance of each query's k nearest rows, ties to the smaller id."""
    outs: list[tuple] = []
    norms = (x * x).sum(1)
    for at in range(0, len(q), 512):
        own = q[at : at + 512]
        rough = norms[None, :] - 2 * (own @ x.T)  # squared distance less the query's own norm
        rough[query_ids[at : at + 512, None] == ids[None, :]] = np.inf
        if len(ids) > k:
            edge = np.partition(rough, k - 1, axis=1)[:, k - 1]
            scale = np.abs(norms).max() + (own * own).sum(1)
            hit = rough <= (edge + 1e-9 * scale)[:, None]
        else:
            hit = np.ones(rough.shape, bool)
        hit &= np.isfinite(rough)
        row, col = np.nonzero(hit)
        exact = np.sqrt(((own[row] - x[col]) ** 2).sum(1))
        order = np.lexsort((ids[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, row, "left")
        keep = np.arange(len(row)) - first < k
        outs.append((query_ids[at + row[keep]], ids[col[keep]], exact[keep]))
    return tuple(np.concatenate(c) for c in zip(*outs, strict=True)) if outs else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _window(rows: DataFrame, curves: Curves, queries: DataFrame, k: int) -> float | None:
    """Half the window as a share of all rows; None for a full scan."""
    probes = queries.orderBy(F.xxhash64("id"), "id").limit(PROBES).toArrow()
    query_ids, q = probes.column("id").to_numpy(), _matrix(probes.column("v"))
    if not len(query_ids):
        return None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column("id").to_numpy(), _matrix(batch.column("v"))
                query, row, distance = nearest(ids, x, query_ids, q, k)
                row_at = {i: n for n, i in enumerate(ids.tolist())}
                there = curves.places(x[[row_at[i] for i in row.tolist()]])
                near = np.abs(there - asked[[query_at[i] for i in query.tolist()]]).min(1)
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(row), pa.array(distance), pa.array(near)], ["query_id", "id", "score", "away"])

    query_at, asked = {i: n for n, i in enumerate(query_ids.tolist())}, curves.places(q)
    best = rows.mapInArrow(task, "query_id long, id long, score double, away double")
    best = best.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("n") <= k)
    away = np.sort(best.select("away").toArrow().column("away").to_numpy())  # PROBES * k rows
    needed = away[min(len(away) - 1, int(np.ceil(TARGET * len(away))))] if len(away) else 1.0
    fitting = [w for w in _WINDOWS if w >= needed]
    return fitting[0] if fitting and 2 * fitting[0] * len(curves.keys) < 0.7 else None


def search(embeddings: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row of ``embeddings`` (vec_id, embedding) for which ``is_query``."""
    spark = embeddings.sparkSession
    rows = written(usable(embeddings).distinct(), "vectors")
    total = rows.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    queries = rows.where(is_query)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    curves = fit(_matrix(sample.column("v")))
    half = _window(rows, curves, queries, k)
    blocks = max(1, -(-total // BLOCK_ROWS))
    used = 1 if half is None else len(curves.keys)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.minimum((curves.places(_matrix(batch.column("v")))[:, :used] * blocks).astype(np.int32), blocks - 1)
            for c in range(used):
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(at[:, c])], ["id", "v", "curve", "block"])

    schema = "id long, v array<double>, curve int, block int"
    indexed = rows.mapInArrow(placed, schema)
    # groups in each block, by its rows; one row for each block
    crowd = small(indexed.groupBy("curve", "block").agg(F.ceil(F.count(F.lit(1)) / (2 * BLOCK_ROWS)).cast("int").alias("groups")))
    chunks = max(1, -(-queries.count() // GROUP_QUERIES)) if half is None else 1
    reach = blocks if half is None else int(np.ceil(half * blocks))
    deal = F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("part")
    chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    held = indexed.join(crowd, ["curve", "block"]).select("id", "v", "curve", "block", deal, chunk)
    visits = F.sequence(F.greatest(F.lit(0), F.col("block") - reach), F.least(F.lit(blocks - 1), F.col("block") + reach))
    asked = queries.mapInArrow(placed, schema).select("id", "v", "curve", F.explode(visits).alias("block"), F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int").alias("chunk"))
    asked = asked.join(crowd, ["curve", "block"]).select("id", "v", "curve", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "chunk")

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            out = nearest(left.column("id").to_numpy(), _matrix(left.column("v")), right.column("id").to_numpy(), _matrix(right.column("v")), k)
        else:
            out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([pa.array(c) for c in out], ["query_id", "vec_id", "score"])

    keys = ("curve", "block", "part", "chunk")
    found = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(group, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
