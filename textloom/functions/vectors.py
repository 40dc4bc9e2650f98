"""Vector measures as column expressions, and search of blocks of queries against all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors sent whole at a time; more go in further blocks.
QUERY_BLOCK = 32768


def parsed(text: Column) -> Column:
    """Vector of comma-separated numbers; what isn't one is null."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Similarity; null where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _totals(q: np.ndarray, v: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over components in their order, as the column expressions add, for each of ``q`` against each of ``v``."""
    out = np.zeros((len(q), len(v)))
    for x, y in zip(q.T, v.T, strict=True):
        out += term(x[:, None], y[None, :])
    return out


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x * y


def _gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x - y) * (x - y)


def _norms(v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v))
    with np.errstate(over="ignore"):
        for x in v.T:
            out += x * x
    return np.sqrt(out)


def _cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return -(_totals(q, v, _product) / (_norms(q)[:, None] * _norms(v)[None, :]))


#: Scores of which the smallest is best, of blocks of queries and rows.
MEASURES = {"l2": lambda q, v: _totals(q, v, _gap), "cosine": _cosines, "dot": lambda q, v: -_totals(q, v, _product)}

#: Pairs that a task scores at once, queries of these, and pairs near the best that are scored anew at once.
_PAIRS, _TILE, _NEAR = 1 << 20, 2048, 8192
#: Squared lengths whose products and roots neither overflow nor vanish.
_TAME = (1e-140, 1e140)


def _tame(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths, and which vectors can be scored by matrix products: zero ones and those of usual lengths."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares = np.einsum("ij,ij->i", v, v)
    return squares, ((squares > _TAME[0]) & (squares < _TAME[1])) | ~v.any(axis=1)


def _units(v: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Vectors of length one, in single precision; those without length stay zero."""
    return np.divide(v, norms[:, None], out=np.zeros(v.shape, np.float32), where=norms[:, None] > 0, casting="same_kind")


def _bounds(measure: str, q: np.ndarray, q2: np.ndarray, v: np.ndarray, v2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores by a matrix product, and how far each query's may be from those by sums over components; for cosine, ``q`` and ``v`` are units."""
    if measure == "cosine":
        product = q @ -v.T
        product[:, v2 == 0] = np.inf  # a vector without length has no score
        return product, np.full(len(q), (q.shape[1] + 8) * np.finfo(np.float32).eps)
    product = q @ v.T
    eps = 4 * (q.shape[1] + 4) * np.finfo(float).eps
    most = v2.max(initial=0.0)
    if measure == "l2":
        product *= -2
        product += q2[:, None]
        product += v2[None, :]
        return product, eps * (np.sqrt(q2) + np.sqrt(most)) ** 2
    return -product, eps * np.sqrt(q2) * np.sqrt(most)


def _of_pairs(measure: str, q: np.ndarray, v: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Scores of pairs, added up as those of blocks are; ``norms`` are the products of their lengths."""
    if not q.shape[1]:
        total = np.zeros(len(q))
    else:
        total = np.add.accumulate(_gap(q, v) if measure == "l2" else q * v, axis=1)[:, -1] + 0.0
    if measure == "l2":
        return total
    with np.errstate(invalid="ignore", divide="ignore"):
        return -total if measure == "dot" else -(total / norms)


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, starts = vectors.values.to_numpy(), vectors.offsets.to_numpy()[:-1]
    if len(lengths) and (lengths == lengths[0]).all():
        yield np.arange(len(lengths)), flat[starts[0] : starts[0] + lengths.sum()].reshape(len(lengths), lengths[0])
        return
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, flat[starts[at][:, None] + np.arange(n)]


class _Best:
    """The k best rows so far for each of some queries of one length."""

    def __init__(self, ids: np.ndarray, scopes: np.ndarray, q: np.ndarray, k: int) -> None:
        self.ids, self.scopes, self.q, self.k = ids, scopes, q, k
        self.scores, self.rows = np.full((len(ids), k), np.nan), np.zeros((len(ids), k), np.int64)
        self.limit = np.full(len(ids), np.inf)
        self.squares, self.tame = _tame(q)
        self.norms = _norms(q)
        self.units: np.ndarray | None = None

    @property
    def of(self) -> np.ndarray:
        return np.nonzero(~np.isnan(self.scores))[0]

    @property
    def vec(self) -> np.ndarray:
        return self.rows[~np.isnan(self.scores)]

    @property
    def score(self) -> np.ndarray:
        return self.scores[~np.isnan(self.scores)]

    def meet(self, vec: np.ndarray, scopes: np.ndarray, v: np.ndarray, measure: str, earlier: bool) -> None:
        """Rows are first scored by a matrix product; pairs that this leaves in doubt are scored as ``MEASURES`` says."""
        squares, tame = _tame(v)
        quick = bool(self.tame.all())
        if quick and measure == "cosine" and self.units is None:
            self.units = _units(self.q, self.norms)
            self.limit[self.norms == 0] = -np.inf  # such a query finds nothing
        step = max(1, _PAIRS // max(1, min(len(self.ids), _TILE)))
        for rows, fast in ((np.flatnonzero(tame), True), (np.flatnonzero(~tame), False)) if quick else ((np.arange(len(v)), False),):
            for a in range(0, len(rows), step):
                at = rows[a : a + step]
                own, norms = v[at], _norms(v[at])
                units = _units(own, norms) if fast and measure == "cosine" else None
                for b in range(0, len(self.ids), _TILE):
                    self._meet(slice(b, b + _TILE), vec[at], scopes[at], own, squares[at], norms, units, measure, earlier, fast)

    def _meet(self, part: slice, ids: np.ndarray, scopes: np.ndarray, v: np.ndarray, squares: np.ndarray, norms: np.ndarray, units: np.ndarray | None, measure: str, earlier: bool, fast: bool) -> None:
        q, limit, slack = self.q[part], self.limit[part], np.zeros(1)
        if not fast:
            score = MEASURES[measure](q, v)
        elif units is None:
            score, slack = _bounds(measure, q, self.squares[part], v, squares)
        else:
            score, slack = _bounds(measure, self.units[part], self.squares[part], units, squares)
        scoped = self.scopes[part].any() or scopes.any()
        if len(ids) > self.k and (limit == np.inf).any():  # the first rows: those of a step can't all be among the best
            apart = ids[None, :] >= self.ids[part, None] if earlier else ids[None, :] == self.ids[part, None]
            if scoped:
                apart |= scopes[None, :] != self.scopes[part, None]
            score[apart] = np.nan
            limit = np.fmin(limit, np.partition(score, self.k - 1, axis=1)[:, self.k - 1] + slack)
        of, to = np.divmod(np.flatnonzero(score <= (limit + slack).astype(score.dtype)[:, None]), len(ids))
        apart = ids[to] >= self.ids[part][of] if earlier else ids[to] == self.ids[part][of]
        if scoped:
            apart |= scopes[to] != self.scopes[part][of]
        of, to = of[~apart], to[~apart]
        if not len(of):
            return
        own = self.norms[part]
        near = [_of_pairs(measure, q[of[a : a + _NEAR]], v[to[a : a + _NEAR]], own[of[a : a + _NEAR]] * norms[to[a : a + _NEAR]]) for a in range(0, len(of), _NEAR)] if fast else [score[of, to]]
        self._take(of + part.start, ids[to], np.concatenate(near))

    def _take(self, of: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        """Rows found go among the best of the queries that they meet, other queries aren't touched; ``of`` ascends."""
        ok = score <= self.limit[of]
        if not ok.any():
            return
        some, of = np.unique(of[ok], return_inverse=True)
        of = np.append(np.repeat(np.arange(len(some)), self.k), of)
        vec, score = np.append(self.rows[some], vec[ok]), np.append(self.scores[some], score[ok])
        order = np.lexsort((vec, score, of))  # what isn't a number, a free place, goes last
        first = np.flatnonzero(np.append(True, np.diff(of[order]) > 0))
        kept = order[first[:, None] + np.arange(self.k)]
        self.rows[some], self.scores[some] = vec[kept], score[kept]
        last = self.scores[some, -1]
        self.limit[some] = np.where(np.isnan(last), np.inf, last)


def search(rows: DataFrame, queries: DataFrame, k: int, measure: str = "l2", scope: str | None = None, earlier: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the best ``k`` of ``rows`` (vec_id, v) for each of ``queries`` (query_id, q), not itself.

    ``scope`` names a column that both must share; ``earlier`` leaves only smaller ids.  Queries go
    out in blocks of about ``QUERY_BLOCK``; a task scores its rows against a block by matrix products (cosine's in single precision),
    those near its best anew by sums over components, and yields k rows a query.  ``rows`` are read once
    a block: what is dear to compute should be written first.  Ids are integers; a null id, scope, vector or component takes no part, and
    neither does a pair of different lengths or whose score isn't a number.
    """
    shape = lambda rows, key, v: rows.select(F.col(key).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"), (F.lit("") if scope is None else F.col(scope).cast("string")).alias("scope")).where(F.col("v").isNotNull() & F.col("id").isNotNull() & F.col("scope").isNotNull())
    asked, rows = shape(queries, "query_id", "q"), shape(rows, "vec_id", "v")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()
        found = rows.mapInArrow(_task(own, k, measure, earlier), "query_id long, vec_id long, score double")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def _task(own: pa.Table, k: int, measure: str, earlier: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = pc.unique(own.column("scope"))

    def parts(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, v, scope = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (batch.column(x) for x in ("id", "v", "scope")))
        ids, scope = ids.to_numpy(), pc.fill_null(pc.index_in(scope, value_set=names), -1).to_numpy()
        if v.values.null_count:
            holes, edges = np.append(0, np.cumsum(v.values.is_null().to_numpy(zero_copy_only=False))), v.offsets.to_numpy()
            whole = np.flatnonzero(holes[edges[1:]] == holes[edges[:-1]])
            v, ids, scope = v.take(pa.array(whole)), ids[whole], scope[whole]
        for at, matrix in _by_length(v):
            yield ids[at], scope[at], matrix

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not own.num_rows:
            return
        best = {q.shape[1]: _Best(ids, scope, q, k) for ids, scope, q in parts(own)}
        for batch in batches:
            for ids, scope, v in parts(batch):
                if v.shape[1] in best:
                    best[v.shape[1]].meet(ids, scope, v, measure, earlier)
        for x in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(x.ids[x.of]), pa.array(x.vec), pa.array(x.score)], ["query_id", "vec_id", "score"])

    return task
