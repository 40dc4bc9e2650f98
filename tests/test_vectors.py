"""Search against plain loops: every measure, scopes, earlier ids, several blocks, ties, vectors that can't be compared."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import vectors

SCORE = {
    "l2": lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b)),
    "dot": lambda a, b: -sum(x * y for x, y in zip(a, b)),
    "cosine": lambda a, b: -sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b)) if any(a) and any(b) else None,
}


@pytest.mark.parametrize("measure", sorted(SCORE))
@pytest.mark.parametrize("scope,earlier", [(None, False), ("lang", False), ("lang", True)])
def test_search(spark, monkeypatch, measure, scope, earlier):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vectors, "_PAIRS", 64)
    rows = [(k, [float(k * 7 % 5), float(k * 11 % 3), 1.0], "ab"[k % 2]) for k in range(40)]  # many ties
    rows += [(50, [0.0, 0.0, 0.0], "a"), (51, [1.0, 2.0], "a"), (52, [2.0, 1.0], "a"), (53, None, "a"), (54, [1.0, None, 2.0], "b"), (55, [float("nan")] * 3, "b"), (56, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], "a")]
    table = spark.createDataFrame(rows, "vec_id long, v array<double>, lang string").repartition(3)
    asked = table.where("vec_id % 3 <> 1").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "lang")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in vectors.search(table, asked, 4, measure, scope, earlier).collect())
    good = [r for r in rows if r[0] is not None and r[1] is not None and None not in r[1] and r[1] == r[1] and not any(math.isnan(x) for x in r[1]) and (scope is None or r[2] is not None)]
    expected = []
    for i, q, own in (r for r in good if r[0] % 3 != 1):
        near = [(SCORE[measure](q, v), k) for k, v, lang in good if len(v) == len(q) and (k < i if earlier else k != i) and (scope is None or lang == own)]
        near = sorted((round(s, 9), k) for s, k in near if s is not None)[:4]
        expected += [(i, n + 1, k, s) for n, (s, k) in enumerate(near)]
    assert [(q, n, s) for q, n, _, s in got] == [(q, n, s) for q, n, _, s in sorted(expected)]
    if measure == "l2":  # exact scores, so ties are exact too
        assert got == sorted(expected)
    assert vectors.search(table.limit(0), asked, 4, measure, scope).count() == 0 and vectors.search(table, asked.limit(0), 4, measure, scope).count() == 0


@pytest.mark.parametrize("measure", sorted(SCORE))
def test_products_leave_exact_scores(monkeypatch, measure):
    """Rows near a query by less than a product's error are told apart as by sums over components, and odd lengths aren't lost."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 16)) * 1e3
    v = np.concatenate([base, base + rng.normal(size=base.shape) * 1e-12, base[:4] * 1e-170, base[:4] * 1e170, np.zeros((1, 16)), np.full((1, 16), np.inf)])
    ids = np.arange(len(v))
    for q in (v[:40], v):  # all usual, and with odd lengths
        with np.errstate(all="ignore"):
            score = vectors.MEASURES[measure](q, v)
        monkeypatch.setattr(vectors, "_PAIRS", 7 * len(q))
        best = vectors._Best(ids[: len(q)], np.zeros(len(q), np.int64), q, 5)
        with np.errstate(all="ignore"):
            best.meet(ids, np.zeros(len(v), np.int64), v, measure, False)
        got = {i: [(s, k) for o, k, s in zip(best.of, best.vec, best.score) if o == i] for i in range(len(q))}
        for i in range(len(q)):
            assert got[i] == sorted((s, k) for k, s in enumerate(score[i]) if k != i and not math.isnan(s))[:5]


def test_rows_are_read_once_for_many_queries(spark):
    """20,000 queries are one block, not three, each of which read all rows."""
    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    plan = vectors.search(rows, rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("measure", sorted(SCORE))
def test_many_copies_are_scored_piece_by_piece(monkeypatch, measure):
    """copies are all as near as the best, so that all their pairs are scored anew, but not laid out at once."""
    sizes, score = [], vectors._of_pairs
    monkeypatch.setattr(vectors, "_of_pairs", lambda measure, q, *rest: sizes.append(len(q)) or score(measure, q, *rest))
    v = np.ones((300, 4))
    best = vectors._Best(np.arange(300), np.zeros(300, np.int64), v, 3)
    best.meet(np.arange(300), np.zeros(300, np.int64), v, measure, False)
    assert sum(sizes) == 300 * 299 and max(sizes) <= 8192
    assert best.rows[5].tolist() == [0, 1, 2] and best.rows[1].tolist() == [0, 2, 3]


def test_queries_beyond_a_tile(monkeypatch):
    monkeypatch.setattr(vectors, "_TILE", 16)
    v = np.random.default_rng(1).normal(size=(100, 8))
    got = {}
    for measure in SCORE:
        best = vectors._Best(np.arange(50), np.zeros(50, np.int64), v[:50], 4)
        for a in range(0, 100, 30):
            best.meet(np.arange(100)[a : a + 30], np.zeros(len(v[a : a + 30]), np.int64), v[a : a + 30], measure, False)
        score = vectors.MEASURES[measure](v[:50], v)
        score[np.arange(50), np.arange(50)] = np.inf
        got[measure] = (best.rows == np.argsort(score, axis=1)[:, :4]).all()
    assert all(got.values())
