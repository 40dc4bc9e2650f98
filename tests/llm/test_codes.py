"""Vector codes: the VA-file against all distances, the operator against a plain version."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from textloom.llm import codes
from textloom.llm.queries import ORACLE_SQL, op11_vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n long"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, l, [math.floor(4096 * x) for x in v]) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    cut = [[v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)] for _, _, v in kept]
    first, seen = [], set()
    for k in sorted((k for k in range(len(kept)) if kept[k][0] is not None), key=lambda k: (kept[k][0], kept[k][2])):
        if kept[k][0] not in seen:
            seen.add(kept[k][0])
            first.append(k)
    books = [[cut[k][p] for k in first[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                of = [c[p] for c, o in zip(cut, own, strict=True) if o == e]
                if of:
                    books[p][e] = [sum(col) // len(of) for col in zip(*of, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    label = {}
    for (_, of, _), e in zip(kept, error, strict=True):
        label[of] = label.get(of, 0) + e
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, label[of], digest) for (i, of, _), f, e in zip(kept, found, error, strict=True))


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    near = [(k, [float(x) for x in rng.normal(k % 7, 0.3, 16).astype("f4")], None if k % 5 == 0 else k % 2) for k in range(90)]
    odd = [(100, None, 1), (101, [None] * 16, 1), (102, [float("nan")] * 16, 1), (103, [float("inf")] + [0.0] * 15, 0), (104, [], 0), (None, [1.5] * 16, 0), (None, [-0.0001] * 16, None)]
    return [*near, *odd, near[3], (3, [0.25] * 16, 1)]  # a repeated row, and another vector under its id


def test_cells_bound_distances_and_skip_entries():
    rng = np.random.default_rng(1)
    for entries in (rng.integers(-4000, 4000, (16, 8)), np.zeros((5, 8), np.int64), rng.integers(-codes.MOST, codes.MOST, (16, 8)), np.array([[-5] * 8, [7] * 8])):
        cells = codes.Cells.of(entries)
        q = np.concatenate([rng.integers(-5000, 5000, (300, 8)), entries])
        exact = ((q[:, None] - entries[None]) ** 2).sum(2)
        lower, upper = cells.bounds(q)
        assert (lower <= exact).all() and (exact <= upper).all()
        at, far = cells.nearest(q)
        assert (at == exact.argmin(1)).all() and (far == exact.min(1)).all()
    q = rng.integers(-1000, 1000, (500, 8))
    assert codes.Cells.of(q[:16]).candidates(q).sum(1).mean() < 4


def test_vector_codes(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    assert got(codes.vector_codes(df)) == plain(rows)
    few = [r for r in rows if r[0] in (1, 2, 101)]
    assert got(codes.vector_codes(spark.createDataFrame([(*r, "c", 1) for r in few], SCHEMA))) == plain(few)


def test_empty_and_extreme(spark):
    assert codes.vector_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    big = [(1, [3e38] * 8, 1, "", 0), (2, [-3e38] * 8, 1, "", 0), (None, [1.0] * 8, None, "", 0), (5, [1.0] * 9, 1, "", 0)]
    out = {r["vec_id"]: r for r in codes.vector_codes(spark.createDataFrame(big, SCHEMA)).collect()}
    assert set(out) == {1, 2, None} and out[1]["error"] == 0 and out[1]["code"] != out[2]["code"]
    odd = spark.createDataFrame([(k, [float(k)] * 5, k, "", 0) for k in range(3)], SCHEMA)
    assert [r["error"] for r in codes.vector_codes(odd).collect()] == [0, 0, 0]


def test_many_labels_are_joined(spark, rows):
    own = [(k, v, k) for k, (_, v, _) in enumerate(rows) if v]
    assert got(codes.vector_codes(spark.createDataFrame([(*r, "c", 1) for r in own], SCHEMA))) == plain(own)


def test_query_matches_sql(spark):
    db = duckdb.connect()
    db.execute("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    out = op11_vector_codes(spark, "/root/testdata/sf0.001")
    expected = db.execute(ORACLE_SQL["op11_vector_codes"])
    names = [d[0] for d in expected.description]
    assert sorted(map(tuple, out.select(*names).collect())) == sorted(expected.fetchall())
