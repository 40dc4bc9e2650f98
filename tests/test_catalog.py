"""Every catalog query with SQL against DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from textloom.plans import answers, assess, catalog, experiments, generate, measures, passages, ranking, records, retrieval, rewrite, samples, sessions  # noqa: F401

SF = "/root/testdata/sf0.001"


def rows(frame):
    def value(x):
        if isinstance(x, list) or getattr(x, "ndim", 0):
            return str([value(y) for y in x])
        if pd.isna(x):
            return "null"
        return f"{x:.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted("|".join(map(value, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations", "events", "orders", "customer"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = db.execute(catalog.SQL[name]).fetchdf()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert rows(got) == rows(expected)
