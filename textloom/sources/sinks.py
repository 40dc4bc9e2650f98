"""Where results go: split files, details and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_splits(rows: DataFrame, path: str, by: str = "split") -> None:
    """JSON lines, a folder for each value of ``by``."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def flat(rows: DataFrame) -> DataFrame:
    """Arrays of strings as sorted text joined by ``, ``, so that CSV can hold them."""
    arrays = {n for n, t in rows.dtypes if t == "array<string>"}
    return rows.select(*[F.array_join(F.array_sort(n), ", ").alias(n) if n in arrays else F.col(n) for n in rows.columns])


def write_details(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("overwrite").option("header", "true").csv(path)


def write_report(scores: DataFrame, path: str, details: DataFrame | None = None) -> None:
    """``scores`` as JSON lines below ``path``/json and as CSV with numbers to four places below ``path``/summary; ``details`` as CSV below ``path``/detailed."""
    scores.write.mode("overwrite").json(f"{path}/json")
    places = [F.round(n, 4).cast("decimal(38,4)").alias(n) if t in ("double", "float") else F.col(n) for n, t in scores.dtypes]
    write_details(scores.select(*places), f"{path}/summary")
    if details is not None:
        write_details(details, f"{path}/detailed")


def errors_together(missed: DataFrame, wrong: DataFrame, width: int = 100) -> DataFrame:
    """Both kinds of errors in one table; columns that one lacks hold N/A, contexts are cut at ``width``."""
    rows = missed.withColumn("error", F.lit("FN")).unionByName(wrong.withColumn("error", F.lit("FP")), allowMissingColumns=True)
    cells = {n: F.coalesce(F.col(n).cast("string"), F.lit("N/A")) for n in rows.columns}
    return rows.select(*[(F.left(c, F.lit(width)) if n == "context" else c).alias(n) for n, c in cells.items()])


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``old`` and ``new``; of those that share a key, one of ``new``."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.col("_new").desc(), F.xxhash64(*[c for c in new.columns if c != key]))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def cascade_deleted(tables: dict[str, DataFrame], gone: DataFrame, key: str = "session_id", keep: tuple[str, ...] = ("processing_log",)) -> dict[str, DataFrame]:
    """Every table without the keys in ``gone``; those in ``keep`` stay whole."""
    return {n: t if n in keep else t.join(gone.select(key), key, "left_anti") for n, t in tables.items()}
