"""Results that are kept and taken up again: only rows whose content is new are computed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.scratch import exists

DIGEST = "content"


def content(columns: Sequence[str]) -> Column:
    """Digest of the columns' values; null differs from empty, and lengths keep values apart."""
    cells = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws("|", *cells), 256)


def resumed(spark: SparkSession, path: str, rows: DataFrame, by: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with what ``compute`` adds to them, by their content in the columns ``by``.

    ``compute`` gets one row for each new content, with the digest in ``content``, and keeps that
    column.  Its results are appended at ``path`` as one commit; contents that stand there aren't
    computed again, whatever became of the other columns.
    """
    now = rows.withColumn(DIGEST, content(by))
    todo = now.dropDuplicates([DIGEST])
    if exists(spark, path):
        todo = todo.join(spark.read.parquet(path).select(DIGEST), DIGEST, "left_anti")
    added = compute(todo)
    added.select(DIGEST, *[c for c in added.columns if c not in now.columns]).write.mode("append").parquet(path)
    return now.join(spark.read.parquet(path), DIGEST)


def folded(results: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """by, n, total, mean, right: scores folded in over all results; right ones score 1."""
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("total"), F.avg(score).alias("mean"), F.count_if(F.col(score) == 1).alias("right"))
