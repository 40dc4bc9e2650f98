"""Relevance labels of questions, and measures of ranked hits against them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labels(answers: DataFrame, node: str = "node_id", answer: str = "answer") -> DataFrame:
    """query_id, question, ordinal, node_id: the questions in a model's answer, one a line, each relevant to the node that it was asked about.

    A leading number with ``)``, ``.`` or a blank is taken off and blank lines go.  Ids are digests of
    node, place and question, so that reruns agree.
    """
    lines = answers.select(F.col(node).alias("node_id"), F.posexplode(F.split(F.trim(answer), "\n")).alias("ordinal", "line"))
    rows = lines.select("node_id", "ordinal", F.regexp_replace(F.trim("line"), r"^\d+[).\s]", "").alias("question")).where("question <> ''")
    return rows.select(F.left(F.sha2(F.concat_ws("\x1f", F.col("node_id").cast("string"), F.col("ordinal").cast("string"), "question"), 256), F.lit(32)).alias("query_id"), "question", "ordinal", "node_id")


def measures(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, n_relevant, recall, reciprocal_rank, gain of each query that has relevant ids.

    ``hits`` holds query_id, rank (from 1) and id, ``relevant`` query_id, id and a grade above 0; ids
    don't repeat in a query.  Recall is the share of relevant ids in the first ``k``; the reciprocal
    rank that of the first relevant one there; the gain is discounted by log2(rank + 1) and divided by
    the gain of the ideal order.  A query without hits has zeros.
    """
    best = relevant.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc())))
    ideal = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"), F.sum(F.when(F.col("_r") <= k, F.col("grade") * _discount(F.col("_r")))).alias("ideal"))
    return _measured(hits.where(F.col("rank") <= k).join(relevant, ["query_id", "id"]), ideal)


def measures_by_group(hits: DataFrame, members: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``measures`` where the members of a query's group are relevant, itself aside; they aren't laid out query by query.

    ``members`` holds id, group and grade, ``queries`` query_id and group; a null id or group takes no part.
    """
    members, queries = members.dropna(subset=["id", "group"]), queries.dropna(subset=["query_id", "group"])
    order = Window.partitionBy("group").orderBy(F.col("grade").desc(), "id")
    top = members.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)  # one may be the query
    top = top.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("_r", "id", "grade"))).alias("top"))
    groups = members.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).join(top, "group")
    own = queries.join(members.select(F.col("id").alias("query_id"), "group", F.lit(1).alias("_own")), ["query_id", "group"], "left").join(groups, "group")
    best = F.slice(F.filter("top", lambda m: m["id"] != F.col("query_id")), 1, k)
    ideal = F.aggregate(F.transform(best, lambda m, i: m["grade"] * _discount(i + 1)), F.lit(0.0), lambda a, x: a + x)
    ideal = own.select("query_id", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("n_relevant"), ideal.alias("ideal")).where("n_relevant > 0")
    found = hits.where(F.col("rank") <= k).where("id <> query_id").join(queries, "query_id").join(members, ["id", "group"])
    return _measured(found, ideal)


def _discount(rank: Column) -> Column:
    return 1 / F.log2(rank + F.lit(1.0))


def _measured(found: DataFrame, ideal: DataFrame) -> DataFrame:
    """The measures of ``found`` (query_id, rank, grade) against ``ideal`` (query_id, n_relevant, ideal)."""
    got = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("hit"), F.min("rank").alias("first"), F.sum(F.col("grade") * _discount(F.col("rank"))).alias("got"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = ideal.join(got, "query_id", "left")
    return rows.select("query_id", "n_relevant", zero(F.col("hit") / F.col("n_relevant")).alias("recall"), zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.col("got") / F.col("ideal")).alias("gain"))
