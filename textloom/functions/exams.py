"""Accuracy of answered exams by subject, by category of subjects and over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_accuracy(answers: DataFrame, mapping: DataFrame, other: str = "other") -> DataFrame:
    """level, category, subject, n, n_right, accuracy of ``answers`` (subject, right boolean).

    ``mapping`` (subject, category, place) may name a subject often: the category of the greatest
    place wins, of equal places the one that sorts last.  A subject without one is in ``other``.
    ``level`` is subject, category (subject is null) or all (both are null); a null subject is a
    subject.  A null ``right`` is wrong.  Without answers there are no rows.  Answers are summed by
    subject before anything is joined.
    """
    per = answers.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.count_if("right").alias("n_right"))
    named = mapping.where("category is not null and place is not null").groupBy(F.col("subject").alias("_subject")).agg(F.max_by("category", F.struct("place", "category")).alias("category"))
    rows = per.join(named, F.col("subject").eqNullSafe(F.col("_subject")), "left").withColumn("category", F.coalesce("category", F.lit(other)))
    sums = rows.rollup("category", "subject").agg(F.grouping_id().alias("_level"), F.sum("n").alias("n"), F.sum("n_right").alias("n_right"))
    level = F.when(F.col("_level") == 0, "subject").when(F.col("_level") == 1, "category").otherwise("all")
    return sums.select(level.alias("level"), "category", "subject", "n", "n_right", (F.col("n_right") / F.col("n")).alias("accuracy"))
