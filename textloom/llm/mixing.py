"""Mixing sources to target weights by capped water-filling.

The mix holds ``share`` times the words of all documents.  Each source's target is its weight
times a common level, but at most ``max_epochs`` times its size; what exceeds that is shared anew
by weight until none is above, which is the level at which the targets add up to the mix.
A source takes every document ``floor(target / size)`` whole times and fills the rest, in an order
dealt by a seeded hash, with further documents; the last of these may be cut, so that a source's
taken words are its target to the word.

Running totals are kept per (source, leading hash digits), so that no task holds a source.

Defined cases: a null source is a source of its own, the last; null, empty and blank texts have
size 0 and are never taken; null ids are hashed as an empty string; repeated rows are documents of
their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.storage import small

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3


def text_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """source, source_size, target of ``sizes`` (source, source_size), one row a source.

    Sources weigh ``weights`` in turn, in code point order, null last.  One task sees one row a
    source: the number of sources, not of documents, is what it holds.
    """
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    row = sizes.select("source", "source_size", F.element_at(turn, ((place - 1) % len(weights) + 1).cast("int")).alias("w"))
    row = row.select("*", (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"), (F.sum("source_size").over(everything) * F.lit(float(share))).alias("mix"))
    # sources by how soon they are full; the level if all sooner ones are full, which rises while
    # the next one is full below it and falls after that
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_ = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    row = row.select("*", ((F.col("mix") - full) / open_).alias("level"))
    level = F.coalesce(F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything), F.lit(float("inf")))
    return row.select("source", "source_size", F.least(F.col("cap"), F.col("w") * level).alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: str = "mix", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken and ``keep`` for all ``docs`` (doc_id, text, source)."""
    sized = small(docs.select(*keep, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_size(F.col("text").cast("string")).alias("size")))
    order = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = sized.withColumn("dealt", order).withColumn("bucket", F.substring("dealt", 1, DIGITS))
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    # this many rows a source at most: one for each value of the leading digits
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = small(buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(before), F.lit(0))))
    sources = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sources, weights, share, max_epochs)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.select("*", times.cast("long").alias("times"))
    targets = targets.withColumn("rest", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    buckets = buckets.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "bucket_size")
    inside = Window.partitionBy("source", "bucket").orderBy("dealt", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    there = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "source_size", "target", "times", "rest")
    rows = rows.join(there, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("inside")))
    return rows.select(*keep, "doc_id", "size", "source_size", "target", (F.col("size") * F.col("times") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each repetition, a cut one with the words it takes.

    Rows count each by themselves, also those that share an id or have none.
    A cut document keeps its first words with single blanks between them and its own ``n_chars``.
    """
    keyed = docs.withColumn("_key", F.xxhash64(*docs.columns))  # the same for equal rows only
    taken = mix_sources(keyed, keep=("_key",), **options).where("taken > 0").select("_key", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    rows = keyed.dropDuplicates(["_key"]).join(taken, "_key")
    whole = F.floor(F.col("_taken") / F.col("_size"))
    cut = F.col("_taken") - whole * F.col("_size")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), (whole + F.when(cut > 0, 1).otherwise(0)).cast("int"))))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    text = F.when(F.col("_copy") > whole, F.array_join(F.slice(words, F.lit(1), F.greatest(cut, F.lit(1)).cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_copy") > whole, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
