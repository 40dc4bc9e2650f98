"""A session's masked values as a kept table: numbered on from what is there, recovered by any of their names.

An entry is an occurrence: session, turn, start, stop, entity_type, entity_value, confidence, number,
placeholder (``${TYPE_001}``), entity_id (``TYPE_1``), hash_value, sensitivity.  The same value at two
places has two numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import spans
from textloom.sources.scratch import exists

PLACE = ["session", "turn", "entity_type", "start", "stop"]
ENTRY = "session long, turn long, entity_type string, start int, stop int, entity_value string, confidence double, number long, placeholder string, entity_id string, hash_value string, sensitivity int"
#: How a masked text shows an entry: what is looked for, and the entry's name in it.
FORMS = {
    "placeholder": (r"\$\{[A-Z_]+_\d+\}", "placeholder"),
    "numbered": (r"\[[A-Z_]+_\d+\]", "concat('[', entity_id, ']')"),
    "hash": (r"\[HASH:[a-f0-9]{16}\]", "concat('[HASH:', left(hash_value, 16), ']')"),
}
#: Turns that are numbered together; a session's turns are spread over as many tasks as it has runs of them.
TURNS = 1000


def checked(entities: Column, text: Column) -> Column:
    """Given entities that lie in the text, disjoint; types default to UNKNOWN, values to the text there, confidences to 1."""

    def whole(s: Column) -> Column:
        value = F.coalesce(s["entity_value"], F.substr(text, s["start"] + 1, s["stop"] - s["start"]))
        return F.struct(F.coalesce(s["entity_type"], F.lit("UNKNOWN")).alias("entity_type"), s["start"].alias("start"), s["stop"].alias("stop"), value.alias("entity_value"), F.coalesce(s["confidence"], F.lit(1.0)).alias("confidence"))

    return spans.merge_longest(F.transform(spans.valid(entities, text), whole))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The mapping kept at ``path``; an empty one if there is none yet."""
    return spark.read.schema(ENTRY).parquet(path) if exists(spark, path) else spark.createDataFrame([], ENTRY)


def additions(old: DataFrame, found: DataFrame) -> DataFrame:
    """Entries of ``found`` (session, turn, entity_type, start, stop, entity_value, confidence) whose places ``old`` lacks.

    Numbers go on from the highest of the session and type: turn by turn, in a text from its last span.
    """
    new = found.dropDuplicates(PLACE).join(old.select(*PLACE), PLACE, "left_anti").withColumn("_run", F.floor(F.col("turn") / TURNS))
    high = old.groupBy("session", "entity_type").agg(F.max("number").alias("_high"))
    kind, run = ["session", "entity_type"], Window.partitionBy("session", "entity_type", "_run")
    runs = new.groupBy(*kind, "_run").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*kind).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(high, kind, "left").select(*kind, "_run", (F.col("_before") + F.coalesce("_high", F.lit(0))).alias("_base"))
    own = F.row_number().over(run.orderBy("turn", F.col("start").desc(), "stop"))
    rows = new.withColumn("_own", own).join(runs, [*kind, "_run"]).withColumn("number", F.col("_base") + F.col("_own"))
    shown = F.when(F.col("number") < 1000, F.lpad(F.col("number").cast("string"), 3, "0")).otherwise(F.col("number").cast("string"))
    names = [F.concat(F.lit("${"), "entity_type", F.lit("_"), shown, F.lit("}")).alias("placeholder"), F.concat_ws("_", "entity_type", "number").alias("entity_id")]
    cells = [F.col("session").cast("long").alias("session"), F.col("turn").cast("long").alias("turn"), "entity_type", "start", "stop", "entity_value", "confidence", "number"]
    return rows.select(*cells, *names, F.sha2("entity_value", 256).alias("hash_value"), spans.sensitivity(F.col("entity_type")).alias("sensitivity"))


def keep(spark: SparkSession, path: str, texts: DataFrame) -> DataFrame:
    """Appends what ``texts`` (session, turn, text, entities) add to the mapping at ``path``, and gives the mapping.

    Entities that don't lie in their text are left out.  A rerun adds nothing; Spark commits the files of a
    batch together, so a batch that fails adds nothing either.  One batch at a time may write.
    """
    found = texts.select("session", "turn", F.inline(checked(F.col("entities"), F.col("text"))))
    additions(read(spark, path), found).write.mode("append").parquet(path)
    return read(spark, path)


def log(mapping: DataFrame) -> DataFrame:
    """session, entity_type, n_entities, n_values, n_turns, highest: what was masked so far."""
    counts = [F.count(F.lit(1)).alias("n_entities"), F.countDistinct("hash_value").alias("n_values"), F.countDistinct("turn").alias("n_turns"), F.max("number").alias("highest")]
    return mapping.groupBy("session", "entity_type").agg(*counts)


def masked_forms(texts: DataFrame, mapping: DataFrame, forms: Sequence[str] = tuple(FORMS), known: bool = False) -> DataFrame:
    """session, turn and, of each form, the texts with the mapping's names in place of values; texts move once for all forms.

    ``known`` leaves out texts without an entry.
    """
    names = [F.expr(FORMS[form][1]).alias(form) for form in forms]
    marked = mapping.groupBy("session", "turn").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "entity_value", *names))).alias("marked"))
    rows = texts.select("session", "turn", "text").join(marked, ["session", "turn"], "inner" if known else "left")
    whole = lambda form: spans.rewritten(F.col("text"), F.col("marked"), lambda s: s[form])
    return rows.select("session", "turn", *[F.when(F.col("marked").isNull(), F.col("text")).otherwise(whole(form)).alias(form) for form in forms])


def recovered_forms(masked_texts: DataFrame, mapping: DataFrame, forms: Sequence[str] = tuple(FORMS)) -> DataFrame:
    """session, turn and, of each form, the masked text and ``<form>_back``: its names replaced by their values; unknown ones stay.

    A text is read once, so that a value which looks like a name isn't replaced in turn.  The names of all forms meet the mapping together.
    """
    hits = {form: F.regexp_extract_all(form, F.lit(FORMS[form][0]), F.lit(0)) for form in forms}
    names = lambda form: F.transform(F.array_distinct(hits[form]), lambda h: F.struct(F.lit(form).alias("form"), h.alias("name")))
    asked = F.flatten(F.array(*map(names, forms)))
    asked = masked_texts.select("session", "turn", F.inline(asked)).distinct()
    shown = F.array(*[F.struct(F.lit(form).alias("form"), F.expr(FORMS[form][1]).alias("name")) for form in forms])
    values = mapping.select("session", "entity_value", F.inline(shown)).distinct()
    of = lambda form: F.map_from_entries(F.collect_list(F.when(F.col("form") == form, F.struct("name", "entity_value")))).alias(f"_{form}")
    known = asked.join(values, ["session", "form", "name"]).groupBy("session", "turn").agg(*map(of, forms))
    rows = masked_texts.join(known, ["session", "turn"], "left")

    def back(form: str) -> Column:
        value = lambda h: F.coalesce(F.try_element_at(F.col(f"_{form}"), h), h)
        parts = F.zip_with(F.split(form, FORMS[form][0], -1), F.transform(hits[form], value), lambda gap, v: F.concat(gap, F.coalesce(v, F.lit(""))))
        return F.array_join(parts, "").alias(f"{form}_back")

    return rows.select("session", "turn", *[c for form in forms for c in (F.col(form), back(form))])


def masked(texts: DataFrame, mapping: DataFrame, form: str = "placeholder") -> DataFrame:
    """session, turn, masked: texts with the mapping's names in the form given in place of values."""
    return masked_forms(texts, mapping, [form]).withColumnRenamed(form, "masked")


def recovered(masked_texts: DataFrame, mapping: DataFrame, form: str = "placeholder") -> DataFrame:
    """session, turn, masked, text: the names of the form replaced by their values; unknown ones stay."""
    rows = recovered_forms(masked_texts.select("session", "turn", F.col("masked").alias(form)), mapping, [form])
    return rows.select("session", "turn", F.col(form).alias("masked"), F.col(f"{form}_back").alias("text"))
