"""Queries over kept mappings and numbered lines; they join the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import spans
from textloom.plans.catalog import _DISJOINT, _LEVEL, query, table
from textloom.sources import mapping, records
from textloom.sources.scratch import new_folder

_C = F.col
#: Lines of a part, some, where there are more than a few parts' lines.
LINES = 10_000
_ENTRIES = _DISJOINT + """,
run_on as (select doc_id // 10 as session, doc_id as turn, *, row_number() over (partition by doc_id // 10, entity_type order by doc_id % 2, doc_id, start desc) as number from kept),
entries as (select *, '${' || entity_type || '_' || lpad(number::varchar, greatest(3, length(number::varchar))::int, '0') || '}' as placeholder, entity_type || '_' || number::varchar as entity_id, sha256(entity_value) as hash_value from run_on)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbouring documents are a session, each a turn; their entities are given as found, some outside the text."""
    rows = table(spark, sf_dir, "documents").select(F.floor(_C("doc_id") / 10).cast("long").alias("session"), _C("doc_id").alias("turn"), "text")
    outside = F.struct(F.lit("URL").alias("entity_type"), F.length("text").alias("start"), (F.length("text") + 4).alias("stop"), F.lit("none").alias("entity_value"), F.lit(1.0).alias("confidence"))
    return rows.withColumn("entities", F.concat(spans.find_all(_C("text")), F.array(outside)))


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The texts, and the mapping that is kept of them: even turns come first, then all turns.  Entities are found once."""
    at, path = new_folder(spark, "texts"), new_folder(spark, "mapping")
    found = _texts(spark, sf_dir)
    found.write.parquet(at)
    texts = spark.read.schema(found.schema).parquet(at)
    mapping.keep(spark, path, texts.where("turn % 2 = 0"))
    return texts, mapping.keep(spark, path, texts)


@query(_ENTRIES + f" select session, turn, entity_type, start, stop, entity_value, number, placeholder, entity_id, hash_value, {_LEVEL} as sensitivity from entries")
def session_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of all types, the second with the turns of the first again: numbers go on, places are kept once."""
    return _kept(spark, sf_dir)[1].drop("confidence")


@query(_ENTRIES + " select session, entity_type, count(*) as n_entities, count(distinct hash_value) as n_values, count(distinct turn) as n_turns, max(number) as highest from entries group by all")
def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.log(_kept(spark, sf_dir)[1])


_CUT = ", ".join(f"string_agg(substr(text, before + 1, start - before) || {name}, '' order by start) || substr(max(text), (max(stop) + 1)::bigint) as {form}, max(text) as {form}_back" for form, name in (("placeholder", "placeholder"), ("numbered", "'[' || entity_id || ']'"), ("hash", "'[HASH:' || left(hash_value, 16) || ']'")))


@query(_ENTRIES + f", cuts as (select *, coalesce(lag(stop) over (partition by turn order by start), 0) as before from entries) select turn, {_CUT} from cuts join documents using (doc_id) group by turn")
def session_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts masked by placeholders, numbered ids and hashes, and each recovered from the kept mapping."""
    texts, kept = _kept(spark, sf_dir)
    back = mapping.recovered_forms(mapping.masked_forms(texts, kept, known=True), kept)
    return back.select("turn", *[c for form in mapping.FORMS for c in (form, f"{form}_back")])


@query("select row_number() over (order by doc_id) - 1 as sample_id, coalesce(text, '') as text, lang as predicted, source as truth from documents")
def paired_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of lines, written in another number of parts each, paired by the lines' numbers."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "lines")
    first = F.struct(_C("lang").alias("entity_value"), F.lit(0).alias("start"), F.lit(1).alias("end"))
    second = F.struct(_C("source").alias("entity_value"), F.lit(0).alias("start_position"), F.lit(1).alias("end_position"))
    sides = {"predicted": (7, F.struct(_C("text").alias("full_text"), F.array(first).alias("spans"))), "truth": (3, F.struct(_C("text"), F.array(second).alias("entities")))}
    many = -(-docs.count() // LINES)
    for name, (parts, line) in sides.items():
        rows = docs.repartitionByRange(max(parts, parts * many // 7), "doc_id").sortWithinPartitions("doc_id")
        rows.select(F.to_json(line).alias("value")).write.text(f"{folder}/{name}")
    both = records.paired(*(records.read_labelled(spark, f"{folder}/{name}") for name in sides))
    return both.select("sample_id", "text", *[_C(n)[0]["entity_value"].alias(n) for n in sides])
