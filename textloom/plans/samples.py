"""Queries that classify samples, extract by lists, and mix passages; they join the catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import spans
from textloom.plans.assess import _ANSWERS, answer_labels
from textloom.plans.catalog import _EVERY, query, said, table
from textloom.plans.measures import nested

# Entity types whose values make a sample hard, by which patterns, and what each such entity is worth.
HARD = (
    ("complex_phone_format", ("PHONE", "PHONE_NUMBER"), (r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?", r"\(\d{3}\)\s*\d{3}-\d{4}", r"\d{3}\.\d{3}\.\d{4}"), 2),
    ("complex_address_format", ("LOCATION", "ADDRESS"), (r"P\.?O\.?\s*Box\s+\d+", r"\d+\s+[A-Z][a-z]+\s+(St|Ave|Rd|Blvd|Dr|Ln|Ct)[,.]", r"Apt\.?\s*\d+|Unit\s*\d+|#\d+"), 2),
    ("partial_masked_credit_card", ("CREDIT_CARD",), (r"\*{4}[-\s]*\d{4}", r"\d{4}[-\s]*\*{4}", r"XXXX[-\s]*\d{4}"), 3),
)
# What texts are hard, and what that is worth.
FOREIGN, UNSURE = r"[^\x00-\x7F]+", (r"\b[A-Z]{2,}\b", r"\d{1,2}/\d{1,2}/\d{2,4}")
LONG, KINDS, DENSE = 200, 4, 0.3


def sample_reasons_of(text: Column, found: Column) -> Column:
    """reasons (sorted, each once) and score of a text with its spans; no reason: a common sample."""

    def hard(name: str, types: Sequence[str], patterns: Sequence[str], worth: int) -> Column:
        n = F.size(F.filter(found, lambda s: s["entity_type"].isin(*types) & s["entity_value"].rlike("|".join(patterns))))
        return F.struct(F.lit(name).alias("reason"), (n * worth).alias("worth"))

    def when(name: str, fits: Column, worth: int) -> Column:
        return F.struct(F.lit(name).alias("reason"), F.when(fits, worth).otherwise(0).alias("worth"))

    parts = F.array(
        *[hard(*h) for h in HARD],
        when("multilingual_text", text.rlike(FOREIGN), 3),
        when("long_text", F.length(text) > LONG, 1),
        when("multiple_pii_types", F.size(F.array_distinct(F.transform(found, lambda s: s["entity_type"]))) >= KINDS, 2),
        when("ambiguous_format", text.rlike("|".join(UNSURE)), 1),
        when("nested_entities", nested(found), 2),
        when("high_entity_density", F.size(found) > DENSE * F.length(text), 1),
    )
    reasons = F.array_sort(F.transform(F.filter(parts, lambda p: p["worth"] > 0), lambda p: p["reason"]))
    return F.struct(reasons.alias("reasons"), F.aggregate(parts, F.lit(0), lambda a, p: a + p["worth"]).alias("score"), F.size(found).alias("n_entities"), F.array_sort(F.array_distinct(F.transform(found, lambda s: s["entity_type"]))).alias("types"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, classification, reasons, score, n_entities, types."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", spans.let(spans.find_all(text), lambda found: sample_reasons_of(text, found)).alias("x"))
    return rows.select("doc_id", F.when(F.size("x.reasons") > 0, "boundary").otherwise("common").alias("classification"), "x.*")


_HARD_SQL = ", ".join(f"count_if(entity_type in ({', '.join(map(repr, types))}) and regexp_matches(entity_value, '{'|'.join(patterns)}')) * {worth} as h{k}" for k, (_, types, patterns, worth) in enumerate(HARD))
_SAMPLES = _EVERY + f""",
e as (select doc_id, count(*) as n, count(distinct entity_type) as kinds, list_sort(list(distinct entity_type)) as types, {_HARD_SQL} from spans group by doc_id),
inside as (select distinct a.doc_id from spans a join spans b on a.doc_id = b.doc_id and a.start >= b.start and a.stop <= b.stop and (a.start, a.stop) <> (b.start, b.stop)),
w as (select d.doc_id, coalesce(n, 0) as n, coalesce(types, []) as types, [coalesce(h0, 0), coalesce(h1, 0), coalesce(h2, 0), case when regexp_matches(text, '{FOREIGN}') then 3 else 0 end, case when length(text) > {LONG} then 1 else 0 end,
  case when kinds >= {KINDS} then 2 else 0 end, case when regexp_matches({said(UNSURE[0])}, '{"|".join(UNSURE)}') then 1 else 0 end, case when i.doc_id is not null then 2 else 0 end, case when coalesce(n, 0) > {DENSE} * length(text) then 1 else 0 end] as worth
  from documents d left join e on d.doc_id = e.doc_id left join inside i on d.doc_id = i.doc_id),
samples as (select doc_id, n::int as n_entities, types, list_sum(worth)::int as score, case when list_sum(worth) > 0 then 'boundary' else 'common' end as classification,
  list_sort(list_filter(['{HARD[0][0]}', '{HARD[1][0]}', '{HARD[2][0]}', 'multilingual_text', 'long_text', 'multiple_pii_types', 'ambiguous_format', 'nested_entities', 'high_entity_density'], lambda x, i: worth[i] > 0)) as reasons from w)"""


@query(_SAMPLES + " select doc_id, classification, reasons, score, n_entities from samples")
def sample_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common and boundary samples, and why."""
    return _samples(spark, sf_dir).drop("types")


@query(_SAMPLES + " select coalesce(classification, 'all') as classification, count(*) as n, avg(score)::double as mean_score from samples group by rollup (classification)")
def sample_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of all, common and boundary samples."""
    rows = _samples(spark, sf_dir).rollup("classification").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    return rows.withColumn("classification", F.coalesce("classification", F.lit("all")))


@query(_SAMPLES + " select kind, classification, name, count(*) as n from (select 'reason' as kind, classification, unnest(reasons) as name from samples union all select 'type', classification, unnest(types) from samples) group by all")
def sample_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples of a class have a reason, or a type."""
    tagged = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    rows = _samples(spark, sf_dir).select("classification", F.inline(F.concat(tagged("reason", F.col("reasons")), tagged("type", F.col("types")))))
    return rows.groupBy("kind", "classification", "name").agg(F.count(F.lit(1)).alias("n"))


# Patterns of the comparison extractor, in order of precedence.
COMPARED = (
    ("CREDIT_CARD", r"\b\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b"),
    ("CREDIT_CARD", r"\b\d{4}[\s\-]?\d{6}[\s\-]?\d{5}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\+?\d{1,3}[\s\-]?\(?\d{2,4}\)?[\s\-]?\d{2,4}[\s\-]?\d{2,4}"),
    ("PHONE", r"\d{3}[\s\-]?\d{2}[\s\-]?\d{3}"),
    ("IBAN", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}([A-Z0-9]?){0,16}\b"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("IP_ADDRESS", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b"),
    ("DATE", r"\b\d{4}-\d{2}-\d{2}\b"),
    ("DATE", r"\b\d{2}/\d{2}/\d{4}\b"),
    ("US_DRIVER_LICENSE", r"\b[A-Z]\d{7}\b"),
    ("PERSON", r"\b(?:Mr\.|Ms\.|Mrs\.|Dr\.)\s+[A-Z][a-z]+\s+[A-Z][a-z]+\b"),
)
# Words that let a type be looked for, phrases that forbid all, and what is then looked for.
GATES = {"CREDIT_CARD": ("card", "credit card", "card number"), "EMAIL": ("email", "e-mail", "@"), "PHONE": ("phone", "tel", "call")}
FORBIDDEN = ("card game", "business card")
GATED = (
    ("CREDIT_CARD", r"\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE", r"\+?\d{1,3}[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{4}"),
)


def _places(patterns: Sequence[tuple[str, str]], where: Sequence[str] | None = None) -> str:
    """SQL: ordinal, doc_id, entity_type, start, stop, entity_value of all matches, as ``placed``."""
    found = " union all ".join(
        f"select doc_id, '{t}' as entity_type, {k} as ordinal, regexp_extract_all({said(p)}, '{p}') as hits, string_split_regex({said(p)}, '{p}') as gaps from documents where regexp_matches({said(p)}, '{p}')" + (f" and {where[k]}" if where else "")
        for k, (t, p) in enumerate(patterns)
    )
    return f"""with found as ({found}), numbered as (select *, unnest(range(1, len(hits) + 1)) as i from found),
at_ as (select ordinal, doc_id, entity_type, hits[i] as entity_value, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::int as start from numbered),
placed as (select *, (start + length(entity_value))::int as stop from at_)"""


@query(_places(COMPARED) + " select doc_id, entity_type, start, stop, entity_value from placed qualify row_number() over (partition by doc_id, start, stop order by ordinal) = 1")
def compare_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the comparison patterns; of equal spans the first pattern's."""
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(spans.find_all(F.col("text"), COMPARED))).drop("confidence")


_ALLOWED = " and ".join(f"not contains(lower(text), '{x}')" for x in FORBIDDEN)


@query(_places(GATED, [f"{_ALLOWED} and (" + " or ".join(f"contains(lower(text), '{w}')" for w in GATES[t]) + ")" for t, _ in GATED]) + " select doc_id, entity_type, start, stop, entity_value from placed")
def list_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types whose keywords a text holds, unless it holds a forbidden phrase."""
    low = F.lower("text")
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    none = F.array().cast(f"array<{spans.SPAN}>")
    found = F.concat(*[F.when(holds(GATES[t]), spans.find(F.col("text"), p, t)).otherwise(none) for t, p in GATED])
    return table(spark, sf_dir, "documents").where(~holds(FORBIDDEN)).select("doc_id", F.inline(found)).drop("confidence")


def mixed(positive: Column, negative: Column, n: int, noise: float) -> Column:
    """``n`` passages, a share ``noise`` (rounded up) of them negative; what one side lacks the other gives, the negative side first."""
    wanted = F.ceil(F.lit(n * noise)).cast("int")
    bad = F.when(F.lit(noise == 1), n).when(wanted > F.size(negative), F.size(negative)).when(n - wanted > F.size(positive), n - F.size(positive)).otherwise(wanted)
    good = F.when(F.lit(noise == 1), 0).when((wanted <= F.size(negative)) & (n - wanted > F.size(positive)), F.size(positive)).otherwise(n - bad)
    return F.concat(F.slice(positive, F.lit(1), good), F.slice(negative, F.lit(1), bad))


@query("""with r as (select user_id, event_id, value > 80 as good, row_number() over (partition by user_id, value > 80 order by md5(event_id::varchar), event_id) as k from events),
l as (select user_id, coalesce(list(event_id order by k) filter (good), []) as p, coalesce(list(event_id order by k) filter (not good), []) as q from r where k <= 5 group by user_id),
c as (select *, case when len(q) < 2 then len(q) when len(p) < 3 then 5 - len(p) else 2 end as bad, case when len(q) < 2 then 5 - len(q) when len(p) < 3 then len(p) else 3 end as good from l)
select user_id, p[1:good] || q[1:bad] as passages from c""")
def passage_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five passages a user, two of them negative, in the order of a hash; no more than five of a side are gathered."""
    good = F.coalesce(F.col("value") > 80, F.lit(False)).alias("good")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", good, F.md5(F.col("event_id").cast("string")).alias("h"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("user_id", "good").orderBy("h", "event_id"))).where("k <= 5")
    of = lambda side: F.array_sort(F.collect_list(F.when(side, F.struct("k", "event_id"))))["event_id"]
    lists = first.groupBy("user_id").agg(of(F.col("good")).alias("p"), of(~F.col("good")).alias("q"))
    return lists.select("user_id", mixed(F.col("p"), F.col("q"), 5, 0.4).alias("passages"))


@query("select conv_id, [" + ", ".join("max(greatest(" + ", ".join(f"contains(lower(coalesce(text, '')), '{a.lower()}')::int" for a in x) + ", 0))" for x in _ANSWERS) + "] as labels, " + " and ".join("max(greatest(" + ", ".join(f"contains(lower(coalesce(text, '')), '{a.lower()}')::int" for a in x) + ", 0)) = 1" for x in _ANSWERS) + " as right_ from conversations group by conv_id")
def best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's labels, each the best of its turns, and whether none is 0."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", answer_labels(F.col("text"), _ANSWERS).alias("l"))
    best = rows.groupBy("conv_id").agg(*[F.max(F.get("l", F.lit(k))).alias(f"l{k}") for k in range(len(_ANSWERS))])
    labels = F.array(*[F.col(f"l{k}") for k in range(len(_ANSWERS))])
    return best.select("conv_id", labels.alias("labels"), (~F.array_contains(labels, 0)).alias("right_"))
