"""Queries that compare extractors, merges and thresholds; they join the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import extractors, spans
from textloom.plans.catalog import _EVERY, query, said, table
from textloom.plans.measures import EVALUATED, THRESHOLDS, context_complexity, f1, format_complexity, rate
from textloom.sources import sinks
from textloom.sources.scratch import new_folder

_C = F.col
_DIGITS, _CARD = r"\d[\d .()-]{5,}\d", spans.PATTERNS["CREDIT_CARD"]
_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 0 then (case when substr(d, i, 1)::int > 4 then substr(d, i, 1)::int * 2 - 9 else substr(d, i, 1)::int * 2 end) else substr(d, i, 1)::int end)) % 10 = 0"
#: Spans of the three extractors with confidence and source.
_UNION = _EVERY + f""",
more as (select doc_id, 'card' as k, regexp_extract_all({said(_CARD)}, '{_CARD}') as hits, string_split_regex({said(_CARD)}, '{_CARD}') as gaps from documents
  union all select doc_id, 'digits', regexp_extract_all(text, '{_DIGITS}'), string_split_regex(text, '{_DIGITS}') from documents),
each as (select *, unnest(range(1, len(hits) + 1)) as i from more where len(hits) > 0),
laid as (select doc_id, k, hits[i] as entity_value, reverse(regexp_replace(hits[i], '\\D', '', 'g')) as d,
  (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::int as start from each),
united as (
  select doc_id, entity_type, start, stop, entity_value, 0.9::double as confidence, 'patterns' as source from spans
  union all select doc_id, 'CREDIT_CARD', start, (start + length(entity_value))::int, entity_value, 0.95, 'checked' from laid where k = 'card' and {_LUHN}
  union all select doc_id, 'NUMBER', start, (start + length(entity_value))::int, entity_value, 0.6, 'digits' from laid where k = 'digits')"""


def _merged_sql(other: str) -> str:
    """The merge; ``other`` says when a new span x takes the place of a kept one k elsewhere than at the same place."""
    shared = "least(k.b, x.kept[1].b) - greatest(k.a, x.kept[1].a)"
    close = f"({shared}) > 0.5 * least(k.b - k.a, x.kept[1].b - x.kept[1].a)"
    first = f"coalesce(list_position(list_transform(m.kept, lambda k: {close}), true), 0)"
    better = f"case when k.a = x.kept[1].a and k.b = x.kept[1].b then x.kept[1].c > k.c else {other} end"
    return _UNION + f""",
lists as (select doc_id, list({{'kept': [{{'t': entity_type, 'a': start, 'b': stop, 'c': confidence, 's': source}}]}} order by start, confidence desc, stop, source, entity_type) as l from united group by doc_id),
folded as (select doc_id, list_reduce(l, lambda m, x: case when {first} = 0 then {{'kept': list_concat(m.kept, x.kept)}}
  else {{'kept': list_transform(m.kept, lambda k, i: case when i = {first} and {better} then x.kept[1] else k end)}} end).kept as kept from lists),
one as (select doc_id, unnest(kept) as s from folded)
select doc_id, s.t as entity_type, s.a as start, s.b as stop, s.c as confidence, s.s as source from one"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", extractors.extracted(_C("text")).alias("found"))


@query(_UNION + " select * from united")
def extractor_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each registered extractor finds."""
    return _found(spark, sf_dir).select("doc_id", F.inline("found"))


def _merged(spark: SparkSession, sf_dir: str, prefer: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", F.inline(extractors.preferred(_C("found"), prefer))).drop("entity_value")


@query(_merged_sql("x.kept[1].b - x.kept[1].a > k.b - k.a"))
def merge_longer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "longer")


@query(_merged_sql("x.kept[1].c > k.c"))
def merge_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "higher_confidence")


@query(_merged_sql("x.kept[1].s = 'digits' and k.s <> 'digits'"))
def merge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the named source take the place of others."""
    return _merged(spark, sf_dir, "digits")


#: Settings of the experiments: which sources, and the least confidence.
SOURCES = {"patterns": ("patterns",), "checked": ("checked",), "digits": ("digits",), "all": ("patterns", "checked", "digits")}
LEAST = (0.5, 0.7, 0.92)


def judged(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Places of either: key, start, stop, by (source and confidence of what was found there), true.  Matched once for all settings."""
    place = ["doc_id", "start", "stop"]
    by = F.collect_set(F.struct("source", "confidence")).alias("by")
    rows = found.groupBy(*place).agg(by).join(truth.select(*place).distinct().withColumn("true", F.lit(True)), place, "full")
    return rows.withColumn("true", F.coalesce("true", F.lit(False)))


def experiments(rows: DataFrame) -> DataFrame:
    """sources, least, tp, fp, fn, precision, recall, f1, rank of each setting, the best first, over ``judged`` places."""
    settings = F.array(*[F.struct(F.lit(name).alias("sources"), F.array(*map(F.lit, of)).alias("_of"), F.lit(x).alias("least")) for name, of in SOURCES.items() for x in LEAST])
    each = rows.select("by", "true", F.inline(settings))
    hit = F.coalesce(F.exists("by", lambda b: F.array_contains(_C("_of"), b["source"]) & (b["confidence"] >= _C("least"))), F.lit(False))
    each = each.select("sources", "least", hit.alias("hit"), "true")
    sums = each.groupBy("sources", "least").agg(F.count_if(_C("hit") & _C("true")).alias("tp"), F.count_if(_C("hit") & ~_C("true")).alias("fp"), F.count_if(~_C("hit") & _C("true")).alias("fn"))
    p, r = rate(_C("tp"), _C("fp")), rate(_C("tp"), _C("fn"))
    sums = sums.select("*", p.alias("precision"), r.alias("recall"), F.round(f1(p, r), 9).alias("f1"))
    return sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("f1").desc(), "sources", "least")))  # one row a setting


#: Truth of the queries: places of e-mails, addresses on the net and cards.
_TRUE = ("EMAIL", "IP_ADDRESS", "CREDIT_CARD")
_JUDGED = _UNION + f""",
places as (select distinct doc_id, start, stop from united),
actual as (select distinct doc_id, start, stop from spans where entity_type in {_TRUE}),
settings(sources, least) as (values {", ".join(f"('{n}', {x}::double)" for n in SOURCES for x in LEAST)}),
cells as (select sources, least, p.doc_id, p.start, p.stop, exists (select 1 from united u where u.doc_id = p.doc_id and u.start = p.start and u.stop = p.stop and (s.sources = 'all' or u.source = s.sources) and u.confidence >= s.least) as hit,
  exists (select 1 from actual a where a.doc_id = p.doc_id and a.start = p.start and a.stop = p.stop) as actual from places p, settings s),
sums as (select sources, least, count_if(hit and actual)::bigint as tp, count_if(hit and not actual)::bigint as fp, count_if(actual and not hit)::bigint as fn from cells group by all),
rates as (select *, coalesce(tp / nullif(tp + fp, 0), 0)::double as precision, coalesce(tp / nullif(tp + fn, 0), 0)::double as recall from sums),
scored as (select *, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::double, 9) as f1 from rates)"""


@query(_JUDGED + " select *, (row_number() over (order by f1 desc, sources, least))::int as rank from scored")
def experiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extractors by thresholds, the best first."""
    found = extractor_union(spark, sf_dir)
    return experiments(judged(found, found.where(_C("source") == "patterns").where(_C("entity_type").isin(*_TRUE))))


@query(_JUDGED + " select * replace (round(precision, 4) as precision, round(recall, 4) as recall, round(f1, 4) as f1), (row_number() over (order by f1 desc, sources, least))::int as rank from scored")
def experiment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary that a report of ``experiment_scores`` holds, read back from its file."""
    path = new_folder(spark, "report")
    scores = experiment_scores(spark, sf_dir)
    sinks.write_report(scores, path)
    rows = spark.read.option("header", "true").csv(f"{path}/summary")
    return rows.select(*[F.col(n).cast(t).alias(n) for n, t in scores.dtypes])


def confidence_level(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "HIGH").when(confidence >= 0.5, "MEDIUM").otherwise("LOW")


PLACE = ("doc_id", "entity_type", "start", "stop")


def errors(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """error (FN, FP), category, entity_type, format, around, level of each true span not predicted and each predicted span that isn't true.

    Both sides hold doc_id, entity_type, start, stop, entity_value, confidence, context.  Of missed spans the
    category tells type, format and surroundings, of wrong ones type and confidence; what doesn't apply is null.
    """
    more = [_C(c) for c in (*PLACE, "confidence", "entity_value", "context")]
    sides = [rows.select(F.lit(p).alias("predicted"), F.lit(not p).alias("true"), *more) for rows, p in ((predicted, True), (truth, False))]
    return marked_errors(sides[0].unionByName(sides[1]))


def marked_errors(rows: DataFrame) -> DataFrame:
    """``errors`` of one table whose rows tell by ``predicted`` and ``true`` which sides they are of; places meet once.

    A place that isn't wholly known is the same as no other of the other side.
    """
    none = F.lit(None).cast("string")
    whole = F.forall(F.array(*[_C(c).isNull() for c in PLACE]), lambda x: ~x)
    key = F.when(~whole, _C("predicted")).alias("_side")
    meant = F.max_by(F.struct("entity_value", "context"), F.when(_C("true"), 1)).alias("x")  # what a place holds is the same in all its rows
    sums = rows.groupBy(*PLACE, key).agg(F.bool_or("predicted").alias("predicted"), F.bool_or("true").alias("true"), F.max(F.when(_C("predicted"), _C("confidence"))).alias("confidence"), meant)
    of = lambda missed, other: F.when(_C("true"), missed).otherwise(other)
    out = sums.where(_C("predicted") != _C("true")).select(
        of(F.lit("FN"), F.lit("FP")).alias("error"), "entity_type",
        of(format_complexity(_C("entity_type"), _C("x.entity_value")), none).alias("format"),
        of(context_complexity(_C("x.context")), none).alias("around"),
        of(none, confidence_level(_C("confidence"))).alias("level"),
    )
    return out.withColumn("category", F.concat_ws("_", "error", "entity_type", "format", "around", "level"))


def summaries(rows: DataFrame) -> DataFrame:
    """error, property, value, n: counts of ``errors`` by category, type, format, surroundings and level, and in all, in one pass."""
    keys = ["category", "entity_type", "format", "around", "level"]
    sets = [[_C("error")], *[[_C("error"), _C(k)] for k in keys]]
    counts = rows.groupingSets(sets, _C("error"), *map(_C, keys)).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    bits = {((1 << len(keys)) - 1) ^ (1 << (len(keys) - 1 - i)): k for i, k in enumerate(keys)}
    by = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x).cast(t) for kv in bits.items() for x, t in zip(kv, ("long", "string"), strict=True)]), _C("g").cast("long")), F.lit("total"))
    return counts.select("error", by.alias("property"), F.coalesce(*keys).alias("value"), "n").where((_C("property") == "total") | _C("value").isNotNull())


# What is advised, and the share of missed or wrong spans above which it is.
ADVICE = (
    ("FN", "format", "COMPLEX", 0.3, "patterns for complex formats"),
    ("FN", "entity_type", "PHONE_NUMBER", 0.2, "phone formats of more countries"),
    ("FN", "entity_type", "LOCATION", 0.2, "more examples of addresses"),
    ("FP", "level", "HIGH", 0.4, "higher thresholds and counterexamples"),
    ("FP", "entity_type", "PERSON", 0.3, "names told from common words"),
)
BALANCE = (1.5, "strategy of high recall", "strategy of high precision")


def advice(summary: DataFrame) -> DataFrame:
    """ordinal, advice: which of the seven rules hold for ``summaries``."""
    n = lambda error, by, value: F.coalesce(F.sum(F.when((_C("error") == error) & (_C("property") == by) & ((_C("value") == value) if value else F.lit(True)), _C("n"))), F.lit(0))
    totals = {e: n(e, "total", None) for e in ("FN", "FP")}
    rules = [F.when(n(e, by, value) > totals[e] * share, text) for e, by, value, share, text in ADVICE]
    rules += [F.when(totals["FN"] > totals["FP"] * BALANCE[0], BALANCE[1]), F.when(totals["FP"] > totals["FN"] * BALANCE[0], BALANCE[2])]
    held = summary.agg(F.array(*rules).alias("rules"))
    return held.select(F.posexplode("rules").alias("ordinal", "advice")).where("advice is not null")


_NAMED = "case entity_type " + " ".join(f"when '{a}' then '{b}'" for a, b in EVALUATED.items()) + " else entity_type end"
#: Predicted: what is found by looking for digits and names; true: all patterns but names.  So both kinds of errors occur.
_ERRORS = _UNION + f""",
every_ as (select u.doc_id, {_NAMED} as entity_type, start, stop, entity_value, confidence, u.source, substr(text, greatest(start - 20, 0) + 1, stop + 20 - greatest(start - 20, 0)) as context from united u join documents using (doc_id)),
p as (select doc_id, entity_type, start, stop, max(confidence) as confidence from every_ where source <> 'patterns' or entity_type in ('PERSON', 'EMAIL_ADDRESS') group by all),
t as (select distinct doc_id, entity_type, start, stop, entity_value, context from every_ where source = 'patterns' and entity_type <> 'PERSON'),
missed as (select entity_type, case when case entity_type when 'PHONE_NUMBER' then regexp_matches(entity_value, '[+(). ]') when 'EMAIL_ADDRESS' then false when 'LOCATION' then len(string_split_regex(trim(entity_value), '\\s+')) > 4
    when 'CREDIT_CARD' then regexp_matches(entity_value, '[- *]') else length(entity_value) > 20 end then 'COMPLEX' else 'SIMPLE' end as format,
  case when length(context) - length(translate(context, '.!?', '')) > 1 or length(regexp_replace(context, '[\\p{{L}}\\p{{N}} .,!?]', '', 'g')) > 5 then 'COMPLEX' else 'SIMPLE' end as around
  from t where not exists (select 1 from p where (p.doc_id, p.entity_type, p.start, p.stop) = (t.doc_id, t.entity_type, t.start, t.stop))),
wrong as (select entity_type, case when confidence >= 0.8 then 'HIGH' when confidence >= 0.5 then 'MEDIUM' else 'LOW' end as level from p where not exists (select 1 from t where (p.doc_id, p.entity_type, p.start, p.stop) = (t.doc_id, t.entity_type, t.start, t.stop))),
errors as (select 'FN' as error, entity_type, format, around, null as level, 'FN_' || entity_type || '_' || format || '_' || around as category from missed
  union all select 'FP', entity_type, null, null, level, 'FP_' || entity_type || '_' || level from wrong),
summary as (
  select error, 'total' as property, null as value, count(*) as n from errors group by error
  union all select error, 'category', category, count(*) from errors group by all union all select error, 'entity_type', entity_type, count(*) from errors group by all
  union all select error, 'format', format, count(*) from errors where format is not null group by all union all select error, 'around', around, count(*) from errors where around is not null group by all
  union all select error, 'level', level, count(*) from errors where level is not null group by all)"""


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.greatest(_C("start") - 20, F.lit(0))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVALUATED.items() for x in kv]), _C("entity_type")), _C("entity_type"))
    rows = _found(spark, sf_dir).select("doc_id", "text", F.inline("found"))
    rows = rows.withColumns({"entity_type": named, "context": F.substr("text", left + 1, _C("stop") + 20 - left)}).drop("text")
    predicted = (_C("source") != "patterns") | _C("entity_type").isin("PERSON", "EMAIL_ADDRESS")
    true = (_C("source") == "patterns") & (_C("entity_type") != "PERSON")
    return marked_errors(rows.withColumns({"predicted": predicted, "true": true}).where("predicted or true"))


@query(_ERRORS + " select * from summary")
def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of errors by each of five properties, and in all."""
    return summaries(_errors(spark, sf_dir))


def _advice_sql() -> str:
    n = lambda e, by, v: f"coalesce((select sum(n) from summary where error = '{e}' and property = '{by}'" + (f" and value = '{v}'" if v else "") + "), 0)"
    total = {e: n(e, "total", "") for e in ("FN", "FP")}
    rules = [f"case when {n(e, by, v)} > {total[e]} * {share}::double then '{text}' end" for e, by, v, share, text in ADVICE]
    rules += [f"case when {total[a]} > {total[b]} * {BALANCE[0]}::double then '{text}' end" for a, b, text in (("FN", "FP", BALANCE[1]), ("FP", "FN", BALANCE[2]))]
    return _ERRORS + f", rules as (select unnest([{', '.join(rules)}]) as advice, unnest(range(0, {len(rules)}))::int as ordinal) select ordinal, advice from rules where advice is not null"


@query(_advice_sql())
def error_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to mend first."""
    return advice(summaries(_errors(spark, sf_dir)))


@query(_UNION + " select source, entity_type, case when confidence >= 0.8 then 'HIGH' when confidence >= 0.5 then 'MEDIUM' else 'LOW' end as level, count(*) as n from united group by all")
def confidence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all extractors by how sure they are."""
    return extractor_union(spark, sf_dir).groupBy("source", "entity_type", confidence_level(_C("confidence")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


# Least confidences of merged spans by detection strategy.
MERGED = {"high_recall": 0.3, "balanced": 0.5, "high_precision": 0.7}
_SETTINGS = ", ".join(f"('{k}', {a}::double, {b}::double, {MERGED[k]}::double)" for k, (a, b) in THRESHOLDS.items())


_LONGER = _merged_sql("x.kept[1].b - x.kept[1].a > k.b - k.a").rsplit("select doc_id, s.t", 1)[0]


@query(_LONGER + f""", s(strategy, recognised, modelled, merged) as (values {_SETTINGS})
select strategy, (select count_if(confidence >= recognised) from united)::bigint as recognised, (select count_if(confidence >= modelled) from united)::bigint as modelled, (select count_if(one.s.c >= merged) from one)::bigint as merged from s""")
def thresholds_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that pass each detection strategy's three thresholds, found and merged, in one pass."""
    rows = _found(spark, sf_dir).select("found", extractors.preferred(_C("found")).alias("kept"))
    passed = lambda spans_, least: F.sum(F.size(F.filter(spans_, lambda s: s["confidence"] >= least))).cast("long")
    cells = {k: (passed("found", a), passed("found", b), passed("kept", MERGED[k])) for k, (a, b) in THRESHOLDS.items()}
    names = ("recognised", "modelled", "merged")
    sums = rows.agg(*[c.alias(f"{k}_{n}") for k, own in cells.items() for n, c in zip(names, own, strict=True)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(k).alias("strategy"), *[_C(f"{k}_{n}").alias(n) for n in names]) for k in cells])))
