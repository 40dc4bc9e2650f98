"""Queries that match, score and assemble; they join the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import spans
from textloom.plans.catalog import PLAIN, query, table

_NARROW = r"\b(?:[0-9]{1,2}\.){3}[0-9]{1,2}\b"


def greedy_match(predicted: Column, truth: Column, least: float = 0.5) -> Column:
    """For each predicted span, in order, the place of the first free true span of its type that it overlaps by ``least``; -1 without one."""

    def step(state: Column, p: Column) -> Column:
        fits = F.transform(truth, lambda t, i: F.when((t["entity_type"] == p["entity_type"]) & (spans.overlap(p, t) >= least) & ~F.array_contains(state, i), i).otherwise(-1))
        return F.concat(state, F.array(F.coalesce(F.get(F.filter(fits, lambda i: i >= 0), F.lit(0)), F.lit(-1))))

    return F.aggregate(predicted, F.array().cast("array<int>"), step)


def _numbered(name: str, pattern: str) -> str:
    """SQL: doc_id, start, stop of a pattern's matches."""
    return f"""{name} as (select doc_id, start, start + length(hits[i]) as stop from (
  select doc_id, hits, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as start from (
    select *, unnest(range(1, len(hits) + 1)) as i from (select doc_id, regexp_extract_all(text, '{pattern}') as hits, string_split_regex(text, '{pattern}') as gaps from documents) where len(hits) > 0)))"""


@query(f"""with {_numbered("p", PLAIN["IP_ADDRESS"])}, {_numbered("t", _NARROW)},
m as (select distinct t.doc_id, t.start from t join p on p.doc_id = t.doc_id and 2 * (least(p.stop, t.stop) - greatest(p.start, t.start)) >= least(p.stop - p.start, t.stop - t.start))
select (select count(*) from m) as tp, (select count(*) from p) - (select count(*) from m) as fp, (select count(*) from t) - (select count(*) from m) as fn""")
def eval_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy matching by overlap of an address extractor's spans against a narrower one's."""
    docs = table(spark, sf_dir, "documents").select(spans.find(F.col("text"), PLAIN["IP_ADDRESS"], "IP").alias("p"), spans.find(F.col("text"), _NARROW, "IP").alias("t"))
    rows = docs.where("size(p) + size(t) > 0").select(F.size("p").alias("np"), F.size("t").alias("nt"), F.size(F.filter(greedy_match(F.col("p"), F.col("t")), lambda i: i >= 0)).alias("tp"))
    return rows.agg(F.sum("tp").alias("tp"), F.sum(F.col("np") - F.col("tp")).alias("fp"), F.sum(F.col("nt") - F.col("tp")).alias("fn"))


def answer_labels(prediction: Column, answers: list[list[str]]) -> Column:
    """1 for each answer of which some alternative is in ``prediction``, whatever the case; else 0."""
    low = F.lower(F.coalesce(prediction, F.lit("")))
    return F.array(*[F.greatest(*[F.contains(low, F.lit(a.lower())).cast("int") for a in alternatives], F.lit(0)) for alternatives in answers])


_ANSWERS = [["report", "market"], ["Time"]]
_LABELS = "select doc_id, lang, [" + ", ".join("greatest(" + ", ".join(f"contains(lower(text), '{a.lower()}')::int" for a in x) + ", 0)" for x in _ANSWERS) + "] as labels from documents"


@query(_LABELS)
def answer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", answer_labels(F.col("text"), _ANSWERS).alias("labels"))


@query(f"select lang, count(*) as n, avg((not list_contains(labels, 0) and list_contains(labels, 1))::int) as all_rate, avg(list_contains(labels, 1)::int) as any_rate from ({_LABELS}) group by lang")
def answer_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = answer_labels(F.col("text"), _ANSWERS)
    rows = table(spark, sf_dir, "documents").select("lang", labels.alias("labels"))
    any_, none_missing = F.array_contains("labels", 1), ~F.array_contains("labels", 0)
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg((any_ & none_missing).cast("int")).alias("all_rate"), F.avg(any_.cast("int")).alias("any_rate"))


def assemble(lines: Column) -> Column:
    """Text of a streamed answer: NDJSON or ``data:`` lines, in order; malformed ones and ``[DONE]`` say nothing."""

    def content(line: Column) -> Column:
        body = F.regexp_replace(line, r"^data:\s*", "")
        paths = ("$.response", "$.choices[0].delta.content", "$.choices[0].message.content", "$.message.content")
        return F.coalesce(*[F.get_json_object(body, p) for p in paths], F.lit(""))

    return F.array_join(F.transform(lines, content), "")


@query("select conv_id, turn, coalesce(text, '') as assembled from conversations")
def stream_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip: every turn dealt into lines of both kinds, with noise, and assembled."""
    words = F.split(F.coalesce("text", F.lit("")), "(?<= )")
    plain = lambda w: F.to_json(F.struct(w.alias("response")))
    event = lambda w: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(w.alias("content")).alias("delta"))).alias("choices"))))
    lines = F.concat(F.transform(words, lambda w, i: F.when(i % 2 == 0, plain(w)).otherwise(event(w))), F.array(F.lit('{"response": "cut'), F.lit("data: [DONE]")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", assemble(lines).alias("assembled"))


def template_slots(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(line, F.lit(r"\{\{(\w+)\}\}"), F.lit(1)))


def fill(template: Column, values: Column) -> Column:
    """text, spans of a template whose ``{{SLOT}}`` are filled from the map ``values``; an unknown slot stays as it is."""
    slots = F.regexp_extract_all(template, F.lit(r"\{\{(\w+)\}\}"), F.lit(1))
    gaps = F.split(template, r"\{\{\w+\}\}", -1)
    start = F.struct(F.get(gaps, F.lit(0)).alias("text"), F.array().cast(f"array<{spans.SPAN}>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        known = F.try_element_at(values, x["slot"])
        value = F.coalesce(known, F.concat(F.lit("{{"), x["slot"], F.lit("}}")))
        at = F.length(state["text"])
        span = F.struct(x["slot"].alias("entity_type"), at.alias("start"), (at + F.length(value)).alias("stop"), value.alias("entity_value"), F.lit(1.0).alias("confidence"))
        return F.struct(F.concat(state["text"], value, x["gap"]).alias("text"), F.when(known.isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span))).alias("spans"))

    pairs = F.zip_with(slots, F.slice(gaps, F.lit(2), F.size(slots)), lambda slot, gap: F.struct(slot.alias("slot"), gap.alias("gap")))
    return F.aggregate(pairs, start, step)


_FIRST, _LAST = ["Ana", "Bo", "Cleo", "Dara", "Edda"], ["Berg", "Costa", "Dunn"]
_TEMPLATES = ["Contact {{PERSON}} at {{EMAIL}} today.", "{{PERSON}} called from {{PHONE}}", "Write to {{EMAIL}} or ring {{PHONE}}, please", "Nothing to see here"]


def _listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""
with v as (select i as id, {_listed(_TEMPLATES)}[i % 4 + 1] as template, {_listed(_FIRST)}[i % 5 + 1] as f, {_listed(_LAST)}[i % 3 + 1] as l, i from (select doc_id as i from documents)),
w as (select id, template, f || ' ' || l as person, lower(f || '.' || l) || (i % 97)::varchar || '@example.com' as email, '555-' || lpad((i * 7919 % 10000)::varchar, 4, '0') as phone from v),
x as (select *, replace(replace(replace(template, '{{{{PERSON}}}}', person), '{{{{EMAIL}}}}', email), '{{{{PHONE}}}}', phone) as text from w),
y as (select id, text, template, unnest(['PERSON', 'EMAIL', 'PHONE']) as entity_type, unnest([person, email, phone]) as entity_value from x)
select id, text, entity_type, instr(text, entity_value) - 1 as start, instr(text, entity_value) - 1 + length(entity_value) as stop, entity_value from y where contains(template, '{{{{' || entity_type || '}}}}')""")
def template_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples, one a document: templates filled with made-up values, and where these stand."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("id") % len(values)).cast("int"))
    person = F.concat(pick(_FIRST), F.lit(" "), pick(_LAST))
    email = F.concat(F.lower(F.replace(person, F.lit(" "), F.lit("."))), (F.col("id") % 97).cast("string"), F.lit("@example.com"))
    phone = F.concat(F.lit("555-"), F.lpad((F.col("id") * 7919 % 10000).cast("string"), 4, "0"))
    values = F.create_map(F.lit("PERSON"), person, F.lit("EMAIL"), email, F.lit("PHONE"), phone)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).select("id", fill(pick(_TEMPLATES), values).alias("x"))
    return rows.select("id", F.col("x.text").alias("text"), F.inline("x.spans")).drop("confidence")


_SLOTS = ["", " {{PERSON}}", " {{SSN}} {{EMAIL}}", " {{EMAIL}} {{PHONE}}"]


@query(f"select doc_id, line from (select doc_id, case when doc_id % 7 = 0 then ' ' else left(text, 30) || {_listed(_SLOTS)}[doc_id % 4 + 1] end as line from documents) where trim(line) <> '' and len(list_filter(list_distinct(regexp_extract_all(line, '\\{{\\{{(\\w+)\\}}\\}}', 1)), lambda s: s not in ('PERSON', 'EMAIL', 'PHONE'))) = 0")
def template_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates begun by the documents whose slots are all known; blank lines go."""
    slot = F.get(F.array(*map(F.lit, _SLOTS)), (F.col("doc_id") % len(_SLOTS)).cast("int"))
    line = F.when(F.col("doc_id") % 7 == 0, " ").otherwise(F.concat(F.left("text", F.lit(30)), slot))
    lines = table(spark, sf_dir, "documents").select("doc_id", line.alias("line"))
    known = F.array(*map(F.lit, ("PERSON", "EMAIL", "PHONE")))
    return lines.where((F.trim("line") != "") & (F.size(F.array_except(template_slots(F.col("line")), known)) == 0))


def answer_verdict(prediction: Column, answers: list[list[str]], spaced: Column) -> Column:
    """labels, factual of a model's answer.

    Without information it is labelled -1 only; spaces are taken out where words aren't ``spaced``; factual is 1 where it points out errors of fact.
    """
    said = F.when(spaced, prediction).otherwise(F.replace(prediction, F.lit(" "), F.lit("")))
    holds = lambda *xs: F.greatest(*[F.coalesce(F.contains(said, F.lit(x)), F.lit(False)) for x in xs])
    # What an answer says that lacks information, or finds wrong facts.
    lacking, wrong = ("\u4fe1\u606f\u4e0d\u8db3", "insufficient information"), ("\u4e8b\u5b9e\u6027\u9519\u8bef", "factual errors")
    labels = F.when(holds(*lacking), F.array(F.lit(-1))).otherwise(answer_labels(said, answers))
    return F.struct(labels.alias("labels"), holds(*wrong).cast("int").alias("factual"))


_VERDICTS = [["the", "der"], ["ofthe", "lade"]]
_SAID = "(case when doc_id % 3 = 0 then replace(p, ' ', '') else p end)"


@query("with p as (select doc_id, coalesce(text, '') || case when doc_id % 5 = 0 then ' insufficient information' when doc_id % 7 = 0 then ' \u4fe1\u606f \u4e0d\u8db3' else '' end || case when doc_id % 4 = 0 then ' factual errors' else '' end as p from documents), "
       + f"s as (select doc_id, {_SAID} as s from p) select doc_id, case when contains(s, '\u4fe1\u606f\u4e0d\u8db3') or contains(s, 'insufficient information') then [-1] else [" + ", ".join("greatest(" + ", ".join(f"contains(lower(s), '{a}')::int" for a in x) + ", 0)" for x in _VERDICTS) + "] end as labels, contains(s, 'factual errors')::int as factual from s")
def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: every third without spaces, some that lack information or point out errors."""
    _id = F.col("doc_id")
    lacking = F.when(_id % 5 == 0, " insufficient information").when(_id % 7 == 0, " \u4fe1\u606f \u4e0d\u8db3").otherwise("")
    said = F.concat(F.coalesce("text", F.lit("")), lacking, F.when(_id % 4 == 0, " factual errors").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", answer_verdict(said, _VERDICTS, _id % 3 != 0).alias("x")).select("doc_id", "x.*")


def grouped_scores(results: DataFrame, mapping: DataFrame) -> DataFrame:
    """category, subject, n, correct, score: by subject, by category and in all.

    ``results`` holds subject and correct, ``mapping`` subject, ordinal and category; of a subject's categories the last counts.
    """
    last = mapping.groupBy("subject").agg(F.max_by("category", "ordinal").alias("category"))
    rows = results.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("correct")).join(last, "subject")
    sums = rows.rollup("category", "subject").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))
    return sums.withColumn("score", F.col("correct") / F.col("n"))


@query("""with r as (select source as subject, quality from documents join labels using (doc_id)),
m as (select source as subject, max_by(lang, lang) as category from documents group by source),
s as (select subject, count(*) as n, sum(quality)::bigint as correct from r group by subject)
select category, subject, sum(n)::bigint as n, sum(correct)::bigint as correct, (sum(correct) / sum(n))::double as score from s join m using (subject) group by rollup (category, subject)""")
def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality by source, by the last language of each source, and in all."""
    docs = table(spark, sf_dir, "documents")
    results = docs.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("subject"), F.col("quality").alias("correct"))
    return grouped_scores(results, docs.select(F.col("source").alias("subject"), F.col("lang").alias("ordinal"), F.col("lang").alias("category")).distinct())


@query("select lang, count(*) as n, avg(n_chars) as mean, median(n_chars)::double as median, stddev_pop(n_chars) as spread from documents group by lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean"), F.percentile(n, 0.5).alias("median"), F.stddev_pop(n).alias("spread"))


@query("select role, count(*) as n, 100.0::double * avg(case when contains(text, 'the') then 0 when contains(text, 'a') then 1 else 0 end) as win_rate from conversations group by role")
def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of judgements that name the second choice, the first one checked first."""
    second = F.when(F.contains("text", F.lit("the")), 0).when(F.contains("text", F.lit("a")), 1).otherwise(0)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), (F.avg(second) * 100).alias("win_rate"))
