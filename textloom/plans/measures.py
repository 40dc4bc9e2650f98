"""Queries that evaluate spans, choose strategies and rewrite texts; they join the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import profile, spans
from textloom.plans.catalog import _DISJOINT, _EVERY, _ONE, _all_spans, _kept_spans, _spans, nearest, query, table

# Masking strategies in order, with what they keep and the types they suit.
STRATEGIES = (
    ("placeholder", True, False, False, "low", ("ALL",)),
    ("fake_entity", True, True, True, "high", ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION", "ADDRESS", "CREDIT_CARD", "SSN", "ORGANIZATION", "IP_ADDRESS", "URL", "DATE", "DATE_TIME")),
    ("hash", False, False, False, "low", ("ALL",)),
    ("encrypt", True, False, False, "low", ("ALL",)),
    ("mask", False, True, False, "medium", ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "SSN")),
    ("generalize", False, False, False, "medium", ("DATE", "DATE_TIME", "LOCATION", "AGE")),
)
# The strategy of a scenario; others take placeholders.
SCENARIOS = {"general": "placeholder", "llm_training": "fake_entity", "analytics": "fake_entity", "display": "mask", "storage": "encrypt", "deduplication": "hash"}
# The strategy of a type.
BY_TYPE = {"PERSON": "fake_entity", "EMAIL_ADDRESS": "fake_entity", "PHONE_NUMBER": "fake_entity", "LOCATION": "fake_entity", "ADDRESS": "fake_entity", "CREDIT_CARD": "fake_entity", "SSN": "hash", "IP_ADDRESS": "fake_entity", "URL": "fake_entity", "ORGANIZATION": "fake_entity", "DATE": "generalize", "DATE_TIME": "generalize"}
# Least confidences by detection strategy: recognisers', language models'.
THRESHOLDS = {"high_recall": (0.3, 0.5), "balanced": (0.5, 0.7), "high_precision": (0.7, 0.8)}
#: Names of types in evaluations.
EVALUATED = {"EMAIL": "EMAIL_ADDRESS", "PHONE": "PHONE_NUMBER", "ADDRESS": "LOCATION"}


def rate(part: Column, other: Column) -> Column:
    """``part`` of both; 0 of nothing."""
    return F.coalesce(F.try_divide(part, part + other), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def _matched(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, entity_type, ``more``, predicted, true for each (type, start, stop) of either: spans of ten characters or more against those of plain types."""
    key = ["doc_id", "entity_type", "start", "stop"]
    predicted = _all_spans(spark, sf_dir).where("stop - start >= 10").select(*key).distinct().withColumn("predicted", F.lit(True))
    truth = _spans(spark, sf_dir).select(*key).distinct().withColumn("true", F.lit(True))
    return predicted.join(truth, key, "full").select("doc_id", "entity_type", *more, F.coalesce("predicted", F.lit(False)).alias("predicted"), F.coalesce("true", F.lit(False)).alias("true"))


_MATCHED = _EVERY + """,
p as (select doc_id, entity_type, start, stop, true as predicted from spans where stop - start >= 10),
t as (select doc_id, entity_type, start, stop, true as actual from spans where entity_type in ('EMAIL', 'CREDIT_CARD', 'IP_ADDRESS') and (doc_id, entity_type, start, stop) in (select doc_id, entity_type, start, stop from plain)),
m as (select doc_id, entity_type, coalesce(predicted, false) as predicted, coalesce(actual, false) as actual from p full join t using (doc_id, entity_type, start, stop))"""
_MATCHED = _MATCHED.replace("(select doc_id, entity_type, start, stop from plain)", "(select doc_id, entity_type, start, start + length(entity_value) from placed where ordinal in (0, 2, 6))")


def _counts() -> list[Column]:
    p, t = F.col("predicted"), F.col("true")
    return [F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn")]


@query(_MATCHED + """,
c as (select entity_type, count_if(predicted and actual)::bigint as tp, count_if(predicted and not actual)::bigint as fp, count_if(actual and not predicted)::bigint as fn from m group by all),
r as (select *, coalesce(tp / nullif(tp + fp, 0), 0)::double as p, coalesce(tp / nullif(tp + fn, 0), 0)::double as r from c)
select entity_type, tp, fp, fn, p as span_precision, r as span_recall, coalesce(2 * p * r / nullif(p + r, 0), 0)::double as f1 from r""")
def eval_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sets of (type, start, stop): counts and rates by type."""
    rows = _matched(spark, sf_dir).groupBy("entity_type").agg(*_counts())
    p, r = rate(F.col("tp"), F.col("fp")), rate(F.col("tp"), F.col("fn"))
    return rows.select("*", p.alias("span_precision"), r.alias("span_recall"), f1(p, r).alias("f1"))


@query(_MATCHED + """,
k as (select coalesce(p.doc_id, t.doc_id) as doc_id, p.doc_id is not null as predicted, t.doc_id is not null as actual from (select distinct doc_id, start, stop from p) p full join (select distinct doc_id, start, stop from t) t on p.doc_id = t.doc_id and p.start = t.start and p.stop = t.stop),
c as (select doc_id, count_if(predicted and actual)::bigint as tp, count_if(predicted and not actual)::bigint as fp, count_if(actual and not predicted)::bigint as fn from k group by doc_id),
r as (select *, coalesce(tp / nullif(tp + fp, 0), 0)::double as p, coalesce(tp / nullif(tp + fn, 0), 0)::double as r from c)
select doc_id, tp, fp, fn, p as span_precision, r as span_recall, coalesce(2 * p * r / nullif(p + r, 0), 0)::double as f1 from r""")
def eval_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sets of (start, stop) whatever the type: counts and rates by text."""
    places = _matched(spark, sf_dir, "start", "stop").groupBy("doc_id", "start", "stop").agg(F.bool_or("predicted").alias("predicted"), F.bool_or("true").alias("true"))
    rows = places.groupBy("doc_id").agg(*_counts())
    p, r = rate(F.col("tp"), F.col("fp")), rate(F.col("tp"), F.col("fn"))
    return rows.select("*", p.alias("span_precision"), r.alias("span_recall"), f1(p, r).alias("f1"))


@query(_MATCHED + """,
c as (select doc_id, count_if(predicted and actual) as tp, count_if(predicted and not actual) as fp, count_if(actual and not predicted) as fn from m group by doc_id)
select count(*) as n, round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 9)::double as macro_precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 9)::double as macro_recall,
       (sum(tp) / sum(tp + fp))::double as micro_precision, (sum(tp) / sum(tp + fn))::double as micro_recall from c""")
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the documents' rates beside rates of all spans."""
    rows = _matched(spark, sf_dir).groupBy("doc_id").agg(*_counts())
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(rate(tp, fp)), 9).alias("macro_precision"), F.round(F.avg(rate(tp, fn)), 9).alias("macro_recall"), F.sum("tp").alias("a"), F.sum("fp").alias("b"), F.sum("fn").alias("c"))
    return sums.select("n", "macro_precision", "macro_recall", rate(F.col("a"), F.col("b")).alias("micro_precision"), rate(F.col("a"), F.col("c")).alias("micro_recall"))


@query(_EVERY + """,
p as (select * from spans where entity_type = 'PHONE'), t as (select * from spans where entity_type = 'CREDIT_CARD')
select (select count(*) from t where exists (select 1 from p where p.doc_id = t.doc_id and p.start < t.stop and t.start < p.stop)) as tp,
       (select count(*) from p where not exists (select 1 from t where p.doc_id = t.doc_id and p.start < t.stop and t.start < p.stop)) as fp,
       (select count(*) from t where not exists (select 1 from p where p.doc_id = t.doc_id and p.start < t.stop and t.start < p.stop)) as fn""")
def eval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many to many: true spans that any predicted one overlaps, and predictions that overlap none."""
    both = table(spark, sf_dir, "documents").select(spans.find_all(F.col("text")).alias("s"))
    rows = both.select(F.filter("s", lambda x: x["entity_type"] == "PHONE").alias("p"), F.filter("s", lambda x: x["entity_type"] == "CREDIT_CARD").alias("t"))
    meets = lambda a, others: F.exists(others, lambda b: (a["start"] < b["stop"]) & (b["start"] < a["stop"]))
    hit = F.size(F.filter("t", lambda x: meets(x, F.col("p"))))
    wrong = F.size(F.filter("p", lambda x: ~meets(x, F.col("t"))))
    return rows.select(hit.alias("hit"), wrong.alias("wrong"), F.size("t").alias("n")).agg(F.sum("hit").alias("tp"), F.sum("wrong").alias("fp"), F.sum(F.col("n") - F.col("hit")).alias("fn"))


def nested(found: Column) -> Column:
    """Whether some span lies in another; equal ones do."""
    return F.exists(found, lambda a: F.size(F.filter(found, lambda b: (a["start"] >= b["start"]) & (a["stop"] <= b["stop"]))) > 1)


@query(_EVERY + " select d.doc_id, exists (select 1 from spans a join spans b on a.doc_id = b.doc_id and a.start >= b.start and a.stop <= b.stop and (a.start, a.stop) <> (b.start, b.stop) where a.doc_id = d.doc_id) as nested from documents d")
def nested_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", spans.let(spans.find_all(F.col("text")), nested).alias("nested"))


def format_complexity(entity_type: Column, value: Column) -> Column:
    odd = F.when(entity_type == "PHONE_NUMBER", value.rlike(r"[+(). ]")).when(entity_type == "EMAIL_ADDRESS", F.lit(False))
    odd = odd.when(entity_type == "LOCATION", F.size(F.split(F.trim(value), r"\s+")) > 4).when(entity_type == "CREDIT_CARD", value.rlike(r"[- *]"))
    return F.when(odd.otherwise(F.length(value) > 20), "COMPLEX").otherwise("SIMPLE")


def context_complexity(context: Column) -> Column:
    special = F.length(F.regexp_replace(context, r"[\p{L}\p{N} .,!?]", ""))
    return F.when((profile.chars(context, ".!?") > 1) | (special > 5), "COMPLEX").otherwise("SIMPLE")


_NAMED = "case entity_type " + " ".join(f"when '{a}' then '{b}'" for a, b in EVALUATED.items()) + " else entity_type end"
_CATEGORIES = _EVERY + f""",
e as (select {_NAMED} as entity_type, entity_value, substr(text, greatest(start - 20, 0) + 1, stop + 20 - greatest(start - 20, 0)) as context from spans join documents using (doc_id)),
c as (select entity_type, case when case entity_type when 'PHONE_NUMBER' then regexp_matches(entity_value, '[+(). ]') when 'EMAIL_ADDRESS' then false when 'LOCATION' then len(string_split_regex(trim(entity_value), '\\s+')) > 4
    when 'CREDIT_CARD' then regexp_matches(entity_value, '[- *]') else length(entity_value) > 20 end then 'COMPLEX' else 'SIMPLE' end as format,
  case when length(context) - length(translate(context, '.!?', '')) > 1 or length(regexp_replace(context, '[\\p{{L}}\\p{{N}} .,!?]', '', 'g')) > 5 then 'COMPLEX' else 'SIMPLE' end as around from e),
counted as (select 'FN_' || entity_type || '_' || format || '_' || around as category, entity_type, format, around, count(*) as n from c group by all)"""


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("text", F.inline(spans.find_all(F.col("text"))))
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVALUATED.items() for x in kv]), F.col("entity_type")), F.col("entity_type"))
    left = F.greatest(F.col("start") - 20, F.lit(0))
    rows = rows.select(name.alias("entity_type"), "entity_value", F.substr("text", left + 1, F.col("stop") + 20 - left).alias("context"))
    rows = rows.select("entity_type", format_complexity(F.col("entity_type"), F.col("entity_value")).alias("format"), context_complexity(F.col("context")).alias("around"))
    return rows.groupBy(F.concat_ws("_", F.lit("FN"), "entity_type", "format", "around").alias("category"), "entity_type", "format", "around").agg(F.count(F.lit(1)).alias("n"))


@query(_CATEGORIES + " select * from counted")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _categories(spark, sf_dir)


@query(_CATEGORIES + " select category, n from counted order by n desc, category limit 10")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten commonest, ties by name."""
    return _categories(spark, sf_dir).select("category", "n").orderBy(F.col("n").desc(), "category").limit(10)


def strategy_table(spark: SparkSession) -> DataFrame:
    """ordinal, strategy, reversible, keeps_format, keeps_meaning, utility, types."""
    rows = [F.struct(F.lit(k).alias("ordinal"), F.lit(n).alias("strategy"), F.lit(r).alias("reversible"), F.lit(f).alias("keeps_format"), F.lit(m).alias("keeps_meaning"), F.lit(u).alias("utility"), F.array(*map(F.lit, t)).alias("types")) for k, (n, r, f, m, u, t) in enumerate(STRATEGIES)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def applicable(types: Column, entity_type: Column) -> Column:
    return F.array_contains(types, "ALL") | F.array_contains(types, entity_type)


def default_strategy(entity_type: Column, scenario: Column) -> Column:
    """Fakes for training and analysis where the type has some, else the scenario's."""
    out = F.when(scenario.isin("llm_training", "analytics") & entity_type.isin(*STRATEGIES[1][5]), "fake_entity")
    for name, strategy in SCENARIOS.items():
        out = out.when(scenario == name, strategy)
    return out.otherwise("placeholder")


_TABLE = "(values " + ", ".join(f"({k}, '{n}', {r}, {f}, {m}, '{u}', [{', '.join(repr(x) for x in t)}])" for k, (n, r, f, m, u, t) in enumerate(STRATEGIES)) + ") s(ordinal, strategy, reversible, keeps_format, keeps_meaning, utility, types)"


@query(_EVERY + f", t as (select {_NAMED} as entity_type, count(*) as n from spans group by 1) select c.*, count(entity_type) as n_types, coalesce(sum(n), 0)::bigint as n_spans from (select * from {_TABLE}) c left join t on list_contains(types, 'ALL') or list_contains(types, entity_type) group by all")
def strategy_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each strategy with the types and the number of spans in the documents that it suits."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVALUATED.items() for x in kv]), F.col("entity_type")), F.col("entity_type"))
    found = _all_spans(spark, sf_dir).groupBy(name.alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))  # one row a type
    strategies = strategy_table(spark)
    rows = strategies.join(F.broadcast(found), applicable(F.col("types"), F.col("entity_type")), "left")
    return rows.groupBy(*strategies.columns).agg(F.count("entity_type").alias("n_types"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_spans"))


@query(_EVERY + f", t as (select distinct {_NAMED} as entity_type from spans) select entity_type, list(strategy order by ordinal) as strategies from t join {_TABLE} on list_contains(types, 'ALL') or list_contains(types, entity_type) group by entity_type")
def strategies_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What suits each type found, in the table's order."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVALUATED.items() for x in kv]), F.col("entity_type")), F.col("entity_type"))
    types = _all_spans(spark, sf_dir).select(name.alias("entity_type")).distinct()
    table_ = F.array(*[F.struct(F.lit(n).alias("strategy"), F.array(*map(F.lit, t)).alias("types")) for n, *_, t in STRATEGIES])
    return types.select("entity_type", F.transform(F.filter(table_, lambda s: applicable(s["types"], F.col("entity_type"))), lambda s: s["strategy"]).alias("strategies"))


@query(_EVERY + f", t as (select {_NAMED} as entity_type, count(*) as n from spans group by 1), c as (select unnest([{', '.join(repr(c) for c in (*SCENARIOS, 'other'))}]) as scenario) select entity_type, n, scenario, case when scenario in ('llm_training', 'analytics') and entity_type in {tuple(BY_TYPE)} then 'fake_entity' " + " ".join(f"when scenario = '{c}' then '{s}'" for c, s in SCENARIOS.items()) + " else 'placeholder' end as strategy, case entity_type " + " ".join(f"when '{t}' then '{s}'" for t, s in BY_TYPE.items()) + " end as of_type from t, c")
def strategy_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each type that occurs is masked in each scenario."""
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVALUATED.items() for x in kv]), F.col("entity_type")), F.col("entity_type"))
    found = _all_spans(spark, sf_dir).groupBy(name.alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
    rows = found.select("entity_type", "n", F.explode(F.array(*map(F.lit, (*SCENARIOS, "other")))).alias("scenario"))
    of_type = F.try_element_at(F.create_map(*[F.lit(x) for kv in BY_TYPE.items() for x in kv]), F.col("entity_type"))
    return rows.select("entity_type", "n", "scenario", default_strategy(F.col("entity_type"), F.col("scenario")).alias("strategy"), of_type.alias("of_type"))


_FINANCE, _HEALTH = profile.DOMAINS["financial"][:6], profile.DOMAINS["medical"][:5]
_THREE = (profile.FOUND[0], profile.FOUND[2], profile.FOUND[1])


@query("with f as (select doc_id, length(text) as n, (" + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in _THREE) + r")::double / greatest(len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')), 1) as density, regexp_matches(text, '[^\x00-\x7F]') as multilingual, regexp_matches(text, '[+().\-]{2,}') as formatting, "
       + " or ".join(f"contains(lower(text), '{k}')" for k in (*_FINANCE, *_HEALTH)) + " as risky from documents) select doc_id, case when risky then 'high_precision' when n > 200 and density < 0.1 then 'balanced' when density > 0.3 or formatting or multilingual then 'high_recall' else 'balanced' end as strategy from f")
def smart_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shorter choice of a detection strategy: any keyword of two domains, then length, density and script."""
    text = F.col("text")
    low = F.lower(text)
    f = profile.features(text)
    found = sum((F.regexp_count(text, F.lit(p)) for p in _THREE[1:]), F.regexp_count(text, F.lit(_THREE[0])))
    risky = F.lit(False)
    for k in (*_FINANCE, *_HEALTH):
        risky = risky | F.contains(low, F.lit(k))
    rows = table(spark, sf_dir, "documents").select("doc_id", f["text_length"].alias("n"), (found / F.greatest(f["word_count"], F.lit(1))).alias("density"), f["multilingual"].alias("multilingual"), f["complex_formatting"].alias("formatting"), risky.alias("risky"))
    choice = F.when(F.col("risky"), "high_precision").when((F.col("n") > 200) & (F.col("density") < 0.1), "balanced").when((F.col("density") > 0.3) | F.col("formatting") | F.col("multilingual"), "high_recall").otherwise("balanced")
    return rows.select("doc_id", choice.alias("strategy"))


@query(r"select locale, count(*) as n from (select case when regexp_matches(text, '[\x{4e00}-\x{9fff}]') then 'zh_CN' when regexp_matches(text, '[\x{3040}-\x{30ff}]') then 'ja_JP' when regexp_matches(text, '[\x{ac00}-\x{d7af}]') then 'ko_KR' else 'en_US' end as locale from documents union all select unnest(['zh_CN', 'ja_JP', 'ko_KR', 'zh_CN'])) group by locale")
def locale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locales of all documents and of four lines in other scripts."""
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ("你好", "かな", "한글", "日本かな")))).alias("text"))
    rows = table(spark, sf_dir, "documents").select("text").unionByName(more)
    return rows.groupBy(profile.locale(F.col("text")).alias("locale")).agg(F.count(F.lit(1)).alias("n"))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


@query("select doc_id, case when length(text) > 200 then left(text, 200) || '...' else text end as shown, sha256(text) as content_hash, left(md5(doc_id::varchar), 2) || '/' || substr(md5(doc_id::varchar), 3) as path from documents")
def document_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preview, content hash and sharded file path."""
    name = F.md5(F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("shown"), F.sha2("text", 256).alias("content_hash"), F.concat(F.left(name, F.lit(2)), F.lit("/"), F.substr(name, F.lit(3))).alias("path"))


# Runs of characters that cleaning keeps.
_KEPT = r"""[a-zA-Z0-9 \x{00C0}-\x{01B0}\x{1EA0}-\x{1EF9}`~!@#$%^&*()_\-+=\[\]{}|\\;:'",.<>/?]+"""


@query("select doc_id, regexp_replace(trim(array_to_string(regexp_extract_all(text, '" + _KEPT.replace("'", "''") + r"'), ' ')), '\s+', ' ', 'g') as cleaned from documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.array_join(F.regexp_extract_all("text", F.lit(_KEPT), F.lit(0)), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.trim(runs), r"\s+", " ").alias("cleaned"))


@query("""select query_id, '<details>' || string_agg(text || chr(10), '' order by rank) || '</details>' as context, count(*) as n from (select q.vec_id as query_id, r.vec_id, row_number() over (partition by q.vec_id order by list_distance(q.embedding::double[], r.embedding::double[]), r.vec_id) as rank
from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0) join documents on doc_id = vec_id where rank <= 3 group by query_id""")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest passages of each query, in order, as one block; three rows a query."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    hits = nearest(rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 3)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.concat("text", F.lit("\n")).alias("line"))
    out = hits.join(texts, "vec_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"), F.count(F.lit(1)).alias("n"))
    return out.select("query_id", F.concat(F.lit("<details>"), F.array_join("x.line", ""), F.lit("</details>")).alias("context"), "n")


# What normalising an answer takes away.
_PUNCTUATION = r"[!-/:-@\[-`{-~]"


@query("select conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '" + _PUNCTUATION + r"', '', 'g'), '\s+', ' ', 'g')) as answer, regexp_matches(regexp_replace(lower(text), '" + _PUNCTUATION + "', '', 'g'), '[abcd]') as has_choice from conversations where role = 'assistant'")
def answer_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.regexp_replace(F.lower("text"), _PUNCTUATION, "")
    return table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("answer"), bare.rlike("[abcd]").alias("has_choice"))


@query("select count(*) filter (toxic = 1)::double / count(*) as fact_check_rate, coalesce(count(*) filter (toxic = 1 and quality = 0) / nullif(count(*) filter (toxic = 1), 0), 0)::double as correct_rate, count(*) filter (toxic = 1) as fact_tt, count(*) filter (toxic = 1 and quality = 0) as correct_tt from labels")
def fact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of answers flagged, and of those the share that is right; 0 without any."""
    flagged, right = F.count_if(F.col("toxic") == 1), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 0))
    sums = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("n"), flagged.alias("fact_tt"), right.alias("correct_tt"))
    return sums.select((F.col("fact_tt") / F.col("n")).alias("fact_check_rate"), F.coalesce(F.try_divide("correct_tt", "fact_tt"), F.lit(0.0)).alias("correct_rate"), "fact_tt", "correct_tt")


@query("with c as (select doc_id, length(text) as n, greatest(1, ceil((length(text) - 100) / 1900.0)::int) as chunks from documents) select doc_id, chunks as n_chunks, least(n, 2000)::bigint as largest, (n + 100 * (chunks - 1))::double / chunks as mean_size from c")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and sizes of each document's overlapping chunks."""
    last = F.greatest(F.lit(1), F.ceil((F.length("text") - 100) / F.lit(1900.0)).cast("int")) - 1
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    size = F.length(F.substr("text", F.col("i") * 1900 + 1, F.lit(2000)))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_chunks"), F.max(size).cast("long").alias("largest"), F.avg(size).alias("mean_size"))


_WHITE = ("terms of use", "this work is licensed")


@query(_EVERY + ", w as (select doc_id, " + " or ".join(f"contains(lower(text), '{x}')" for x in _WHITE) + " as listed from documents) select doc_id, listed, case when listed then 0 else coalesce(n, 0) end as n from w left join (select doc_id, count(*) as n from spans group by doc_id) using (doc_id)")
def whitelisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a listed phrase report no spans."""
    listed = F.exists(F.array(*map(F.lit, _WHITE)), lambda x: F.contains(F.lower("text"), x))
    found = F.size(spans.find_all(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", listed.alias("listed"), F.when(listed, 0).otherwise(found).cast("long").alias("n"))


@query(_EVERY + " select doc_id, start, stop, '[' || entity_type || '_' || (row_number() over (partition by doc_id, entity_type order by start, stop) - 1) || ']' as label from spans")
def spans_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels numbered from 0 by type, in order of place."""
    place = F.row_number().over(Window.partitionBy("doc_id", "entity_type").orderBy("start", "stop")) - 1
    return _all_spans(spark, sf_dir).select("doc_id", "start", "stop", F.concat(F.lit("["), "entity_type", F.lit("_"), place.cast("string"), F.lit("]")).alias("label"))


_SHOWN = {"tagged": "'<pii:' || lower(t) || '>' || v || '</pii:' || lower(t) || '>'", "redacted": "'<PII:' || lower(t) || '/>'", "replaced": "'<' || t || '>'"}


@query(_ONE + """, p as (select doc_id, s.t as t, s.a as a, s.b as b, substr(text, s.a + 1, s.b - s.a) as v, text, coalesce(lag(s.b) over (partition by doc_id order by s.a), 0) as before from one join documents using (doc_id))
select doc_id, """ + ", ".join(f"string_agg(substr(text, before + 1, a - before) || {x}, '' order by a) || substr(max(text), (max(b) + 1)::bigint) as {n}" for n, x in _SHOWN.items()) + " from p group by doc_id")
def redaction_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged, redacted and replaced texts, over spans of all types."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", spans.merge_longest(spans.find_all(F.col("text"))).alias("s")).where("size(s) > 0")
    return rows.select("doc_id", *[spans.rewritten(F.col("text"), F.col("s"), x).alias(n) for n, x in spans.REDACTIONS.items()])


def located(text: Column, value: Column) -> Column:
    """start, entity_value of the first place of ``value``, else of the first in any case as it stands there; null without one."""
    exact, loose = F.position(value, text), F.position(F.lower(value), F.lower(text))
    at = F.when(exact > 0, exact).when(loose > 0, loose)
    return F.when(at.isNotNull(), F.struct((at - 1).alias("start"), F.substr(text, at, F.length(value)).alias("entity_value")))


_UP = "translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(f"""with w as (select doc_id, text, string_split(text, ' ')[3] as w from documents),
v as (select doc_id, text, case doc_id % 3 when 0 then w when 1 then {_UP} else w || '#' end as value from w where w <> ''),
a as (select *, case when instr(text, value) > 0 then instr(text, value) else instr(lower(text), lower(value)) end as at_ from v)
select doc_id, (at_ - 1)::int as start, substr(text, at_, length(value)) as entity_value from a where at_ > 0""")
def value_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each text's third word stands first, asked for as it is, in capitals or with a sign too many."""
    word = F.get(F.split("text", " "), F.lit(2))
    asked = F.when(F.col("doc_id") % 3 == 0, word).when(F.col("doc_id") % 3 == 1, F.translate(word, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.concat(word, F.lit("#")))
    rows = table(spark, sf_dir, "documents").where(word != "").select("doc_id", located(F.col("text"), asked).alias("x"))
    return rows.where("x is not null").select("doc_id", "x.start", "x.entity_value")


def session_mapping(found: DataFrame) -> DataFrame:
    """``found`` (session, turn, entity_type, start, entity_value) with its placeholder, numbered by session and type: turn by turn, from the last in a text."""
    place = F.row_number().over(Window.partitionBy("session", "entity_type").orderBy("turn", F.col("start").desc()))
    number = F.when(place < 1000, F.lpad(place.cast("string"), 3, "0")).otherwise(place.cast("string"))
    return found.withColumn("placeholder", F.concat(F.lit("${"), "entity_type", F.lit("_"), number, F.lit("}")))


def recovered(masked: DataFrame, mapping: DataFrame) -> DataFrame:
    """``masked`` (session, turn, masked) with ``text``, every placeholder known to its session replaced; others stay."""
    names = masked.select("session", "turn", F.explode(F.array_distinct(F.regexp_extract_all("masked", F.lit(r"\$\{[A-Z_]+_\d+\}"), F.lit(0)))).alias("placeholder"))
    values = names.join(mapping.select("session", "placeholder", "entity_value"), ["session", "placeholder"])
    values = values.groupBy("session", "turn").agg(F.array_sort(F.collect_list(F.struct("placeholder", "entity_value"))).alias("known"))
    rows = masked.join(values, ["session", "turn"], "left")
    text = F.aggregate(F.coalesce("known", F.array().cast("array<struct<placeholder:string,entity_value:string>>")), F.col("masked"), lambda t, x: F.replace(t, x["placeholder"], x["entity_value"]))
    return rows.select("session", "turn", "masked", text.alias("text"))


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbouring documents are a session, each a turn."""
    rows = _kept_spans(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).alias("session"), F.col("doc_id").alias("turn"), "entity_type", "start", "stop", "entity_value")
    return session_mapping(rows)


_MAPPING = _DISJOINT + ", mapped as (select doc_id // 10 as session, doc_id as turn, entity_type, start, entity_value, '${' || entity_type || '_' || lpad((row_number() over (partition by doc_id // 10, entity_type order by doc_id, start desc))::varchar, 3, '0') || '}' as placeholder from kept)"


@query(_MAPPING + " select * from mapped")
def session_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).drop("stop")


@query(_MAPPING + """, cuts as (select *, start + length(entity_value) as stop, coalesce(lag(start + length(entity_value)) over (partition by turn order by start), 0) as before from mapped)
select turn, max(text) as text, string_agg(substr(text, before + 1, start - before) || placeholder, '' order by start) || substr(max(text), (max(stop) + 1)::bigint) as masked from cuts join documents on turn = doc_id group by turn""")
def session_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked by the sessions' numbers, then recovered by a join on session and placeholder."""
    mapping = _sessions(spark, sf_dir)
    marked = mapping.groupBy("session", "turn").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "entity_value", "placeholder"))).alias("marked"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("turn"), "text")
    masked = marked.join(docs, "turn").select("session", "turn", spans.splice(F.col("text"), F.col("marked")).alias("masked"))
    return recovered(masked, mapping).select("turn", "text", "masked")


@query("select u.conv_id, u.turn, u.text as asked, a.text as answered from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with the turn after it, joined on the turn's number."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    answered = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answered"))
    return asked.join(answered, ["conv_id", "turn"])


@query("select doc_id, 'unlabelled' as side from (select doc_id from documents except select doc_id from labels) union all select doc_id, 'both' as side from (select doc_id from documents intersect select doc_id from labels)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    return docs.subtract(labels).withColumn("side", F.lit("unlabelled")).unionByName(docs.intersect(labels).withColumn("side", F.lit("both")))


@query("select user_id, event_id, greatest(coalesce(value - lag(value) over w, 0), 0) / nullif(epoch(ts) - epoch(lag(ts) over w), 0) * 100 as load from events window w as (partition by user_id order by ts, event_id)")
def load_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth since the user's last sample over the time between, 0 if it fell; null at the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    grown = F.greatest(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)), F.lit(0.0))
    seconds = F.col("ts").cast("timestamp").cast("double") - F.lag("ts").over(w).cast("timestamp").cast("double")
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.try_divide(grown, seconds) * 100).alias("load"))


_STEP = "struct<entity_type:string,start:int,stop:int,confidence:double>"


def merge_preferred(found: Column, prefer: str = "longer", limit: float = 0.5) -> Column:
    """Spans merged in order of start and falling confidence.

    Each meets the first kept span that it overlaps by more than ``limit``; of the same place the
    more confident stays, else the ``longer`` one or that of ``higher_confidence``, in its place.
    """
    ordered = F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("a"), (-s["confidence"]).alias("b"), s["stop"].alias("c"), s["entity_type"].alias("d"), s.alias("s")))), lambda x: x["s"])

    def better(new: Column, old: Column) -> Column:
        surer = new["confidence"] > old["confidence"]
        longer = (new["stop"] - new["start"]) > (old["stop"] - old["start"])
        return F.when((new["start"] == old["start"]) & (new["stop"] == old["stop"]), surer).otherwise(longer if prefer == "longer" else surer)

    def step(kept: Column, s: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: spans.overlap(k, s) > limit), F.lit(True)) - 1
        swapped = F.transform(kept, lambda k, i: F.when((i == at) & better(s, k), s).otherwise(k))
        return F.when(at < 0, F.concat(kept, F.array(s))).otherwise(swapped)

    return F.aggregate(ordered, F.array().cast(f"array<{_STEP}>"), step)
