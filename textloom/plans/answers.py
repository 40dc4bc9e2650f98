"""Queries that mix passages, measure search, take up results again and refill formats; they join the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import fakes, mixes, relevance
from textloom.plans.catalog import _DISJOINT, _kept_spans, knn_l2, query, table
from textloom.sources import resume
from textloom.sources.scratch import new_folder

_C = F.col
N, NOISE, RIGHT = 6, 0.4, 0.2
_BAD, _GOOD = mixes._share(N, NOISE), mixes._share(N, RIGHT)


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, id, good, k: no more than ``N`` events of a user's kind can be taken, so no more are gathered."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", _C("event_id").cast("string").alias("id"), F.coalesce(_C("value") > 60, F.lit(False)).alias("good"))
    order = Window.partitionBy("user_id", "event_type", "good").orderBy(F.md5("id"), "id")
    return rows.withColumn("k", F.row_number().over(order)).where(_C("k") <= N)


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, groups (good events by type), negative (others, by type and rank)."""
    kinds = _ranked(spark, sf_dir).groupBy("user_id", "event_type", "good").agg(F.array_sort(F.collect_list(F.struct("k", "id")))["id"].alias("ids"))
    of = lambda side: F.array_sort(F.collect_list(F.when(side, F.struct("event_type", "ids"))))["ids"]
    return kinds.groupBy("user_id").agg(of(_C("good")).alias("groups"), F.flatten(of(~_C("good"))).alias("negative"))


_RANKED = f"""with ranked as (select user_id, event_type, event_id::varchar as id, coalesce(value > 60, false) as good, row_number() over (partition by user_id, event_type, coalesce(value > 60, false) order by md5(event_id::varchar), event_id::varchar) as k from events qualify k <= {N}),
bad as (select user_id, list(id order by event_type, k) as q from ranked where not good group by user_id)"""


@query(_RANKED + f""",
turns as (select *, row_number() over (partition by user_id order by k, event_type) as place, count(*) filter (k = 1) over (partition by user_id) as kinds from ranked where good),
good as (select user_id, list(id order by place) as p from turns where place <= greatest(kinds, {N - _BAD}) group by user_id)
select user_id, list_concat(coalesce(p, []), (coalesce(q, []))[1:greatest({N} - len(coalesce(p, [])), 0)]) as passages from good full join bad using (user_id)""")
def passage_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six passages a user: one of each type of good events, then more in turn, and others to fill up."""
    return _lists(spark, sf_dir).select("user_id", mixes.by_groups(_C("groups"), _C("negative"), N, NOISE).alias("passages"))


@query(_RANKED + f""",
flat as (select user_id, id, (row_number() over (partition by user_id order by event_type, k) - 1) as i from ranked where good),
drawn as (select *, row_number() over (partition by user_id order by md5('{mixes.SEED}:' || i::varchar || ':' || i::varchar), i) as place from flat),
facts as (select user_id, list(case when place <= {N - _BAD - _GOOD} then 'not ' || id else id end order by place) as p from drawn where place <= {N - _BAD} group by user_id)
select user_id, list_concat(coalesce(p, []), (coalesce(q, []))[1:{_BAD}]) as passages from facts full join bad using (user_id)""")
def passage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong versions of good events drawn without replacement, right ones of others, and noise."""
    flat = F.flatten("groups")
    rows = _lists(spark, sf_dir).select("user_id", flat.alias("p"), F.transform(flat, lambda x: F.concat(F.lit("not "), x)).alias("w"), "negative")
    return rows.select("user_id", mixes.with_wrong_facts(_C("p"), _C("w"), _C("negative"), N, NOISE, RIGHT).alias("passages"))


@query(r"""with lines as (select conv_id * 1000 + turn as node_id, unnest(string_split('1. ' || trim(text), chr(10))) as line, generate_subscripts(string_split('1. ' || trim(text), chr(10)), 1) - 1 as ordinal from conversations where text is not null),
cut as (select node_id, ordinal::int as ordinal, regexp_replace(trim(line), '^\d+[).\s]', '') as question from lines)
select left(sha256(concat_ws(chr(31), node_id::varchar, ordinal::varchar, question)), 32) as query_id, question, ordinal, node_id from cut where question <> ''""")
def question_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines as questions, each relevant to the turn that it is from."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    return relevance.labels(turns.select((_C("conv_id") * 1000 + _C("turn")).alias("node_id"), F.concat(F.lit("1. "), F.trim("text")).alias("answer")))


_HITS = """with hits as (select query_id, rank, vec_id as id from (select q.vec_id as query_id, r.vec_id, row_number() over (partition by q.vec_id order by list_distance(q.embedding::double[], r.embedding::double[]), r.vec_id) as rank
from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0) where rank <= 4),
relevant as (select q.vec_id as query_id, r.vec_id as id, case when r.vec_id % 3 = 0 then 2 else 1 end as grade, row_number() over (partition by q.vec_id order by case when r.vec_id % 3 = 0 then 2 else 1 end desc, r.vec_id) as k
  from embeddings q join embeddings r on q.label = r.label and q.vec_id <> r.vec_id where q.vec_id % 20 = 0),
ideal as (select query_id, count(*) as n_relevant, sum(grade / log2(k + 1)) filter (k <= 4) as ideal from relevant group by query_id),
got as (select query_id, count(*) as hit, min(rank) as first, sum(grade / log2(rank + 1)) as got from hits join relevant using (query_id, id) group by query_id)"""


@query(_HITS + " select query_id, n_relevant, round(coalesce(hit / n_relevant, 0)::double, 9) as recall, round(coalesce(1 / first, 0)::double, 9) as reciprocal_rank, round(coalesce(got / ideal, 0)::double, 9) as gain from ideal left join got using (query_id)")
def search_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well nearest vectors find those of the query's own label."""
    hits = knn_l2(spark, sf_dir).withColumnRenamed("vec_id", "id")
    rows = table(spark, sf_dir, "embeddings").select(_C("vec_id").alias("id"), _C("label").alias("group"), F.when(_C("vec_id") % 3 == 0, 2).otherwise(1).alias("grade"))
    asked = rows.where("id % 20 = 0").select(_C("id").alias("query_id"), "group")
    out = relevance.measures_by_group(hits, rows, asked, 4)
    return out.select("query_id", "n_relevant", *[F.round(c, 9).alias(c) for c in ("recall", "reciprocal_rank", "gain")])


def _scored(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"score": (F.size(F.split("answer", " ")) > 20).cast("int"), "run": F.lit(0)})


@query("""with c as (select conv_id, turn, role, text, turn % 2 = 0 as changed, case when turn % 2 = 0 then text || ' ' || role else text end as answer from conversations where text is not null),
s as (select *, (len(string_split(answer, ' ')) > 20)::int as score, (changed and (conv_id, turn, answer) not in (select conv_id, turn, text from c))::int as run from c)
select role, run, count(*) as n, sum(score)::bigint as total, avg(score) as mean, count_if(score = 1)::bigint as right from s group by all""")
def resumed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers scored, half of them changed, and scored again: run tells in which run a row's score was computed."""
    rows = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "role", _C("text").alias("answer"))
    path, by = new_folder(spark, "scores"), ("conv_id", "turn", "answer")
    resume.resumed(spark, path, rows, by, _scored)
    changed = rows.withColumn("answer", F.when(_C("turn") % 2 == 0, F.concat_ws(" ", "answer", "role")).otherwise(_C("answer")))
    out = resume.resumed(spark, path, changed, by, lambda todo: _scored(todo).withColumn("run", F.lit(1)))
    return resume.folded(out, ("role", "run"))


_CHAR = "substr(entity_value, i::bigint, 1)"
_LEAD = f"{_CHAR} between '1' and '9' and not (i > 1 and regexp_matches(substr(entity_value, (i - 1)::bigint, 1), '[0-9]')) and not (i > 2 and regexp_matches(substr(entity_value, (i - 2)::bigint, 2), '[0-9][.,]'))"
_ALPHABET = f"replace(case when {_LEAD} then '123456789' when regexp_matches({_CHAR}, '[0-9]') then '0123456789' when regexp_matches({_CHAR}, '\\p{{Lu}}') then 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' when regexp_matches({_CHAR}, '\\p{{L}}') then 'abcdefghijklmnopqrstuvwxyz' end, {_CHAR}, '')"
_DRAW = "('0x' || substr(sha256(entity_type || ':' || entity_value || '/' || ((i - 1) // 32)::varchar), ((i - 1) % 32 * 2 + 1)::bigint, 2))::int"


@query(_DISJOINT + f", named as (select distinct entity_type, entity_value from kept), fakes as (select *, array_to_string(list_transform(range(1, length(entity_value) + 1), lambda i: coalesce(substr({_ALPHABET}, ({_DRAW} % length({_ALPHABET}) + 1)::bigint, 1), {_CHAR})), '') as fake from named) select doc_id, start, entity_type, fake from kept join fakes using (entity_type, entity_value)")
def format_fakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fake for each type and original, in the original's own format."""
    found = _kept_spans(spark, sf_dir).select("doc_id", "start", "entity_type", "entity_value")
    made = found.select("entity_type", "entity_value").distinct()
    made = made.withColumn("fake", fakes.refilled(F.concat_ws(":", "entity_type", "entity_value"), _C("entity_value")))
    return found.join(made, ["entity_type", "entity_value"]).select("doc_id", "start", "entity_type", "fake")
