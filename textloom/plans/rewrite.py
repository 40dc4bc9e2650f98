"""Queries that rewrite, join and generate; they join the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import spans
from textloom.plans.catalog import _EVERY, _SPANS, _all_spans, _spans, query, table


def rewrite_think(text: Column) -> Column:
    """``<think>`` block as quoted lines, the first marked; texts without one stay."""
    pattern = r"(?s)^(.*?)<think>(.*?)</think>(.*)$"
    lines = F.filter(F.transform(F.split(F.regexp_extract(text, pattern, 2), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    quoted = F.array_join(F.transform(lines, lambda x, i: F.concat(F.when(i == 0, "> DeepThink: ").otherwise("> "), x)), "\n")
    return F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), quoted, F.regexp_extract(text, pattern, 3))).otherwise(text)


@query(_EVERY + """
select s.doc_id, s.start, s.stop, substr(text, greatest(s.start - 20, 0) + 1, s.start - greatest(s.start - 20, 0)) as before, substr(text, s.stop + 1, 20) as after
from spans s join documents using (doc_id)""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.inline(spans.find_all(F.col("text"))))
    left = F.greatest(F.col("start") - 20, F.lit(0))
    return docs.select("doc_id", "start", "stop", F.substr("text", left + 1, F.col("start") - left).alias("before"), F.substr("text", F.col("stop") + 1, F.lit(20)).alias("after"))


@query(_EVERY + """
select a.doc_id, a.entity_type as type_a, a.start as start_a, b.entity_type as type_b, b.start as start_b
from spans a join spans b on a.doc_id = b.doc_id and a.start < b.stop + 200 and b.start < a.stop + 200
where (a.entity_type, a.start, a.stop) < (b.entity_type, b.start, b.stop)""")
def near_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval join: spans of a document within 200 characters of each other."""
    rows = _all_spans(spark, sf_dir).select("doc_id", "entity_type", "start", "stop")
    a, b = (rows.select("doc_id", *[F.col(c).alias(f"{c}_{x}") for c in ("entity_type", "start", "stop")]) for x in "ab")
    close = (F.col("start_a") < F.col("stop_b") + 200) & (F.col("start_b") < F.col("stop_a") + 200)
    place = lambda x: F.struct(*[F.col(f"{c}_{x}").alias(c) for c in ("entity_type", "start", "stop")])
    return a.join(b, "doc_id").where(close & (place("a") < place("b"))).select("doc_id", F.col("entity_type_a").alias("type_a"), "start_a", F.col("entity_type_b").alias("type_b"), "start_b")


@query(_SPANS + " select doc_id, start, left(entity_value, 2) || repeat('*', length(entity_value) - 6) || right(entity_value, 4) as masked from spans where entity_type = 'CREDIT_CARD'")
def pii_mask_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("entity_value")
    masked = F.concat(F.left(v, F.lit(2)), F.repeat(F.lit("*"), F.length(v) - 6), F.right(v, F.lit(4)))
    return _spans(spark, sf_dir).where("entity_type = 'CREDIT_CARD'").select("doc_id", "start", masked.alias("masked"))


@query("select date_trunc('month', o_orderdate)::timestamp as month, floor(o_totalprice / 10000) * 10000 as band, count(*) as n from orders group by all")
def mask_generalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    band = (F.floor(F.col("o_totalprice") / 10000) * 10000).cast("double").alias("band")
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), band).agg(F.count(F.lit(1)).alias("n"))


@query("""
with d as (select i as id, '4' || lpad(((i * 2654435761 + 12345) % 100000000000000)::varchar, 14, '0') as head from (select doc_id as i from documents)),
c as (select *, (10 - list_sum(list_transform(range(1, 16), lambda k: case when k % 2 = 1 then (case when substr(head, k, 1)::int > 4 then substr(head, k, 1)::int * 2 - 9 else substr(head, k, 1)::int * 2 end) else substr(head, k, 1)::int end)) % 10) % 10 as digit from d)
select id, regexp_replace(head || digit::bigint::varchar, '(.{4})(.{4})(.{4})(.{4})', '\\1 \\2 \\3 \\4') as card from c""")
def card_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded card numbers with their check digit."""
    head = F.concat(F.lit("4"), F.lpad(((F.col("id") * 2654435761 + 12345) % 100000000000000).cast("string"), 14, "0"))
    digit = F.expr("(10 - aggregate(transform(sequence(1, 15), k -> case when k % 2 = 1 then case when int(substr(head, k, 1)) > 4 then int(substr(head, k, 1)) * 2 - 9 else int(substr(head, k, 1)) * 2 end else int(substr(head, k, 1)) end), 0, (a, x) -> a + x) % 10) % 10")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).select("id", head.alias("head"))
    return rows.select("id", F.regexp_replace(F.concat("head", digit.cast("string")), r"(.{4})(.{4})(.{4})(.{4})", "$1 $2 $3 $4").alias("card"))


@query("select * from events where user_id not in (select user_id from events where event_type = (select min(event_type) from events) and value > 95)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("event_type").alias("event_type"))
    gone = events.where("value > 95").join(F.broadcast(first), "event_type").select("user_id")  # one row
    return events.join(gone, "user_id", "left_anti").select(*events.columns)


@query("""
with lines as (select conv_id, turn, unnest(string_split(text, chr(10))) as line from conversations where role = 'user')
select conv_id, turn, trim(regexp_replace(line, '^[0-9]+[).\\s]', '')) as question, count(*) as n from lines where trim(line) <> '' group by all""")
def parse_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return rows.groupBy("conv_id", "turn", F.trim(F.regexp_replace("line", r"^[0-9]+[).\s]", "")).alias("question")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, count(*) as n, sum(value) as total, coalesce(sum(value) / nullif(count(distinct user_id), 0), 0) as per_user from events group by event_type")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.sum("value"), F.countDistinct("user_id")), F.lit(0.0))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), rate.alias("per_user"))


@query("select conv_id, list(case when role = 'assistant' then 'assistant' else 'user' end order by turn) as roles, count(*) as n from conversations group by conv_id")
def conv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user").alias("role")
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role))).alias("x"), F.count(F.lit(1)).alias("n"))
    return rows.select("conv_id", F.col("x.role").alias("roles"), "n")


@query("select conv_id, turn, case when role = 'assistant' then '> DeepThink: ' || trim(split_part(text, chr(10), 1)) || '!' else text end as shown from conversations where trim(split_part(text, chr(10), 1)) <> ''")
def think_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    raw = F.when(F.col("role") == "assistant", F.concat(F.lit("<think>"), first, F.lit("</think>!"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").where(F.trim(first) != "").select("conv_id", "turn", rewrite_think(raw).alias("shown"))
