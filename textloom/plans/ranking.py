"""Queries that rank sentences, answers and search results; they join the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import embed, exams, markdown, sentences
from textloom.functions.batches import small_batches
from textloom.models import preference
from textloom.plans.catalog import query, table
from textloom.sources.scratch import new_folder

_C = F.col
_SENTENCES = f"""with recursive said as (
  select doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '{sentences.ENDS}'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') as s from documents),
line as (select doc_id, unnest(s) as sentence, generate_subscripts(s, 1) - 1 as nr, len(s) as n from said),
w as (select doc_id, nr, list_filter(string_split_regex(lower(sentence), '{sentences.WORD_GAPS}'), lambda x: x <> '') as w from line),
word as (select distinct doc_id, nr, len(w) as size, unnest(w) as word from w),
shared as (select a.doc_id, a.nr as a, b.nr as b, count(*) / (ln(any_value(a.size)) + ln(any_value(b.size))) as weight
  from word a join word b on a.doc_id = b.doc_id and a.word = b.word where ln(a.size) + ln(b.size) > 1e-12 group by all),
degree as (select doc_id, a, sum(weight) as degree from shared group by all),
edge as materialized (
  select doc_id, a, b, weight / degree as share from shared join degree using (doc_id, a)
  union all select x.doc_id, x.nr, y.nr, 1.0::double / x.n from line x join line y using (doc_id) where not exists (select 1 from degree d where d.doc_id = x.doc_id and d.a = x.nr)),
total as materialized (select doc_id, any_value(n) as n from line group by doc_id),
rank_ as (select doc_id, nr, 1.0::double / n as x, 0 as i from line
  union all select e.doc_id, e.b, {1 - sentences.DAMPING:.2f}::double / any_value(t.n) + {sentences.DAMPING}::double * sum(r.x * e.share), any_value(r.i) + 1
  from rank_ r join edge e on e.doc_id = r.doc_id and e.a = r.nr join total t on t.doc_id = r.doc_id where r.i < {sentences.ROUNDS} group by e.doc_id, e.b),
scored as (select doc_id, nr, sentence, round(x, 6) as score from rank_ join line using (doc_id, nr) where i = {sentences.ROUNDS} and length(sentence) >= {sentences.SHORTEST}),
best as (select doc_id, (row_number() over (partition by doc_id order by score desc, nr))::int as rank, nr::int as position, sentence, score from scored)"""


@query(_SENTENCES + " select * from best where rank <= 3")
def key_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's three key sentences by TextRank."""
    return sentences.key_sentences(table(spark, sf_dir, "documents"))


@query(_SENTENCES + f" select doc_id, coalesce(sentence, left(text, {sentences.FALLBACK})) as abstract from documents left join (select * from best where rank = 1) using (doc_id)")
def abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentence of each text."""
    return sentences.abstracts(table(spark, sf_dir, "documents"))


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as markdown."""
    return markdown.markdown(table(spark, sf_dir, "pages"))


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair, question, answer_1, answer_2, label: a good and a bad document of a language, by the order of a hash, sides by another."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").join(labels, "doc_id").withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    ranked = docs.withColumn("k", F.row_number().over(Window.partitionBy("lang", "quality", "deal").orderBy(F.md5(_C("doc_id").cast("string")))))
    sides = [ranked.where(_C("quality") == q).select("lang", "deal", "k", _C("doc_id").alias(f"doc_{q}"), _C("text").alias(f"text_{q}")) for q in (1, 0)]
    first = F.pmod(F.xxhash64("doc_1", F.lit("side")), F.lit(2)) == 0
    text = lambda a, b: F.when(first, _C(a)).otherwise(_C(b))
    return sides[0].join(sides[1], ["lang", "deal", "k"]).select(_C("doc_1").alias("pair"), _C("lang").alias("question"), text("text_1", "text_0").alias("answer_1"), text("text_0", "text_1").alias("answer_2"), first.cast("int").alias("label"))


@query()
def better_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs held out from training with the answer that the model prefers."""
    pairs = answer_pairs(spark, sf_dir)
    model = preference.train(pairs.where(~preference.held_out(_C("pair"))))
    return preference.compare(pairs.where(preference.held_out(_C("pair"))), model).select("pair", "label", "better", F.round("margin", 6).alias("margin"))


_HASHED_WORDS = "select doc_id, md5(unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+'))) as h from documents"
_HEX = "(position({} in '0123456789abcdef') - 1)"
_HASHED = f"select doc_id, {_HEX.format('h[1]')} * 16 + {_HEX.format('h[2]')} as place, sum(case when h[3] >= '8' then -1 else 1 end)::double as weight from ({_HASHED_WORDS}) group by all"


@query(f"select doc_id, place::int as place, weight from ({_HASHED}) where weight <> 0")
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashed vectors of all texts, the places that aren't zero."""
    small_batches(spark)
    rows = table(spark, sf_dir, "documents").select("doc_id", embed.embedded(F.col("text"), batch=1024).alias("v"))
    return rows.select("doc_id", F.posexplode("v").alias("place", "weight")).where("weight <> 0")


@query(f"""with v as (select doc_id, map_from_entries(list((place, weight))) as m from ({_HASHED}) group by doc_id), d as (select doc_id, list_transform(range(256), lambda k: coalesce(m[k], 0.0::double)) as v from v),
n as (select doc_id, v, sqrt(list_dot_product(v, v)) as norm from d where list_dot_product(v, v) > 0),
s as (select q.doc_id as query_id, r.doc_id as vec_id, list_dot_product(q.v, r.v) / (q.norm * r.norm) as score from n q join n r on q.doc_id <> r.doc_id where q.doc_id % 20 = 0)
select query_id, vec_id, round(score, 9) as similarity, row_number() over (partition by query_id order by score desc, vec_id) as rank from s qualify rank between 6 and 10""")
def passage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of five texts for every text whose id is divisible by 20, by hashed vectors."""
    path, vectors = new_folder(spark, "vectors"), embed.embedded(F.col("text"), batch=1024)
    small_batches(spark)
    table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), vectors.alias("v")).write.parquet(path)  # texts are encoded once, not for each block of queries
    rows = spark.read.schema("vec_id long, v array<double>").parquet(path)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return embed.page(rows, asked, 2, 5).select("query_id", "rank", "vec_id", F.round(-F.col("score"), 9).alias("similarity"))


@query("""with m as (select source, arg_max(lang, doc_id) as category from documents where lang is not null group by source),
a as (select d.source as subject, coalesce(m.category, 'other') as category, coalesce(quality = 1, false) as right_ from documents d join labels using (doc_id) left join m on m.source is not distinct from d.source)
select case grouping(category, subject) when 0 then 'subject' when 1 then 'category' else 'all' end as level, category, subject, count(*) as n, count(*) filter (right_) as n_right, count(*) filter (right_) / nullif(count(*), 0) as accuracy from a group by rollup (category, subject)""")
def category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good documents by source, by the language that a source's last document is in, and over all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    answers = docs.select("doc_id", F.col("source").alias("subject")).join(labels.select("doc_id", (F.col("quality") == 1).alias("right")), "doc_id")
    return exams.category_accuracy(answers, docs.select(F.col("source").alias("subject"), F.col("lang").alias("category"), F.col("doc_id").alias("place")))
