"""Search, reranking, references and sessions; they join the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import vectors
from textloom.plans.catalog import _SPANS, _spans, query, table
from textloom.sources import sinks

_C = F.col
_V = "embedding::double[]"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", _C("embedding").cast("array<double>").alias("v"))


def _asked(rows: DataFrame, *more: str) -> DataFrame:
    """Every vector whose id is divisible by 20."""
    return rows.where("vec_id % 20 = 0").select(_C("vec_id").alias("query_id"), _C("v").alias("q"), *more)


def _ranked(distance: str, where: str, k: int) -> str:
    return f"select q.vec_id as query_id, r.vec_id, {distance} as d, row_number() over (partition by q.vec_id order by {distance}, r.vec_id) as rank from e q join e r on q.vec_id <> r.vec_id and {where} where q.vec_id % 20 = 0 qualify rank <= {k}"


_E = f"with e as (select vec_id, {_V} as v, lang from embeddings left join documents on doc_id = vec_id)"
_COS, _L2 = "-list_cosine_similarity(q.v, r.v)", "list_distance(q.v, r.v)"


@query(f"{_E} select query_id, rank, vec_id, round(-d, 9) as similarity from ({_ranked(_COS, 'true', 5)})")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return vectors.search(rows, _asked(rows), 5, "cosine").select("query_id", "rank", "vec_id", F.round(-_C("score"), 9).alias("similarity"))


@query(f"{_E} select query_id, rank, vec_id, round(d * d, 9) as distance from ({_ranked(_L2, 'q.lang = r.lang', 3)})")
def knn_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search inside the collection of a query: the rows of its document's language."""
    langs = table(spark, sf_dir, "documents").select(_C("doc_id").alias("vec_id"), "lang")
    rows = _vectors(spark, sf_dir).join(langs, "vec_id", "left")
    return vectors.search(rows, _asked(rows, "lang"), 3, scope="lang").select("query_id", "rank", "vec_id", F.round("score", 9).alias("distance"))


@query(f"{_E} select query_id, rank, vec_id from ({_ranked(_COS, 'r.vec_id < q.vec_id', 3)}) where -d >= 0.2")
def earlier_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stored before a question and is like it by 0.2 or more, three at most."""
    rows = _vectors(spark, sf_dir)
    return vectors.search(rows, _asked(rows), 3, "cosine", earlier=True).where("score <= -0.2").drop("score")


_WORDS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> ''))"


@query(f"""{_E}, h as ({_ranked(_L2, 'true', 10)}), w as (select doc_id, {_WORDS} as w from documents),
s as (select query_id, vec_id, rank, len(list_intersect(a.w, b.w))::double / greatest(len(list_distinct(a.w || b.w)), 1) as score from h join w a on a.doc_id = query_id join w b on b.doc_id = vec_id)
select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, rank) as place from s qualify place <= 5""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors, of which the five whose texts share most words with the query's stay."""
    rows = _vectors(spark, sf_dir)
    hits = vectors.search(rows, _asked(rows), 10).drop("score")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != ""))
    texts = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    both = hits.join(texts.select(_C("doc_id").alias("query_id"), _C("w").alias("a")), "query_id").join(texts.select(_C("doc_id").alias("vec_id"), _C("w").alias("b")), "vec_id")
    score = F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_union("a", "b")), F.lit(1))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-score).alias("s"), "rank", "vec_id"))), 1, 5)  # ten a query
    out = both.groupBy("query_id").agg(best.alias("x")).select("query_id", F.posexplode("x").alias("i", "x"))
    return out.select("query_id", "x.vec_id", (-_C("x.s")).alias("score"), (_C("i") + 1).alias("place"))


@query(f"select vec_id, len(embedding) as n, round(list_sum({_V}), 6) as total from embeddings")
def vector_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as text and read again."""
    text = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), " , ")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.parsed(text).alias("v"))
    return rows.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def reference(abstract: Column, content: Column, name: Column) -> Column:
    """A folded passage with its abstract and a link to its file, whose name is dealt over folders."""
    link = F.concat(F.lit("static/"), F.left(name, F.lit(2)), F.lit("/"), F.substr(name, F.lit(3)))
    return F.concat(F.lit("<details>\n  <summary>"), abstract, F.lit("</summary>\n  <p>"), content, F.lit('</p>\n  <p><strong>For more details, visit <a href="'), link, F.lit('" target="_blank">this reference</a>.</strong></p>\n</details>'))


@query("""select doc_id, '<details>
  <summary>' || left(text, 10) || '</summary>
  <p>' || text || '</p>
  <p><strong>For more details, visit <a href="static/' || left(md5(doc_id::varchar), 2) || '/' || substr(md5(doc_id::varchar), 3) || '" target="_blank">this reference</a>.</strong></p>
</details>' as block from documents""")
def reference_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", reference(F.left("text", F.lit(10)), F.col("text"), F.md5(_C("doc_id").cast("string"))).alias("block"))


@query("select conv_id, count(*) as turns, max(turn) as newest, count(*) filter (role = 'user') as asked from conversations group by conv_id order by newest desc, conv_id limit 20 offset 20")
def session_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of sessions, newest first."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max("turn").alias("newest"), F.count_if(_C("role") == "user").alias("asked"))
    return rows.orderBy(F.desc("newest"), "conv_id").offset(20).limit(20)


@query("with n as (select user_id, max(event_id) as event_id from events where value > 50 group by user_id) select user_id, case when n.event_id is null then 'old' else 'new' end as origin from (select distinct user_id from events) left join n using (user_id)")
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table keyed by user, of which the users with high values are written anew."""
    events = table(spark, sf_dir, "events")
    old = events.select("user_id").distinct().withColumn("origin", F.lit("old"))
    new = events.where("value > 50").select("user_id").distinct().withColumn("origin", F.lit("new"))
    return sinks.upserted(old, new, "user_id")


@query("""with gone as (select distinct conv_id from conversations where turn = 3)
select 'sessions' as name, count(distinct conv_id) as n from conversations where conv_id not in (from gone)
union all select 'entities', count(*) from conversations where role = 'user' and conv_id not in (from gone)
union all select 'mappings', count(*) from conversations where role = 'assistant' and conv_id not in (from gone)
union all select 'processing_log', count(*) from conversations""")
def cascade_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions deleted with what belongs to them; the log stays."""
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id")
    parts = {"sessions": rows.select("session_id").distinct(), "entities": rows.where("role = 'user'"), "mappings": rows.where("role = 'assistant'"), "processing_log": rows}
    left = sinks.cascade_deleted(parts, rows.where("turn = 3").select("session_id").distinct())
    out = None
    for name, part in left.items():
        one = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_KEY = "0123456789abcdef"


@query(_SPANS + " select doc_id, start, entity_value as back, true as hidden from spans")
def encrypt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values encrypted and decrypted; none is its own cipher."""
    rows = _spans(spark, sf_dir)
    cipher = F.base64(F.aes_encrypt("entity_value", F.lit(_KEY), F.lit("GCM")))
    rows = rows.select("doc_id", "start", "entity_value", cipher.alias("cipher"))
    back = F.aes_decrypt(F.unbase64("cipher"), F.lit(_KEY), F.lit("GCM")).cast("string")
    return rows.select("doc_id", "start", back.alias("back"), (_C("cipher") != _C("entity_value")).alias("hidden"))
