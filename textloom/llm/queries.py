"""The operators as queries over the tables of a folder."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (host, path, verdict); fixed values of the query.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.urls import judge_urls

    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.chat import format_chats, log_of, read_back

    same = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(log_of(rows.unionByName(more))))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.neighbours import search

    return search(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0, k=10)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.rules import judge_quality, learn_rules

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = judge_quality(docs, learn_rules(docs, _table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.perplexity import classify

    return classify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), _table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=2048)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2.0)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.binary import token_output

    return token_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.setjoin import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.brown import score_documents

    return score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.codes import vector_codes

    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.secrets import find_secrets, summarised

    return summarised(find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from textloom.llm.align import align

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_url_filters, op2_chat_formatting, op3_nearest_neighbours, op4_quality_rules, op5_quality_classifier, op6_packing, op7_mixing, op8_token_output, op9_ngram_jaccard_join, op10_lm_scoring, op11_vector_codes, op12_secret_scans, op13_token_alignment)}


def _codes_sql(rounds: int = 6) -> str:
    """Statement of op11: one step of assigning and moving for each round, then a last assignment."""
    near = "select r, p, x, e, d from (select *, row_number() over (partition by r, p order by d, e) as n from (select parts.*, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from parts join book{k} using (p))) where n = 1"
    move = "select b.p, b.e, case when m.p is null then b.c else m.c end as c from book{k} b left join (select p, e, list(m order by i) as c from (select p, e, i, floor(sum(x[i])::double / count(*))::bigint as m from near{k}, range(1, 9) t(i) group by p, e, i) group by p, e) m using (p, e)"
    steps = ",\n".join(f"near{k} as materialized ({near.format(k=k)})" + (f",\nbook{k + 1} as materialized ({move.format(k=k)})" if k < rounds else "") for k in range(rounds + 1))
    return f"""
with kept as materialized (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(x::double * 4096)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
parts as materialized (select r, p, v[p * 8 + 1 : p * 8 + 8] as x from kept, range(8) t(p)),
starts as (select v, row_number() over (order by vec_id) - 1 as e from kept where vec_id is not null qualify e < 16),
book0 as materialized (select p, e, v[p * 8 + 1 : p * 8 + 8] as c from starts, range(8) t(p)),
{steps},
coded as (select r, string_agg(lpad(to_hex(e), 2, '0'), '' order by p) as code, sum(d)::bigint as error from near{rounds} group by r)
select vec_id, lower(code) as code, error, (sum(error) over (partition by label))::bigint as label_error,
       (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) from book{rounds}) as codebooks_sha256
from kept join coded using (r)"""


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(),
    "op1_url_filters": r"""
with rest as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
  from rest),
rules(rhost, rpath, rverdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (
  select p.*, rhost || rpath as rule, rverdict,
         row_number() over (partition by page_id order by length(rhost || rpath) desc nulls last, length(rhost) desc) as n
  from parts p left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from fits where n = 1""",
    "op2_chat_formatting": r"""
with logs as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked as (
  select *, replace(text, '␛', '␛␛') as m from logs),
escaped as (
  select *, length(regexp_replace(m, '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|\|system\|>|\|user\|>|\|assistant\|>|\|eot_id\|>|\|start_header_id\|>|\|end_header_id\|>|s>|/s>|unk>|pad>|<SYS>>|</SYS>>)|(\[)(INST\]|/INST\])', '\1\3␛\2\4', 'g')) as n
  from marked)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length('<|im_start|>') + length(role) + 1 + n + length('<|im_end|>') + 1)::bigint as formatted_chars
from escaped group by conv_id""",
    "op3_nearest_neighbours": r"""
with sound as (
  select distinct vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x)))
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id as query_id, r.vec_id as vec_id, list_distance(q.v, r.v) as score
  from sound q join sound r on q.vec_id <> r.vec_id where q.vec_id % 100 = 0),
ranked as (select *, row_number() over (partition by query_id order by score, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 10""",
    "op7_mixing": r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5('mix:' || coalesce(doc_id::varchar, '')) as dealt
  from documents),
per as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select source, source_size, ([3.0::double, 1.0::double, 2.0::double])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w,
         source_size * 2.0::double as cap, (sum(source_size) over ())::bigint * 1.5::double as mix
  from per),
levels as (
  select *, (mix - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
            / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level
  from weighed),
targets as (
  select source, source_size, least(cap, w * max(case when level * w <= cap then level end) over ()) as target from levels),
dealt as (
  select s.*, t.source_size, t.target,
         case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as times,
         coalesce(sum(size) over (partition by s.source order by dealt, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (size * times + greatest(0, least(size, round(target - times * source_size)::bigint - before)))::bigint as taken
from dealt""",
    "op9_ngram_jaccard_join": r"""
with recursive worded as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
words as (select r, unnest(w) as word, generate_subscripts(w, 1) as i from worded),
runs as (
  select r, word || coalesce(' ' || lead(word, 1) over o, '') || coalesce(' ' || lead(word, 2) over o, '') || coalesce(' ' || lead(word, 3) over o, '') || coalesce(' ' || lead(word, 4) over o, '') as h,
         i, count(*) over (partition by r) as c
  from words window o as (partition by r order by i)),
shingles as (select distinct r, h from runs where i <= greatest(c - 4, 1)),
sets as (select r, doc_id, coalesce(n, 0) as n from worded left join (select r, count(*) as n from shingles group by r) using (r)),
shared as (select a.r as a, b.r as b, count(*) as common from shingles a join shingles b on a.h = b.h and a.r <> b.r group by a.r, b.r),
links as (
  select a, b from shared join sets x on x.r = a join sets y on y.r = b where 100 * common >= 80 * (x.n + y.n - common)),
reached as (select r, r as other from sets union select reached.r, b from reached join links on a = other)
select x.doc_id, x.n::bigint as n_shingles, case when x.n = 0 then x.doc_id else min(y.doc_id) end as component_id
from reached join sets x on x.r = reached.r join sets y on y.r = other group by x.r, x.doc_id, x.n""",
}
