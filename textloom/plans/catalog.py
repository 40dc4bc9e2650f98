"""Queries over the tables of a folder, each beside its DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import profile, spans, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Types whose spans can't overlap each other.
PLAIN = {k: spans.PATTERNS[k] for k in ("EMAIL", "CREDIT_CARD", "IP_ADDRESS")}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOUND = " union all ".join(
    f"""select doc_id, '{t}' as entity_type, regexp_extract_all(text, '{p}') as hits, string_split_regex(text, '{p}') as gaps from documents""" for t, p in PLAIN.items()
)
_SPANS = f"""
with found as ({_FOUND}),
numbered as (select *, unnest(range(1, len(hits) + 1)) as i from found where len(hits) > 0),
spans as (
  select doc_id, entity_type, hits[i] as entity_value,
         (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::int as start
  from numbered)"""


def said(pattern: str) -> str:
    """SQL: the text as ``pattern`` sees it.

    RE2's ``\\b`` knows ASCII words only; letters, marks and digits of other scripts go on with a
    word in the JVM and elsewhere, so they stand as ``_`` here, unless the pattern takes ``_`` itself.
    """
    return "text" if "_" in pattern or r"\b" not in pattern else r"regexp_replace(text, '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]', '_', 'g')"


#: All patterns; of equal spans the first pattern's.
_EVERY = "with found as (" + " union all ".join(
    f"""select doc_id, '{t}' as entity_type, {k} as ordinal, regexp_extract_all({said(p)}, '{p}') as hits, string_split_regex({said(p)}, '{p}') as gaps from documents where regexp_matches({said(p)}, '{p}')""" for k, (t, p) in enumerate(spans.ALL)
) + """),
numbered as (select *, unnest(range(1, len(hits) + 1)) as i from found),
placed as (
  select doc_id, entity_type, ordinal, hits[i] as entity_value,
         (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::int as start
  from numbered),
spans as (
  select doc_id, entity_type, entity_value, start, (start + length(entity_value))::int as stop from placed
  qualify row_number() over (partition by doc_id, start, length(entity_value) order by ordinal) = 1)"""
_LEVEL = "case entity_type " + " ".join(f"when '{t}' then {n}" for t, n in spans.SENSITIVITY.items()) + " else 5 end"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.inline(F.concat(*[spans.find(F.col("text"), p, t) for t, p in PLAIN.items()])))


def _all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all types; of equal spans the first pattern's."""
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(spans.find_all(F.col("text"))))


def _kept_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all types, disjoint: of overlapping neighbours the longer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.inline(spans.merge_longest(spans.find_all(F.col("text")))))


@query(_EVERY + " select doc_id, entity_type, start, stop, entity_value from spans")
def pii_span_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_spans(spark, sf_dir).drop("confidence")


@query(_EVERY + f" select entity_type, {_LEVEL} as sensitivity, count(*) as n, count(distinct doc_id) as docs from spans group by all")
def pii_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _all_spans(spark, sf_dir).withColumn("sensitivity", spans.sensitivity(F.col("entity_type")))
    return rows.groupBy("entity_type", "sensitivity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(_EVERY + " select entity_type, lang, count(*) as n from spans join documents using (doc_id) group by rollup (entity_type, lang)")
def pii_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", F.inline(spans.find_all(F.col("text"))))
    return docs.rollup("entity_type", "lang").agg(F.count(F.lit(1)).alias("n"))


@query(_EVERY + " select entity_type, lang, source, count(*) as n from spans join documents using (doc_id) group by grouping sets ((entity_type), (lang), (source))")
def error_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", F.inline(spans.find_all(F.col("text"))))
    keys = [F.col(c) for c in ("entity_type", "lang", "source")]
    return docs.groupingSets([[k] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n")).select("entity_type", "lang", "source", "n")


# The keys and patterns of the extractor by key.
KEYS = {"email": spans.PATTERNS["EMAIL"], "phone": r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b", "credit_card": spans.PATTERNS["CREDIT_CARD"], "id_card": r"\b\d{17}[\dXx]\b"}


@query("select doc_id, " + ", ".join(f"case when regexp_matches({said(p)}, '{p}') then regexp_extract_all({said(p)}, '{p}') end as {k}" for k, p in KEYS.items()) + " from documents where " + " or ".join(f"regexp_matches({said(p)}, '{p}')" for p in KEYS.values()))
def pii_dict_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by key; a key without any is null, a text without any key is left out."""
    found = {k: F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in KEYS.items()}
    rows = table(spark, sf_dir, "documents").select("doc_id", *[F.when(F.size(x) > 0, x).alias(k) for k, x in found.items()])
    return rows.where(F.coalesce(*KEYS).isNotNull())


#: Disjoint spans: of overlapping neighbours the longer.
_ONE = _EVERY + """,
lists as (select doc_id, list({'kept': [{'t': entity_type, 'a': start, 'b': stop}]} order by start, stop desc) as l from spans group by doc_id),
merged as (select doc_id, list_reduce(l, lambda k, x: case when x.kept[1].a >= k.kept[len(k.kept)].b then {'kept': list_concat(k.kept, x.kept)}
  when x.kept[1].b - x.kept[1].a > k.kept[len(k.kept)].b - k.kept[len(k.kept)].a then {'kept': list_concat(k.kept[1:len(k.kept) - 1], x.kept)} else k end).kept as kept from lists),
one as (select doc_id, unnest(kept) as s from merged)"""
_DISJOINT = _ONE + ", kept as (select doc_id, s.t as entity_type, s.a as start, s.b as stop, substr(text, s.a + 1, s.b - s.a) as entity_value from one join documents using (doc_id))"
_MERGED = _ONE + """,
named as (select doc_id, s.a as a, s.b as b, '${' || s.t || '_' || lpad((row_number() over (partition by doc_id, s.t order by s.a desc))::varchar, 3, '0') || '}' as name, coalesce(lag(s.b) over (partition by doc_id order by s.a), 0) as before from one)"""


@query(_MERGED + " select doc_id, string_agg(substr(text, before + 1, a - before) || name, '' order by a) || substr(max(text), (max(b) + 1)::bigint) as masked, count(*)::int as n_masked from named join documents using (doc_id) group by doc_id")
def pii_mask_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", spans.merge_longest(spans.find_all(F.col("text"))).alias("spans"))
    marked = docs.select("doc_id", "text", spans.placeholders(F.col("spans")).alias("marked")).where("size(marked) > 0")
    return marked.select("doc_id", spans.splice(F.col("text"), F.col("marked")).alias("masked"), F.size("marked").alias("n_masked"))


@query("select doc_id, text as recovered, " + " or ".join(f"regexp_matches({said(p)}, '{p}')" for _, p in spans.ALL) + " as changed from documents")
def pii_recover_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", spans.merge_longest(spans.find_all(F.col("text"))).alias("spans"))
    masked = docs.select("doc_id", "text", spans.placeholders(F.col("spans")).alias("marked")).select("doc_id", "marked", spans.splice(F.col("text"), F.col("marked")).alias("masked"))
    return masked.select("doc_id", spans.recover(F.col("masked"), F.col("marked")).alias("recovered"), (F.size("marked") > 0).alias("changed"))


@query(f"select doc_id, list_reduce(list_distinct(regexp_extract_all(text, '{spans.PATTERNS['CREDIT_CARD']}')), lambda t, v: replace(t, v, 'CARD[HASH:' || left(sha256(v), 16) || ']'), text) as masked from documents")
def pii_mask_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.array_distinct(F.regexp_extract_all("text", F.lit(spans.PATTERNS["CREDIT_CARD"]), F.lit(0)))
    return table(spark, sf_dir, "documents").select("doc_id", spans.hash_mask(F.col("text"), "CARD", values).alias("masked"))


@query(_SPANS + """,
digits as (select doc_id, start, entity_value, reverse(regexp_replace(entity_value, '\\D', '', 'g')) as d from spans where entity_type = 'CREDIT_CARD')
select doc_id, start, entity_value, list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 0 then (case when substr(d, i, 1)::int > 4 then substr(d, i, 1)::int * 2 - 9 else substr(d, i, 1)::int * 2 end) else substr(d, i, 1)::int end)) % 10 = 0 as valid
from digits""".replace("\\\\D", "\\D"))
def luhn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir).where("entity_type = 'CREDIT_CARD'")
    return rows.select("doc_id", "start", "entity_value", spans.luhn(F.col("entity_value")).alias("valid"))


_FEATURES = f"""
with f as (
  select doc_id, text, length(text)::int as text_length, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::int as word_count,
         (length(text) - length(translate(text, '.!?', '')))::int as sentence_count,
         ({" + ".join(f"len(regexp_extract_all({said(p)}, '{p}'))" for p in profile.FOUND)})::int as n_found,
         regexp_matches(text, '[^\\x00-\\x7F]') as multilingual, regexp_matches(text, '[+().\\-]{{2,}}') as formatting from documents),
g as (select *, n_found::double / greatest(word_count, 1) as density from f)"""


@query(_FEATURES + " select doc_id, text_length, word_count, sentence_count, n_found, density from g")
def smart_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = profile.features(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *[f[c].alias(c) for c in ("text_length", "word_count", "sentence_count", "n_found", "density")])


_SCORES = ", ".join("[" + ", ".join(f"contains(lower(text), '{k}')::int" for k in w) + "]" for w in profile.DOMAINS.values())
_NAMES = ", ".join(f"'{d}'" for d in profile.DOMAINS)
_SOURCE = " ".join("when " + " + ".join(f"regexp_matches(lower(text), '{p}')::int" for p in ps) + f" >= 2 then '{s}'" for s, ps in profile.SOURCES.items())
_STRATEGY = _FEATURES + f""",
h as (select *, list_transform([{_SCORES}], lambda x: list_sum(x)) as scores from g),
i as (select *, case when list_max(scores) < 2 then 'general' else ([{_NAMES}])[list_position(scores, list_max(scores))] end as domain,
  case {_SOURCE} when text_length / greatest(length(text) - length(replace(text, '.', '')), 1) < 100 and length(text) - length(replace(text, chr(10), '')) > length(text) - length(replace(text, '.', '')) then 'conversation'
  when text_length > 500 then 'document' else 'unknown' end as source_type,
  least(1.0::double, (case when text_length > 500 then 0.2::double else 0 end) + (case when text_length > 1000 then 0.1::double else 0 end) + (case when density > 0.1 then 0.2::double else 0 end)
    + (case when density > 0.3 then 0.1::double else 0 end) + (case when multilingual then 0.15::double else 0 end) + (case when formatting then 0.1::double else 0 end) + (case when sentence_count > 5 then 0.1::double else 0 end)) as complexity from h)
select doc_id, domain, source_type, complexity,
  case when domain in ('financial', 'medical', 'legal') then 'high_precision' when density > 0.3 or formatting or multilingual then 'high_recall'
       when source_type = 'conversation' and text_length < 200 then 'high_precision' when text_length > 500 and density < 0.1 or domain in ('technical', 'customer_service') then 'balanced'
       when complexity > 0.6 then 'high_recall' else 'balanced' end as strategy,
  case when domain in ('financial', 'medical', 'legal') or complexity > 0.5 or multilingual then 'large' else 'medium' end as model_size
from i"""


@query(_STRATEGY)
def smart_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = profile.features(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in f.items()], profile.domain(F.col("text")).alias("domain"), profile.source_type(F.col("text")).alias("source_type"))
    score = profile.complexity(*[F.col(c) for c in ("text_length", "density", "multilingual", "complex_formatting", "sentence_count")])
    rows = rows.withColumn("complexity", score)
    c = F.col
    return rows.select("doc_id", "domain", "source_type", "complexity", profile.strategy(c("domain"), c("source_type"), c("text_length"), c("density"), c("multilingual"), c("complex_formatting"), c("complexity")).alias("strategy"), profile.model_size(c("domain"), c("multilingual"), c("complexity")).alias("model_size"))


@query("select doc_id, ratio from (select doc_id, case when length(text) > 0 then (length(text) - length(regexp_replace(text, '[\\x09-\\x0D\\x20-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]', '', 'g')))::double / length(text) else 0.0 end as ratio from documents) where ratio <= 0.5")
def special_char_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", profile.special_ratio(F.col("text")).alias("ratio")).where("ratio <= 0.5")


@query(_EVERY + f", l as (select doc_id, entity_type, start, stop, {_LEVEL} as level, doc_id % 2 = 0 as reversible, doc_id % 3 = 0 as realistic from spans) select *, case when level >= 8 then (case when reversible then 'encrypt' else 'hash' end) when level >= 5 then (case when realistic then 'fake' when reversible then 'placeholder' else 'mask' end) else (case when realistic then 'fake' else 'placeholder' end) end as strategy from l")
def strategy_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each span, by its type's sensitivity and by what its document asks for."""
    rows = _all_spans(spark, sf_dir).select("doc_id", "entity_type", "start", "stop", spans.sensitivity(F.col("entity_type")).alias("level"), (F.col("doc_id") % 2 == 0).alias("reversible"), (F.col("doc_id") % 3 == 0).alias("realistic"))
    return rows.withColumn("strategy", profile.recommended(F.col("level"), F.col("reversible"), F.col("realistic")))


@query("select doc_id, i::int as chunk_index, substr(text, i * 1900 + 1, 2000) as chunk from documents, lateral (select unnest(range(0, greatest(1, ceil((length(text) - 100) / 1900.0)::int))) as i)")
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.greatest(F.lit(1), F.ceil((F.length("text") - 100) / F.lit(1900.0)).cast("int")) - 1
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.substr("text", F.col("chunk_index") * 1900 + 1, F.lit(2000)).alias("chunk"))


@query("with w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as w from documents) select doc_id, (i / 320)::int as chunk_index, array_to_string(w[i + 1:i + 400], ' ') as chunk from (select doc_id, w, unnest(range(0, greatest(1, len(w)), 320)) as i from w)")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - 1), F.lit(320))).alias("i"))
    return rows.select("doc_id", (F.col("i") / 320).cast("int").alias("chunk_index"), F.array_join(F.slice("w", F.col("i") + 1, 400), " ").alias("chunk"))


# What isn't a page's content, and characters by their names; the last one could make others.
_ASIDE = r'(?is)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<title.*?</title>|<div class="ad".*?</div>'
_NAMED = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
_BARE = f"regexp_replace(regexp_replace(regexp_replace(html, '{_ASIDE}', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _name, _char in _NAMED.items():
    _BARE = f"replace({_BARE}, '{_name}', chr({ord(_char)}))"


@query(f"select page_id, trim(regexp_replace({_BARE}, '\\s+', ' ', 'g')) as content from pages")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's content, without what stands aside of it, as plain text."""
    text = F.regexp_replace("html", _ASIDE, " ")
    for pattern in ("(?s)<!--.*?-->", "(?s)<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    for name, char in _NAMED.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("content"))


@query("select conv_id, string_agg((case when role = 'user' then 'User: ' when role = 'assistant' then 'Assistant: ' else 'System: ' end) || text, chr(10) order by turn) as prompt from conversations group by conv_id")
def conv_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise("System: "), F.col("text"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x"))
    return rows.select("conv_id", F.array_join(F.col("x.line"), "\n").alias("prompt"))


@query("select conv_id, case when length(t) > 30 then left(t, 30) || '...' else t end as title from (select conv_id, arg_min(text, turn) as t from conversations where role = 'user' group by conv_id)")
def conv_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return rows.select("conv_id", F.when(F.length("t") > 30, F.concat(F.substring("t", 1, 30), F.lit("..."))).otherwise(F.col("t")).alias("title"))


@query("select user_id, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) where n = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(newest.alias("x")).select("user_id", "x.event_id", "x.value")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select event_id, ts, value from events order by ts desc, event_id desc limit 20 offset 20")
def usage_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "value").orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(20).limit(20)


@query("select user_id, event_id, max(value) over (partition by user_id order by ts, event_id rows between 199 preceding and current row) as peak from events")
def last_n_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-199, 0)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.max("value").over(recent).alias("peak"))


@query("select event_type, time_bucket(interval '1 hour', ts) as hour, count(*) as n, sum(value) as total from events group by all")
def usage_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select("event_type", F.col("w.start").alias("hour"), "n", "total")


@query("select lang, quality, count(*) as n, avg(toxic) as toxic_rate from documents join labels using (doc_id) group by rollup (lang, quality)")
def accuracy_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.rollup("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.avg("toxic").alias("toxic_rate"))


@query("with r as (select doc_id, quality, row_number() over (partition by quality order by md5(doc_id::varchar), doc_id) as n, count(*) over (partition by quality) as c from labels) select doc_id, quality, case when n <= floor(c * 0.7::double) then 'train' when n <= floor(c * 0.7::double) + floor(c * 0.15::double) then 'val' else 'test' end as split from r")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    # places are counted inside leading hash digits, so that no task holds a stratum
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", F.md5(F.col("doc_id").cast("string")).alias("dealt")).withColumn("bucket", F.substring("dealt", 1, 3))
    buckets = rows.groupBy("quality", "bucket").agg(F.count(F.lit(1)).alias("own"))
    upto = Window.partitionBy("quality").orderBy("bucket")
    buckets = buckets.select(F.col("quality").alias("q"), F.col("bucket").alias("b"), (F.sum("own").over(upto) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy("quality")).alias("c"))
    rows = rows.join(buckets, F.col("quality").eqNullSafe(F.col("q")) & (F.col("bucket") == F.col("b")))
    rows = rows.withColumn("n", F.col("before") + F.row_number().over(Window.partitionBy("quality", "bucket").orderBy("dealt", "doc_id")))
    train, val = F.floor(F.col("c") * 0.7), F.floor(F.col("c") * 0.15)
    return rows.select("doc_id", "quality", F.when(F.col("n") <= train, "train").when(F.col("n") <= train + val, "val").otherwise("test").alias("split"))


_EVAL = f"""
with p as (select doc_id, len(list_distinct(regexp_extract_all(text, '{PLAIN['IP_ADDRESS']}'))) as predicted, len(list_intersect(list_distinct(regexp_extract_all(text, '{PLAIN['IP_ADDRESS']}')), list_distinct(regexp_extract_all(text, '\\b(?:[0-9]{{1,2}}\\.){{3}}[0-9]{{1,2}}\\b')))) as tp,
  len(list_distinct(regexp_extract_all(text, '\\b(?:[0-9]{{1,2}}\\.){{3}}[0-9]{{1,2}}\\b'))) as truth from documents)
select sum(tp)::bigint as tp, sum(predicted - tp)::bigint as fp, sum(truth - tp)::bigint as fn, coalesce(sum(tp) / nullif(sum(predicted), 0), 0)::double as micro_precision, coalesce(sum(tp) / nullif(sum(truth), 0), 0)::double as micro_recall, coalesce(2.0::double * sum(tp) / nullif(sum(predicted) + sum(truth), 0), 0)::double as micro_f1 from p"""


@query(_EVAL)
def eval_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address extractor against a narrower one, by sets of values."""
    predicted = F.array_distinct(F.regexp_extract_all("text", F.lit(PLAIN["IP_ADDRESS"]), F.lit(0)))
    truth = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:[0-9]{1,2}\.){3}[0-9]{1,2}\b"), F.lit(0)))
    rows = table(spark, sf_dir, "documents").select(F.size(predicted).alias("p"), F.size(truth).alias("t"), F.size(F.array_intersect(predicted, truth)).alias("tp"))
    sums = rows.agg(F.sum("tp").alias("tp"), F.sum(F.col("p") - F.col("tp")).alias("fp"), F.sum(F.col("t") - F.col("tp")).alias("fn"))
    rate = lambda other: F.coalesce(F.try_divide("tp", F.col("tp") + F.col(other)), F.lit(0.0))
    return sums.select("*", rate("fp").alias("micro_precision"), rate("fn").alias("micro_recall"), F.coalesce(F.try_divide(F.col("tp") * 2.0, F.col("tp") * 2 + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("micro_f1"))


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id: the ``k`` nearest of ``rows`` (vec_id, v) for each of ``queries`` (query_id, q), not itself."""
    return vectors.search(rows, queries, k).drop("score")


@query("""select query_id, rank, vec_id from (select q.vec_id as query_id, r.vec_id, row_number() over (partition by q.vec_id order by list_distance(q.embedding::double[], r.embedding::double[]), r.vec_id) as rank
from embeddings q join embeddings r on q.vec_id <> r.vec_id where q.vec_id % 20 = 0) where rank <= 4""")
def knn_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact search: every vector whose id is divisible by 20 against all."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return nearest(rows, rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 4)

