"""Chunk queries; they join the catalog.  Their SQL cuts the same texts by folds and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import passages, spans
from textloom.functions.batches import small_batches
from textloom.functions.chunks import chunks
from textloom.plans.catalog import query, said, table

SIZE, OVERLAP = 600, 100
_WS = r"[ \t\n\r\f\x0B]"
_SENTENCES = rf"regexp_replace(text, '([.!?])(?:{_WS}+([A-Z])|{_WS}*\n)|\n\n+', '\1' || chr(30) || '\2', 'g')"
_PARAGRAPHS = rf"regexp_replace(replace(text, chr(10), chr(10) || chr(10)), '\n{_WS}*\n', chr(30), 'g')"


def _packed(name: str, split: str, glue: str, tail: str) -> str:
    """SQL: doc_id, chunk_index, chunk of texts longer than SIZE whose pieces are joined by ``glue`` while they fit."""
    n = len(glue.encode().decode("unicode_escape"))
    joiner = "' '" if glue == " " else "chr(10) || chr(10)"
    start = "{'done': []::varchar[], 'held': ''}"
    return rf"""{name}_p as (select doc_id, list_transform(list_filter(list_transform(string_split({split}, chr(30)), lambda x: regexp_replace(regexp_replace(x, '^{_WS}+', ''), '{_WS}+$', '')), lambda x: x <> ''), lambda x: {{'done': []::varchar[], 'held': x}}) as p from documents where length(text) > {SIZE}),
{name}_f as (select doc_id, list_reduce(p, lambda a, x: case when length(a.held) + length(x.held) + {n} > {SIZE} then {{'done': case when a.held = '' then a.done else list_append(a.done, a.held) end, 'held': {tail} || x.held}}
  when a.held = '' then {{'done': a.done, 'held': x.held}} else {{'done': a.done, 'held': a.held || {joiner} || x.held}} end, {start}) as r from {name}_p),
{name} as (select doc_id, unnest(range(0, len(c)))::int as chunk_index, unnest(c) as chunk from (select doc_id, list_append(r.done, r.held) as c from {name}_f))"""


_TAIL = f"case when a.held = '' then '' when position(' ' in right(a.held, {OVERLAP})) > 1 then substr(right(a.held, {OVERLAP}), position(' ' in right(a.held, {OVERLAP})) + 1) || ' ' else right(a.held, {OVERLAP}) || ' ' end"
_SHORT = rf"select doc_id, 0 as chunk_index, text as chunk from documents where length(text) <= {SIZE} and regexp_matches(text, '[^ \t\n\r\f\x0B]')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, which go to Python in small batches."""
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def _long(spark: SparkSession, sf_dir: str, way: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", F.inline(passages.chunked(F.col("text"), way, SIZE, OVERLAP)))
    return rows


@query("with " + _packed("s", _SENTENCES, " ", _TAIL) + " select * from s union all " + _SHORT)
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences as long as they fit; each chunk begins with the last words of the one before."""
    return _long(spark, sf_dir, "sentence").select("doc_id", "chunk_index", "chunk")


_SENT, _SPACE = rf"'(?s)^(.*?[.!?]{_WS}+)'", r"'(?s)^(.*) '"


def _sized(source: str) -> str:
    """SQL: doc_id, chunk_index, start, stop of the rows (doc_id, text) of ``source``, cut by size; what has no blank nearby is cut there."""
    end = f"""case when pos + {SIZE} >= length(text) then length(text) when regexp_extract(w, {_SENT}, 1) <> '' then greatest(t - 50, 0) + length(regexp_extract(w, {_SENT}, 1))
  when regexp_extract(w, {_SPACE}, 1) <> '' then greatest(t - 50, 0) + length(regexp_extract(w, {_SPACE}, 1)) + 1 else t end"""
    step = lambda pos: f"select doc_id, text, {pos} as pos, {pos} + {SIZE} as t, substr(text, greatest({pos} + {SIZE} - 50, 0) + 1, 100) as w"
    return f"""c as (select doc_id, text, pos, 0 as chunk_index, {end} as stop from ({step('0')} from {source})
  union all select doc_id, text, pos, chunk_index, {end} from (select *, chunk_index from (select n.doc_id, n.text, n.pos, n.pos + {SIZE} as t, substr(n.text, greatest(n.pos + {SIZE} - 50, 0) + 1, 100) as w, n.chunk_index
    from (select doc_id, text, greatest(stop - {OVERLAP}, pos + 1) as pos, chunk_index + 1 as chunk_index from c where stop < length(text)) n)))"""


@query(f"with recursive {_sized('(select doc_id, text from documents where length(text) > ' + str(SIZE) + ')')} select doc_id, chunk_index, pos::int as start, stop::int as stop, substr(text, pos + 1, stop - pos) as chunk from c union all select doc_id, 0, 0, length(text)::int, chunk from ({_SHORT}) join documents using (doc_id)")
def chunk_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut by size after a sentence or a word, each chunk overlapping the one before."""
    return _long(spark, sf_dir, "size")


_BIG = f"(select {{'d': doc_id, 'i': chunk_index}} as doc_id, chunk as text from p where length(chunk) > {SIZE})"  # a long paragraph is alone in its chunk


@query("with recursive " + _packed("p", _PARAGRAPHS, r"\n\n", "''") + f""", {_sized(_BIG)},
pieces as (select doc_id, chunk_index, 0 as k, chunk from p where length(chunk) <= {SIZE} union all select doc_id.d, doc_id.i, chunk_index, substr(text, pos + 1, stop - pos) from c)
select doc_id, count(*) as n, max(length(chunk))::int as longest, sha256(string_agg(chunk, chr(30) order by chunk_index, k)) as digest from pieces group by doc_id""")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines taken for paragraphs, as many as fit, of all longer texts; a line too long is cut by size."""
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    rows = _docs(spark, sf_dir).where(F.length("text") > SIZE).select("doc_id", passages.chunked(text, "paragraph", SIZE, OVERLAP).alias("c")).where("size(c) > 0")
    return rows.select("doc_id", F.size("c").cast("long").alias("n"), F.array_max(F.transform("c.chunk", F.length)).alias("longest"), F.sha2(F.array_join("c.chunk", "\x1e"), 256).alias("digest"))


_COUNTS = rf"""select doc_id, length(text) as n, len(regexp_extract_all(text, '\n{_WS}*\n')) + 1 as paragraphs, length({_SENTENCES}) - length(replace({_SENTENCES}, chr(30), '')) + 1 as sentences from documents where regexp_matches(text, '[^ \t\n\r\f\x0B]')"""


@query(f"select doc_id, case when n <= {SIZE} then 'whole' when n::double / paragraphs < 0.8 * {SIZE} then 'paragraph' when n::double / sentences < 0.5 * {SIZE} then 'sentence' else 'size' end as way from ({_COUNTS})")
def chunk_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the adaptive chunker cuts each text."""
    n = F.length("text")
    split = lambda pattern: n / F.size(F.split("text", pattern, -1))
    way = F.when(n <= SIZE, "whole").when(split(r"\n\s*\n") < 0.8 * SIZE, "paragraph")
    way = way.when(split(passages.SENTENCE_END.pattern) < 0.5 * SIZE, "sentence").otherwise("size")
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).select("doc_id", way.alias("way"))


_CHUNK_SPANS = " union all ".join(
    f"""select doc_id, chunk_index, pos, text, '{t}' as entity_type, {n} as ordinal, regexp_extract_all({said(p)}, '{p}') as hits, string_split_regex({said(p)}, '{p}') as gaps from k where regexp_matches({said(p)}, '{p}')""" for n, (t, p) in enumerate(spans.ALL)
)
_CLOSE = "(least(k.b, x.kept[1].b) - greatest(k.a, x.kept[1].a)) > 0.5 * least(k.b - k.a, x.kept[1].b - x.kept[1].a)"
_FIRST = f"coalesce(list_position(list_transform(m.kept, lambda k: {_CLOSE}), true), 0)"
_BETTER = "case when k.r <> x.kept[1].r then k.r else x.kept[1].b - x.kept[1].a > k.b - k.a end"


@query(f"""with recursive {_sized('documents')}, k as (select doc_id, chunk_index, pos, substr(text, pos + 1, stop - pos) as text from c),
found as ({_CHUNK_SPANS}), numbered as (select *, unnest(range(1, len(hits) + 1)) as i from found),
placed as (select doc_id, chunk_index, pos, entity_type, ordinal, length(hits[i]) as n, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::int as s from numbered),
own as (select * from placed qualify row_number() over (partition by doc_id, chunk_index, s, n order by ordinal) = 1),
lists as (select doc_id, list({{'kept': [{{'a': pos + s, 'b': pos + s + n, 'r': chunk_index > 0 and s < {OVERLAP}, 't': entity_type}}]}} order by pos + s, n desc, chunk_index > 0 and s < {OVERLAP}, entity_type) as l from own group by doc_id),
folded as (select doc_id, len(l) as n_found, list_reduce(l, lambda m, x: case when {_FIRST} = 0 then {{'kept': list_concat(m.kept, x.kept)}}
  else {{'kept': list_transform(m.kept, lambda k, i: case when i = {_FIRST} and {_BETTER} then x.kept[1] else k end)}} end).kept as kept from lists)
select doc_id, s.t as entity_type, s.a::int as start, s.b::int as stop, substr(text, s.a + 1, s.b - s.a) as entity_value, n_found::int as n_found, len(kept)::int as n_kept from (select doc_id, n_found, kept, unnest(kept) as s from folded) join documents using (doc_id)""")
def chunked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all types found chunk by chunk, moved to their places and merged, with their numbers before and after; all in the row."""
    rows = _docs(spark, sf_dir).select("doc_id", passages.chunked(F.col("text"), "size", SIZE, OVERLAP).alias("chunks"))
    found = F.flatten(F.transform("chunks", lambda c: passages.shifted(spans.find_all(c["chunk"]), c)))
    rows = rows.select("doc_id", found.alias("found")).select("doc_id", F.size("found").alias("n_found"), passages.merge_chunks(F.col("found")).alias("kept"))
    return rows.select("doc_id", "n_found", F.size("kept").alias("n_kept"), F.inline("kept")).drop("confidence", "repeated")


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive chunks of 500, in order; held against a plain version in the tests."""
    rows = _docs(spark, sf_dir).select("doc_id", F.posexplode(chunks(F.col("text"), 500)).alias("chunk_index", "chunk"))
    return rows
