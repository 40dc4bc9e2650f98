"""Made-up values, keywords and term weights; they join the catalog."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import fakes, spans
from textloom.functions.sentences import rounded
from textloom.plans.catalog import _DISJOINT, _kept_spans, query, table

_C = F.col


def _num(seed: str) -> str:
    return f"('0x' || left(sha256({seed}), 8))::bigint"


def _pick(values: tuple[str, ...], seed: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{_num(seed)} % {len(values)} + 1]"


def _digits(seed: str) -> str:
    return f"translate(sha256({seed}), 'abcdef', '012345')"


_SEED = "((doc_id // 10)::varchar || ':' || entity_value)"
_OWN = " or ".join(f"contains(lower(split_part(entity_value, '@', -1)), '{p}')" for p in fakes.PERSONAL)


@query(_DISJOINT + f""" select doc_id, start, case when entity_type = 'EMAIL' then lower({_pick(fakes.FIRST, _SEED + " || '/first'")} || '.' || {_pick(fakes.LAST, _SEED + " || '/last'")}) || ({_num(_SEED)} % 100)::varchar || '@' || case when {_OWN} then 'example.com' else split_part(entity_value, '@', -1) end
  when entity_type = 'PERSON' then {_pick(fakes.FIRST, _SEED + " || '/first'")} || ' ' || {_pick(fakes.LAST, _SEED + " || '/last'")}
  else array_to_string(list_transform(string_split(entity_value, ''), lambda c, i: case when regexp_matches(c, '[0-9]') then substr({_digits(_SEED + " || case when i > 64 then '/' || ((i - 1) // 64)::varchar else '' end")}, ((i - 1) % 64 + 1)::bigint, 1) else c end), '') end as fake from kept""")
def consistent_fakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fakes in the form of what they replace, the same for the same value of a session."""
    seed = F.concat(F.floor(_C("doc_id") / 10).cast("string"), F.lit(":"), "entity_value")
    fake = F.when(_C("entity_type") == "EMAIL", fakes.email(seed, _C("entity_value"))).when(_C("entity_type") == "PERSON", fakes.person(seed)).otherwise(fakes.like(seed, _C("entity_value")))
    return _kept_spans(spark, sf_dir).select("doc_id", "start", fake.alias("fake"))


@query(f"""with b(brand, len, n) as (values {", ".join(f"('{b}', {n}, {len(fakes.FORMATS)})" for b, (_, n) in fakes.BRANDS.items())})
select brand, f.format, d.n, true as valid, d.n as well_formed from b, (select count(*) as n from documents) d, (select unnest([{", ".join(f"'{f}'" for f in fakes.FORMATS)}]) as format) f""")
def card_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card of each brand for each document, in each format: how many, whether all have a right check digit, how many the brand's length and first digits."""
    seeds, out = table(spark, sf_dir, "documents").select(_C("doc_id").cast("string").alias("seed")), None
    for brand, (prefixes, length) in fakes.BRANDS.items():
        cards = seeds.select(fakes.card(brand, _C("seed")).alias("card"))
        shown = F.array(*[F.struct(F.lit(name).alias("format"), written(_C("card")).alias("shown")) for name, written in fakes.FORMATS.items()])
        rows = cards.select("card", F.inline(shown))
        kept = F.right(F.regexp_replace("shown", "[^0-9]", ""), F.lit(4))
        formed = (F.length("card") == length) & _C("card").rlike("^(" + "|".join(prefixes) + ")") & (F.right("card", F.length(kept)) == kept)
        rows = rows.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.bool_and(spans.luhn(_C("card"))).alias("valid"), F.count_if(formed).alias("well_formed")).select(F.lit(brand).alias("brand"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


_ID = "i::varchar"


@query(f"""select i as id, {_pick(fakes.FIRST, _ID + " || '/first'")} || ' ' || {_pick(fakes.LAST, _ID + " || '/last'")} as full_name, lower({_pick(fakes.FIRST, _ID + " || '/first'")} || '.' || {_pick(fakes.LAST, _ID + " || '/last'")}) || '@example.com' as email,
  '+1 (' || substr({_digits(_ID)}, 1, 3) || ') 555-' || substr({_digits(_ID)}, 4, 4) as phone_intl, ({_num(_ID)} % 200 + 1)::varchar || ' ' || {_pick(fakes.STREETS, _ID + " || '/street'")} || ', ' || {_pick(fakes.TOWNS, _ID + " || '/town'")} as address,
  strftime(date '1950-01-01' + ({_num(_ID)} % 18000)::int, '%Y-%m-%d') as dob, '9' || substr({_digits(_ID)}, 8, 2) || '-' || substr({_digits(_ID)}, 10, 2) || '-' || substr({_digits(_ID)}, 12, 4) as ssn, {_pick(("female", "male"), _ID + " || '/gender'")} as gender from (select c_custkey as i from customer)""")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up person for each customer."""
    fields = fakes.identity(_C("id").cast("string"))
    rows = table(spark, sf_dir, "customer").select(_C("c_custkey").alias("id"))
    return rows.select("id", *[fields[c].alias(c) for c in ("full_name", "email", "phone_intl", "address", "dob", "ssn", "gender")])


@query(f"select conv_id, turn, role, case when role = 'user' then 'I am ' || {_pick(fakes.FIRST, _ID)} || ', how are you?' else 'Fine, and in ' || {_pick(fakes.TOWNS, _ID)} || '?' end as text from (select *, conv_id * 1000 + turn as i from conversations)")
def mock_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations' turns with made-up texts."""
    rows = table(spark, sf_dir, "conversations")
    seed = (_C("conv_id") * 1000 + _C("turn")).cast("string")
    text = F.when(_C("role") == "user", F.concat(F.lit("I am "), fakes.pick(fakes.FIRST, seed), F.lit(", how are you?"))).otherwise(F.concat(F.lit("Fine, and in "), fakes.pick(fakes.TOWNS, seed), F.lit("?")))
    return rows.select("conv_id", "turn", "role", text.alias("text"))


DAMPING, ROUNDS = 0.85, 30


def ranked_words(words: list[str], k: int, shortest: int = 2) -> list[tuple[str, float]]:
    """The ``k`` best words by PageRank over neighbours in the text, ties by the word; each word's score is a share of 1."""
    names, at = np.unique(np.array(words, object).astype(str), return_inverse=True)
    n = len(names)
    if n < 2:
        return []
    pairs = np.unique(np.concatenate([at[:-1] * n + at[1:], at[1:] * n + at[:-1]]))
    a, b = pairs // n, pairs % n
    degree = np.bincount(a, minlength=n)
    x = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        x = (1 - DAMPING) / n + DAMPING * np.bincount(b, weights=x[a] / degree[a], minlength=n)
    best = sorted((-s, w) for w, s in zip(names, rounded(x).tolist(), strict=True) if len(w) >= shortest)
    return [(w, -s) for s, w in best[:k]]


_TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"""with recursive t as (select doc_id, {_TOKENS} as w from documents),
p as (select doc_id, unnest(w[1:len(w) - 1]) as a, unnest(w[2:]) as b from t where len(list_distinct(w)) > 1),
e as (select doc_id, a, b from p union select doc_id, b, a from p),
d as (select doc_id, a, count(*) as degree, count(*) over (partition by doc_id) as n from e group by doc_id, a),
l as (select e.doc_id, e.a, e.b, degree, n from e join d on e.doc_id = d.doc_id and e.a = d.a),
r as (select doc_id, a as w, 1.0::double / n as x, 0 as i from d
  union all select l.doc_id, l.b, {1 - DAMPING:.2f}::double / any_value(l.n) + {DAMPING}::double * sum(r.x / l.degree), any_value(r.i) + 1 from r join l on l.doc_id = r.doc_id and l.a = r.w where r.i < {ROUNDS} group by l.doc_id, l.b)
select doc_id, w as word, round(x, 6) as score from r where i = {ROUNDS} and length(w) > 1 qualify row_number() over (partition by doc_id order by round(x, 6) desc, w) <= 5""")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five keywords a text; a text's graph lives in one task's memory, as its words do."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, w, s) for d, words in zip(batch["doc_id"], batch["words"], strict=True) for w, s in ranked_words(list(words), 5)]
            yield pd.DataFrame(rows, columns=["doc_id", "word", "score"])

    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words")).mapInPandas(task, "doc_id long, word string, score double")


@query(f"""with t as (select doc_id, unnest({_TOKENS}) as word from documents), f as (select doc_id, word, count(*) as tf from t group by all),
i as (select word, ln((1 + (select count(*) from documents))::double / (1 + count(*))) + 1 as idf from f group by word),
w as (select doc_id, word, tf * idf as raw from f join i using (word)),
n as (select doc_id, word, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 6) as weight from w)
select doc_id, word, weight from n qualify row_number() over (partition by doc_id order by weight desc, word) <= 3""")
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three heaviest words of each text by smoothed, normalised TF-IDF over all texts."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    # texts move once and are counted where they come to, so that their words needn't
    tf = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))  # one row
    raw = tf.join(df, "word").select("doc_id", "word", (_C("tf") * (F.log((_C("n") + 1) / (_C("df") + 1)) + 1)).alias("raw"))
    # a text's words meet once: their length and their places are windows over the same partitions
    length = F.sqrt(F.sum(_C("raw") * _C("raw")).over(Window.partitionBy("doc_id")))
    weighed = raw.select("doc_id", "word", F.round(_C("raw") / length, 6).alias("weight"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("weight"), "word")
    return weighed.withColumn("k", F.row_number().over(best)).where("k <= 3").drop("k")
