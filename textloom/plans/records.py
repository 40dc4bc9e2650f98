"""Round trips of records: rows are written in the forms that occur, and read back; they join the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.plans.catalog import query, table
from textloom.sources import records

_C = F.col


@query("""select conv_id, turn, case when turn % 3 = 2 then '' else coalesce(text, '') end as text, case when turn % 3 = 2 then null else 0 end as start, case when turn % 3 = 2 then null else least(length(text), 5) end::int as stop, case when turn % 3 = 2 then null else role end as entity_type from conversations""")
def labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines of both spellings, and empty ones."""
    stop, rows = F.least(F.length("text"), F.lit(5)), table(spark, sf_dir, "conversations")
    long = F.struct(_C("role").alias("entity_type"), F.left("text", F.lit(5)).alias("entity_value"), F.lit(0).alias("start_position"), stop.alias("end_position"))
    short = F.struct(_C("role").alias("entity_type"), F.left("text", F.lit(5)).alias("entity_value"), F.lit(0).alias("start"), stop.alias("end"))
    line = F.when(_C("turn") % 3 == 0, F.to_json(F.struct(_C("text").alias("full_text"), F.array(long).alias("spans"))))
    line = line.when(_C("turn") % 3 == 1, F.to_json(F.struct("text", F.array(short).alias("entities")))).otherwise("{}")
    read = rows.select("conv_id", "turn", records.labelled(line).alias("x"))
    return read.select("conv_id", "turn", "x.text", F.explode_outer("x.spans").alias("s")).select("conv_id", "turn", "text", _C("s.start").alias("start"), _C("s.stop").alias("stop"), _C("s.entity_type").alias("entity_type"))


@query("""select doc_id, coalesce(lang, '') as entity_value, 'LANG' as entity_type from documents where doc_id % 4 < 3 union all select doc_id, coalesce(source, ''), 'SOURCE' from documents where doc_id % 4 = 2""")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in fences, with bare values, misspelt and cut off, and without any array, mended and parsed."""
    lang, source = (F.coalesce(c, F.lit("")) for c in ("lang", "source"))
    forms = (
        F.concat(F.lit('```json\n[{"entity_type": "LANG", "entity_value": "'), lang, F.lit('"}]\n```')),
        F.concat(F.lit('Here it is: [{"entity_type": LANG , "entity_value": '), lang, F.lit("},] as asked")),
        F.concat(F.lit('[{"entity__type": "LANG", "entity__value": "'), lang, F.lit('"}\n{"entity_type": SOURCE, "entity_value": "'), source, F.lit('"},')),
        F.lit("There is nothing of the kind."),
    )
    kind = _C("doc_id") % 4
    answer = F.when(kind == 0, forms[0]).when(kind == 1, forms[1]).when(kind == 2, forms[2]).otherwise(forms[3])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.from_json(records.repaired(answer), "array<struct<entity_type:string,entity_value:string>>").alias("x"))
    return rows.select("doc_id", F.inline("x"))


@query("""select page_id, page_id::varchar as key, case when page_id % 2 = 0 then 'No Title' else left(url, 20) end as title, case when page_id % 3 = 0 then '' else 'Ann ' || page_id::varchar || ', Lee' end as creators, case when page_id % 2 = 0 then 'a, b' else '' end as tags, 'No Date' as date, url, case when page_id % 2 = 0 then '/docs/' || url || ' 100%+é' end as path from pages where url is not null""")
def catalog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library items with and without each part."""
    rows, key = table(spark, sf_dir, "pages").where("url is not null"), _C("page_id").cast("string")
    even, name = _C("page_id") % 2 == 0, "struct<firstName:string,lastName:string>"
    people = F.array(F.struct(F.lit("Ann").alias("firstName"), key.alias("lastName")).cast(name), F.struct(F.lit(None).cast("string").alias("firstName"), F.lit("Lee").alias("lastName")).cast(name))
    data = F.struct(F.when(~even, F.left("url", F.lit(20))).alias("title"), F.when(_C("page_id") % 3 != 0, people).alias("creators"), F.when(even, F.array(F.struct(F.lit("a").alias("tag")), F.struct(F.lit("b").alias("tag")))).alias("tags"), _C("url").alias("url"))
    file = F.concat(F.lit("file:///docs/"), F.replace(F.url_encode(F.concat("url", F.lit(" 100%+é"))), F.lit("+"), F.lit("%20")))
    link = F.struct(F.struct(F.when(even, file).otherwise("https://a.org/x").alias("href")).alias("enclosure"))
    return rows.select("page_id", records.catalog_item(F.to_json(F.struct(key.alias("key"), data.alias("data"), link.alias("links")))).alias("x")).select("page_id", "x.*")


@query("select doc_id, 'm' || doc_id::varchar as name, 'm' as model, coalesce(n_chars, 0)::bigint as size, case when doc_id % 2 = 0 then coalesce(lang, '') else '' end as parameter_size, '' as quantization from documents")
def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of one payload a document, every other without details."""
    details = F.when(_C("doc_id") % 2 == 0, F.struct(_C("lang").alias("parameter_size")))
    one = F.struct(F.concat(F.lit("m"), _C("doc_id").cast("string")).alias("name"), F.lit("m").alias("model"), _C("n_chars").alias("size"), details.alias("details"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.inline(records.models(F.to_json(F.struct(F.array(one).alias("models"))))))
    return rows.select("doc_id", "name", "model", "size", "parameter_size", "quantization")


@query("""with l as (select user_id as log, event_id as position, case when event_id % 3 = 0 then '[##] ' || value::varchar || '%' else event_type end as line, event_id % 3 = 0 and value::varchar like '%.%' as bar from events),
k as (select *, position = max(position) over (partition by log) as newest from l)
select log, position from k where not bar or newest qualify row_number() over (partition by log order by position desc) <= 10""")
def log_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten lines of each user's log, a third of whose lines are progress bars."""
    line = F.when(_C("event_id") % 3 == 0, F.concat(F.lit("[##] "), _C("value").cast("string"), F.lit("%"))).otherwise(_C("event_type"))
    lines = table(spark, sf_dir, "events").select(_C("user_id").alias("log"), _C("event_id").alias("position"), line.alias("line"))
    return records.log_tail(lines, 10).select("log", "position")
