"""Records in JSON, CSV and logs: labelled lines, exam sheets, catalog items, model lists, repaired answers, log tails.

Parsers are column expressions, so that they serve files and columns alike; a malformed line gives
nulls and no spans.  Only answers are mended in Python, over Arrow batches.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPAN = "entity_type string, entity_value string, start int, `end` int, start_position int, end_position int"
_LINE = f"full_text string, text string, spans array<struct<{_SPAN.replace(' string', ':string').replace(' int', ':int')}>>, entities array<struct<{_SPAN.replace(' string', ':string').replace(' int', ':int')}>>"
_ITEM = "key string, data struct<title:string,creators:array<struct<firstName:string,lastName:string>>,tags:array<struct<tag:string>>,date:string,url:string>, links struct<enclosure:struct<href:string>>"
_MODELS = "models array<struct<name:string,model:string,size:bigint,digest:string,modified_at:string,details:struct<parameter_size:string,format:string,quantization_level:string>>>"


def labelled(line: Column) -> Column:
    """text, spans (entity_type, entity_value, start, stop) of a JSON line.

    The text is ``full_text``, else ``text``, else empty; spans are ``spans``, else ``entities``, and
    their places ``start_position`` and ``end_position``, else ``start`` and ``end``.
    """
    x = F.from_json(line, _LINE)
    found = F.coalesce(x["spans"], x["entities"], F.array().cast(f"array<struct<{_SPAN.replace(' string', ':string').replace(' int', ':int')}>>"))
    places = F.transform(found, lambda s: F.struct(s["entity_type"].alias("entity_type"), s["entity_value"].alias("entity_value"), F.coalesce(s["start_position"], s["start"]).alias("start"), F.coalesce(s["end_position"], s["end"]).alias("stop")))
    return F.struct(F.coalesce(x["full_text"], x["text"], F.lit("")).alias("text"), places.alias("spans"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0), value of all lines of ``path``, its files taken in order of their names.

    A file is read in splits; lines are counted by split, the counts are added up along the files,
    and each line's place in its split is added.  So numbers don't depend on where files are cut.
    """
    meta = F.col("_metadata")
    rows = spark.read.text(path).select("value", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_split"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_n")).select("_file", before(Window.orderBy("_file")).alias("_base"))  # one row a file
    starts = splits.withColumn("_own", before(Window.partitionBy("_file").orderBy("_split"))).join(files, "_file")
    starts = starts.select("_file", "_split", (F.col("_base") + F.col("_own") - F.col("_first")).alias("_start"))
    return rows.join(starts, ["_file", "_split"]).select((F.col("_at") + F.col("_start")).alias("line"), "value")


def read_labelled(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """sample_id, text, spans of JSON lines; ids are the numbers of lines, and ``limit`` takes the first lines that aren't blank."""
    rows = numbered_lines(spark, path).where(F.trim("value") != "")
    rows = rows.select(F.col("line").alias("sample_id"), labelled(F.col("value")).alias("x")).select("sample_id", "x.*")
    return rows if limit is None else rows.orderBy("sample_id").limit(limit)


def paired(predicted: DataFrame, truth: DataFrame, key: str = "sample_id") -> DataFrame:
    """Spans of both sides by sample: key, text, predicted, truth; a sample that one side lacks has no spans there."""
    a = predicted.select(key, F.col("text").alias("_t"), F.col("spans").alias("predicted"))
    rows = a.join(truth.select(key, "text", F.col("spans").alias("truth")), key, "full")
    return rows.select(key, F.coalesce("text", "_t").alias("text"), *[F.coalesce(c, F.array()).alias(c) for c in ("predicted", "truth")])


def catalog_item(line: Column) -> Column:
    """key, title, creators, tags, date, url, path of a library item; what is missing has its stated default."""
    x = F.from_json(line, _ITEM)
    data = x["data"]
    name = lambda c: F.trim(F.concat(F.coalesce(c["firstName"], F.lit("")), F.lit(" "), F.coalesce(c["lastName"], F.lit(""))))
    joined = lambda xs, f: F.coalesce(F.array_join(F.transform(xs, f), ", "), F.lit(""))
    href = x["links"]["enclosure"]["href"]
    # a plus sign is itself in a path, unlike in a query
    path = F.when(href.startswith("file://"), F.try_url_decode(F.replace(F.replace(href, F.lit("file://"), F.lit("")), F.lit("+"), F.lit("%2B"))))
    return F.struct(
        F.coalesce(x["key"], F.lit("N/A")).alias("key"),
        F.coalesce(data["title"], F.lit("No Title")).alias("title"),
        joined(data["creators"], name).alias("creators"),
        joined(data["tags"], lambda t: F.coalesce(t["tag"], F.lit(""))).alias("tags"),
        F.coalesce(data["date"], F.lit("No Date")).alias("date"),
        F.coalesce(data["url"], F.lit("No URL")).alias("url"),
        path.alias("path"),
    )


def models(payload: Column) -> Column:
    """Array of name, model, size, digest, parameter_size, format, quantization, modified_at; texts default to empty, sizes to 0."""
    listed = F.coalesce(F.from_json(payload, _MODELS)["models"], F.from_json(F.lit('{"models": []}'), _MODELS)["models"])

    def one(m: Column) -> Column:
        text = lambda c: F.coalesce(c, F.lit(""))
        d = m["details"]
        return F.struct(text(m["name"]).alias("name"), text(m["model"]).alias("model"), F.coalesce(m["size"], F.lit(0)).alias("size"), text(m["digest"]).alias("digest"), text(d["parameter_size"]).alias("parameter_size"), text(d["format"]).alias("format"), text(d["quantization_level"]).alias("quantization"), text(m["modified_at"]).alias("modified_at"))

    return F.transform(listed, one)


_NAME = re.compile(r'"?([^":{}\[\],]*+)"?\s*+:')
_QUOTED = re.compile(r'"((?:[^"\\]|\\.|"(?!\s*(?:[,}\]]|$)))*+)"', re.DOTALL)  # ends at the quote that a value's end follows
_BARE = re.compile(r'"?([^,}\]\r\n]*+)')
_LITERAL = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null")


def _unescaped(inner: str) -> str:
    """What stands between a string's quotes; with an escape that JSON lacks it is taken as it is."""
    closed = re.sub(r'(\\.)|"', lambda m: m[1] or '\\"', inner, flags=re.DOTALL)
    try:
        return json.loads(f'"{closed}"', strict=False)
    except ValueError:
        return inner


def _value(text: str, at: int) -> tuple[str, int]:
    """The JSON form of the value at ``at``, quoted or bare, and where it ends."""
    if quoted := _QUOTED.match(text, at):
        return json.dumps(_unescaped(quoted[1]), ensure_ascii=False), quoted.end()
    bare = _BARE.match(text, at)
    said = bare[1].strip()
    return said if _LITERAL.fullmatch(said) else json.dumps(said, ensure_ascii=False), max(bare.end(), at + 1)


def mended(answer: str | None) -> str:
    """The array of objects in ``answer`` as JSON, read by one scan that keeps the closers of open brackets; ``[]`` without one.

    Talk around it goes.  Missing commas, quotes and brackets are set, surplus ones go, a name without
    a value has null, and a name's repeated underscores count as one.
    """
    begun = re.search(r"\[\s*\{", answer or "")
    if begun is None:
        return "[]"
    out, open_, filled, named, at = ["["], ["]"], [False], False, begun.start() + 1

    def put(piece: str) -> None:
        out.append(piece if named or not filled[-1] else ", " + piece)
        filled[-1] = True

    def close() -> None:
        out.append(("null" if named else "") + open_.pop())
        filled.pop()

    while open_ and at < len(answer):
        c = answer[at]
        nameless = open_[-1] == "}" and not named
        if c in "{[" and nameless:  # has no place in an object
            at += 1
        elif c in "{[":
            put(c)
            open_.append("}" if c == "{" else "]")
            filled.append(False)
            named, at = False, at + 1
        elif c in "}]":
            while c in open_:  # what was left open inside ends with it
                last = open_[-1]
                close()
                named = False
                if last == c:
                    break
            at += 1
        elif c.isspace() or c in ",:":
            at += 1
        elif nameless:
            name = _NAME.match(answer, at)
            if name:
                put(json.dumps(re.sub("_+", "_", _unescaped(name[1].strip())), ensure_ascii=False) + ": ")
                named = True
            at = name.end() if name else at + 1
        else:
            value, at = _value(answer, at)
            put(value)
            named = False
    while open_:
        close()
        named = False
    return "".join(out)


def repaired(answer: Column) -> Column:
    """``mended`` of a column."""

    @F.pandas_udf("string")
    def each(answers: pd.Series) -> pd.Series:
        return answers.map(mended)

    return each(answer)


def read_exams(spark: SparkSession, path: str) -> DataFrame:
    """subject, Question, A, B, C, D, Answer of a folder of sheets, one CSV a subject."""
    sheets = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    subject = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1).alias("subject")
    return sheets.select(subject, *[F.col(c).cast("string").alias(c) for c in ("Question", "A", "B", "C", "D", "Answer")])


def log_tail(lines: DataFrame, n: int = 300, by: str = "log") -> DataFrame:
    """The last ``n`` lines of each log of ``lines`` (``by``, position, line).

    Lines with a null character go, and so do progress bars, but for one that is its log's last line.
    """
    bar = F.col("line").rlike(r"\[.*\] \d+\.\d+%") & ~F.endswith("line", F.lit(" - Completed!"))
    seen = lines.where(~F.contains("line", F.lit("\x00"))).withColumn("_bar", bar)
    # the last line stays whatever it is; of the others those that aren't bars
    order = Window.partitionBy(by).orderBy(F.col("position").desc())
    ranked = seen.withColumn("_first", F.row_number().over(order)).where(~F.col("_bar") | (F.col("_first") == 1))
    return ranked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select(*lines.columns)
