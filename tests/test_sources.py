"""Readers and sinks on small files, chunks and matching on literal cases."""

import zipfile

from pyspark.sql import functions as F

from textloom.functions.chunks import recursive_chunks
from textloom.plans.assess import answer_labels, assemble, fill, greedy_match
from textloom.sources import office, sinks
from textloom.streaming.usage import latest

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def word(path, paragraphs):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')


def test_docx_sections(spark, tmp_path):
    word(tmp_path / "a.docx", [("Normal", "before"), ("Heading1", "One"), ("Heading2", "Two"), ("Normal", "x"), ("Normal", "y"), ("Heading1", "Three"), ("Normal", "z")])
    (tmp_path / "b.docx").write_bytes(b"not a package")
    rows = office.read_docx(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r.headings, r.content) for r in rows] == [("", "before"), ("One > Two", "x\ny"), ("Three", "z")]


def test_pptx_slides_in_number_order(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        for k in (10, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f'<s xmlns:a="{A}"><a:p><a:r><a:t>s</a:t></a:r><a:r><a:t>{k}</a:t></a:r></a:p></s>')
    assert [(r.slide, r.content) for r in office.read_pptx(spark, str(tmp_path)).orderBy("slide").collect()] == [(1, "s2"), (2, "s10")]


def test_text_files_and_listing(spark, tmp_path):
    for name, text in (("b.md", "two\nlines"), ("A.TXT", "x"), ("c.txt", "yy")):
        (tmp_path / name).write_text(text)
    assert sorted(r.content for r in office.read_text(spark, str(tmp_path)).collect()) == ["two\nlines", "yy"]
    assert [r.name for r in office.listing(spark, str(tmp_path), ".t", "length", False).collect()] == ["c.txt", "A.TXT"]
    kinds = spark.createDataFrame([("x/A.TXT",), ("b.docx",), ("c.exe",)], "p string").select(office.kind(F.col("p")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["text", "docx", None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["b", "a"], "train"), (2, None, "val")], "id int, tags array<string>, split string")
    sinks.write_splits(rows, str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits/split=train")).collect()[0].id == 1
    sinks.write_details(rows, str(tmp_path / "csv"))
    assert {(r.id, r.tags) for r in spark.read.csv(str(tmp_path / "csv"), header=True).collect()} == {("1", "a, b"), ("2", None)}
    missed = spark.createDataFrame([("x" * 120, "EMAIL")], "context string, kind string")
    wrong = spark.createDataFrame([("c", 0.5)], "context string, confidence double")
    got = {r.error: r for r in sinks.errors_together(missed, wrong).collect()}
    assert len(got["FN"].context) == 100 and got["FN"].confidence == "N/A" and got["FP"].kind == "N/A"
    old, new = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, sinks.upserted(old, new).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    left = sinks.cascade_deleted({"t": old, "processing_log": old}, new.select("id"), "id")
    assert (left["t"].count(), left["processing_log"].count()) == (1, 2)


def test_recursive_chunks():
    assert recursive_chunks(None) == recursive_chunks("  ") == []
    assert recursive_chunks("ab cd\nef gh", 5) == ["ab cd", "ef gh"]
    assert recursive_chunks("abcdefgh", 3) == ["abc", "def", "gh"]
    text = "word " * 500 + "\n\n" + "x" * 1300
    assert all(len(c) <= 500 for c in recursive_chunks(text)) and "".join("".join(recursive_chunks(text)).split()) == "".join(text.split())


def test_greedy_match_takes_each_truth_once(spark):
    span = "array<struct<entity_type:string,start:int,stop:int>>"
    rows = spark.createDataFrame([([("A", 0, 4), ("A", 1, 5), ("B", 0, 4)], [("A", 0, 5)])], f"p {span}, t {span}")
    assert rows.select(greedy_match(F.col("p"), F.col("t")).alias("m")).first().m == [0, -1, -1]


def test_answers_streams_and_templates(spark):
    row = spark.createDataFrame([("The Cat", ['{"response":"a"}', 'data: {"choices":[{"delta":{"content":"b"}}]}', "data: [DONE]", "{cut"])], "s string, lines array<string>")
    got = row.select(answer_labels(F.col("s"), [["dog", "CAT"], ["cow"]]).alias("a"), assemble(F.col("lines")).alias("b"), fill(F.lit("{{X}}-{{Y}}"), F.create_map(F.lit("X"), F.lit("1"))).alias("c")).first()
    assert got.a == [1, 0] and got.b == "ab" and got.c.text == "1-{{Y}}" and [(s.start, s.stop) for s in got.c.spans] == [(0, 1)]


def test_latest_keeps_the_last_rows(spark, tmp_path):
    source = tmp_path / "in"
    out, last = str(tmp_path / "out"), None
    for k in range(2):
        spark.range(k * 10, k * 10 + 10, 1, 1).withColumnRenamed("id", "ts").write.mode("append").parquet(str(source))
        latest(spark.readStream.schema("ts long").parquet(str(source)), out, str(tmp_path / "check"), 4).awaitTermination()
        last = sorted(r.ts for r in spark.read.parquet(f"{out}/batch={k}").collect())
        assert last == list(range(k * 10 + 6, k * 10 + 10))


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([("all", 2, 0.123456), ("none", 0, None)], "name string, n int, rate double")
    details = spark.createDataFrame([("d1", ["b", "a"])], "doc string, types array<string>")
    sinks.write_report(rows, str(tmp_path), details)
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "json")).select("name", "n", "rate").collect())) == [("all", 2, 0.123456), ("none", 0, None)]
    read = lambda n: sorted(map(tuple, spark.read.option("header", "true").csv(str(tmp_path / n)).collect()))
    assert read("summary") == [("all", "2", "0.1235"), ("none", "0", None)] and read("detailed") == [("d1", "a, b")]
