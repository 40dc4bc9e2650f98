"""Numbered lines over any splits, and a mapping that grows by batches."""

import pytest
from pyspark.sql import functions as F

from textloom.plans import measures, sessions
from textloom.sources import mapping, records
from textloom.sources.scratch import new_folder

TEXT = "session long, turn long, text string, entities array<struct<entity_type:string,start:int,stop:int,entity_value:string,confidence:double>>"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [700, 9_000, 200_000])
def test_pairs_follow_lines_at_any_split_size(spark, tmp_path, small_splits, size):
    small_splits(size)
    with open(tmp_path / "p.jsonl", "w") as p, open(tmp_path / "t.jsonl", "w") as t:
        for k in range(2000):
            p.write(f'{{"text": "{k}", "entities": [{{"entity_type": "P{k}", "start": 0, "end": 1}}]}}\n')
            t.write(f'{{"text": "{k}", "pad": "{"x" * (k % 300)}", "spans": [{{"entity_type": "P{k}", "start_position": 0, "end_position": 1}}]}}\n' if k % 500 else "\n")
    predicted, truth = (records.read_labelled(spark, str(tmp_path / f"{n}.jsonl")) for n in "pt")
    if size == 700:
        assert spark.read.text(str(tmp_path / "p.jsonl")).rdd.getNumPartitions() > 100
    rows = records.paired(predicted, truth).collect()
    assert sorted(r["sample_id"] for r in rows) == list(range(2000))
    for r in rows:
        assert r["text"] == str(r["sample_id"]) and r["predicted"][0]["entity_type"] == f"P{r['sample_id']}"
        assert [s["entity_type"] for s in r["truth"]] == ([f"P{r['sample_id']}"] if r["sample_id"] % 500 else [])
    assert [r["sample_id"] for r in records.read_labelled(spark, str(tmp_path / "t.jsonl"), 3).collect()] == [1, 2, 3]


def test_lines_run_on_over_files(spark, tmp_path, small_splits):
    small_splits(64)
    lines = [f"line {k} " + "y" * (k % 90) for k in range(300)]
    for n, (a, b) in enumerate(((0, 7), (7, 7), (7, 250), (250, 300))):
        (tmp_path / f"f{n}.txt").write_text("".join(x + "\n" for x in lines[a:b]))
    assert {r["line"]: r["value"] for r in records.numbered_lines(spark, str(tmp_path)).collect()} == dict(enumerate(lines))


def entity(kind, start, stop, value=None, confidence=None):
    return (kind, start, stop, value, confidence)


def test_mapping_grows_by_batches(spark, tmp_path):
    path = str(tmp_path / "mapping")
    first = [(1, 0, "Ann at a@b.org, a@b.org", [entity("EMAIL", 7, 14), entity("EMAIL", 16, 23), entity("PERSON", 0, 3, "Ann")])]
    second = [(1, 1, "a@b.org! [EMAIL_1] ${EMAIL_009}", [entity("EMAIL", 0, 7), entity(None, 0, 3), entity("URL", -1, 4), entity("URL", 20, 99), entity("URL", 5, 5)]), (2, 0, "a@b.org", [entity("EMAIL", 0, 7)]), (2, 1, None, None)]
    frames = [spark.createDataFrame(rows, TEXT) for rows in (first, second)]
    mapping.keep(spark, path, frames[0])
    kept = mapping.keep(spark, path, frames[0].unionByName(frames[1]))
    got = {(r["session"], r["turn"], r["start"]): (r["placeholder"], r["entity_id"], r["entity_value"]) for r in kept.collect()}
    assert got == {
        (1, 0, 16): ("${EMAIL_001}", "EMAIL_1", "a@b.org"), (1, 0, 7): ("${EMAIL_002}", "EMAIL_2", "a@b.org"), (1, 0, 0): ("${PERSON_001}", "PERSON_1", "Ann"),
        (1, 1, 0): ("${EMAIL_003}", "EMAIL_3", "a@b.org"), (2, 0, 0): ("${EMAIL_001}", "EMAIL_1", "a@b.org"),
    }
    assert mapping.keep(spark, path, frames[1]).count() == 5  # a rerun adds nothing
    both = frames[0].unionByName(frames[1])
    texts = {(r["session"], r["turn"]): r["text"] for r in both.collect()}
    for form in mapping.FORMS:
        masked = mapping.masked(both, kept, form)
        assert all("a@b.org" not in (r["masked"] or "") for r in masked.collect())
        back = {(r["session"], r["turn"]): r["text"] for r in mapping.recovered(masked, kept, form).collect()}
        if form == "numbered":  # the text holds a name of its own that is in the mapping
            assert back.pop((1, 1)) == "a@b.org! a@b.org ${EMAIL_009}"
            assert {k: v for k, v in texts.items() if k != (1, 1)} == back
        else:
            assert back == texts


def test_numbers_over_many_runs_of_turns(spark, tmp_path):
    rows = spark.range(2500).select(F.lit(5).cast("long").alias("session"), F.col("id").alias("turn"), F.lit("ab").alias("text"), F.expr("array(named_struct('entity_type', 'X', 'start', 0, 'stop', 1, 'entity_value', cast(null as string), 'confidence', cast(null as double)), named_struct('entity_type', 'X', 'start', 1, 'stop', 2, 'entity_value', cast(null as string), 'confidence', cast(null as double)))").alias("entities"))
    got = {(r["turn"], r["start"]): r["number"] for r in mapping.keep(spark, str(tmp_path / "m"), rows).collect()}
    assert got == {(t, s): 2 * t + 2 - s for t in range(2500) for s in (0, 1)}


def test_parts_of_lines_grow_with_the_lines(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(sessions, "LINES", 10)
    monkeypatch.setattr(sessions, "new_folder", lambda spark, name: folders.append(new_folder(spark, name)) or folders[-1])
    rows = {r["sample_id"]: r["truth"] for r in sessions.paired_lines(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    assert rows == {k: d["source"] for k, d in enumerate(docs)}
    parts = [len(spark.read.text(f"{folders[0]}/{n}").inputFiles()) for n in ("predicted", "truth")]
    assert parts[0] >= 15 and 6 <= parts[1] < parts[0]


def test_texts_are_read_from_where_entities_were_found(spark):
    files = sessions.session_forms(spark, "/root/testdata/sf0.001").inputFiles()
    assert any("/texts-" in f for f in files) and not any("documents.parquet" in f for f in files)


def test_numbers_beyond_three_digits_name_one_place_each(spark):
    """lpad(number, 3) in the queries' SQL cuts 1084 to 108, so that places share a name."""
    found = spark.range(1200).select(F.lit(1).alias("session"), F.col("id").alias("turn"), F.lit("PERSON").alias("entity_type"), F.lit(0).alias("start"), F.concat(F.lit("v"), "id").alias("entity_value"))
    names = measures.session_mapping(found)
    assert names.select("placeholder").distinct().count() == 1200
    back = measures.recovered(names.select("session", "turn", F.col("placeholder").alias("masked")), names)
    assert back.where("text = concat('v', turn)").count() == 1200
