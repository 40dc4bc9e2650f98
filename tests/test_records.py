import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.plans import samples
from textloom.sources import records


def test_labelled_lines_and_pairs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"full_text": "Ann é", "spans": [{"entity_type": "PERSON", "start_position": 0, "end_position": 3}]}\n{"text": "b", "entities": [{"entity_type": "X", "start": 0, "end": 1}]}\n\n{broken\n')
    rows = records.read_labelled(spark, str(tmp_path / "a.jsonl")).orderBy("sample_id").collect()
    assert [r["text"] for r in rows] == ["Ann é", "b", ""] and [[(s["entity_type"], s["start"], s["stop"]) for s in r["spans"]] for r in rows] == [[("PERSON", 0, 3)], [("X", 0, 1)], []]
    first = records.read_labelled(spark, str(tmp_path / "a.jsonl"), 1)
    both = records.paired(first, records.read_labelled(spark, str(tmp_path / "a.jsonl"))).orderBy("sample_id").collect()
    assert [(len(r["predicted"]), len(r["truth"])) for r in both] == [(1, 1), (0, 1), (0, 0)]


def test_repaired(spark):
    cases = {
        '```json\n[{"entity_type": "A"}]\n```': '[{"entity_type": "A"}]',
        'x [{"entity_type": A, "entity_value": say "hi" },] y': '[{"entity_type": "A", "entity_value": "say \\"hi\\""}]',
        '[{"entity__type": "A"} {"entity_type": B}': '[{"entity_type": "A"}, {"entity_type": "B"}]',
        '[{"a": "say "hi" now", "b": 10:30}': '[{"a": "say \\"hi\\" now", "b": "10:30"}]',
        '[{a: 1.5, "b": [true, x}, {"c": "é\\n", "d":}]': '[{"a": 1.5, "b": [true, "x"]}, {"c": "é\\n", "d": null}]',
        '[{"a": "cut of': '[{"a": "cut of"}]',
        '[{"a": "x"}] and [{"a": "y"}]': '[{"a": "x"}]',
        "none": "[]",
        "": "[]",
        None: "[]",
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, a string").select("k", records.repaired(F.col("a")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in rows] == list(cases.values())


@settings(deadline=None)
@given(st.text(alphabet='[]{}:,"\\ab1 \n_', max_size=60))
def test_repaired_is_json(text):
    got = json.loads(records.mended("[{" + text))
    assert isinstance(got, list)


@settings(deadline=None)
@given(st.lists(st.dictionaries(st.text("abc_é", min_size=1).filter(lambda x: "__" not in x), st.text('ab"\\é\n,}]{: ', max_size=12) | st.integers(-99, 99) | st.none(), max_size=3), min_size=1, max_size=4))
def test_repaired_keeps_json(rows):
    assert json.loads(records.mended("So: " + json.dumps(rows))) == rows


def test_exams_and_log(spark, tmp_path):
    (tmp_path / "law.csv").write_text('Question,A,B,C,D,Answer\n"Which, then?",1,2,3,4,B\n')
    (tmp_path / "art.csv").write_text("Question,A,B,C,D,Answer\nWho?,a,b,c,d,A\n")
    assert {(r["subject"], r["Question"], r["Answer"]) for r in records.read_exams(spark, str(tmp_path)).collect()} == {("law", "Which, then?", "B"), ("art", "Who?", "A")}
    lines = ["a", "[#] 10.0%", "b\x00", "[##] 100.0% - Completed!", "[#] 20.0%"]
    frame = spark.createDataFrame([("l", k, x) for k, x in enumerate(lines)] + [("m", 0, "[#] 1.0%"), ("m", 1, "z")], "log string, position int, line string")
    got = {(r["log"], r["position"]) for r in records.log_tail(frame, 3).collect()}
    assert got == {("l", 0), ("l", 3), ("l", 4), ("m", 1)}


def test_mixed_passages(spark):
    def mix(p, n, noise):
        rows = spark.createDataFrame([(p, n)], "p array<int>, n array<int>")
        return rows.select(samples.mixed(F.col("p"), F.col("n"), 4, noise).alias("x")).first()["x"]

    assert mix([1, 2, 3, 4], [-1, -2, -3], 0.3) == [1, 2, -1, -2]
    assert mix([1, 2, 3, 4], [-1], 0.5) == [1, 2, 3, -1] and mix([1], [-1, -2, -3, -4], 0.5) == [1, -1, -2, -3]
    assert mix([1, 2, 3, 4], [-1, -2, -3, -4], 1) == [-1, -2, -3, -4]
