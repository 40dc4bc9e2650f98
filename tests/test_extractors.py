"""Extractors and their merge against a plain fold, experiments and errors on stated cases, formats, mixes, resumption."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import extractors, fakes, mixes, relevance, spans
from textloom.plans import experiments
from textloom.sources import resume

SPAN = "doc_id int, entity_type string, start int, stop int, entity_value string, confidence double, context string"


def plain_merge(found, prefer, limit=0.5):
    kept = []
    for s in sorted(found, key=lambda s: (s[1], -s[4], s[2], s[5], s[0])):
        for i, k in enumerate(kept):
            shared, shorter = min(s[2], k[2]) - max(s[1], k[1]), min(s[2] - s[1], k[2] - k[1])
            if shorter > 0 and shared / shorter > limit:
                if (s[1], s[2]) == (k[1], k[2]):
                    better = s[4] > k[4]
                elif prefer == "longer":
                    better = s[2] - s[1] > k[2] - k[1]
                else:
                    better = s[4] > k[4] if prefer == "higher_confidence" else s[5] == prefer != k[5]
                kept[i] = s if better else k
                break
        else:
            kept.append(s)
    return kept


@pytest.mark.parametrize("prefer", ["longer", "higher_confidence", "a"])
def test_preferred_is_the_plain_fold(spark, prefer):
    rng = random.Random(7)
    rows = []
    for k in range(150):
        found = []
        for _ in range(rng.randrange(9)):
            start = rng.randrange(12)
            found.append(("T", start, start + rng.randrange(0, 7), "v", rng.choice((0.5, 0.7, 0.9)), rng.choice("ab")))
        rows.append((k, found))
    got = spark.createDataFrame(rows, f"k int, f array<{extractors.FOUND}>").select("k", extractors.preferred(F.col("f"), prefer).alias("m")).collect()
    for r in got:
        assert [tuple(s) for s in r["m"]] == plain_merge(rows[r["k"]][1], prefer)


def test_registry(spark):
    extractors.register(extractors.Extractor("away", spans.find_all, 0.5, available=lambda: False))
    try:
        assert "away" not in {e.name for e in extractors.available()} and [e.name for e in extractors.available(["digits", "away", "checked"])] == ["digits", "checked"]
        with pytest.raises(KeyError):
            extractors.available(["nobody"])
        rows = spark.createDataFrame([("card 4111 1111 1111 1111 or 4111 1111 1111 1112",), ("",), (None,)], "text string")
        got = rows.select(extractors.extracted(F.col("text"), ["digits", "checked", "away"]).alias("s")).collect()
        assert [(s["source"], s["start"], s["confidence"]) for s in got[0]["s"]] == [("digits", 5, 0.6), ("digits", 28, 0.6), ("checked", 5, 0.95)]
        assert got[1]["s"] == got[2]["s"] == []
    finally:
        del extractors.REGISTRY["away"]


def test_experiments_on_the_stated_case(spark):
    found = spark.createDataFrame([(1, "CREDIT_CARD", 10, 29, 0.9, "patterns"), (1, "EMAIL", 50, 70, 0.9, "patterns"), (1, "PHONE", 100, 115, 0.9, "patterns"), (1, "EMAIL", 50, 70, 0.95, "checked")], "doc_id int, entity_type string, start int, stop int, confidence double, source string")
    truth = spark.createDataFrame([(1, 10, 29), (1, 50, 70), (1, 200, 210)], "doc_id int, start int, stop int")
    rows = {(r["sources"], r["least"]): r for r in experiments.experiments(experiments.judged(found, truth)).collect()}
    best = rows[("patterns", 0.5)]
    assert (best["tp"], best["fp"], best["fn"]) == (2, 1, 1) and abs(best["precision"] - 2 / 3) < 1e-9 and abs(best["f1"] - 2 / 3) < 1e-6
    assert (rows[("all", 0.92)]["tp"], rows[("all", 0.92)]["fp"], rows[("patterns", 0.92)]["tp"]) == (1, 0, 0)
    assert sorted(r["rank"] for r in rows.values()) == list(range(1, 13)) and {r["rank"] for k, r in rows.items() if k[0] in ("all", "patterns") and k[1] < 0.9} == {1, 2, 3, 4}


def test_errors_summaries_and_all_seven_rules(spark):
    def frame(rows):
        return spark.createDataFrame([(1, t, a, a + 5, v, c, x) for t, a, v, c, x in rows], SPAN)

    def told(predicted, truth):
        return [r["advice"] for r in experiments.advice(experiments.summaries(experiments.errors(frame(predicted), frame(truth)))).orderBy("ordinal").collect()]

    texts = [t for *_, t in experiments.ADVICE]
    missed = [("PHONE_NUMBER", 0, "+1 (2)", 0.9, "a"), ("LOCATION", 10, "1 A B C Street", 0.9, "a. b! c?"), ("EMAIL_ADDRESS", 20, "a@b", 0.9, "a")]
    wrong = [("PERSON", 30, "A B", 0.9, "a"), ("PERSON", 40, "C D", 0.4, "a")]
    assert told(wrong[:1], missed) == [texts[0], texts[1], texts[2], texts[3], texts[4], experiments.BALANCE[1]]
    assert told(wrong, [missed[2]]) == [texts[3], texts[4], experiments.BALANCE[2]]
    assert told([], []) == [] and told(missed, missed) == []
    rows = {(r["error"], r["property"], r["value"]): r["n"] for r in experiments.summaries(experiments.errors(frame(wrong), frame(missed))).collect()}
    assert rows[("FN", "total", None)] == 3 and rows[("FP", "total", None)] == 2
    assert rows[("FN", "category", "FN_LOCATION_COMPLEX_COMPLEX")] == 1 and rows[("FP", "category", "FP_PERSON_LOW")] == 1
    assert rows[("FN", "format", "COMPLEX")] == 2 and rows[("FN", "around", "SIMPLE")] == 2 and rows[("FP", "level", "HIGH")] == 1 and rows[("FP", "entity_type", "PERSON")] == 2


def test_formats_are_kept_and_no_character_stays(spark):
    values = ["$1,234.56", "€ 0.5", "-12.5%", "007-42", "Ab9-Éz", "+1 (555) 010-9999", "4111 1111 1111 1111", "x" * 100 + "1" * 100, "", "¥¥ -- 。", None, "90210.00"]
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", "v", fakes.grammar(F.col("v")).alias("g"), fakes.refilled(F.lit("s"), F.col("v")).alias("f"), fakes.refilled(F.lit("t"), F.col("v")).alias("o")).orderBy("k").collect()
    assert [r["g"] for r in rows[:5]] == ["$1,999.99", "€ 9.9", "-19.9%", "001-19", "Aa1-Aa"] or [r["g"] for r in rows[:3]] == ["$1,999.99", "€ 9.9", "-19.9%"]
    for r in rows:
        if r["v"] is None:
            assert r["f"] is None
            continue
        assert len(r["f"]) == len(r["v"])
        for a, b in zip(r["v"], r["f"], strict=True):
            assert a != b if a.isalnum() and not ("　" < a) else a == b
            assert a.isdigit() == b.isdigit() and a.isupper() == b.isupper()
        assert r["v"][:1] not in set("123456789") or r["f"][0] != "0"
    assert rows[7]["f"] != rows[7]["o"] and len(set(rows[7]["f"][100:])) > 5


def test_passages_by_groups_and_wrong_facts(spark):
    def groups(gs, q, n=5, noise=0.4):
        return spark.createDataFrame([(gs, q)], "g array<array<string>>, q array<string>").select(mixes.by_groups(F.col("g"), F.col("q"), n, noise).alias("x")).first()["x"]

    assert groups([["a1", "a2", "a3"], ["b1"]], ["x", "y", "z"]) == ["a1", "b1", "a2", "x", "y"]
    assert groups([["a1", "a2"], [], ["b1", "b2"]], ["x"], 6, 0.2) == ["a1", "b1", "a2", "b2", "x"]
    assert groups([[c] for c in "abcdefg"], ["x"]) == list("abcdefg")  # more groups than passages: each stays
    assert groups([], ["x", "y"]) == ["x", "y"] and groups([], []) == []

    def facts(p, q, n, noise, right):
        w = [f"not {x}" for x in p]
        return spark.createDataFrame([(p, w, q)], "p array<string>, w array<string>, q array<string>").select(mixes.with_wrong_facts(F.col("p"), F.col("w"), F.col("q"), n, noise, right).alias("x")).first()["x"]

    got = facts(list("abcdef"), ["x", "y", "z"], 6, 0.3, 0.3)
    assert len(got) == 6 and all(x.startswith("not ") for x in got[:2]) and got[4:] == ["x", "y"]
    assert len({x[-1] for x in got[:4]}) == 4 and all(len(x) == 1 for x in got[2:4])  # no passage is drawn twice
    assert got == facts(list("abcdef"), ["x", "y", "z"], 6, 0.3, 0.3)
    assert facts(["a"], [], 6, 0.5, 0.2) == ["not a"] and facts([], ["x"], 4, 0.5, 0.25) == ["x"] and facts(["a"], ["x", "y"], 2, 1.0, 0.0) == ["x", "y"]


def test_search_measures(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 20)], "query_id int, rank int, id int")
    relevant = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 13, 1), (2, 99, 1), (3, 5, 1)], "query_id int, id int, grade int")
    got = {r["query_id"]: r for r in relevance.measures(hits, relevant, 2).collect()}
    assert (got[1]["n_relevant"], got[1]["recall"], got[1]["reciprocal_rank"]) == (3, pytest.approx(1 / 3), 0.5)
    assert got[1]["gain"] == pytest.approx((2 / 1.584962500721156) / (2 + 1 / 1.584962500721156))
    assert got[2]["recall"] == got[3]["gain"] == got[2]["reciprocal_rank"] == 0
    asked = relevance.labels(spark.createDataFrame([("n", "1. What?\n\n2) Why?\n3 Who"), ("m", None)], "node_id string, answer string")).orderBy("ordinal").collect()
    assert [r["question"] for r in asked] == [" What?", " Why?", "Who"] and len({r["query_id"] for r in asked}) == 3


def test_only_changed_content_is_computed(spark, tmp_path):
    ran = []

    def score(todo):
        ran.append(sorted((r["id"], r["answer"]) for r in todo.collect()))
        return todo.withColumn("score", F.length("answer"))

    rows = [(1, "q", "a", "x"), (2, "q", None, "x"), (3, "q", "", "x"), (1, "q", "a", "other column")]
    frame = lambda r: spark.createDataFrame(r, "id int, question string, answer string, more string")
    by, path = ("id", "question", "answer"), str(tmp_path / "kept")
    first = resume.resumed(spark, path, frame(rows), by, score)
    assert first.count() == 4 and len(ran[0]) == 3
    changed = [*rows[:1], (2, "q", "now", "x"), (4, "q", "new", "x")]
    out = resume.resumed(spark, path, frame(changed), by, score)
    assert ran[1] == [(2, "now"), (4, "new")]
    assert {(r["id"], r["score"]) for r in out.collect()} == {(1, 1), (2, 3), (4, 3)}
    resume.resumed(spark, path, frame(changed), by, score)
    assert ran[2] == [] and resume.folded(out, ["question"]).first()["total"] == 7


def test_errors_scan_once_and_tell_unknown_places_apart(spark):
    plan = experiments.error_summary(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    rows = spark.createDataFrame([(None, "PERSON", 0, 5, "A B", 0.9, "a"), (1, "PERSON", 0, 5, "A B", 0.9, "a")], SPAN)
    assert sorted((r["error"], r["category"]) for r in experiments.errors(rows, rows).collect()) == [("FN", "FN_PERSON_SIMPLE_SIMPLE"), ("FP", "FP_PERSON_HIGH")]


def test_measures_by_group_are_those_of_all_pairs(spark):
    members = spark.createDataFrame([(k, "abc"[k % 3] if k < 30 else None if k == 30 else "d", 1 + k % 2) for k in range(32)], "id long, group string, grade int")
    queries = members.where("id % 4 = 0 or id > 29").selectExpr("id as query_id", "group")
    hits = spark.createDataFrame([(q, r, (q * 7 + r * 5) % 32) for q in range(32) for r in range(1, 7)], "query_id long, rank int, id long").where("id <> query_id")
    relevant = queries.join(members, "group").where("query_id <> id").select("query_id", "id", "grade")
    told = lambda df: sorted((r["query_id"], r["n_relevant"], *(round(r[c], 9) for c in ("recall", "reciprocal_rank", "gain"))) for r in df.collect())
    out = relevance.measures_by_group(hits, members, queries, 4)
    assert told(out) == told(relevance.measures(hits, relevant, 4)) and len(told(out)) == 8
