"""Encoders by batch, paged search, and accuracy by category in their defined cases."""

import numpy as np
from pyspark.sql import functions as F

from textloom.functions import embed, exams, vectors
from textloom.functions.batches import BATCH
from textloom.plans import ranking


def test_hashed():
    a, b, c = embed.hashed(["The cat the", "cat THE the", ""])
    assert (a == b).all() and np.abs(a).sum() == 3 and not c.any()


def test_texts_are_encoded_once_for_all_blocks(spark, monkeypatch):
    """The encoder runs where texts are written; blocks of queries read vectors."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    plan = ranking.passage_page(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_encoder_sees_whole_texts_in_batches(spark):
    def sizes():
        return lambda texts: np.array([[len(t), len(texts)] for t in texts], float)

    texts = ["x" * n for n in (5, 100_000, 1)] + [None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    got = [r["v"] for r in rows.select("k", embed.embedded(F.col("t"), sizes, 2, "q: ").alias("v")).orderBy("k").collect()]
    assert [v and v[0] for v in got] == [8.0, 100_003.0, 4.0, None, 3.0] and all(v[1] == 2 for v in got if v)


def test_pages_join_to_one_ranking(spark):
    rows = spark.createDataFrame([(k, f"w{k % 3} w{k % 5} all") for k in range(30)], "vec_id long, t string").select("vec_id", embed.embedded(F.col("t")).alias("v"))
    asked = rows.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    whole = sorted(map(tuple, embed.page(rows, asked, 1, 12).collect()))
    assert sorted(tuple(r) for n in (1, 2, 3) for r in embed.page(rows, asked, n, 4).collect()) == whole and len(whole) == 36
    assert embed.page(rows, asked, 9, 4).count() == 0


def test_category_accuracy(spark):
    answers = spark.createDataFrame([("law", True), ("law", False), ("art", None), (None, True), ("new", True)], "subject string, right boolean")
    mapping = spark.createDataFrame([("law", "social", 0), ("law", "local", 1), ("art", "arts", 0), ("art", None, 5), (None, "arts", 0)], "subject string, category string, place int")
    got = {(r["level"], r["category"], r["subject"]): (r["n"], r["n_right"], r["accuracy"]) for r in exams.category_accuracy(answers, mapping).collect()}
    assert got == {
        ("subject", "local", "law"): (2, 1, 0.5), ("subject", "arts", "art"): (1, 0, 0.0), ("subject", "arts", None): (1, 1, 1.0), ("subject", "other", "new"): (1, 1, 1.0),
        ("category", "local", None): (2, 1, 0.5), ("category", "arts", None): (2, 1, 0.5), ("category", "other", None): (1, 1, 1.0),
        ("all", None, None): (5, 3, 0.6),
    }


def test_no_answers(spark):
    answers = spark.createDataFrame([], "subject string, right boolean")
    assert exams.category_accuracy(answers, spark.createDataFrame([], "subject string, category string, place int")).count() == 0


def test_texts_go_to_the_encoder_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    ranking.text_vectors(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(key)) == BATCH


def test_a_worker_holds_few_long_texts_at_once(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    ranking.text_vectors(spark, "/root/testdata/sf0.001")
    texts = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("word "), 200_000).alias("t"))
    held = lambda: lambda texts: np.full((len(texts), 1), float(sum(map(len, texts))))
    got = [r["v"][0] for r in texts.select(embed.embedded(F.col("t"), held, batch=1000).alias("v")).collect()]
    assert len(got) == 24 and max(got) <= BATCH + 1_000_000  # a limit is met by the text that passes it


def test_texts_are_encoded_once(spark):
    plan = ranking.text_vectors(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1


def test_words_are_looked_up_once_a_call(monkeypatch):
    """words stay in Arrow; letters beyond ASCII part words, whatever their bytes."""
    asked = []

    class Places(dict):
        def __getitem__(self, word):
            asked.append(word)
            return 2 * (word == b"b1") + (word == b"c")

    monkeypatch.setattr(embed, "_PLACES", Places())
    got = embed.hashed(["A b1 a", "", "caéa\u0130A\ud800c", "b1\x00B1_\u212a-"])
    assert sorted(asked) == [b"a", b"b1", b"c", b"ca"]
    assert got[:, :2].tolist() == [[2, 1], [0, 0], [2, 0], [0, 2]] and not got[:, 2:].any()
    assert embed.hashed([]).shape == (0, embed.DIMS)
