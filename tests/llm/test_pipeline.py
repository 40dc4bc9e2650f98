"""Every stage of the pipeline on its predecessor's rows, and the whole run, against plain versions."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, jaccard
from textloom.llm import perplexity, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig long, component long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    words = "time people water house small river green light stone paper market garden winter letter music".split()
    rows = []
    for k in range(60):
        own = [words[(k * 7 + j * j + j * (k % 5)) % len(words)] + str((k * j) % 37) for j in range(40)]
        rows.append((k, " ".join(own), "en" if k % 3 else None, ["a", "b", None][k % 3]))
    rows += [(60 + k, rows[k][1], "en", "a") for k in range(5)]  # exact copies
    rows += [(65 + k, rows[10 + k][1] + " end", "en", "b") for k in range(5)]  # near copies
    rows += [(70, None, "en", "a"), (71, "", "en", "a"), (72, "too short", "en", "b"), (73, "again and again " * 30, "en", "a"), (None, rows[20][1] + " more of it", "en", "b")]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or ""), 1, 2) for r in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, 0) for k in range(40)] + [(73, 0, 0), (72, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_and_run(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = (before, docs)
        if k < 4:
            assert docs.columns == before.columns

    def rows(df):
        return sorted(map(str, df.collect()))

    before, after = seen["quality classifier"]
    kept = perplexity.classify(before, spark.read.parquet(f"{folder}/labels.parquet")).where("kept").select("doc_id")
    assert rows(after.select("doc_id")) == rows(kept)
    assert {r["doc_id"] for r in after.collect()}.isdisjoint({70, 71}) and after.where("doc_id < 40").count() == 40  # trusted ones stay

    before, after = seen["quality rules"]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = rules.judge_quality(before, rules.learn_rules(before, labels)).where("kept").select("doc_id")
    assert rows(after.select("doc_id")) == rows(judged)
    for r in after.collect():
        words = WORD.findall(r["text"])
        grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        assert len(words) >= 10 and sum(n for n in grams.values() if n > 1) * 100 <= 20 * len(words) * 5

    before, after = seen["n-gram Jaccard join"]
    groups = {x[2] for x in jaccard([tuple(r) for r in before.collect()])}
    assert sorted(str(r["doc_id"]) for r in after.collect()) == sorted(groups)

    before, after = seen["source mix"]

    def sizes(df):
        out = collections.Counter()
        for r in df.collect():
            out[r["source"]] += len(WORD.findall(r["text"] or ""))
        return out

    had, took = sizes(before), sizes(after)
    assert all(took[s] <= 2 * had[s] for s in had) and abs(sum(took.values()) - min(1.5 * sum(had.values()), 2 * sum(had.values()))) <= len(had)

    before, after = seen["packing"]
    assert after.agg(F.sum("length")).first()[0] == after.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert after.where("start = 0").count() == before.count()
    result = corpus_pipeline.run(spark, folder)
    assert result.columns == after.columns and result.agg(F.sum("length")).first() == after.agg(F.sum("length")).first()


def test_run_of_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
