import numpy as np
import re

from pyspark.sql import functions as F

from textloom.functions import fakes, vectors
from textloom.plans import generate
from textloom.plans.generate import ranked_words


def test_fakes(spark):
    rows = spark.createDataFrame([("s", "Ann@Corp.org", "4111-1111 (22)"), ("s", "a@gmail.com", ""), ("t", "none", "x")], "seed string, mail string, number string")
    got = rows.select(fakes.email(F.col("seed"), F.col("mail")).alias("m"), fakes.like(F.col("seed"), F.col("number")).alias("n")).collect()
    assert got[0]["m"].endswith("@Corp.org") and got[1]["m"].endswith("@example.com") and got[2]["m"].endswith("@example.com")
    assert got[0]["m"].split("@")[0] == got[1]["m"].split("@")[0] != got[2]["m"].split("@")[0]
    assert [c for c in got[0]["n"] if not c.isdigit()] == ["-", " ", "(", ")"] and len(got[0]["n"]) == 14 and got[1]["n"] == "" and got[2]["n"] == "x"


def test_formats(spark):
    n = spark.createDataFrame([("378282246310005",)], "n string")
    got = n.select(*[f(F.col("n")).alias(k) for k, f in fakes.FORMATS.items()]).first().asDict()
    assert got["space_4"] == "3782 8224 6310 005" and got["last_4_only"] == "**** **** **** 005" and got["first_6_last_4"] == "378282*****0005"
    assert got["amex_format"] == "3782 822463 10005" and got["diners_format"] == got["space_4"]


def test_ranked_words_against_dense_pagerank():
    pick = np.random.default_rng(7)
    words = [f"w{k}" for k in pick.zipf(1.6, 300) % 40]
    names = sorted(set(words))
    at = {w: k for k, w in enumerate(names)}
    graph = np.zeros((len(names), len(names)))
    for a, b in zip(words, words[1:], strict=False):
        graph[at[a], at[b]] = graph[at[b], at[a]] = 1
    step = graph / graph.sum(1, keepdims=True)
    x = np.full(len(names), 1 / len(names))
    for _ in range(200):
        x = 0.15 / len(names) + 0.85 * x @ step
    got = ranked_words(words, 100)
    assert len(got) == len(names) and all(abs(s - x[at[w]]) < 2e-3 for w, s in got) and abs(sum(s for _, s in got) - 1) < 1e-3
    assert ranked_words([], 5) == [] and ranked_words(["one"], 5) == []


def test_search(spark):
    rows = spark.createDataFrame([(k, [float(k), 1.0], "a" if k % 2 else "b") for k in range(8)] + [(9, [0.0, 0.0], "a")], "vec_id long, v array<double>, kind string")
    asked = rows.where("vec_id in (4, 9)").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "kind")

    def ids(*args, **kw):
        return [(r["query_id"], r["vec_id"]) for r in vectors.search(rows, asked, 2, *args, **kw).orderBy("query_id", "rank").collect()]

    assert ids() == [(4, 3), (4, 5), (9, 0), (9, 1)]
    assert ids(scope="kind") == [(4, 2), (4, 6), (9, 1), (9, 3)] and ids(earlier=True) == [(4, 3), (4, 2), (9, 0), (9, 1)]
    assert ids("cosine") == [(4, 5), (4, 3)]  # a vector without length is like none
    parsed = spark.createDataFrame([("1, 2.5,x",)], "t string").select(vectors.parsed(F.col("t")).alias("v")).first()["v"]
    assert parsed == [1.0, 2.5, None]


def test_words_are_counted_where_their_text_comes_to(spark):
    plan = generate.tfidf_terms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id#" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L, word#", plan)
