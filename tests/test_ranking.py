"""Sentence ranks against a plain PageRank, the answer model against a plain run, markdown of nested blocks."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from textloom.functions import sentences
from textloom.functions.markdown import markdown, to_markdown
from textloom.models import preference
from textloom.plans import ranking
from textloom.plans.generate import ranked_words


def plain_scores(texts):
    n = len(texts)

    def similar(a, b):
        below = math.log(max(len(a), 1)) + math.log(max(len(b), 1))
        return len(set(a) & set(b)) / below if below > 1e-12 else 0.0

    s = [[similar(a, b) for b in texts] for a in texts]
    x = [1 / n] * n
    for _ in range(sentences.ROUNDS):
        y = [(1 - sentences.DAMPING) / n] * n
        for a in range(n):
            total = sum(s[a])
            for b in range(n):
                y[b] += sentences.DAMPING * x[a] * (s[a][b] / total if total > 0 else 1 / n)
        x = y
    return x


def test_scores_are_pagerank():
    rng = random.Random(4)
    for n in (1, 2, 7, 40):
        texts = [[rng.choice("abcdefghijklmnop") for _ in range(rng.choice((0, 1, 1, 3, 8)))] for _ in range(n)]
        got = sentences.scores(texts)
        assert np.allclose(got, plain_scores(texts)) and abs(got.sum() - 1) < 1e-9
    assert len(sentences.scores([])) == 0 and np.allclose(sentences.scores([["a"], ["b"]]), [0.5, 0.5])


def test_abstracts(spark):
    long = "The cat sat on the mat. The cat ate. A dog ran far away! The cat sat on a mat with the dog?\nNo. 日本語の文です。"
    rows = spark.createDataFrame([(1, long), (2, "no. end. we. ... so much"), (3, ""), (4, None), (5, "é" * 30), (6, "ab. cd. ef. gh. ij")], "doc_id long, text string")
    got = {r["doc_id"]: r["abstract"] for r in sentences.abstracts(rows).collect()}
    assert got[1] == "The cat sat on a mat with the dog" and got[2] == "so much" and got[3] == "" and got[4] is None and got[5] == "é" * 30 and got[6] == "ab. cd. ef"
    best = sentences.key_sentences(rows).where("doc_id = 1").orderBy("rank").collect()
    assert [r["rank"] for r in best] == [1, 2, 3] and best[0]["score"] >= best[1]["score"] >= best[2]["score"] > 0
    assert sentences.key_sentences(rows.limit(0)).count() == 0


def test_halves_round_up(spark):
    """128 sentences that share nothing: each has 1/128, which SQL rounds to 0.007813."""
    rows = spark.createDataFrame([(1, ". ".join(f"only{k:03d}" for k in range(128)))], "doc_id long, text string")
    assert [(r["rank"], r["position"], r["score"]) for r in sentences.key_sentences(rows).collect()] == [(1, 0, 0.007813), (2, 1, 0.007813), (3, 2, 0.007813)]
    assert sentences.rounded([0.0078125, 0.0078124]).tolist() == [0.007813, 0.007812]


def test_sums_run_as_in_sql(spark):
    """640 sentences that share nothing: 1/640 ends in a half as well, and adding it up leaves less than that."""
    rows = spark.createDataFrame([(1, ". ".join(f"only{k:03d}" for k in range(640)))], "doc_id long, text string")
    assert [r["score"] for r in sentences.key_sentences(rows).collect()] == [0.001562] * 3


def test_scores_agree_with_and_without_the_graph(monkeypatch):
    rng = random.Random(5)
    texts = [[rng.choice("abcdefghijklmnop") for _ in range(rng.choice((0, 1, 1, 3, 8)))] for _ in range(60)]
    laid = sentences.scores(texts)
    monkeypatch.setattr(sentences, "_LAID", 0)
    assert np.allclose(laid, sentences.scores(texts), atol=1e-12)


def test_words_in_a_ring_round_halves_up():
    ring = [f"w{k:03d}" for k in range(128)]
    assert ranked_words([*ring, ring[0]], 2) == [("w000", 0.007813), ("w001", 0.007813)]


def test_abstracts_move_no_text(spark):
    """Each text's abstract is made where the text is: no exchange, and repeated keys keep their rows."""
    rows = spark.createDataFrame([(1, "The first one. x"), (1, None), (2, "a")], "doc_id long, text string")
    out = sentences.abstracts(rows)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["doc_id"], r["abstract"] or "") for r in out.collect()) == [(1, ""), (1, "The first one"), (2, "a")]


STOP: set[str] = set()


def plain_accuracy(train, test):
    """Subgradient descent on the hinge loss over the same TF-IDF features, without hashing."""
    ids, df = {}, {}

    def words(pair, side):
        text = f"{pair['question'] or ''} {pair[side] or ''}".lower()
        return [w for w in re.findall(r"[^\W_]+", text) if w not in STOP]

    for p in train:
        for w in set(words(p, "answer_1")):
            df[w] = df.get(w, 0) + 1

    def vector(pair):
        x = {}
        for side in ("answer_1", "answer_2"):
            own = {}
            for w in words(pair, side):
                own[w] = own.get(w, 0) + math.log((len(train) + 1) / (df.get(w, 0) + 1))
            size = math.sqrt(sum(v * v for v in own.values())) or 1
            for w, v in own.items():
                x[ids.setdefault((side, w), len(ids))] = v / size
        return x

    rows = [(vector(p), 2 * p["label"] - 1) for p in train]
    weights, bias, scale = {}, 0.0, 1.0
    for step in range(1, 13):
        for x, y in rows:
            scale *= 1 - preference.PENALTY / step
            if y * (scale * sum(weights.get(k, 0) * v for k, v in x.items()) + bias) < 1:
                for k, v in x.items():
                    weights[k] = weights.get(k, 0) + y * v / step / scale
                bias += y * 0.1 / step
    hit = [(scale * sum(weights.get(k, 0) * v for k, v in vector(p).items()) + bias > 0) == (p["label"] == 1) for p in test]
    return sum(hit) / len(hit)


def test_answer_model(spark, tmp_path):
    global STOP
    STOP = set(StopWordsRemover.loadDefaultStopWords("english"))
    pairs = ranking.answer_pairs(spark, "/root/testdata/sf0.1").cache()
    held = preference.held_out(F.col("pair"))
    train, test = pairs.where(~held), pairs.where(held)
    assert train.count() > 100 and test.count() > 15
    model = preference.train(train)
    out = preference.compare(test, model)
    accuracy = out.where((F.col("label") == 1) == (F.col("better") == 1)).count() / out.count()
    plain = plain_accuracy(train.collect(), test.collect())
    assert accuracy >= 0.75 and accuracy >= plain - 0.1, (accuracy, plain)
    preference.save(model, str(tmp_path / "model"))
    again = preference.compare(test, preference.load(str(tmp_path / "model")))
    assert sorted(out.select("pair", "margin", "better").collect()) == sorted(again.select("pair", "margin", "better").collect())
    odd = spark.createDataFrame([(None, None, "x", 1), ("q", "", None, None)], "question string, answer_1 string, answer_2 string, label int")
    assert preference.compare(odd, model).count() == 2
    pairs.unpersist()


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<h1>A &amp; <em>b</em></h1><p>One<br>two &#8217; &#x41; &copy; *x*", "# A & *b*\n\nOne\ntwo ’ A © \\*x\\*"),
        ("<ul><li>a<ul><li>b<li>c</ul><li><p>d</p><p>e</p></ul>", "- a\n  - b\n  - c\n- d\n  e"),
        ("<ol><li>1<ol><li>2</li></ol></li><li>3</ol>", "1. 1\n   1. 2\n2. 3"),
        ('<div class="top-ad x"><div>in</div>ad</div>kept<div id="ads">n</div><p class="shadow">s</p>', "kept\n\ns"),
        ("<blockquote>q<p>r</p><ul><li>i</ul></blockquote>", "> q\n>\n> r\n>\n> - i"),
        ("<pre><code>x = *1\n  y &lt; 2</code></pre><code>z*</code>", "```\nx = *1\n  y < 2\n```\n\n`z*`"),
        ("<a href='/u v'>li<b>nk</b></a> <a>bare</a> <img src=a.png alt=al><hr>end", "[li **nk**](/u%20v) bare ![al](a.png)\n\n---\n\nend"),
        ("<table><thead><tr><th>h<th>i</thead><tr><td>1|2<td>3</table>", "| h | i |\n| --- | --- |\n| 1\\|2 | 3 |"),
        ("<p><b>bold <p>next</b> <i>it</i>, <del>no</del>", "**bold**\n\nnext *it*, ~~no~~"),
        ("<script>var t='</p>'</script><style>p{}</style><nav><a href=x>n</a></nav><!-- c -->a<p></p><span>b</span>", "a\n\nb"),
        ("plain &amp; text\n\n with  blanks", "plain & text with blanks"),
        ("", ""),
        ("</div></p><div><section>x", "x"),
        (None, None),
    ],
)
def test_markdown(html, expected):
    assert to_markdown(html) == expected


def test_deep_pages_and_whole_pages(spark):
    assert to_markdown("<div>" * 500 + "x" + "</div>" * 500) == "x"
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["markdown"] for r in markdown(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]] == to_markdown(r["html"]) and "<" not in got[r["page_id"]].replace("\\<", "")
