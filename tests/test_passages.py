import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import passages
from textloom.functions.batches import BATCH
from textloom.functions.chunks import recursive_chunks
from textloom.plans import passages as plans


def text_of(seed, n=900):
    pick = random.Random(seed)
    words = ("Ann", "Bo", "saw", "it", "today", "x@y.org", "4111 1111 1111 1111", "naïve", "𝄞")
    return "".join(pick.choice(words) + pick.choice((" ", " ", " ", ". ", "!\n", "\n\n", "\n \n", "? ")) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_sized_chunks_cover_the_text_and_stop_at_its_end(seed):
    text = text_of(seed)
    chunks = list(passages.by_size(text, 200, 30))
    assert all(text[a:b] == c for a, b, c in chunks) and chunks[0][0] == 0 and chunks[-1][1] == len(text)
    assert all(b - 30 == a2 for (_, b, _), (a2, _, _) in zip(chunks, chunks[1:], strict=False))
    assert all(len(c) <= 200 + passages.AROUND for *_, c in chunks) and sum(b == len(text) for _, b, _ in chunks) == 1


def test_safe_end():
    assert passages.safe_end("a" * 60 + ". " + "b" * 60, 70) == 62
    assert passages.safe_end("a" * 60 + " " + "b" * 60, 70) == 61
    assert passages.safe_end("a" * 60 + "@" + "b" * 80 + ".org,", 70) == 145
    assert passages.safe_end("中" * 300, 70) == 70


@pytest.mark.parametrize("seed", range(6))
def test_sentences_and_paragraphs_keep_places(seed):
    text = text_of(seed)
    for way in (passages.by_sentence, passages.by_paragraph):
        chunks = list(way(text, 200, 30))
        assert all(len(c) <= 200 + 31 + passages.AROUND for *_, c in chunks)
        assert all(text[a:b].split()[0] in c and c.endswith(text[a:b].split()[-1]) for a, b, c in chunks)
        said = "".join("".join(text[a:b].split()) for a, b, _ in chunks)
        if way is passages.by_sentence:
            assert said == "".join(text.split())


def test_ways_and_empty(spark):
    long = "Ab cd. " * 400
    texts = [None, "", " \n ", "short", long, "\n\n".join(["Ab cd."] * 600), "x" * 5000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", passages.chunked(F.col("text")).alias("c")).collect()
    n = {r["k"]: r["c"] for r in rows}
    assert not n[0] and not n[1] and not n[2] and [x["chunk"] for x in n[3]] == ["short"]
    assert passages.choice(long) == "sentence" and passages.choice(texts[5]) == "paragraph" and passages.choice(texts[6]) == "size"
    assert all(len(n[k]) > 1 for k in (4, 5, 6)) and n[6][-1]["stop"] == 5000
    with pytest.raises(ValueError):
        passages.chunked(F.col("text"), "other")


@pytest.mark.parametrize("prefer", [False, True])
def test_merge_prefers_what_is_not_repeated(spark, prefer):
    kind = "array<struct<entity_type:string,start:int,stop:int,entity_value:string,confidence:double,repeated:boolean>>"
    found = [("A", 0, 10, "a", 0.9, True), ("A", 0, 9, "b", 0.5, not prefer), ("B", 20, 25, "c", 0.5, False), ("B", 24, 30, "d", 0.5, False)]
    got = spark.createDataFrame([(found,)], f"x {kind}").select(passages.merge_chunks(F.col("x")).alias("m")).first()["m"]
    assert [s["entity_value"] for s in got] == [["a", "c", "d"], ["b", "c", "d"]][prefer]


def plain_recursive(text, size, separators):
    """Cut at the coarsest separator, pieces that are still too long at the next, then neighbours joined while they fit."""
    if len(text) <= size:
        return [text]
    s = next((x for x in separators if not x or x in text), "")
    if not s:
        return [text[i : i + size] for i in range(0, len(text), size)]
    return [p for part in text.split(s) for p in plain_recursive(part, size, separators[separators.index(s) + 1 :])]


@pytest.mark.parametrize("seed", range(6))
def test_recursive_chunks_against_a_plain_version(seed):
    text = text_of(seed)
    got = recursive_chunks(text, 120)
    assert all(0 < len(c) <= 120 for c in got)
    assert "".join("".join(got).split()) == "".join(text.split())
    plain = [p.strip() for p in plain_recursive(text, 120, ("\n\n", "\n", " ", ""))]
    at = 0  # every chunk is a run of the plain pieces
    for c in got:
        inked, run = "".join(c.split()), ""
        while len(run) < len(inked):
            run += "".join(plain[at].split())
            at += 1
        assert run == inked


@pytest.mark.parametrize("name", ["chunk_sentences", "chunk_sized", "chunk_paragraphs", "chunked_spans", "chunk_recursive"])
def test_texts_go_to_python_in_small_batches(spark, name):
    """A batch is bounded in bytes, so that a worker's memory doesn't grow with the rows of a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    getattr(plans, name)(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(key)) == BATCH
