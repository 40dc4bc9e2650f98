"""Sentences of a text and their rank in the graph of shared words.

Two sentences are as similar as the words that they share over the logarithms of their lengths; each
is linked with itself as well.  A sentence's score is its PageRank over these weights; one that
shares nothing passes its weight to all.  The graph of a text of many sentences isn't laid out: what
flows from sentence to sentence goes by way of the words, once for each length of sentences, so the
work grows with a text's words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.batches import small_batches

DAMPING, REST, ROUNDS, SHORTEST, FALLBACK = 0.85, 0.15, 30, 6, 10
#: Sentences whose graph is laid out as a matrix.
_LAID = 1024
# What ends a sentence.
ENDS = r"[.!?;。！？；…\n]+"
WORD_GAPS = r"[^\p{L}\p{N}]+"


def sentences(text: Column) -> Column:
    """Sentences in order, without white space at their ends; empty ones go."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ENDS), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: s != "")


def words(sentence: Column) -> Column:
    return F.filter(F.split(F.lower(sentence), WORD_GAPS), lambda w: w != "")


def scores(texts: Sequence[Sequence[str]]) -> np.ndarray:
    """Each sentence's score, given its words; they add up to 1."""
    flat = np.array([w for t in texts for w in t], object).astype(str)
    return _scores(np.array([len(t) for t in texts], np.int64), np.unique(flat, return_inverse=True)[1])


def _scores(size: np.ndarray, word: np.ndarray) -> np.ndarray:
    """``scores`` of sentences of ``size`` words, given a number for each word, sentence by sentence."""
    n = len(size)
    if not n:
        return np.zeros(0)
    names, word = np.unique(word, return_inverse=True)
    many = len(names)
    pair = np.unique(np.repeat(np.arange(n), size) * max(many, 1) + word)
    at, word = pair // max(many, 1), pair % max(many, 1)
    laid = n <= _LAID and n * many <= _LAID**2
    return _from_matrix(size, at, word, many) if laid else _by_words(size, at, word, many)


def _from_matrix(size: np.ndarray, at: np.ndarray, word: np.ndarray, many: int) -> np.ndarray:
    """Scores by the graph laid out; products are added sentence by sentence, as SQL adds them."""
    n = len(size)
    holds = np.zeros((n, many), np.float32)
    holds[at, word] = 1
    logs = np.log(np.maximum(size, 1))
    both = logs[:, None] + logs[None, :]
    weight = np.divide((holds @ holds.T).astype(float), both, out=np.zeros_like(both), where=both > 1e-12)
    degree = weight.sum(axis=0)
    share = np.divide(weight, degree[:, None], out=np.full_like(weight, 1 / n), where=degree[:, None] > 0)
    x = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        x = REST / n + DAMPING * (x[:, None] * share).sum(axis=0)
    return x


def _by_words(size: np.ndarray, at: np.ndarray, word: np.ndarray, many: int) -> np.ndarray:
    """Scores of many sentences: what flows from one to another goes by way of their words."""
    n = len(size)
    lengths, kind = np.unique(size, return_inverse=True)
    logs = np.log(np.maximum(lengths, 1))
    both = logs[:, None] + logs[None, :]
    over = np.divide(1.0, both, out=np.zeros_like(both), where=both > 1e-12)

    def spread(x: np.ndarray) -> np.ndarray:
        """The similarities times ``x``."""
        by_word = np.bincount(word * len(lengths) + kind[at], weights=x[at], minlength=many * len(lengths)).reshape(many, len(lengths))
        return np.bincount(at, weights=(by_word @ over)[word, kind[at]], minlength=n)

    degree = spread(np.ones(n))
    alone = degree <= 0
    share = np.divide(1.0, degree, out=np.zeros(n), where=~alone)
    x = np.full(n, 1 / n)
    for _ in range(ROUNDS):
        x = REST / n + DAMPING * (spread(x * share) + np.append(0.0, x[alone] / n).cumsum()[-1])
    return x


def rounded(score: np.ndarray) -> np.ndarray:
    """Scores to six places, halves up, as SQL rounds them."""
    return np.floor(np.asarray(score, float) * 1e6 + 0.5) / 1e6


def _split(docs: DataFrame, *kept: Column) -> DataFrame:
    """``kept``, said (the sentences), words (of each) of the texts, in small batches."""
    small_batches(docs.sparkSession)
    rows = docs.select(*kept, sentences(F.col("text")).alias("said"))
    return rows.select("*", F.transform("said", words).alias("words"))


def _best(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, list[int], np.ndarray]]:
    """Of each text of a batch (said, words): where its sentences begin in the batch, its ``k`` best's positions, all scores."""
    own = batch.column("words")
    first, inner = own.offsets.to_numpy().astype(np.int64), own.flatten()
    first = first - first[0]
    edge = inner.offsets.to_numpy().astype(np.int64)
    edge = edge - edge[0]
    word = pc.dictionary_encode(inner.flatten()).indices.to_numpy()  # strings stay in Arrow
    long = pc.utf8_length(batch.column("said").flatten()).to_numpy() >= SHORTEST
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        score = rounded(_scores(np.diff(edge[a : b + 1]), word[edge[a] : edge[b]]))
        order = np.argsort(-score, kind="stable")
        yield a, order[long[a:b][order]][:k].tolist(), score


def key_sentences(docs: DataFrame, k: int = 3, key: str = "doc_id") -> DataFrame:
    """key, rank, position, sentence, score: the ``k`` best sentences of at least six characters of each text, ties to the earlier.

    Scores are rounded to six places, halves up, before they are compared.  Texts without such a sentence give no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, r, p, a + p, score[p]) for i, (a, best, score) in enumerate(_best(batch, k)) for r, p in enumerate(best, 1)]
            of, rank, position, at, score = (np.array(c) for c in zip(*rows, strict=True)) if rows else np.zeros((5, 0), np.int64)
            said = batch.column("said").flatten().take(pa.array(at))
            columns = [batch.column("key").take(pa.array(of)), pa.array(rank.astype(np.int32)), pa.array(position.astype(np.int32)), said, pa.array(score.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "rank", "position", "sentence", "score"])

    rows = _split(docs, F.col(key).alias("key"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(task, f"key {kind}, rank int, position int, sentence string, score double").withColumnRenamed("key", key)


def abstracts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, abstract: a text's best sentence, else its first ten characters; null for a null text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [a + best[0] if best else None for a, best, _ in _best(batch, 1)]
            said = batch.column("said").flatten().take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pc.coalesce(said, batch.column("first"))], ["key", "abstract"])

    rows = _split(docs, F.col(key).alias("key"), F.left("text", F.lit(FALLBACK)).alias("first"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(task, f"key {kind}, abstract string").withColumnRenamed("key", key)
