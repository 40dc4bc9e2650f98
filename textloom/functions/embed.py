"""Vectors of texts by an encoder that takes lists of texts, and a hashing encoder that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import vectors

#: What stands for each byte of a text: A-Z lower-cased, a space for what belongs to no word (all bytes of letters beyond ASCII too).
_BYTES = bytes(ord(c.lower()) if (c := chr(k)).isascii() and c.isalnum() else 32 for k in range(256))
#: Dimensions of ``hashed``: two hexadecimal digits of a word's digest.
DIMS = 256
#: Words whose places a worker remembers.
_KNOWN = 1 << 19


class _Places(dict[bytes, int]):
    """Twice a word's place, and one if it counts down."""

    def __missing__(self, word: bytes) -> int:
        digest = hashlib.md5(word).hexdigest()
        if len(self) >= _KNOWN:
            self.clear()
        self[word] = place = int(digest[:2], 16) * 2 + (digest[2] >= "8")
        return place


_PLACES = _Places()


def hashed(texts: list[str]) -> np.ndarray:
    """Signed counts of a text's words (a-z and 0-9, A-Z lower-cased) in ``DIMS`` places: the digest's first two digits name it, the third the sign."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    first = np.cumsum([0, *(len(t) + 1 for t in raw)])[:-1]
    said = np.frombuffer(b" ".join(raw).translate(_BYTES), np.uint8)
    inside = said != 32
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    buffers = [None, pa.py_buffer(np.append(0, np.cumsum(end - begin))), pa.py_buffer(said[inside])]
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), buffers).dictionary_encode()  # words stay in Arrow, each is looked up once
    if not len(words):
        return np.zeros((len(texts), DIMS))
    cuts, known = np.frombuffer(words.dictionary.buffers()[1], np.int64)[: len(words.dictionary) + 1].tolist(), words.dictionary.buffers()[2].to_pybytes()
    place = np.fromiter((_PLACES[known[a:b]] for a, b in pairwise(cuts)), np.int64, len(words.dictionary))
    of = np.searchsorted(first, begin, side="right") - 1
    n = np.bincount(of * (2 * DIMS) + place[words.indices.to_numpy()], minlength=len(texts) * 2 * DIMS).reshape(len(texts), DIMS, 2)
    return (n[:, :, 0] - n[:, :, 1]).astype(float)


def embedded(text: Column, encode: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashed, batch: int = 32, before: str = "") -> Column:
    """Vector of each text by ``encode()``, which is called once a task and returns what encodes ``batch`` texts at a time.

    ``before`` is set before each text, for encoders that tell questions from passages so.  Texts go to
    the encoder whole, by length inside an Arrow batch, so that those of one call are alike; null has no vector.
    """

    @F.pandas_udf("array<double>")
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encode()
        for texts in parts:
            out: list[np.ndarray | None] = [None] * len(texts)
            order = sorted((k for k, t in enumerate(texts) if t is not None), key=lambda k: len(texts.iloc[k]))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                for k, v in zip(own, encoder([before + texts.iloc[k] for k in own]), strict=True):
                    out[k] = v
            yield pd.Series(out)

    return each.asNondeterministic()(text)  # else Spark copies it into the filter that it infers from an explode, and encodes twice


def page(rows: DataFrame, queries: DataFrame, number: int, size: int, measure: str = "cosine") -> DataFrame:
    """query_id, rank, vec_id, score of the ``number``-th page (from 1) of ``size`` hits; ranks go on over pages."""
    return vectors.search(rows, queries, number * size, measure).where(F.col("rank") > (number - 1) * size)
