"""Recursive chunks: a text is cut at the coarsest separator that makes pieces small enough."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# From coarse to fine; the last cuts anywhere.
SEPARATORS = ("\n\n", "\n", " ", "")


def recursive_chunks(text: str | None, size: int = 500, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Stripped chunks of at most ``size`` code points that hold all of ``text`` but blanks at cuts.

    Neighbouring pieces share a chunk as long as they fit.  Null and blank texts have no chunk.
    """
    out: list[str] = []
    held = ""
    todo = [(text or "", 0, "")]  # text, first separator to try, what stood before it
    while todo:
        piece, at, before = todo.pop()
        together = held + before + piece if held else piece
        if len(together) <= size:
            held = together
            continue
        if len(piece) <= size:
            out.append(held)
            held = piece
            continue
        while separators[at] and separators[at] not in piece:
            at += 1
        s = separators[at]
        parts = piece.split(s) if s else [piece[i : i + size] for i in range(0, len(piece), size)]
        todo += [(p, at + 1 if s else at, s if k else before) for k, p in reversed(list(enumerate(parts)))]
    return [c for c in (x.strip() for x in [*out, held]) if c]


def chunks(text: Column, size: int = 500) -> Column:
    """Array of ``recursive_chunks``."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_chunks(t, size))

    return cut(text)
