"""Chunks of a text that keep their true places: by sentences, by paragraphs, by size at safe places, or as the text asks.

A chunk is ``struct<chunk_index, start, stop, chunk>``; ``start`` and ``stop`` are code points of the
part that is new in it (a sentence chunk may begin with words repeated from the one before).  Where
one chunk ends decides where the next begins, so the cutting runs over Arrow batches, in time linear
in a text; null and blank texts have no chunk.  The last chunk ends at the end of the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SIZE, OVERLAP, AROUND = 2000, 100, 50
CHUNK = "struct<chunk_index:int,start:int,stop:int,chunk:string>"
_BLANK = " \t\n\r\f\v"
# Where sentences and paragraphs end, and what cuts should not split.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z])|(?<=[.!?])\s*\n|\n\n+", re.ASCII)
PARAGRAPH_END = re.compile(r"\n\s*\n", re.ASCII)
SAFE_END = re.compile(r"[.!?]\s+", re.ASCII)
WHOLE = tuple(
    re.compile(p, re.ASCII)
    for p in (
        r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
        r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
        r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
        r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    )
)
Piece = tuple[int, int, str]


def trimmed(text: str, boundary: re.Pattern[str]) -> Iterator[tuple[int, str]]:
    """start, piece of what lies between boundaries, without blanks around it."""
    edges = [0, *(x for m in boundary.finditer(text) for x in m.span()), len(text)]
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        piece = text[a:b]
        inner = piece.strip(_BLANK)
        if inner:
            yield a + len(piece) - len(piece.lstrip(_BLANK)), inner


class Whole:
    """What cuts should not split in a text, looked for once and only if it is asked for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: list[tuple[list[int], list[int]]] | None = None

    def end(self, target: int) -> int | None:
        """The end of what a cut at ``target`` would split, of the first kind that has some."""
        if self.found is None:
            places = [[m.span() for m in pattern.finditer(self.text)] for pattern in WHOLE]
            self.found = [([a for a, _ in p], [b for _, b in p]) for p in places]
        for starts, ends in self.found:
            at = bisect_left(starts, target) - 1
            if at >= 0 and target < ends[at]:
                return ends[at]
        return None


def safe_end(text: str, target: int, around: int = AROUND, whole: Whole | None = None) -> int:
    """A place near ``target``: after the first sentence end around it, else after the last space, else after what it would split."""
    first = max(0, target - around)
    window = text[first : target + around]
    sentence = SAFE_END.search(window)
    if sentence:
        return first + sentence.end()
    space = window.rfind(" ")
    if space > 0:
        return first + space + 1
    return (whole or Whole(text)).end(target) or target


def by_size(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[Piece]:
    at, whole = 0, Whole(text)
    while at < len(text):
        end = at + size
        end = len(text) if end >= len(text) else safe_end(text, end, whole=whole)
        yield at, end, text[at:end]
        if end >= len(text):
            return
        at = max(end - overlap, at + 1)


def _tail(chunk: str, overlap: int) -> str:
    """The last words of a chunk, to stand before the next one."""
    tail = chunk[-overlap:] if overlap else ""
    space = tail.find(" ")
    return tail[space + 1 :] + " " if chunk and overlap and space > 0 else tail + " " if tail else ""


def by_sentence(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[Piece]:
    held, start, stop = "", 0, 0
    for at, sentence in trimmed(text, SENTENCE_END):
        if len(held) + len(sentence) + 1 > size:
            if held:
                yield start, stop, held
            held, start = _tail(held, overlap) + sentence, at
        elif held:
            held += " " + sentence
        else:
            held, start = sentence, at
        stop = at + len(sentence)
    if held:
        yield start, stop, held


def by_paragraph(text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[Piece]:
    """Whole paragraphs as long as they fit; one that is too long alone is cut by size."""
    held, start, stop = "", 0, 0
    for at, paragraph in trimmed(text, PARAGRAPH_END):
        if len(held) + len(paragraph) + 2 > size:
            if held:
                yield start, stop, held
            held = ""
            if len(paragraph) > size:
                yield from ((at + a, at + b, c) for a, b, c in by_size(paragraph, size, overlap))
                continue
        held, start = (f"{held}\n\n{paragraph}", start) if held else (paragraph, at)
        stop = at + len(paragraph)
    if held:
        yield start, stop, held


def choice(text: str, size: int = SIZE) -> str:
    """paragraph if paragraphs are short on average, else sentence if sentences are, else size."""
    if len(text) / (len(PARAGRAPH_END.findall(text)) + 1) < 0.8 * size:
        return "paragraph"
    return "sentence" if len(text) / (len(SENTENCE_END.findall(text)) + 1) < 0.5 * size else "size"


#: How to cut; ``semantic`` is by paragraphs.
WAYS: dict[str, Callable[..., Iterator[Piece]]] = {"size": by_size, "sentence": by_sentence, "paragraph": by_paragraph, "semantic": by_paragraph}


def cut(text: str | None, way: str = "adaptive", size: int = SIZE, overlap: int = OVERLAP) -> list[Piece]:
    """A text that fits stays one chunk, whatever the way."""
    if not text or not text.strip(_BLANK):
        return []
    if len(text) <= size:
        return [(0, len(text), text)]
    return list(WAYS[choice(text, size) if way == "adaptive" else way](text, size, overlap))


def chunked(text: Column, way: str = "adaptive", size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Array of chunks of ``text``."""
    if way not in {"adaptive", *WAYS}:
        raise ValueError(f"unknown way to chunk: {way}")

    @F.pandas_udf(f"array<{CHUNK}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"chunk_index": k, "start": a, "stop": b, "chunk": c} for k, (a, b, c) in enumerate(cut(t, way, size, overlap))])

    return run(text)


def shifted(found: Column, chunk: Column, overlap: int = OVERLAP) -> Column:
    """Spans of a chunk at their places in the text, with ``repeated``: whether they begin where the chunk repeats its predecessor."""

    def one(s: Column) -> Column:
        early = (chunk["chunk_index"] > 0) & (s["start"] < overlap)
        return F.struct(s["entity_type"].alias("entity_type"), (s["start"] + chunk["start"]).alias("start"), (s["stop"] + chunk["start"]).alias("stop"), s["entity_value"].alias("entity_value"), s["confidence"].alias("confidence"), early.alias("repeated"))

    return F.transform(found, one)


def merge_chunks(found: Column, limit: float = 0.5) -> Column:
    """Spans of all chunks, by start and then the longer: each meets the first kept one that it overlaps by more than ``limit``.

    Of the two the one that isn't ``repeated`` stays, else the more confident, else the longer, in the kept one's place.
    """
    from textloom.functions.spans import overlap

    key = lambda s: F.struct(s["start"].alias("a"), (-s["stop"]).alias("b"), s["repeated"].alias("c"), s["entity_type"].alias("d"), s.alias("s"))
    ordered = F.transform(F.array_sort(F.transform(found, key)), lambda x: x["s"])

    def better(new: Column, old: Column) -> Column:
        longer = (new["stop"] - new["start"]) > (old["stop"] - old["start"])
        return F.when(old["repeated"] != new["repeated"], old["repeated"]).otherwise((new["confidence"] > old["confidence"]) | longer)

    def step(kept: Column, s: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: overlap(k, s) > limit), F.lit(True)) - 1
        swapped = F.transform(kept, lambda k, i: F.when((i == at) & better(s, k), s).otherwise(k))
        return F.when(at < 0, F.concat(kept, F.array(s))).otherwise(swapped)

    kept = "array<struct<entity_type:string,start:int,stop:int,entity_value:string,confidence:double,repeated:boolean>>"
    return F.aggregate(ordered, F.array().cast(kept), step)
