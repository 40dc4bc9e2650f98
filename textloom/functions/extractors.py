"""Extractors of spans by name, several at once, and the merge of what they find.

An extractor is a function of a text column to spans.  The registry holds its confidence and whether
it can run here; those that can't are passed over.  ``extracted`` puts the spans of several in one
array, each with its source; ``preferred`` keeps of overlapping spans the one that is preferred.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import spans

FOUND = "struct<entity_type:string,start:int,stop:int,entity_value:string,confidence:double,source:string>"


@dataclass(frozen=True)
class Extractor:
    """``extract`` gives an array of spans of a text; its spans have ``confidence``, unless it is None and they have their own."""

    name: str
    extract: Callable[[Column], Column]
    confidence: float | None = None
    available: Callable[[], bool] = lambda: True


REGISTRY: dict[str, Extractor] = {}


def register(extractor: Extractor) -> Extractor:
    REGISTRY[extractor.name] = extractor
    return extractor


def available(names: Sequence[str] | None = None) -> list[Extractor]:
    """Registered extractors that can run, in the order asked for; an unknown name is an error."""
    unknown = [n for n in names or () if n not in REGISTRY]
    if unknown:
        raise KeyError(f"no extractor {', '.join(unknown)}; there are {', '.join(REGISTRY)}")
    return [e for e in (REGISTRY[n] for n in names or REGISTRY) if e.available()]


def extracted(text: Column, names: Sequence[str] | None = None) -> Column:
    """Spans of all these extractors with their source; empty for a null text."""

    def one(e: Extractor) -> Column:
        def span(s: Column) -> Column:
            confidence = F.lit(float(e.confidence)) if e.confidence is not None else s["confidence"]
            return F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["stop"].alias("stop"), s["entity_value"].alias("entity_value"), confidence.alias("confidence"), F.lit(e.name).alias("source"))

        return F.coalesce(F.transform(e.extract(text), span), F.array().cast(f"array<{FOUND}>"))

    running = available(names)
    return F.concat(*map(one, running)) if running else F.array().cast(f"array<{FOUND}>")


def preferred(found: Column, prefer: str = "longer", limit: float = 0.5) -> Column:
    """Spans merged in order of start, falling confidence, stop and source.

    Each meets the first kept span that it overlaps by more than ``limit`` of the shorter.  At the same place the
    more confident stays.  Else it takes the kept one's place if it is ``longer``, has
    ``higher_confidence``, or, with the name of an extractor, is of that source and the kept one isn't.
    """
    key = lambda s: F.struct(s["start"].alias("a"), (-s["confidence"]).alias("b"), s["stop"].alias("c"), s["source"].alias("d"), s["entity_type"].alias("e"), s.alias("s"))
    ordered = F.transform(F.array_sort(F.transform(found, key)), lambda x: x["s"])

    def better(new: Column, old: Column) -> Column:
        surer = new["confidence"] > old["confidence"]
        if prefer == "longer":
            other = (new["stop"] - new["start"]) > (old["stop"] - old["start"])
        elif prefer == "higher_confidence":
            other = surer
        else:
            other = (new["source"] == prefer) & (old["source"] != prefer)
        return F.when((new["start"] == old["start"]) & (new["stop"] == old["stop"]), surer).otherwise(other)

    def step(kept: Column, s: Column) -> Column:
        at = F.array_position(F.transform(kept, lambda k: spans.overlap(k, s) > limit), F.lit(True)) - 1
        swapped = F.transform(kept, lambda k, i: F.when((i == at) & better(s, k), s).otherwise(k))
        return F.when(at < 0, F.concat(kept, F.array(s))).otherwise(swapped)

    return F.aggregate(ordered, F.array().cast(f"array<{FOUND}>"), step)


# Confidences of the kinds of extractors.
register(Extractor("patterns", spans.find_all, 0.9))
register(Extractor("checked", lambda t: F.filter(spans.find(t, spans.PATTERNS["CREDIT_CARD"], "CREDIT_CARD"), lambda s: spans.luhn(s["entity_value"])), 0.95))
register(Extractor("digits", lambda t: spans.find(t, r"\d[\d .()-]{5,}\d", "NUMBER"), 0.6))
