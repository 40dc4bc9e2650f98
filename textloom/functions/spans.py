"""Spans in text: finding, merging, masking and recovering, all as column expressions.

A span is ``struct<entity_type, start, stop, entity_value, confidence>`` with half-open code point
offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Detection patterns, in order of precedence.
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b",
    "CREDIT_CARD": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "SSN": r"\b\d{3}-\d{2}-\d{4}\b",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "URL": r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b(?:[-a-zA-Z0-9()@:%_\+.~#?&/=]*)",
    "DATE": r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b",
    "ADDRESS": r"P\.?O\.?\s*Box\s+\d+",
    "PERSON": r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
}
# All detection patterns with their types, in order of precedence.
ALL = (
    ("EMAIL", PATTERNS["EMAIL"]),
    ("PHONE", PATTERNS["PHONE"]),
    ("CREDIT_CARD", PATTERNS["CREDIT_CARD"]),
    ("CREDIT_CARD", r"\b[0-9]{4}\s[0-9]{4}\s[0-9]{4}\s[0-9]{4}\b"),
    ("CREDIT_CARD", r"\b[0-9]{4}\*{4}\*{4}[0-9]{4}\b"),
    ("SSN", PATTERNS["SSN"]),
    ("IP_ADDRESS", PATTERNS["IP_ADDRESS"]),
    ("URL", PATTERNS["URL"]),
    ("DATE", PATTERNS["DATE"]),
    ("PHONE", r"\b\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b"),
    ("PHONE", r"\b\d{3,4}[-.\s]\d{3,4}[-.\s]\d{4}\b"),
    ("PHONE", r"\(\d{3}\)\s*\d{3}-\d{4}"),
    ("ADDRESS", r"\d+\s+[A-Z][a-z]+\s+(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct)"),
    ("ADDRESS", PATTERNS["ADDRESS"]),
    ("PERSON", PATTERNS["PERSON"]),
)
# How sensitive a type is, 1 to 10; others 5.
SENSITIVITY = {"CREDIT_CARD": 10, "SSN": 10, "PASSWORD": 10, "PHONE": 7, "EMAIL": 6, "PERSON": 5, "ADDRESS": 7, "DATE": 3, "LOCATION": 4, "ORGANIZATION": 3, "IP_ADDRESS": 6, "URL": 4}
SPAN = "struct<entity_type:string,start:int,stop:int,entity_value:string,confidence:double>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find(text: Column, pattern: str, entity_type: str, confidence: float = 0.9) -> Column:
    """All matches of ``pattern``, in order of place; cheap where there is none."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(state: Column, x: Column) -> Column:
        a = state["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        span = F.struct(F.lit(entity_type).alias("entity_type"), a.alias("start"), b.alias("stop"), x["hit"].alias("entity_value"), F.lit(float(confidence)).alias("confidence"))
        return F.struct(b.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step)["spans"]).otherwise(start["spans"])


#: What a text must hold for a pattern to match, where that is quicker to see than the pattern.
_SIGNS = {"EMAIL": "@", "URL": "://", "PERSON": None}


def _may_match(text: Column, kind: str, pattern: str, digits: Column) -> Column:
    """Whether a search is worth while: a pattern without a sign of its own needs a digit, one of masked cards a star as well."""
    if kind in _SIGNS:
        sign = _SIGNS[kind]
        return F.lit(True) if sign is None else F.contains(text, F.lit(sign))
    return (digits & F.contains(text, F.lit("*"))) if r"\*" in pattern else digits


def find_all(text: Column, patterns: Sequence[tuple[str, str]] = ALL) -> Column:
    """Matches of all patterns, in the patterns' order; of equal spans the first pattern's."""
    none = F.array().cast(f"array<{SPAN}>")

    def every(digits: Column) -> Column:
        return F.concat(*[F.when(_may_match(text, t, p, digits), find(text, p, t)).otherwise(none) for t, p in patterns])

    found = let(text.rlike("[0-9]"), every)
    # equal spans are neighbours in order of place and pattern
    place = lambda s, i: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), i.alias("i"))
    same = lambda p, o: (p["start"] == o["start"]) & (p["stop"] == o["stop"])

    def first(f: Column) -> Column:
        kept = let(F.sort_array(F.transform(f, place)), lambda ps: F.filter(ps, lambda p, k: ~F.coalesce(same(p, F.get(ps, k - 1)), F.lit(False))))
        return F.transform(F.sort_array(F.transform(kept, lambda p: p["i"])), lambda i: F.get(f, i))

    return let(found, lambda f: F.when(F.size(f) < 2, f).otherwise(first(f)))


def overlap(a: Column, b: Column) -> Column:
    """Shared length over the shorter span's; 0 if disjoint or empty."""
    shared = F.least(a["stop"], b["stop"]) - F.greatest(a["start"], b["start"])
    shorter = F.least(a["stop"] - a["start"], b["stop"] - b["start"])
    return F.when((shared > 0) & (shorter > 0), shared / shorter).otherwise(0.0)


def valid(spans: Column, text: Column) -> Column:
    return F.filter(spans, lambda s: (s["start"] >= 0) & (s["stop"] <= F.length(text)) & (s["start"] < s["stop"]))


def merge_longest(spans: Column) -> Column:
    """Disjoint spans: by start, of overlapping neighbours the longer stays, the earlier if equal."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("k"), (-s["stop"]).alias("m"), s.alias("s"))))

    def step(kept: Column, x: Column) -> Column:
        last, s = F.element_at(kept, -1), x["s"]
        longer = (s["stop"] - s["start"]) > (last["stop"] - last["start"])
        swapped = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))
        return F.when(F.size(kept) == 0, F.array(s)).when(s["start"] >= last["stop"], F.concat(kept, F.array(s))).when(longer, swapped).otherwise(kept)

    return F.aggregate(ordered, F.array().cast(f"array<{SPAN}>"), step)


def placeholders(spans: Column) -> Column:
    """Disjoint spans with ``${TYPE_001}``, numbered by type from the last in the text."""

    def one(spans: Column, s: Column) -> Column:
        number = F.size(F.filter(spans, lambda y: (y["entity_type"] == s["entity_type"]) & (y["start"] >= s["start"])))
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["entity_value"].alias("entity_value"), F.concat(F.lit("${"), s["entity_type"], F.lit("_"), F.lpad(number.cast("string"), 3, "0"), F.lit("}")).alias("placeholder"))

    return let(spans, lambda all_: F.transform(all_, lambda s: one(all_, s)))


def rewritten(text: Column, spans: Column, piece: Callable[[Column], Column]) -> Column:
    """``text`` with ``piece`` of each of the disjoint ``spans``, which are in order, in its place; gaps and pieces are joined once."""

    def whole(spans: Column) -> Column:
        before = lambda i: F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))
        parts = F.transform(spans, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), piece(s)))
        return F.concat(F.array_join(parts, ""), F.substr(text, before(F.size(spans)) + 1))

    return let(spans, whole)


def splice(text: Column, marked: Column) -> Column:
    """``text`` with each marked span replaced by its placeholder."""
    return rewritten(text, marked, lambda s: s["placeholder"])


#: How a span can be shown: between tags, as an empty tag, as its type.
REDACTIONS: dict[str, Callable[[Column], Column]] = {
    "tagged": lambda s: F.concat(F.lit("<pii:"), F.lower(s["entity_type"]), F.lit(">"), s["entity_value"], F.lit("</pii:"), F.lower(s["entity_type"]), F.lit(">")),
    "redacted": lambda s: F.concat(F.lit("<PII:"), F.lower(s["entity_type"]), F.lit("/>")),
    "replaced": lambda s: F.concat(F.lit("<"), s["entity_type"], F.lit(">")),
}


def recover(masked: Column, marked: Column) -> Column:
    """Every placeholder replaced by its value; unknown ones stay."""
    return F.aggregate(marked, masked, lambda t, s: F.replace(t, s["placeholder"], s["entity_value"]))


def hash_mask(text: Column, category: str, values: Column) -> Column:
    """Each value replaced everywhere by ``CATEGORY[HASH:...]`` with 16 hex digits of its SHA-256."""
    return F.aggregate(values, text, lambda t, v: F.replace(t, v, F.concat(F.lit(f"{category}[HASH:"), F.substring(F.sha2(v, 256), 1, 16), F.lit("]"))))


def sensitivity(entity_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SENSITIVITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, entity_type), F.lit(5))


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` end in a right Luhn check digit."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(number, r"\D", "")), ""), lambda x: F.expr("0") + x.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.coalesce(F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0, F.lit(False))
