"""Text features and the choice of a detection strategy, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.spans import let

# Keywords of each domain, in order of precedence.
DOMAINS = {
    "financial": ("credit", "card", "bank", "account", "payment", "transaction", "balance", "deposit", "withdraw", "loan", "mortgage", "investment", "iban", "routing", "wire", "transfer", "billing", "invoice"),
    "medical": ("patient", "diagnosis", "prescription", "medical", "health", "doctor", "hospital", "treatment", "symptom", "medication", "insurance", "clinic", "nurse", "surgery", "lab", "test"),
    "legal": ("attorney", "lawyer", "court", "legal", "lawsuit", "contract", "defendant", "plaintiff", "witness", "testimony", "evidence", "case", "judge", "settlement", "filing", "jurisdiction"),
    "technical": ("api", "server", "database", "endpoint", "token", "key", "configuration", "deployment", "error", "log", "debug", "ip", "port", "host", "request", "response", "header"),
    "customer_service": ("customer", "support", "ticket", "order", "delivery", "shipping", "return", "refund", "complaint", "inquiry", "service", "help"),
}
# What gives away a source, in order of precedence.
SOURCES = {
    "email": [r"^(from|to|subject|cc|bcc):", r"dear\s+\w+", r"(best|kind)\s+regards", r"sincerely", r"sent\s+from"],
    "form": [r"^\s*(name|email|phone|address|city|state|zip)\s*:", r"(required|optional)\s*\*?", r"please\s+enter", r"(first|last)\s+name"],
    "pdf": [r"page\s+\d+\s+of\s+\d+", r"\[\d+\]", r"figure\s+\d+", r"table\s+\d+"],
}
EMAIL, CARD = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
# What counts towards density.
FOUND = (EMAIL, CARD, r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", r"(?i)\d+\s+[A-Z][a-z]+\s+(St|Ave|Rd|Blvd|Dr|Ln|Ct|Way)")


def chars(text: Column, wanted: str) -> Column:
    return F.length(text) - F.length(F.translate(text, wanted, ""))


def domain(text: Column) -> Column:
    """The domain with most keywords, the first of equals; general with fewer than two."""

    def counts(low: Column) -> Column:
        return F.array(*[sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0)) for words in DOMAINS.values()])

    def best(found: Column) -> Column:
        names = F.array(*map(F.lit, DOMAINS))
        return F.when(F.array_max(found) < 2, "general").otherwise(F.get(names, (F.array_position(found, F.array_max(found)) - 1).cast("int")))

    return let(let(F.lower(text), counts), best)


#: Words of which a text with a match holds one; to look for them is quicker than the pattern.
_HELD = {
    r"dear\s+\w+": ("dear",), r"(best|kind)\s+regards": ("regards",), r"sent\s+from": ("sent",), r"(required|optional)\s*\*?": ("required", "optional"), r"please\s+enter": ("please",),
    r"(first|last)\s+name": ("name",), r"page\s+\d+\s+of\s+\d+": ("page",), r"\[\d+\]": ("[",), r"figure\s+\d+": ("figure",), r"table\s+\d+": ("table",),
}


def source_type(text: Column) -> Column:
    def of(low: Column) -> Column:
        fits = lambda p: (reduce(or_, [F.contains(low, F.lit(w)) for w in _HELD[p]]) & low.rlike(p) if p in _HELD else low.rlike(p)).cast("int")
        found = {name: sum(map(fits, patterns), F.lit(0)) for name, patterns in SOURCES.items()}
        out = None
        for name, n in found.items():
            out = F.when(n >= 2, name) if out is None else out.when(n >= 2, name)
        return out

    dots = chars(text, ".")
    talk = (F.length(text) / F.greatest(dots, F.lit(1)) < 100) & (chars(text, "\n") > dots)
    return F.coalesce(let(F.lower(text), of), F.when(talk, "conversation").when(F.length(text) > 500, "document").otherwise("unknown"))


def features(text: Column) -> dict[str, Column]:
    """Scalar features; densities are per word."""
    words = F.regexp_count(text, F.lit(r"\S+"))
    email, *numbers, name = FOUND[0], FOUND[1], FOUND[2], FOUND[4], FOUND[3]
    count = lambda p: F.regexp_count(text, F.lit(p))
    # without an @ there is no e-mail, without a digit no number
    found = F.when(F.contains(text, F.lit("@")), count(email)).otherwise(0) + F.when(text.rlike("[0-9]"), sum(map(count, numbers[1:]), count(numbers[0]))).otherwise(0) + count(name)
    return {
        "text_length": F.length(text),
        "word_count": words,
        "sentence_count": chars(text, ".!?"),
        "n_found": found,
        "density": found.cast("double") / F.greatest(words, F.lit(1)),
        "multilingual": text.rlike(r"[^\x00-\x7F]"),
        "complex_formatting": text.rlike(r"[+().\-]{2,}"),
    }


def complexity(text_length: Column, density: Column, multilingual: Column, complex_formatting: Column, sentence_count: Column) -> Column:
    parts = [(text_length > 500, 0.2), (text_length > 1000, 0.1), (density > 0.1, 0.2), (density > 0.3, 0.1), (multilingual, 0.15), (complex_formatting, 0.1), (sentence_count > 5, 0.1)]
    total = F.lit(0.0)
    for fits, worth in parts:
        total = total + F.when(fits, worth).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def strategy(domain: Column, source: Column, text_length: Column, density: Column, multilingual: Column, complex_formatting: Column, score: Column) -> Column:
    return (
        F.when(domain.isin("financial", "medical", "legal"), "high_precision")
        .when((density > 0.3) | complex_formatting | multilingual, "high_recall")
        .when((source == "conversation") & (text_length < 200), "high_precision")
        .when((text_length > 500) & (density < 0.1) | domain.isin("technical", "customer_service"), "balanced")
        .when(score > 0.6, "high_recall")
        .otherwise("balanced")
    )


def model_size(domain: Column, multilingual: Column, score: Column) -> Column:
    return F.when(domain.isin("financial", "medical", "legal") | (score > 0.5) | multilingual, "large").otherwise("medium")


def locale(text: Column) -> Column:
    return F.when(text.rlike(r"[\x{4e00}-\x{9fff}]"), "zh_CN").when(text.rlike(r"[\x{3040}-\x{30ff}]"), "ja_JP").when(text.rlike(r"[\x{ac00}-\x{d7af}]"), "ko_KR").otherwise("en_US")


def special_ratio(text: Column) -> Column:
    """Share of ASCII white space and punctuation."""
    special = F.length(text) - F.length(F.regexp_replace(text, r"[\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", ""))
    return F.when(F.length(text) > 0, special / F.length(text)).otherwise(0.0)


def recommended(level: Column, reversible: Column, realistic: Column) -> Column:
    """A masking strategy for a sensitivity from 1 to 10."""
    return F.when(level >= 8, F.when(reversible, "encrypt").otherwise("hash")).when(level >= 5, F.when(realistic, "fake").when(reversible, "placeholder").otherwise("mask")).otherwise(F.when(realistic, "fake").otherwise("placeholder"))
