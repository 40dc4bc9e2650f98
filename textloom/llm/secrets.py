"""Secrets in texts: patterns, and literals that reach a name which says that it holds one.

Base spans are matches of three patterns.  The method adds spans of kind ``named``: source and
configuration syntax is read as assignments of values to names - ``name = "literal"``, ``key:
value``, ``{"key": "literal"}``, ``config["key"] = ...``, ``<key>literal</key>`` - where a value is
literals and names joined by ``+``.  Names are constants: a value that mentions a name holds the
literals bound to it last, over any number of steps.  A literal counts if a name that it reaches is
sensitive, by its words, and the whole value looks like a secret: long and varied enough, no white
space, no placeholder.  Unquoted values must hold digits and letters.  A literal that lies in a base span
adds nothing.

Reading is linear in a text; texts without a pattern or a sensitive name before an assignment are
passed over by a search of the batch.

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive; quotes
that aren't closed in their line open no literal; null ids, repeated rows and ids shared by several
texts each give their row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import small_batches
from textloom.llm.words import pieces

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "named")

#: How much a word of a name says that its value is a secret; other words say nothing.
WEIGHTS = {
    **dict.fromkeys(("password", "passwd", "passphrase", "pwd", "secret", "apikey", "passcode", "credential", "credentials"), 3),
    **dict.fromkeys(("token", "pass", "auth", "bearer", "salt"), 2),
    **dict.fromkeys(("key", "api", "access", "private", "signing", "encryption", "session"), 1),
    **dict.fromkeys(("file", "path", "url", "uri", "name", "length", "size", "count", "type", "field", "label", "hint", "policy", "id", "pattern", "regex", "prompt", "header", "env", "public", "max", "min", "expiry", "ttl"), -3),
}
LEAST_NAME, LEAST_LENGTH, LEAST_DISTINCT = 2, 6, 5
_PLACEHOLDER = re.compile(r"[<>{}%]|\$|x{4}|\*{3}|\.{3}|change|example|your|dummy|sample|placeholder|redacted|todo|none|null|undefined", re.IGNORECASE)
_GATE = r"""(?i)password|passwd|secret|token|api_?key|akia[a-z0-9]{16}|[0-9a-f]{24}|(?:pass|pwd|cred|auth|bearer|salt|key)[a-z0-9_.$-]*["'\]]*\s*(?:[:=>]|:=|=>)"""
_TOKEN = re.compile(
    r"""<(?P<tag>[A-Za-z_][\w.:-]*)>(?P<body>[^<>\n]*)</
    |(?P<quoted>(?<!\w)(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`))
    |(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)
    |(?P<op>:=|=>|==|!=|<=|>=|\+=|[=:+\[\](){},;\n])
    |(?P<open>["'`])
    |(?P<rest>[^\s\[\](){},;"'=:+]+)""",
    re.VERBOSE | re.ASCII,
)
_BARE = re.compile(r"""[^\s,;"'`(){}\[\]]+""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def name_score(name: str) -> int:
    """How sensitive a name is: its words' weights, each once."""
    words = {w.lower() for w in _WORD.findall(name)}
    if {"api", "key"} <= words:
        words |= {"apikey"}
    return sum(WEIGHTS.get(w, 0) for w in words)


class Span(NamedTuple):
    kind: str
    start: int
    stop: int
    name: str


@dataclass
class _Value:
    """What is assigned: literals (start, stop, quoted) and the values bound to the names that it mentions."""

    literals: list[tuple[int, int, bool]] = field(default_factory=list)
    names: list[_Value] = field(default_factory=list)
    name: str = ""


def assignments(text: str) -> Iterator[_Value]:
    """The values assigned in ``text``, in order, with constants resolved."""
    bound: dict[str, _Value] = {}
    tokens = list(_TOKEN.finditer(text))
    target, at = "", 0
    while at < len(tokens):
        m = tokens[at]
        kind, word = m.lastgroup, m.group()
        if kind == "body":
            yield _Value([(*m.span("body"), True)], [], m["tag"])
        elif kind == "quoted":
            target = word[1:-1]
        elif kind == "name":
            target = word
        elif word == "[" and at + 2 < len(tokens) and tokens[at + 1].lastgroup == "quoted" and tokens[at + 2].group() == "]":
            target = f"{target}.{tokens[at + 1].group()[1:-1]}"
            at += 2
        elif word in ("=", ":", ":=", "=>", "+=") and target:
            if word == ":" and at + 2 < len(tokens) and tokens[at + 1].lastgroup == "name" and tokens[at + 2].group() == "=":
                at += 2  # name: type = value
            value, at = _value(text, tokens, at + 1, bound, target)
            if word == "+=" and target in bound:
                value.names.append(bound[target])
            bound[target] = value
            yield value
            target = ""
            continue
        else:
            target = ""
        at += 1


def _value(text: str, tokens: list[re.Match], at: int, bound: dict[str, _Value], target: str) -> tuple[_Value, int]:
    """The value that starts at a token, and the first token behind it."""
    out = _Value(name=target)
    first = True
    while at < len(tokens):
        m = tokens[at]
        kind, word = m.lastgroup, m.group()
        after = tokens[at + 1].group() if at + 1 < len(tokens) else "\n"
        if kind == "quoted":
            if after in (":", "=", "=>") and not first:
                break
            out.literals.append((m.start() + 1, m.end() - 1, True))
        elif kind == "name" and word in bound and after != "(":
            out.names.append(bound[word])
        elif first and kind in ("name", "rest", "op") and word not in "\n,;(){}[]" and after != "(":
            bare = _BARE.match(text, m.start())
            if bare is None:
                break
            out.literals.append((*bare.span(), False))
            while at < len(tokens) and tokens[at].start() < bare.end():
                at += 1
            break
        elif word in ("(", "+") or (word == "\n" and first is False and tokens[at - 1].group() == "+"):
            pass
        else:
            break
        first = first and word == "("
        at += 1
    return out, at


def _looks_secret(texts: list[str], quoted: bool) -> bool:
    whole = "".join(texts)
    if len(whole) < LEAST_LENGTH or len(set(whole)) < LEAST_DISTINCT or any(c.isspace() for c in whole) or _PLACEHOLDER.search(whole):
        return False
    digits, letters = any(c.isdigit() for c in whole), any(c.isalpha() for c in whole)
    return digits and letters or (quoted and any(not c.isalnum() for c in whole)) or (quoted and len(whole) >= 16)


def named(text: str) -> list[Span]:
    """Literals that reach a sensitive name, each once, under the first such name."""
    found: dict[tuple[int, int], str] = {}
    done: set[int] = set()
    values = list(assignments(text))
    for value in values:
        if name_score(value.name) < LEAST_NAME:
            continue
        literals, open_ = [], [value]
        while open_:  # what another sensitive name reached before is settled
            v = open_.pop()
            if id(v) not in done:
                done.add(id(v))
                literals += v.literals
                open_ += v.names
        literals.sort()
        if literals and _looks_secret([text[a:b] for a, b, _ in literals], all(q for *_, q in literals)):
            for a, b, _ in literals:
                if b > a:
                    found.setdefault((a, b), value.name)
    return [Span("named", a, b, n) for (a, b), n in found.items()]


def secret_spans(text: str) -> list[Span]:
    """All spans of a text by start, then kind."""
    base = [Span("assign", *m.span(), m[1]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [Span(kind, *m.span(), "") for kind, p in (("access", ACCESS), ("hex", HEX)) for m in p.finditer(text)]
    base.sort(key=lambda s: (s.start, KINDS.index(s.kind)))
    added, reach, at = [], -1, 0
    for s in sorted(named(text), key=lambda s: s.start):
        while at < len(base) and base[at].start <= s.start:
            reach = max(reach, base[at].stop)
            at += 1
        if s.stop > reach:
            added.append(s)
    return sorted(base + added, key=lambda s: (s.start, KINDS.index(s.kind)))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, found (array of kind, start, stop, name) of each text of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    fields = [("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("name", pa.string())]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column("text").fill_null("")
            maybe = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, _GATE)))
            spans = [secret_spans(texts[k].as_py()) for k in maybe.tolist()]
            counts = np.zeros(batch.num_rows, np.int64)
            counts[maybe] = [len(s) for s in spans]
            flat = [s for own in spans for s in own]
            columns = [pa.array([s[k] for s in flat], t) for k, (_, t) in enumerate(fields)]
            values = pa.StructArray.from_arrays(columns, [n for n, _ in fields])
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, found array<struct<kind: string, start: int, stop: int, name: string>>")


def summarised(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of rows of ``find_secrets``."""

    def of(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("found", lambda s: s["kind"] != "named")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
