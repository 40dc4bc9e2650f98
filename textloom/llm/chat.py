"""Chat formatting by event-sourced reconstruction.

A log has one event a row: conv_id, turn, seq, kind, role, text.  It is partitioned by
conversation and sorted by (turn, seq), and each turn's events are folded into messages:

``message``     opens a message with this role and text (a second one in a turn opens another)
``delta``       adds its text to the turn's open message, or opens one
``edit``        replaces the open message's text, and its role if given
``regenerate``  empties the open message; the deltas behind it build it anew
``delete``      removes the open message

Other kinds are errors.  Rows are streamed in order, so a task holds one message and one segment
of rendered text at a time, however long a conversation is.

The template writes each message as ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``.  Control strings of
this and other templates inside roles and texts get ``MARK`` behind their first character and
``MARK`` itself is doubled, which ``unescape`` undoes exactly; a role's newlines are ``MARK`` n.
Rendered conversations come in segments of whole messages; ``loss`` holds the code point spans of
assistant texts in each segment.

Defined cases: null texts and roles are empty; a null conversation is one of its own; ties in
(turn, seq) are ordered by kind, role and text; repeated rows are repeated events; other columns
are ignored; conversations without a message left, and empty logs, give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MARK = "␛"
START, END = "<|im_start|>", "<|im_end|>"
#: Strings that templates in use take as control marks; fixed values.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)) + "|" + MARK)
_ESCAPED = re.compile(f"{MARK}(.?)", re.S)
_MESSAGE = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)
SEGMENT = 1 << 20
RENDERED = "conv_id long, segment int, formatted string, loss array<struct<start:int,stop:int>>"
_EVENTS = ("conv_id", "turn", "seq", "kind", "role", "text")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: MARK + MARK if m[0] == MARK else m[0][0] + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", MARK + "n")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message in the template, and where its text starts and stops."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """role, text, and the text's span for each message."""
    at = 0
    while at < len(formatted):
        m = _MESSAGE.match(formatted, at)
        if not m:
            raise ValueError("not a rendered conversation")
        yield unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def fold(events: Iterator[tuple]) -> Iterator[tuple[int | None, str, str]]:
    """conv_id, role and text of each final message; ``events`` are in order."""
    place, role, parts = None, None, []
    for conv, turn, _, kind, who, text in events:
        text = text or ""
        if place != (conv, turn) or kind == "message" or role is None and kind in ("delta", "edit"):
            if role is not None:
                yield place[0], role, "".join(parts)
            place, role, parts = (conv, turn), None, []
            if kind in ("message", "delta", "edit"):
                role, parts = who or "", [text]
                continue
        if kind == "delta":
            parts.append(text)
        elif kind == "edit":
            role, parts = who if who is not None else role, [text]
        elif kind == "regenerate":
            parts = []
        elif kind == "delete":
            role, parts = None, []
        elif kind != "message":
            raise ValueError(f"unknown event kind: {kind}")
    if role is not None:
        yield place[0], role, "".join(parts)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_chats(log: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Rendered segments of all conversations of ``log``: conv_id, segment, formatted, loss."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, segment, size, parts, loss = None, 0, 0, [], []

        def row() -> pa.RecordBatch:
            values = [[conv], [segment], ["".join(parts)], [[{"start": a, "stop": b} for a, b in loss]]]
            types = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["conv_id", "segment", "formatted", "loss"])

        for key, role, text in fold(_stream(batches)):
            if parts and (key != conv or size >= SEGMENT):
                yield row()
                segment, size, parts, loss = segment + 1 if key == conv else 0, 0, [], []
            conv = key
            out, a, b = render(role, text)
            if role == trained_role:
                loss.append((size + a, size + b))
            parts.append(out)
            size += len(out)
        if parts:
            yield row()

    partitions = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("string").alias(c) for c in ("kind", "role", "text")])
    return rows.repartition(partitions, "conv_id").sortWithinPartitions(*_EVENTS).mapInArrow(task, RENDERED)


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its rendered segments."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        key, state, done = None, None, []

        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

        def close() -> list:
            return [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for conv, _, formatted, loss in _stream(batches):
            if state is None or conv != key:
                if state is not None:
                    done.append(close())
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"] : span["stop"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(formatted)
            if len(done) >= 1000:
                yield batch(done)
                done = []
        if state is not None:
            yield batch([*done, close()])

    # format_chats left each conversation's segments together and in order
    return rendered.mapInArrow(task, schema)


def log_of(conversations: DataFrame, delta_chars: int = 400) -> DataFrame:
    """The event log of finished rows (conv_id, turn, role, text): each row opens a message with its first characters and streams the rest as deltas."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("whole"))
    # rows that share a turn open a message each
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "whole")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("whole") - 1), F.lit(delta_chars))
    rows = rows.select("conv_id", "turn", "role", "nth", "whole", F.posexplode(starts).alias("k", "at"))
    kind = F.when(F.col("k") == 0, "message").otherwise("delta")
    return rows.select("conv_id", "turn", (F.col("nth").cast("long") * F.lit(1 << 32) + F.col("k")).alias("seq"), kind.alias("kind"), "role", F.substr("whole", F.col("at") + 1, F.lit(delta_chars)).alias("text"))
