"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tasks tokenise texts and line up both sides by the byte offsets where tokens end, a piece of some
1 MB at a time by arrays over its bytes; Spark does the rest.

* Groups.  They end at the offsets where tokens of both sides end.  A text's ids come by group as
  one array of numbers, with marks between sides and groups; Spark makes its text and digest.
* Links.  Two tokens overlap in the bytes between two neighbouring ends of either side, and in one
  such stretch only, so the distinct ends of both sides are the links; the tokens are those of the
  stretch's last byte.  Both steps are linear in a text's bytes, however long its groups.

Links are exploded and counted by pair of ids over the corpus, then each text's links look up their counts: by
broadcast for up to ``SENT`` pairs, else by broadcast for the pairs that stand for more than one
of ``COMMON`` links and by a join of (text, pair) counts for the rest.

Defined cases: null and empty texts, and those whose joined token bytes on either side differ from
a space and the text (such as one with U+2581), have no tokens: zeros, and '' for the groups.
Special tokens' strings are plain text.  Null ids, ids shared by several texts and repeated rows
each give their row and count as often as they stand; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.encoding import Encoder
from textloom.llm.storage import small, small_batches, temporary
from textloom.llm.words import CACHES, pieces, raw

SENT, COMMON = 1_000_000, 1000
_BLANK = "▁"
#: What stands between a group's sides and between groups among their ids.
_OTHER, _NEXT = -1, -2
_OPEN: dict[str, Side] = {}
CACHES.append(_OPEN.clear)


class Pieces(Encoder):
    """Units by a sentencepiece model, which adds a space before a text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.special = []
        known = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # white space inside pieces would join what stands before a unit to it
        odd = {c for p in known for c in p if c in "\t\n\x0b\x0c\r"} | {_BLANK}
        self.unsure = "[" + "".join(rf"\x{{{ord(c):X}}}" for c in sorted(odd)) + "]"
        self.sure = not any(_BLANK in p.lstrip(_BLANK) for p in known)
        self.blank = self.model.piece_to_id(_BLANK)
        self.forget()

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that start with the space that the model adds."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)

    def _learn(self, units: list[bytes]) -> None:
        texts = [u.decode() for u in units]
        ids = self.model.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for k, t in enumerate(texts):
            if t == " ":
                ids[k] = [self.blank]
            elif t[0] != " ":
                ids[k] = ids[k][1:]  # the space that the model adds stands alone before other white space
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(lengths.sum()))
        used = self.bounds[-1]
        while used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[used : used + len(flat)] = flat
        self._new_places = len(self.bounds) - 1 + np.arange(len(units))
        self.bounds = np.concatenate([self.bounds, used + np.cumsum(lengths)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.asarray(pc.match_substring_regex(texts, self.unsure)) if self.sure else np.ones(len(texts), bool)
        if not odd.any():
            return super().encode(texts)
        bounds, ids = super().encode(pc.if_else(pa.array(odd), "", texts))
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        where = np.flatnonzero(odd).tolist()
        for k, own in zip(where, self.whole([texts[k].as_py() for k in where]), strict=True):
            parts[k] = np.array(own, np.uint32)
        return np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts)


class Side:
    """A tokenizer with its tokens' bytes."""

    def __init__(self, path: str) -> None:
        if path.endswith(".json"):
            self.encoder = Encoder(path)
            self.encoder.tokenizer.encode_special_tokens = True
            size = self.encoder.tokenizer.get_vocab_size()
            tokens = [self._bytes_of(self.encoder.tokenizer.id_to_token(i) or "") for i in range(size)]
        else:
            self.encoder = Pieces(path)
            model = self.encoder.model
            tokens = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace(_BLANK, " ").encode() for i in range(model.get_piece_size()) for p in [model.id_to_piece(i)]]
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    _BYTE = {chr(b if keep else 256 + n): b for keep, run in ((True, [*range(33, 127), *range(161, 173), *range(174, 256)]), (False, [*range(33), *range(127, 161), 173])) for n, b in enumerate(run)}

    @classmethod
    def _bytes_of(cls, token: str) -> bytes:
        """Bytes of a byte-level token; a token outside that alphabet stands for its own text."""
        return bytes(cls._BYTE[c] for c in token) if all(c in cls._BYTE for c in token) else token.encode()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bounds by text, ids, ends counted over all texts, and the tokens' joined bytes."""
        bounds, ids = self.encoder.encode(texts)
        size = self.lengths[ids]
        ends = np.cumsum(size)
        joined = self.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - size), size)]
        return bounds, ids, ends, joined


def side(path: str) -> Side:
    """The worker's tokenizer of this vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = Side(path)
    return _OPEN[path]


def _marked(ends: np.ndarray, total: int) -> np.ndarray:
    """Whether a token ends at each offset."""
    out = np.zeros(total + 1, bool)
    out[ends] = True
    return out


def _laid_out(ids: list[np.ndarray], upto: list[np.ndarray], closing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides' ids by group, with ``_OTHER`` between sides and ``_NEXT`` after groups but those ``closing`` a text; and where each group ends.

    ``upto``: for both sides the tokens up to each group's end.
    """
    before = [np.concatenate([[0], u[:-1]]) for u in upto]
    marks = 2 * np.arange(len(closing))
    out = np.empty(len(ids[0]) + len(ids[1]) + 2 * len(closing), np.int32)
    out[np.arange(len(ids[0])) + np.repeat(before[1] + marks, upto[0] - before[0])] = ids[0]
    out[np.arange(len(ids[1])) + np.repeat(upto[0] + marks + 1, upto[1] - before[1])] = ids[1]
    out[upto[0] + before[1] + marks] = _OTHER
    last = upto[0] + upto[1] + marks + 1
    out[last] = _NEXT
    kept = np.ones(len(out), bool)
    kept[last[closing]] = False
    return out[kept], last + 1 - np.cumsum(closing)


def alignments(docs: DataFrame, a_path: str, b_path: str, factor: int, kind: str = "long") -> DataFrame:
    """doc_id, n_a, n_b, n_groups of each text, its groups as numbers, and its links as pairs (``a * factor + b``)."""
    small_batches(docs.sparkSession)
    wide = np.int32 if kind == "int" else np.int64

    def lists(bounds: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20, keep=True):
            texts = batch.column("text").fill_null("")
            full = np.asarray(pc.greater(pc.binary_length(texts), 0))
            spaced = pc.if_else(pa.array(full), pc.binary_join_element_wise(" ", texts, ""), "")
            where, data = raw(spaced)
            both = [side(p).encode(spaced) for p in (a_path, b_path)]
            good = full.copy()
            for bounds, _, ends, joined in both:
                at = np.concatenate([[0], ends])[bounds]
                if len(joined) != len(data) or not np.array_equal(joined, data) or not np.array_equal(at, where):
                    good &= [np.array_equal(joined[at[k] : at[k + 1]], data[where[k] : where[k + 1]]) for k in range(len(good))]
            # from here on the texts that aren't good have no bytes
            stops = np.cumsum(np.where(good, np.diff(where), 0))
            counts = [np.where(good, np.diff(bounds), 0) for bounds, *_ in both]
            ids = [own[np.repeat(good, np.diff(bounds))].astype(np.int32) for bounds, own, *_ in both]
            ends = [_marked(np.cumsum(side(p).lengths[own]), stops[-1]) for p, own in zip((a_path, b_path), ids, strict=True)]
            done = [np.cumsum(e) for e in ends]  # tokens that end up to each offset
            shared, either = np.flatnonzero(ends[0] & ends[1]), np.flatnonzero(ends[0] | ends[1])
            # the tokens of the last byte before an end are those that overlap there
            a, b = (own[d[either - 1]] for own, d in zip(ids, done, strict=True))
            groups, closed = _laid_out(ids, [d[shared] for d in done], np.isin(shared, stops))
            n_groups = np.searchsorted(shared, stops, "right")
            columns = [batch.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in (*counts, np.diff(n_groups, prepend=0)))]
            columns.append(lists(np.concatenate([[0], closed])[np.concatenate([[0], n_groups])], groups))
            columns.append(lists(np.concatenate([[0], np.searchsorted(either, stops, "right")]), a.astype(wide) * wide(factor) + b))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "groups", "pairs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, f"doc_id long, n_a long, n_b long, n_groups long, groups array<int>, pairs array<{kind}>")


def _digest(groups: Column) -> Column:
    """Digest of a text's groups as text, '' without any."""
    text = F.array_join(groups.cast("array<string>"), ",")
    for mark, sign in ((_OTHER, "|"), (_NEXT, ";")):
        text = F.replace(text, F.lit(f",{mark},"), F.lit(sign))
    return F.when(F.size(groups) == 0, "").otherwise(F.sha2(text, 256))


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text of ``docs`` (doc_id, text)."""
    n_a, factor = (len(Side(p).lengths) for p in (a_path, b_path))
    kind = "int" if n_a * factor < 1 << 31 else "long"
    facts = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = alignments(docs, a_path, b_path, factor, kind).withColumns({"row": F.monotonically_increasing_id(), "n_links": F.size("pairs").cast("long"), "groups_sha256": _digest(F.col("groups"))})
    table, drop = temporary(rows.select(*facts, "pairs"), "links", compression="zstd", **{"parquet.dictionary.page.size": str(4 << 20)})
    links = table.select("row", F.explode("pairs").alias("pair"))
    by_b = Window.partitionBy(F.col("pair") % factor)  # at most one row an A id
    counts = links.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = small(counts.select("pair", "n", (F.col("n") == F.max("n").over(by_b)).alias("best")))
    sums = [F.sum(F.col("m") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum")]
    one = links.withColumn("m", F.lit(1).cast("long"))
    if counts.count() <= SENT:
        found = one.join(F.broadcast(counts), "pair").groupBy("row").agg(*sums)
    else:
        total = counts.agg(F.sum("n")).collect()[0][0]
        common = F.broadcast(counts.where(F.col("n") * COMMON > total))  # fewer than COMMON rows
        often = one.join(common, "pair")
        rest = one.join(common, "pair", "left_anti").groupBy("row", "pair").agg(F.sum("m").alias("m")).join(counts, "pair")
        found = often.select("row", "m", "n", "best").unionByName(rest.select("row", "m", "n", "best")).groupBy("row").agg(*sums)
    out = table.select(*facts).join(found, "row", "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")]
    out = small(out.select(*facts[1:-1], *zero, "groups_sha256"))
    drop()
    return out
