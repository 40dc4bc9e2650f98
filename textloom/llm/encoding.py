"""Token ids of whole texts by a public tokenizer, each distinct unit encoded once per worker.

A unit is a word with the ASCII white space before it; white space at a text's end is a unit of
its own.  The units of a text tile it, and a unit's ids don't depend on what stands around it:
both kinds of pre-tokenizer end a token where white space begins after a word.  So ids are kept
in a bounded table of the worker process, and those of a batch are gathered from it.  Texts for
which this isn't sure (special strings, control or Unicode white space) are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from textloom.llm.words import _SPACE, CACHES, range_hashes, raw

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_MOST = 2_500_000
_GROUP = 20_000
_SEPARATORS = "🎉❤➡•€…"
_UNSURE = r"<\||[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F]"
_OPEN: dict[str, Encoder] = {}
CACHES.append(_OPEN.clear)


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]


class Encoder:
    """Encodes string arrays with the vocabulary file at ``path`` (tokenizers' JSON)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.blanks_count = self._ids("a  b") != self._ids("a b")
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.separator = ""
        if self.blanks_count:
            self.opens[[i for s, i in vocab.items() if s[:1] == "Ġ" or s == "Ċ"]] = True
        else:
            for c in _SEPARATORS:
                if len(ids := self._ids(c)) == 1:
                    self.separator, self.opens[ids[0]] = c, True
                    break
        special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [s for s in special if not s.startswith("<|")]
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Lengths and ids of units encoded as one text; None if they can't be told apart."""
        if self.blanks_count:
            ids = np.array(self._ids(b"".join(units).decode()), np.uint32)
            starts = np.flatnonzero(self.opens[ids])
            return (np.diff(np.append(starts, len(ids))), ids) if len(starts) == len(units) and starts[0] == 0 else None
        mark = f" {self.separator} "
        ids = np.array(self._ids(mark.join(u.decode() for u in units) + mark), np.uint32)
        ends = np.flatnonzero(self.opens[ids])
        return (np.diff(ends, prepend=-1) - 1, ids[~self.opens[ids]]) if len(ends) == len(units) else None

    def _learn(self, units: list[bytes]) -> None:
        """Appends the ids of ``units`` to the table."""
        if self.blanks_count:
            plain = [len(u) > 1 and u[0] in b" \n" and not _SPACE[u[1]] for u in units]
        else:
            mark = self.separator.encode()
            plain = [bool(mark) and mark not in u for u in units]
        lengths = np.zeros(len(units), np.int64)
        parts: dict[int, np.ndarray] = {}
        easy = [k for k, p in enumerate(plain) if p]
        hard = [k for k, p in enumerate(plain) if not p]
        order: list[int] = []
        flat: list[np.ndarray] = []
        for at in range(0, len(easy), _GROUP):
            own = easy[at : at + _GROUP]
            got = self._together([units[k] for k in own])
            if got is None:
                hard += own
                continue
            lengths[own] = got[0]
            order += own
            flat.append(got[1])
        for k, ids in zip(hard, self.whole([units[k].decode() for k in hard]), strict=True):
            lengths[k] = len(ids)
            parts[k] = np.array(ids, np.uint32)
        order += hard
        flat += [parts[k] for k in hard]
        ids = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        # order -> units' own order
        place = np.empty(len(units), np.int64)
        place[order] = np.arange(len(units))
        used = self.bounds[-1]
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint32)])
        self.ids[used : used + len(ids)] = ids
        base = len(self.bounds) - 1
        self.bounds = np.concatenate([self.bounds, used + np.cumsum(lengths[order])])
        self._new_places = base + place

    def _places(self, distinct: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Each distinct unit's place in the table; starts and ends show where it stands in ``data``."""
        if len(self.known) > _MOST:
            self.forget()
        at = np.searchsorted(self.known, distinct)
        found = np.zeros(len(distinct), bool)
        inside = at < len(self.known)
        found[inside] = self.known[at[inside]] == distinct[inside]
        out = np.empty(len(distinct), np.int64)
        out[found] = self.place[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            blob = data.tobytes()
            self._learn([blob[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            out[new] = self._new_places
            by = np.argsort(distinct[new])
            where = at[new][by]
            self.known = np.insert(self.known, where, distinct[new][by])
            self.place = np.insert(self.place, where, self._new_places[by])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and the ids of all texts, one after the other; a null text is empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if len(texts) == 0:
            return np.zeros(1, np.int64), np.zeros(0, np.uint32)
        texts = texts.fill_null("")
        unsure = pc.match_substring_regex(texts, _UNSURE)
        for s in self.special:
            unsure = pc.or_(unsure, pc.match_substring(texts, s, ignore_case=True))
        odd = np.asarray(unsure)
        bounds, data = raw(texts if not odd.any() else pc.if_else(unsure, "", texts))
        inside = ~_SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = inside[:-1] & ~inside[1:]
        cut[bounds] = True
        points = np.flatnonzero(cut)
        starts, stops = points[:-1], points[1:]
        first = np.searchsorted(points, bounds)
        if len(starts):
            code, distinct = pd.factorize(range_hashes(data, starts, stops))
            seen = np.empty(len(distinct), np.int64)
            seen[code] = np.arange(len(code))
            where = self._places(distinct, starts[seen], stops[seen], data)[code]
        else:
            where = np.zeros(0, np.int64)
        lengths = np.diff(self.bounds)[where]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(self.bounds[where] - total[:-1], lengths)]
        total = total[first]
        if not odd.any():
            return total, ids
        whole = self.whole(texts.filter(unsure).to_pylist())
        sizes = np.diff(total)
        sizes[odd] = [len(x) for x in whole]
        out_bounds = np.concatenate([[0], np.cumsum(sizes)])
        out, kept = np.empty(out_bounds[-1], np.uint32), np.ones(out_bounds[-1], bool)
        for k, x in zip(np.flatnonzero(odd).tolist(), whole, strict=True):
            out[out_bounds[k] : out_bounds[k + 1]] = x
            kept[out_bounds[k] : out_bounds[k + 1]] = False
        out[kept] = ids
        return out_bounds, out
