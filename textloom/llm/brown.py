"""LM scoring by Brown's class-based bigrams.

A text is its words (A-Z lower-cased) and one end.  ``p(text)`` is the product over its tokens of
the class transition ``p(c | previous c)``, from the end's class at first, and the word emission
``p(w | c)``.  Exchange clustering assigns the classes: each item in turn moves to the class that
raises the training text's class-bigram likelihood most, until at most one item in 500 moves in a
sweep, or for 12 sweeps.

The words with ``CORE * c >= sqrt(n)`` of the n training tokens, at most CORE * sqrt(n) of them and more
in a larger corpus, are clustered by exchange over their sparse bigram counts; all other words
stand in one item there.  Each other word of the training text, down to those that occur once, is
then put in the class that fits its own neighbours best: its counts before and behind each class
of core words (and behind and before other words as one) against the classes' bigrams.  Only words
that the training text lacks go by their last bytes: to the class that holds most of the rarer
words with that ending, in ``ENDINGS`` bins.

Word counts and classes cover the whole vocabulary and stay distributed.  Words above a relative
frequency of ``OFTEN`` (1 / OFTEN words at most) and the core are sent to the tasks; each document's
rarer words are joined with the table, a row for each distinct word of a document.

Emissions are ``(c + 0.5) / (N_class + 0.5 (V_class + 1))``, transitions are smoothed towards the
classes' frequencies, so seen and unseen words of every class keep their share.

Defined cases: a null or empty text is its end alone; a null id counts as the empty string for the
split; repeated rows are counted and scored each; other columns are ignored; an empty table gives
no rows; without training text all counts are 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.storage import written
from textloom.llm.words import Words, pieces, raw

CORE, ENDINGS, CLASSES, OFTEN = 4, 1024, 48, 5e-7
_REST = CLASSES  # the class of all other words while the core is clustered
FOLDS, HELD_OUT, ADD, TOWARDS = 5, 1, 0.5, 5.0
_END = -(2**63)  # the key of the end; no word's hash has it but by chance
_OPEN = np.uint8(255)  # the class of a token whose word is yet to be joined
_COMPACT = 2_000_000


def held_out(doc_id: Column) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % FOLDS == HELD_OUT


def _endings(words: Words) -> np.ndarray:
    """The ending item of each word."""
    out = np.zeros(len(words), np.uint32)
    for k in range(1, 4):
        at = words.ends - k
        there = at >= words.starts
        out = out * np.uint32(2654435761) + np.where(there, words.data[np.maximum(at, 0)], 0).astype(np.uint32) + np.uint32(1)
    return ((out ^ (out >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(16)).astype(np.int64) % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """key, ending, c of all tokens of ``docs`` (text); the end's ending is ENDINGS."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        ends = 0

        def summed() -> pd.DataFrame:
            return pd.concat(held).groupby("key", sort=False).agg({"ending": "first", "c": "sum"}).reset_index()

        def out(rows: pd.DataFrame) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows["key"].to_numpy(np.int64)), pa.array(rows["ending"].to_numpy(np.int32)), pa.array(rows["c"].to_numpy(np.int64))], ["key", "ending", "c"])

        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            ends += batch.num_rows
            code, keys = pd.factorize(words.hashes().view(np.int64))
            ending = np.zeros(len(keys), np.int64)
            ending[code] = _endings(words)
            held.append(pd.DataFrame({"key": keys, "ending": ending, "c": np.bincount(code, minlength=len(keys))}))
            if sum(map(len, held)) > _COMPACT:
                held = [summed()]
                if len(held[0]) > _COMPACT // 2:
                    yield out(held[0])
                    held = []
        if held:
            yield out(summed())
        if ends:
            yield out(pd.DataFrame({"key": [_END], "ending": [ENDINGS], "c": [ends]}))

    return docs.mapInArrow(task, "key long, ending int, c long").groupBy("key").agg(F.first("ending").alias("ending"), F.sum("c").alias("c"))


def _look_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _with_ends(items: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """Tokens of all texts with an end behind each."""
    return np.insert(items, first[1:], end)


def _before(tokens: np.ndarray, end: int) -> np.ndarray:
    """Each token's predecessor; the end stands before the first text too."""
    return np.concatenate([np.full(min(1, len(tokens)), end, tokens.dtype), tokens[:-1]])


def item_bigrams(docs: DataFrame, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of items that follow each other and how often; core words by place, then the end, then all other words."""
    m = len(core) + 2

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, code = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(code, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            pairs, n = summed(held)
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            at, there = _look_up(core, words.hashes().view(np.int64))
            tokens = _with_ends(np.where(there, at, m - 1), words.first, m - 2)
            held.append(np.unique(_before(tokens, m - 2) * m + tokens, return_counts=True))
            if sum(len(p) for p, _ in held) > _COMPACT:
                held = [summed(held)]
                if len(held[0][0]) > _COMPACT // 2:
                    yield out()
                    held = []
        if held:
            yield out()

    rows = docs.mapInArrow(task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs = rows.column("pair").to_numpy()
    return (pairs // m).astype(np.int32), (pairs % m).astype(np.int32), rows.column("n").to_numpy().astype(float)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def _by_row(rows: np.ndarray, cols: np.ndarray, n: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds of each row's entries, their columns and counts."""
    order = np.argsort(rows, kind="stable")
    return np.searchsorted(rows[order], np.arange(m + 1)), cols[order], n[order]


def exchange(m: int, rows: np.ndarray, cols: np.ndarray, n: np.ndarray, classes: int = CLASSES, sweeps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Class of each of ``m`` items and the classes' bigrams; ``n``: bigrams of items.

    The last item (all other words) is alone in class ``classes``, the one before (the end) in class 0.
    """
    k = classes + 1
    out_n, in_n = np.bincount(rows, n, m), np.bincount(cols, n, m)
    order = np.argsort(-(out_n + in_n), kind="stable")
    order = order[order < m - 2]
    member = np.zeros(m, np.int64)
    member[order] = 1 + np.arange(m - 2) % (classes - 1)
    member[m - 1] = classes
    to = np.bincount(rows.astype(np.int64) * k + member[cols], n, m * k).reshape(m, k)  # of each item: to and from each class
    frm = np.bincount(cols.astype(np.int64) * k + member[rows], n, m * k).reshape(m, k)
    g = np.zeros((k, k))
    np.add.at(g, member, to)
    own = np.bincount(rows[rows == cols], n[rows == cols], m)
    right_at, right_of, right_n = _by_row(rows, cols, n, m)
    left_at, left_of, left_n = _by_row(cols, rows, n, m)
    order = order[(out_n + in_n)[order] > 0]
    diagonal = np.arange(k)
    for _ in range(sweeps):
        moves = 0
        for i in order.tolist():
            a = member[i]
            right, left, same = to[i].copy(), frm[i].copy(), own[i]
            right[a] -= same
            left[a] -= same
            g[a] -= right
            g[:, a] -= left
            g[a, a] -= same
            row_n, col_n = g.sum(1) + left, g.sum(0) + right  # the item's neighbours keep their own places
            f = _xlogx(g)
            by_row, by_col = _xlogx(g + right) - f, _xlogx(g + left[:, None]) - f
            d = g[diagonal, diagonal]
            gain = by_row.sum(1) + by_col.sum(0) - by_row[diagonal, diagonal] - by_col[diagonal, diagonal] + _xlogx(d + right + left + same) - f[diagonal, diagonal]
            gain -= _xlogx(row_n + out_n[i]) - _xlogx(row_n) + _xlogx(col_n + in_n[i]) - _xlogx(col_n)
            gain[[0, classes]] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            g[b] += right
            g[:, b] += left
            g[b, b] += same
            if b != a:
                moves += 1
                member[i] = b
                j, c = left_of[left_at[i] : left_at[i + 1]], left_n[left_at[i] : left_at[i + 1]]
                to[j, a] -= c
                to[j, b] += c
                j, c = right_of[right_at[i] : right_at[i + 1]], right_n[right_at[i] : right_at[i + 1]]
                frm[j, a] -= c
                frm[j, b] += c
        if moves <= len(order) // 500:
            break
    return member, g


def rarer_words(docs: DataFrame, core: np.ndarray, member: np.ndarray, g: np.ndarray) -> DataFrame:
    """key, ending, c, class of every word of ``docs`` (text) outside the core: the class that its neighbours fit best."""
    k = CLASSES + 1
    steps = transitions(g)
    # of a neighbour's class behind, then before a word: what it adds to each class's fit, next to nothing for an empty class
    fit = np.concatenate([steps.T, steps - np.log10((g.sum(0) + 1) / (g.sum() + k))])[:, 1:CLASSES]
    core_class = member.astype(np.uint8)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            if not len(words):
                continue
            keys = words.hashes().view(np.int64)
            at, there = _look_up(core, keys)
            classes = _with_ends(np.where(there, core_class[at], np.uint8(_REST)), words.first, 0)
            behind = np.append(classes[1:], np.uint8(0))
            place = np.flatnonzero(~there) + words.rows()[~there]
            if not len(place):
                continue
            around = np.stack([behind[place], _before(classes, 0)[place] + np.uint8(k)], 1)
            code, own = pd.factorize(keys[~there])
            ending = np.zeros(len(own), np.int32)
            ending[code] = _endings(words)[~there]
            bounds = np.append(0, 2 * np.cumsum(np.bincount(code, minlength=len(own)))).astype(np.int32)
            data = np.ascontiguousarray(around[np.argsort(code, kind="stable")])
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ending), packed], ["key", "ending", "around"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, ending and counts of the last key so far

        def out(keys: np.ndarray, endings: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            own = 1 + np.argmax(counts @ fit, 1)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(endings), pa.array((counts.sum(1) // 2).astype(np.int64)), pa.array(own.astype(np.int32))], ["key", "ending", "c", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, endings = batch.column("key").to_numpy(), batch.column("ending").to_numpy()
            bounds, data = raw(batch.column("around"))
            new = np.append(True, keys[1:] != keys[:-1])
            group = np.cumsum(new) - 1
            counts = np.bincount(np.repeat(group, np.diff(bounds)) * 2 * k + data, minlength=(group[-1] + 1) * 2 * k).reshape(-1, 2 * k)
            keys, endings = keys[new], endings[new]
            if last is not None:
                if last[0][0] == keys[0]:
                    counts[0] += last[2][0]
                else:
                    yield out(*last)
            last = keys[-1:].copy(), endings[-1:].copy(), counts[-1:].copy()
            if len(keys) > 1:
                yield out(keys[:-1], endings[:-1], counts[:-1])
        if last is not None:
            yield out(*last)

    rows = docs.mapInArrow(contexts, "key long, ending int, around binary")
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(best, "key long, ending int, c long, class int")


def transitions(g: np.ndarray) -> np.ndarray:
    """log10 p(column's class | row's class) of the classes' bigrams."""
    share = (g.sum(0) + 1) / (g.sum() + len(g))
    return np.log10((g + TOWARDS * share) / (g.sum(1, keepdims=True) + TOWARDS))


def _classes_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens of a batch's texts, their predecessors', each text's first token."""
    bounds, tokens = raw(batch.column("classes"))
    return tokens, _before(tokens, 0), bounds[:-1]


def class_bigrams(classed: DataFrame) -> np.ndarray:
    """How often each class follows each, over ``classed`` (classes)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            tokens, before, _ = _classes_of(batch)
            n += np.bincount(before.astype(np.int64) * CLASSES + tokens, minlength=CLASSES * CLASSES)
        pairs = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n[pairs])], ["pair", "n"])

    rows = classed.mapInArrow(task, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES * CLASSES)
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(CLASSES, CLASSES)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for all ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    training = docs.where(~F.col("held_out")).select("text")
    vocabulary = written(count_words(training), "vocabulary")
    n, v = (int(x or 0) for x in vocabulary.agg(F.sum("c"), F.count(F.lit(1))).first())
    often = max(2.0, n * OFTEN)
    rows = vocabulary.where((F.col("c") * CORE >= float(np.sqrt(n))) | (F.col("key") == _END)).select("key", "c").orderBy("key").toArrow()
    core, core_c = rows.column("key").to_numpy(), rows.column("c").to_numpy()
    ends = int(core_c[core == _END].sum())
    core, core_c = core[core != _END], core_c[core != _END]
    member, g = exchange(len(core) + 2, *item_bigrams(training, core))
    member = member[: len(core) + 1]  # the end's is last, for a core without words
    rarer = written(rarer_words(training, core, member, g), "rarer")
    # words and tokens of each class, and the class of each ending
    per = rarer.groupBy("ending", "class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow()  # ENDINGS * CLASSES rows at most
    own, per_c, per_v = (per.column(x).to_numpy() for x in ("class", "c", "v"))
    size = np.bincount(member[:-1], core_c, CLASSES) + np.bincount(own, per_c, CLASSES)
    words_in = np.bincount(member[:-1], minlength=CLASSES) + np.bincount(own, per_v, CLASSES)
    size[0], words_in[0] = ends, 1
    bins = np.bincount(per.column("ending").to_numpy().astype(np.int64) * CLASSES + own, per_v, ENDINGS * CLASSES).reshape(ENDINGS, CLASSES)
    most = 1 + int(np.argmax(bins.sum(0)[1:]))
    of_ending = np.where(bins.any(1), bins.argmax(1), most).astype(np.uint8)
    below = np.log10(size + ADD * (words_in + 1))
    rows = rarer.where(F.col("c") >= often).select("key", "c", "class").toArrow()  # 1 / OFTEN rows at most
    known_keys = np.concatenate([core, rows.column("key").to_numpy()])
    by = np.argsort(known_keys)
    known_c = np.concatenate([core_c, rows.column("c").to_numpy()])[by]
    known_class = np.concatenate([member[:-1], rows.column("class").to_numpy()])[by].astype(np.uint8)
    model = spark.sparkContext.broadcast((known_keys[by], known_c, known_class))
    end_known, end_log = int(ends > 0), float(np.log10(ends + ADD))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, classes binary, keys array<long>, endings array<int>, places array<int>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys_known, c_known, class_known = model.value
        row = TaskContext.get().partitionId() << 40
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"))
            texts = batch.num_rows
            code, keys = pd.factorize(words.hashes().view(np.int64))
            at, frequent = _look_up(keys_known, keys)
            logs, own = np.zeros(len(keys)), np.full(len(keys), _OPEN)
            logs[frequent], own[frequent] = np.log10(c_known[at[frequent]] + ADD), class_known[at[frequent]]
            ending = np.zeros(len(keys), np.int32)
            ending[code] = _endings(words)
            place = words.rows()
            total = np.bincount(place, logs[code], texts) + end_log
            known = np.bincount(place, frequent[code], texts).astype(np.int64) + end_known
            classes = _with_ends(own[code], words.first, 0)
            packed = pa.BinaryArray.from_buffers(pa.binary(), texts, [None, pa.py_buffer((words.first + np.arange(texts + 1)).astype(np.int32)), pa.py_buffer(classes)])
            # each text's distinct rarer words, and for each of its rarer tokens which of them it is
            rare = ~frequent[code]
            pair, which = np.unique(place[rare] * max(1, len(keys)) + code[rare], return_inverse=True)
            bounds = np.searchsorted(pair, np.arange(texts + 1) * max(1, len(keys))).astype(np.int32)
            tokens = np.searchsorted(place[rare], np.arange(texts + 1)).astype(np.int32)
            pair %= max(1, len(keys))
            arrays = [(bounds, keys[pair]), (bounds, ending[pair]), (tokens, (which - bounds[place[rare]]).astype(np.int32))]
            lists = [pa.ListArray.from_arrays(pa.array(b), pa.array(x)) for b, x in arrays]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(texts)), batch.column("doc_id"), batch.column("held_out"), pa.array(words.counts.astype(np.int64) + 1), pa.array(known), pa.array(total), packed, *lists], ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "classes", "keys", "endings", "places"])
            row += texts

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.num_rows
            bounds, classes = raw(batch.column("classes"))
            classes = classes.copy()
            at, endings = _flat(batch.column("endings"))
            token_at, places = _flat(batch.column("places"))
            c, own = np.zeros(len(endings)), of_ending[endings]
            found_at, found = _flat(batch.column("found"))
            if len(found):
                i, found_c, found_class = (found.field(x).to_numpy() for x in ("i", "c", "class"))
                i = i + np.repeat(at[:-1], np.diff(found_at))
                c[i], own[i] = found_c, found_class
            text = np.repeat(np.arange(texts), np.diff(token_at))
            word = places + at[:-1][text]
            classes[classes == _OPEN] = own[word]
            known = batch.column("known").to_numpy() + np.bincount(text, c[word] > 0, texts).astype(np.int64)
            logs = batch.column("logs").to_numpy() + np.bincount(text, np.log10(c[word] + ADD), texts)
            packed = pa.BinaryArray.from_buffers(pa.binary(), texts, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(classes)])
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "held_out", "n_tokens")), pa.array(known), pa.array(logs), packed], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "classes"])

    scored = written(docs.mapInArrow(task, schema), "scored")
    rare = scored.select("row", F.posexplode("keys").alias("i", "key"))
    found = rare.join(rarer.where(F.col("c") < often).select("key", "c", "class"), "key")
    found = found.groupBy("row").agg(F.collect_list(F.struct("i", "c", "class")).alias("found"))
    filled = scored.drop("keys").join(found, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<i:int,c:bigint,class:int>>")))
    classed = written(filled.mapInArrow(fill, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, classes binary"), "classed")
    steps = transitions(class_bigrams(classed.where(~F.col("held_out")).select("classes")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens, before, first = _classes_of(batch)
                fit = np.add.reduceat(steps[before, tokens] - below[tokens], first)
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "logs")), pa.array(fit)], ["doc_id", "held_out", "n_tokens", "n_known", "logs", "model"])

    rows = classed.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, model double")
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(n + ADD * (v + 1))))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + F.col("logs")).alias("score"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray | pa.StructArray]:
    """Bounds, from 0, and values of a list array."""
    bounds, values = column.offsets.to_numpy().astype(np.int64), column.flatten()
    return bounds - bounds[0], values if pa.types.is_struct(values.type) else values.to_numpy(zero_copy_only=False)
