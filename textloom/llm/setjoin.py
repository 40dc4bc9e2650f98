"""N-gram Jaccard join with set-relation skipping, exact, and the components of its links.

A document's set is its distinct 5-word shingles (64-bit hashes).  Equal sets are one node.

1. Order.  Shingles are ordered by a fixed-size table of how often they occur (rarer first; a
   logarithmic level) and then by hash.  Any order is exact; this one keeps passages that many
   documents share out of the indexed part.  The table has ``CELLS`` bytes whatever the input.
2. Index.  Two sets of similarity 0.8 share one of their first ``n - ceil(0.8 n) + 1`` shingles.
   These make inverted lists; lists of one set are dropped.  Pairs that meet in lists of up to
   ``FEW`` sets are counted, and compared if they share enough; so all that meet there are settled.
   A longer list is cut in classes of size by factors of 1.25, so that linked sets are in the same
   class or neighbouring ones.
3. Answers of the leaders.  The leader of a long list's class is the set with fewest rare shingles, which
   of a group of near copies is the most central and leads all lists that it is in.  Every other
   member is compared with it, a comparison that most lists of a
   group share, and neighbouring classes' leaders with each other.  Links found so far are merged
   to components.
4. Block skipping.  Members of a list that agree in leader, size, position and distance to the
   leader are a block.  Of two blocks, sizes, positions in the order and the distances (Jaccard
   distance is a metric, so ``|d(x,l) - d(y,l)|`` bounds ``d(x,y)`` from below) skip nearly all
   pairs at once, and pairs within a component are settled.  A set with a pair left joins the pool
   of the leader in question.
5. Answers derived.  In a pool, the sets outside its largest component ask all of it: counting
   sketches bound the intersections from above.  Of what they allow, each set compares its best
   candidate of each component first; links merge components and settle the others.  Sets with
   candidates left ask again, for more of them, until none has any.

Comparing moves texts, not sets: compressed text is smaller than its hashes.  A leader's members
are dealt over several groups with a copy of the leader each.  Groups of copies thus cost one
comparison a member and leader, and no link between different sets is lost.

Defined cases: documents without words have an empty set and are linked with nothing; one with
fewer than 5 words has one shingle, the whole sequence; a null id is linked like any other but
never names a component, unless it has only null ids; repeated rows are all returned, repeated ids
with different texts are different documents; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import components
from textloom.llm.storage import small, swept, temporary, written
from textloom.llm.words import Words, mix, pieces, shingles

CELLS, BLOCK = 1 << 23, 1 << 15
MEMBERS, ASKERS, SKETCH = 1000, 1000, 512
#: Keys sent to every task at once; more are joined by shuffles.
_SEND_WHOLE = 200_000
#: Lists of so many sets are taken as pairs.
FEW = 3
#: Candidates of a set and group in the first round of a pool, and the factor from round to round.
FIRST, MORE = 4, 8
#: Bytes of text whose words and shingles a worker holds at once.
_PIECE = 2 << 20
#: Steps of the distance to the leader.
_STEPS = 100


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    words = Words(batch.column("text"))
    return shingles(words.hashes(), words.first)


def _signature(own: np.ndarray) -> int:
    total = np.array([own.sum(dtype=np.uint64) + np.uint64(len(own))], np.uint64)
    return int(mix(total).view(np.int64)[0])


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(41)).astype(np.int64)


def frequent_cells(docs: DataFrame) -> np.ndarray:
    """A byte for each cell: 0, or the binary logarithm of how often its shingles occur more than by chance.

    Tasks count in blocks of cells, which are added up block by block.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, np.int32)
        for batch in pieces(batches, "text", _PIECE):
            np.add.at(n, _cells(np.concatenate(list(_sets(batch)))), 1)
        own = np.minimum(n, 65535).astype(np.uint16).reshape(-1, BLOCK)
        full = np.flatnonzero(own.any(1))
        for k in full:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(own[k] & 255).astype(np.uint8).tobytes()], pa.binary()), pa.array([(own[k] >> 8).astype(np.uint8).tobytes()], pa.binary())], ["block", "low", "high"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = None, np.zeros(BLOCK, np.int64)
        for batch in batches:
            for k, low, high in zip(*(batch.column(c).to_pylist() for c in ("block", "low", "high")), strict=True):
                if k != key and key is not None:
                    yield level(key, n)
                    n = np.zeros(BLOCK, np.int64)
                key = k
                n += np.frombuffer(low, np.uint8) + 256 * np.frombuffer(high, np.uint8).astype(np.int64)
        if key is not None:
            yield level(key, n)

    def level(key: int, n: np.ndarray) -> pa.RecordBatch:
        chance = np.median(n)  # cells of chance are most of them
        more = n - chance
        out = np.where(more >= 3 + 4 * np.sqrt(chance), np.log2(np.maximum(more, 1)), 0).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["block", "levels"])

    counted = docs.mapInArrow(task, "block int, low binary, high binary").repartition(partitions, "block").sortWithinPartitions("block")
    out = np.zeros((CELLS // BLOCK, BLOCK), np.uint8)
    for row in counted.mapInArrow(add, "block int, levels binary").toLocalIterator():  # CELLS bytes
        out[row["block"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, xh, n, sig for each document; xh tells texts apart, sig sets; sig is null for an empty set."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _PIECE):
            own = list(_sets(batch))
            n = np.array([len(x) for x in own], np.int64)
            sig = np.array([_signature(x) if len(x) else 0 for x in own], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("xh"), pa.array(n), pa.array(sig, mask=n == 0)], ["doc_id", "xh", "n", "sig"])

    return docs.withColumn("xh", F.xxhash64("text")).mapInArrow(task, "doc_id long, xh long, n long, sig long")


def prefixes(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """h, rare, pos, n, sig: each task's distinct sets under the shingles they are indexed by; rare counts a set's rare shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # CELLS bytes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, "text", _PIECE):
            parts, sigs, sizes, rare = [], [], [], []
            for own in _sets(batch):
                n = len(own)
                if not n or (sig := _signature(own)) in seen:
                    continue
                seen.add(sig)
                level = shared.value[_cells(own)]
                rare.append(n - np.count_nonzero(level))
                if rare[-1] < n:
                    own = own[np.argsort(level, kind="stable")]
                parts.append(own[: n - -(-4 * n // 5) + 1])
                sigs.append(sig)
                sizes.append(n)
            if parts:
                length = [len(p) for p in parts]
                pos = np.arange(sum(length)) - np.repeat(np.cumsum(length) - length, length)
                columns = [np.concatenate(parts).view(np.int64), np.repeat(np.array(rare, np.int32), length), pos.astype(np.int32), np.repeat(np.array(sizes, np.int32), length), np.repeat(sigs, length)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "rare", "pos", "n", "sig"])

    return docs.mapInArrow(task, "h long, rare int, pos int, n int, sig long")


def _arrays(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def lists(prefix: DataFrame) -> DataFrame:
    """Lists of more than ``FEW`` sets, a row a set: h, class, leader, asks, sig, n, pos; shorter ones as pairs.

    ``asks`` is whom the set is compared with: its leader, or the class before's if it leads itself;
    null if the list lacks that or their sizes and positions allow no link.  A pair of a short list
    is (leader, sig) with the sizes (pos, n), and its class is null.
    """
    partitions = int(prefix.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ("h", "class", "pos", "n", "sig")
    out_names = ["h", "class", "leader", "asks", "sig", "n", "pos"]

    def pairs(rows: list[np.ndarray], starts: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        """Of lists of 2 to FEW sets."""
        ends = [(starts[length > k] + i, starts[length > k] + k) for k in range(1, FEW) for i in range(k)]
        one, other = (np.concatenate(x) for x in zip(*ends, strict=True))
        h, _, _, n, sig = rows
        near = 5 * np.minimum(n[one], n[other]).astype(np.int64) >= 4 * np.maximum(n[one], n[other]).astype(np.int64)
        one, other = one[near], other[near]
        one, other = np.where(sig[one] < sig[other], one, other), np.where(sig[one] < sig[other], other, one)
        none = pa.nulls(len(one), pa.int32()), pa.nulls(len(one), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(h[one]), none[0], pa.array(sig[one]), none[1], pa.array(sig[other]), pa.array(n[other]), pa.array(n[one])], out_names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last long list's row's h, class, leader and the leader's n and pos; the last list's rows while they are few
        head, held, last = (0, 0, 0, 0, 0), [np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int32, np.int64)], None
        going = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _arrays(batch, names)
            h, sig = rows[0], rows[4]
            new = np.append(last != (h[0], sig[0]), (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]))
            last = (h[-1], sig[-1])
            rows = [np.append(x, c[new]) for x, c in zip(held, rows, strict=True)]
            h = rows[0]
            if not len(h):
                continue
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            length = np.diff(np.append(starts, len(h)))
            goes_on = going and head[0] == h[0]
            long = length > FEW
            long[0] |= goes_on
            going = bool(long[-1])
            cut = len(h) if going else starts[-1]
            held = [c[cut:] for c in rows]
            few = ~long & (length > 1)
            few[-1] &= going  # else held
            if few.any():
                yield pairs(rows, starts[few], length[few])
            of_long = np.repeat(long, length)
            if not of_long.any():
                continue
            h, of_size, pos, n, sig = (c[of_long] for c in rows)
            same = np.append(goes_on, h[1:] == h[:-1])
            opens = ~same | (of_size != np.append(head[1], of_size[:-1]))
            at, which = np.flatnonzero(opens), np.cumsum(opens)
            # classes, after the one that may go on
            of_list, classes, leaders, sizes, places = (np.append(x, c[at]) for x, c in zip(head, (h, of_size, sig, n, pos), strict=True))
            follows = np.append(False, same[at] & (of_list[1:] == of_list[:-1]) & (classes[1:] == classes[:-1] + 1))
            asked = np.where(opens, which - 1, which)
            near = 9 * np.minimum(n - pos, (sizes - places)[asked]).astype(np.int64) >= 4 * (n + sizes[asked]).astype(np.int64)
            near &= ~opens | follows[which]
            head = (h[-1], of_size[-1], leaders[-1], sizes[-1], places[-1])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(of_size), pa.array(leaders[which]), pa.array(leaders[asked], mask=~near), pa.array(sig), pa.array(n), pa.array(pos)], out_names)
        if len(held[0]) > 1:
            yield pairs(held, np.zeros(1, int), np.array([len(held[0])]))

    dealt = prefix.repartition(partitions, "h").withColumn("class", F.floor(F.log("n") / math.log(1.25)).cast("int"))
    dealt = dealt.sortWithinPartitions("h", "class", "rare", "sig").drop("rare")
    return dealt.mapInArrow(task, "h long, class int, leader long, asks long, sig long, n int, pos int")


def pairs_of_short_lists(index: DataFrame) -> DataFrame:
    """a, b: pairs of short lists that share enough of what both are indexed by.

    With c shared shingles among the first ones of two sets, no more than c and what is left of the
    set whose indexed part ends later are common.  Long lists add to c at most as many as they hold
    the set.
    """
    pairs = index.where("class is null").groupBy(F.col("leader").alias("a"), F.col("sig").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first("pos").alias("na"), F.first("n").alias("nb"))
    held = index.where("class is not null").groupBy("sig").agg(F.count(F.lit(1)).alias("held"))
    for side in "ab":
        pairs = pairs.join(held.select(F.col("sig").alias(side), F.col("held").alias(f"held_{side}")), side, "left")
    most = F.col("c") + F.least(F.coalesce("held_a", F.lit(0)), F.coalesce("held_b", F.lit(0))) + F.ceil(F.greatest("na", "nb") * 4 / 5) - 1
    return pairs.where(9 * most >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


def pairs_with_leaders(index: DataFrame) -> DataFrame:
    """asks, sig: whom a set of long lists is compared with.

    Not those that it shares so few lists with that a link is unlikely; they stay open.
    """
    pairs = index.where("asks is not null").groupBy("asks", "sig").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    return pairs.where(2 * F.col("c") >= F.col("n") * (8 / 9 - 4 / 5)).select("asks", "sig")


def _sent(keys: DataFrame) -> DataFrame:
    """``keys``, sent whole if they are few."""
    return F.broadcast(keys) if keys.count() <= _SEND_WHOLE else keys


def texts_of(sigs: DataFrame, docs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """sig, text for each of ``sigs`` (sig), and what deletes this table; nodes: sig, doc_id, xh, rows."""
    needed = small(sigs.distinct().join(nodes, "sig").select("sig", F.col("doc_id").alias("_id"), F.col("xh").alias("_xh"), "rows"))
    found = docs.join(_sent(needed), docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_xh")))
    texts = found.where("rows = 1").select("sig", "text")
    if not needed.where("rows > 1").isEmpty():  # repeated rows
        texts = texts.unionByName(found.where("rows > 1").groupBy("sig").agg(F.first("text").alias("text")))
    return temporary(texts, "texts")


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``na``, ``nb`` and ``common``, the sizes of the sets and of the intersection; best where many share their a."""
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("groups"))
    members = pairs.join(deal, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("sig"))
    leaders = deal.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("sig"))
    rows = members.unionByName(leaders).join(texts, "sig").select("a", "part", "role", "sig", "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader = None, None
        for batch in pieces(batches, "text", _PIECE):
            a, part, role, sig = _arrays(batch, ("a", "part", "role", "sig"))
            found = []
            for k, own in enumerate(_sets(batch)):
                if role[k] == 0:
                    key, leader = (a[k], part[k]), own
                elif key == (a[k], part[k]):
                    at = np.searchsorted(leader, own)
                    at[at == len(leader)] = 0
                    found.append((a[k], sig[k], len(leader), len(own), int((leader[at] == own).sum())))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b", "na", "nb", "common"])

    dealt = rows.repartition(partitions, "a", "part").sortWithinPartitions("a", "part", "role", "sig")
    return small(dealt.mapInArrow(task, "a long, b long, na long, nb long, common long"))


def _links(compared: DataFrame) -> DataFrame:
    return compared.where("100 * common >= 80 * (na + nb - common)").select("a", "b")


def _open_blocks(key: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of one list's blocks: leader of a pool, blocks in it, and for each the least and greatest component among those it can link with."""
    of_size, leader, n, pos, step = key
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    rest = n - pos  # what is left from this place on bounds the intersection
    for c in np.unique(of_size):
        ours = np.flatnonzero(of_size == c)
        all_ = np.flatnonzero((of_size == c) | (of_size == c + 1))
        if low[all_].min() == high[all_].max():
            continue
        lows, highs = np.full(len(all_), np.iinfo(np.int64).max), np.full(len(all_), np.iinfo(np.int64).min)
        place = np.searchsorted(all_, ours)
        for a in range(0, len(ours), 128):
            i, at = ours[a : a + 128], place[a : a + 128]
            both = n[i][:, None] + n[all_]
            ok = 9 * np.minimum(rest[i][:, None], rest[all_]) >= 4 * both
            # of the same leader, with both distances known; a step less than the gap is sure
            gap = np.abs(step[i][:, None] - step[all_])
            ok &= ~((of_size[all_] == c) & (step[i][:, None] >= 0) & (step[all_] >= 0) & (5 * (gap - 1) > _STEPS))
            big = np.where(ok, low[all_], np.iinfo(np.int64).max)
            small_ = np.where(ok, high[all_], np.iinfo(np.int64).min)
            lows[at], highs[at] = np.minimum(lows[at], big.min(1)), np.maximum(highs[at], small_.max(1))
            lows = np.minimum(lows, np.where(ok, low[i][:, None], np.iinfo(np.int64).max).min(0))
            highs = np.maximum(highs, np.where(ok, high[i][:, None], np.iinfo(np.int64).min).max(0))
        hit = (lows < high[all_]) | (highs > low[all_])
        if hit.any():
            yield leader[ours[0]], all_[hit], lows[hit], highs[hit]


def open_sets(index: DataFrame, answers: DataFrame) -> DataFrame:
    """pool, sig: sets with a pair in a list that sizes, positions, distances and components leave open.

    ``index``: the lists; ``answers``: leader, sig, component, step (of the distance, null if unknown).
    """
    partitions = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["h", "class", "leader", "n", "pos"]
    rows = index.join(answers, ["leader", "sig"])
    blocks = rows.groupBy(*place, "step").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    names = ("h", "class", "leader", "n", "pos", "step", "low", "high")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # blocks of the list that may go on

        def close() -> Iterator[pa.RecordBatch]:
            h, *key, low, high = (np.concatenate(c) for c in zip(*held, strict=True))
            cuts = np.append(np.flatnonzero(np.append(True, h[1:] != h[:-1])), len(h))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a < 2 and low[a] == high[a]:
                    continue
                for pool, at, lows, highs in _open_blocks([c[a:b] for c in key], low[a:b], high[a:b]):
                    k = a + at
                    columns = [h[k], *[c[k] for c in key], np.full(len(k), pool), lows, highs]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "class", "leader", "n", "pos", "step", "pool", "lows", "highs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = _arrays(batch, names)
            cut = int(np.searchsorted(own[0], own[0][-1]))
            if held and held[-1][0][-1] != own[0][0]:
                yield from close()
                held = []
            if cut:
                held.append([c[:cut] for c in own])
                yield from close()
                held, own = [], [c[cut:] for c in own]
            held.append(own)
        if held:
            yield from close()

    dealt = blocks.withColumn("step", F.coalesce("step", F.lit(-1))).repartition(partitions, "h").sortWithinPartitions("h")
    asked = small(dealt.mapInArrow(task, "h long, class int, leader long, n int, pos int, step int, pool long, lows long, highs long"))
    if asked.isEmpty():
        return asked.select("pool", F.col("n").cast("long").alias("sig"))
    again = index.join(_sent(small(asked.select("h").distinct())), "h").join(answers, ["leader", "sig"]).withColumn("step", F.coalesce("step", F.lit(-1)))
    found = again.join(asked, [*place, "step"]).where((F.col("lows") < F.col("component")) | (F.col("highs") > F.col("component")))
    return small(found.select("pool", "sig").distinct())


def sketches_of(texts: DataFrame) -> DataFrame:
    """sig, n, sketch of ``texts`` (sig, text).

    The sketch counts a set's shingles by ``SKETCH`` cells of their hash, a byte each (null if one
    doesn't fit): the cells' smaller counts add up to an upper bound of an intersection.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", _PIECE):
            own = list(_sets(batch))
            cells = (np.bincount((x % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) for x in own)
            sketch = [c.astype(np.uint8).tobytes() if c.max() < 256 else None for c in cells]
            yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array([len(x) for x in own], pa.int64()), pa.array(sketch, pa.binary())], ["sig", "n", "sketch"])

    return texts.mapInArrow(task, "sig long, n long, sketch binary")


_EVEN = np.uint64(0x00FF00FF00FF00FF)


def _shared(own: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """For each row of ``own`` the sum of its bytes' minima with ``sketch``."""
    least = np.minimum(own, sketch).view(np.uint64)
    pairs = ((least & _EVEN) + ((least >> np.uint64(8)) & _EVEN)).sum(1)  # 16 bits hold each of the four sums
    return sum((pairs >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4))


def possible_links(asking: DataFrame, pools: DataFrame, sketches: DataFrame, most_of_each: int, every: bool) -> DataFrame:
    """a, b, left: pairs of an asking set and one of its pool, of another component, whose sketches allow a link.

    ``asking``, ``pools``: pool, sig, component.  Of each group that a set meets, it names at most
    ``most_of_each`` candidates, the best first, and unless ``every`` only one of each component;
    ``left`` tells whether it has others.  Both sides are dealt over a grid of groups, so that no
    group grows with the pool.
    """
    partitions = int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows_ = asking.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / ASKERS).cast("int").alias("rows"))
    grid = small(rows_.join(pools.groupBy("pool").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("columns")), "pool"))

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def one(count: str) -> Column:
        return F.pmod(F.xxhash64("sig"), F.col(count)).cast("int")

    asks = asking.join(grid, "pool").select("pool", one("rows").alias("i"), each("columns").alias("j"), F.lit(0).alias("role"), "sig", "component")
    told = pools.join(grid, "pool").select("pool", each("rows").alias("i"), one("columns").alias("j"), F.lit(1).alias("role"), "sig", "component")
    rows = asks.unionByName(told).join(sketches, "sig").select("pool", "i", "j", "role", "sig", "component", "n", "sketch")
    full = np.full(SKETCH, 255, np.uint8).tobytes()  # bounds nothing

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, askers = None, []
        for batch in batches:
            keys = np.stack(_arrays(batch, ("pool", "i", "j", "role")), 1)
            sig, part, n = _arrays(batch, ("sig", "component", "n"))
            loose = np.asarray(batch.column("sketch").is_null())
            table = np.frombuffer(b"".join(x if x is not None else full for x in batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
            cuts = np.append(np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1))), len(keys)) if len(keys) else np.zeros(1, int)
            found: list[tuple[int, int, bool]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if key != tuple(keys[a][:3]):
                    key, askers = tuple(keys[a][:3]), []
                if keys[a][3] == 0:
                    askers += [(sig[k], part[k], int(n[k]), table[k], loose[k]) for k in range(a, b)]
                    continue
                own_n, own_sig, own_part, own, own_loose = n[a:b], sig[a:b], part[a:b], table[a:b], loose[a:b]
                for who, home, size, sketch, unsure in askers:
                    most = np.minimum(np.minimum(own_n, size), np.where(own_loose | unsure, size, _shared(own, sketch)))
                    hit = np.flatnonzero((9 * most >= 4 * (own_n + size)) & (own_part != home))
                    if not len(hit):
                        continue
                    order = hit[np.lexsort((own_sig[hit], -most[hit] / (own_n[hit] + size)))]
                    best = order if every else order[np.sort(np.unique(own_part[order], return_index=True)[1])]
                    best = best[:most_of_each]
                    found += [(who, x, len(best) < len(hit)) for x in own_sig[best]]
            if found:
                who, whom, left = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(whom, pa.int64()), pa.array(left)], ["a", "b", "left"])

    dealt = rows.repartition(partitions, "pool", "i", "j").sortWithinPartitions("pool", "i", "j", "role", "sig")
    return small(dealt.mapInArrow(task, "a long, b long, left boolean"))


def _placed(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` (sig) with their component; a set without links is its own."""
    return rows.join(merged.select(F.col("node").alias("sig"), "component"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))


def _joined(merged: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further ``links`` (a, b)."""
    ends = _placed(_placed(links.select("a", F.col("b").alias("sig")), merged).select(F.col("component").alias("b"), F.col("a").alias("sig")), merged)
    more = small(components(ends.select(F.col("component").alias("a"), "b")))
    to = more.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = merged.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return small(moved.unionByName(more.join(merged.select("node"), "node", "left_anti")))


def settled(pools: DataFrame, merged: DataFrame, compared: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Components after all open pairs of ``pools`` (pool, sig) are settled."""
    texts, drop = texts_of(pools.select("sig"), docs, nodes)
    sketches, drop_sketches = temporary(sketches_of(texts), "sketches")
    done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    asking, most_of_each = None, FIRST
    while True:
        placed = small(_placed(pools, merged))
        shares = placed.groupBy("pool", "component").agg(F.count(F.lit(1)).alias("n"))
        largest = shares.groupBy("pool").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        asks = placed.join(largest, "pool")
        if asking is None:
            asks = asks.where("component <> largest").select("pool", "sig", "component")
        else:
            asks = small(asks.join(asking, "sig", "left_semi").select("pool", "sig", "component"))
            if asks.isEmpty():  # what they could still link with has been merged
                break
        found = possible_links(asks, placed, sketches, most_of_each, every=asking is not None)
        pairs = small(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(done, ["a", "b"], "left_anti"))
        answers = compare(pairs, texts)
        done = done.unionByName(pairs)
        merged = _joined(merged, _links(answers))
        asking = small(found.where("left").select(F.col("a").alias("sig")).distinct())
        if asking.isEmpty():
            break
        most_of_each *= MORE
    drop_sketches()
    drop()
    return merged


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, xh, n, sig, component, component_id for all ``docs`` (doc_id, text); component names a component of sets, null ids or not."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = written(signatures(docs), "sets")
    one = table.where("sig is not null").groupBy("sig", "doc_id", "xh").agg(F.count(F.lit(1)).alias("rows"))
    nodes = small(one.groupBy("sig").agg(F.min(F.struct("doc_id", "xh", "rows")).alias("x"), F.min("doc_id").alias("least")).select("sig", "x.doc_id", "x.xh", "x.rows", "least"))
    levels = frequent_cells(docs)
    index, drop = temporary(lists(prefixes(docs, levels)), "lists")
    pairs = pairs_with_leaders(index).select(F.least("asks", "sig").alias("a"), F.greatest("asks", "sig").alias("b"), F.col("asks").alias("leader"))
    pairs = small(pairs.unionByName(pairs_of_short_lists(index).withColumn("leader", F.col("a"))).groupBy("a", "b").agg(F.min("leader").alias("leader")))
    pairs = pairs.select(F.col("leader").alias("a"), F.when(F.col("leader") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("b"))
    index = index.where("class is not null")
    texts, drop_texts = texts_of(pairs.select(F.col("a").alias("sig")).union(pairs.select("b")), docs, nodes)
    compared = compare(pairs, texts)
    drop_texts()
    merged = components(_links(compared))
    # each member's component and distance to its leader; the leader's own row too
    step = F.floor(_STEPS * (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))).cast("int")
    known = compared.select("a", "b", step.alias("step"))
    known = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "step")).select(F.col("a").alias("leader"), F.col("b").alias("sig"), "step")
    answers = index.select("leader", "sig").distinct().join(known, ["leader", "sig"], "left")
    answers = answers.withColumn("step", F.when(F.col("leader") == F.col("sig"), 0).otherwise(F.col("step")))
    pools = open_sets(index, small(_placed(answers, merged)))
    drop()
    if not pools.isEmpty():
        merged = settled(pools, merged, compared, docs, nodes)
    named = _placed(nodes.select("sig", "least"), merged)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = small(named.join(least, "component").select("sig", "component", "component_id"))
    swept(docs.sparkSession)
    return table.join(named, "sig", "left")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for all ``docs`` (doc_id, text)."""
    rows = _named(docs)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component of sets, of smallest id and then signature; a null id comes last.

    Rows with an empty set are linked with nothing: of those with the same id one stays, of those
    without an id all.
    """
    named = _named(docs)
    full, key = named.where("sig is not null"), [F.col("doc_id").alias("_id"), F.col("xh").alias("_xh")]
    first = F.struct(F.col("doc_id").isNull().alias("later"), "doc_id", "sig", "xh")
    kept = small(full.groupBy("component").agg(F.min(first).alias("x")).select("x.*")).select(*key)
    counted = full.groupBy("doc_id", "xh").agg(F.count(F.lit(1)).alias("rows")).select(*key, "rows")
    counted = small(counted.join(kept.withColumn("stays", F.lit(True)), (counted["_id"].eqNullSafe(kept["_id"])) & (counted["_xh"] == kept["_xh"]), "left").select(counted["_id"], counted["_xh"], "rows", F.coalesce("stays", F.lit(False)).alias("stays")))
    empty = small(named.where("sig is null").select(*key).distinct())
    again = counted.where("stays and rows > 1").select("_id", "_xh")
    rows = docs.withColumn("_own", F.col("doc_id").cast("long")).withColumn("_hash", F.xxhash64(F.col("text").cast("string")))

    def joined(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        return left.join(_sent(keys), left["_own"].eqNullSafe(F.col("_id")) & (left["_hash"] == F.col("_xh")), how)

    out = joined(rows, counted.where("not stays").select("_id", "_xh"), "left_anti")
    special = again.unionByName(empty)
    if not special.isEmpty():
        blank = joined(rows, empty, "left_semi")
        parts = [joined(rows, again, "left_semi").dropDuplicates(["_own", "_hash"]), blank.where("_own is not null").dropDuplicates(["_own"]), blank.where("_own is null")]
        out = joined(out, special, "left_anti")
        for part in parts:
            out = out.unionByName(part)
    return out.select(*docs.columns)
