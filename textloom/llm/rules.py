"""Quality rules: document statistics and a learned decision list, as Spark expressions.

Statistics of each whole text are array expressions in the row.  Labelled documents' statistics
teach a list of rules by sequential covering: a rule grows by the threshold that gains most
information about the rejected class on two thirds of the rows it still has to explain, is pruned
back on the other third, and joins the list if it is precise enough there; the rows it covers are
then set aside.  The list becomes one ordered ``when`` expression, whose first fitting rule rejects.

Only learning has a bound: the ``LABELLED`` labelled documents of smallest hash.  Their
statistics, a few numbers a row, are what the driver sees.

Defined cases: a null text has no words, and all statistics are 0, which fails the base rules;
null and unlabelled ids only take part in judging; ids labelled twice count as the worse label;
repeated rows are judged each; other columns are ignored; without labels, or with one class only,
the list is empty and only the base rules reject.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELLED = 6000
_BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_exclaim")
#: What rules look at: counts in relation to each other.
FEATURES: dict[str, tuple[str, str]] = {
    "symbols_per_word": ("n_symbols", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "dup_lines_per_word": ("n_dup_lines", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "exclaim_per_word": ("n_exclaim", "n_words"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(hashes: Column) -> Column:
    """Words in 5-word windows that are found twice or more."""

    def windows(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - 5)
        return F.when(F.size(h) < 5, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)])))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(places, k + 1) - p, F.lit(5))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeats(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = F.filter(s, lambda x, k: F.coalesce((k > 0) & (F.get(s, k - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
            return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(placed, twice))

    return let(hashes, lambda h: let(windows(h), repeats))


def statistics(text: Column) -> Column:
    """A struct of COUNTS (long) of each text."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        values = {
            "n_words": F.size(w),
            "word_chars": F.length(F.array_join(w, "")),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": _repeat_words(F.transform(w, lambda x: F.xxhash64(x))),
            "n_upper": F.regexp_count(text, F.lit(r"[A-Z]")),
            "n_exclaim": F.regexp_count(text, F.lit(r"[!?]")),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(words, counts)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (F.lit(100) * s["n_repeat_words"] > F.lit(20) * s["n_words"])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, s: Column) -> Column:
        over, under = FEATURES[self.feature]
        # without division: over / under > threshold, false where under is 0
        left, right = s[over].cast("double"), F.lit(self.threshold) * s[under]
        return (s[under] > 0) & (left > right if self.above else left <= right)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; each rejects what fulfils all its conditions."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def rejected_by(self, s: Column) -> Column:
        """Name of the first rule that fits, null if none does."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            fits = F.lit(True)
            for c in rule:
                fits = fits & c.column(s)
            out = F.when(fits, F.lit(" and ".join(map(str, rule)))).otherwise(out)
        return out


def _matrix(rows: list) -> np.ndarray:
    out = np.full((len(rows), len(FEATURES)), np.nan)
    for k, (over, under) in enumerate(FEATURES.values()):
        a, b = (np.array([r[c] for r in rows], float) for c in (over, under))
        np.divide(a, b, out=out[:, k], where=b > 0)
    return out


def cover(x: np.ndarray, bad: np.ndarray, precision: float = 0.99, most_rules: int = 12, most_conditions: int = 4, least_covered: int = 3) -> DecisionList:
    """Sequential covering; ``x``: a row of FEATURES each, nan where undefined; ``bad``: to be rejected."""
    candidates, masks, gaps = [], [], []
    for k, feature in enumerate(FEATURES):
        known = np.sort(x[~np.isnan(x[:, k]), k])
        if not len(known):
            continue
        percentiles = np.quantile(known, np.linspace(0.01, 0.99, 99), method="lower")
        tails = known[(known < percentiles[0]) | (known >= percentiles[-1])]  # every value there: a kind of junk may be rarer than 1 %
        cuts = np.unique(np.concatenate([percentiles, tails]))
        for cut, next_ in zip(cuts, [*cuts[1:], known[-1]], strict=True):
            middle = float((cut + next_) / 2)
            for above in (True, False):
                candidates.append(Condition(feature, above, middle))
                gaps.append(next_ - cut)
                masks.append(x[:, k] > middle if above else x[:, k] <= middle)
    if not masks:
        return DecisionList()
    table = np.array(masks)
    prune = np.arange(len(x)) % 3 == 0
    left, rules = np.ones(len(x), bool), []

    def worth(mask: np.ndarray) -> tuple[float, int]:
        p, n = int((mask & bad).sum()), int((mask & ~bad).sum())
        return (p - n) / max(1, p + n), p

    while len(rules) < most_rules and (left & bad & ~prune).any():
        now, rule = left & ~prune, []
        while len(rule) < most_conditions and (now & ~bad).any():
            p, n = (now & bad).sum(), (now & ~bad).sum()
            ps, ns = table @ (now & bad).astype(np.int32), table @ (now & ~bad).astype(np.int32)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ps > 0, ps * (np.log2(ps / (ps + ns)) - np.log2(p / (p + n))), -1.0)
            best = int(np.argmax(gain))
            if gain[best] <= 1e-9:
                break
            # of equal thresholds the one in the widest gap: the others part rows of the pruning third
            first = candidates[best]
            equal = [k for k in np.flatnonzero(gain >= gain[best] - 1e-9) if (candidates[k].feature, candidates[k].above) == (first.feature, first.above)]
            best = int(max(equal, key=lambda k: gaps[k]))
            rule.append(best)
            now = now & table[best]
        if not rule:
            break
        held = [left & prune & np.logical_and.reduce(table[rule[: k + 1]]) for k in range(len(rule))]
        keep = max(range(len(rule)), key=lambda k: (worth(held[k]), -k))
        rule = rule[: keep + 1]
        everywhere = left & np.logical_and.reduce(table[rule])
        good = int((everywhere & bad).sum())
        if good < least_covered or good < precision * int(everywhere.sum()):
            break
        rules.append(tuple(candidates[k] for k in rule))
        left &= ~everywhere
    return DecisionList(tuple(rules))


def learn_rules(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DecisionList:
    """The decision list for ``docs`` (doc_id, text) by ``labels`` (doc_id, quality: 1 good, 0 bad)."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # LABELLED rows of two numbers
    rows = known.select("doc_id", "quality", statistics(F.col("text")).alias("s")).select("doc_id", "quality", "s.*").collect()
    rows = sorted(rows, key=lambda r: tuple(r))
    rows = [rows[k] for k in np.random.default_rng(1).permutation(len(rows))]
    return cover(_matrix(rows), np.array([r["quality"] == 0 for r in rows], bool))


def judge_quality(docs: DataFrame, decisions: DecisionList) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the rejecting rule for all ``docs``."""
    s = F.col("s")
    rows = docs.select("doc_id", statistics(F.col("text").cast("string")).alias("s"))
    rows = rows.select("doc_id", *[s[c].alias(c) for c in COUNTS], base_failed(s).alias("base_failed"), decisions.rejected_by(s).alias("rule"))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def kept_by_rules(docs: DataFrame, decisions: DecisionList) -> DataFrame:
    """The rows of ``docs`` that base rules and decision list keep."""
    return docs.where(let(statistics(F.col("text").cast("string")), lambda s: ~base_failed(s) & decisions.rejected_by(s).isNull()))
