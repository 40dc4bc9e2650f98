"""Passages put together for a question, with a share of noise: dealt in turn over groups, or with wrong facts.

Orders are by a hash of the seed and the passage, so reruns agree; repeated passages keep their places in the list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = "2333"


def dealt(passages: Column, seed: str = SEED) -> Column:
    """``passages`` (strings) in a seeded order."""
    keyed = F.transform(passages, lambda p, i: F.struct(F.md5(F.concat_ws(":", F.lit(seed), i.cast("string"), p)).alias("h"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def _share(n: int, part: float) -> int:
    """Rounded up."""
    whole = int(n * part)
    return whole + (n * part > whole)


def by_groups(groups: Column, negative: Column, n: int, noise: float) -> Column:
    """One passage of each group, then second ones and so on in turn until the positive share is filled; negative ones make up ``n``.

    Groups count in their order and each passage in the order given.  More groups than ``n`` all stay, as an
    answer needs a part of each.
    """
    wanted = n - _share(n, noise)
    filled = F.filter(groups, lambda g: F.size(g) > 0)
    first = F.transform(filled, lambda g: F.get(g, F.lit(0)))
    longest = F.coalesce(F.array_max(F.transform(filled, lambda g: F.size(g))), F.lit(0))
    rounds = F.when(longest > 1, F.sequence(F.lit(1), longest - 1)).otherwise(F.array().cast("array<int>"))
    later = F.flatten(F.transform(rounds, lambda k: F.transform(F.filter(filled, lambda g: F.size(g) > k), lambda g: F.get(g, k))))
    good = F.concat(first, F.slice(later, F.lit(1), F.greatest(F.lit(wanted) - F.size(first), F.lit(0))))
    return F.concat(good, F.slice(negative, F.lit(1), F.greatest(F.lit(n) - F.size(good), F.lit(0))))


def with_wrong_facts(positive: Column, wrong: Column, negative: Column, n: int, noise: float, right: float, seed: str = SEED) -> Column:
    """Wrong versions of passages drawn without replacement, right ones of others for a share ``right``, and negative ones.

    ``positive`` and ``wrong`` stand in the same order.  What one kind lacks no other makes up.
    """
    bad, good = _share(n, noise), _share(n, right)
    drawn = F.transform(dealt(F.transform(F.sequence(F.lit(0), F.greatest(F.size(positive) - 1, F.lit(0))), lambda i: i.cast("string")), seed), lambda i: i.cast("int"))
    drawn = F.when(F.size(positive) > 0, drawn).otherwise(F.array().cast("array<int>"))
    at = max(n - bad - good, 0)
    first = F.transform(F.slice(drawn, F.lit(1), F.lit(at)), lambda i: F.get(wrong, i))
    rest = F.transform(F.slice(drawn, F.lit(at + 1), F.lit(good)), lambda i: F.get(positive, i))
    return F.concat(first, rest, F.slice(negative, F.lit(1), F.lit(bad)))
