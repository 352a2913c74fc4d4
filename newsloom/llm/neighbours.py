"""Neighbours in the order of a key, without putting all rows in one task.

Rows are dealt into groups of consecutive keys; the cuts come from a sample, which only decides how even the
groups are. The first row of each group visits the group before it, and on request the last row the group
behind it, so that a window over one group sees every neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows in a group on average, groups at most (their first and last keys come to the driver), sampled keys a group.
ROWS, GROUPS, SAMPLED = 32, 50_000, 4
BREAK = "\x1f"


def cut_points(keys: DataFrame) -> list:
    """Values between the groups; ``keys`` has one column ``k``."""
    rows = keys.count()
    groups = min(GROUPS, rows // ROWS)
    if groups < 2:
        return []
    # by hash, so that no task sends more than its share
    share = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, groups * SAMPLED / rows))
    sample = sorted({r.k for r in keys.where(share).collect()}) or [keys.first().k]
    return sorted({sample[len(sample) * i // groups] for i in range(1, groups)})


def constant(values: list, kind: str) -> Column:
    """A constant array, sent as one string."""
    return F.split(F.lit(BREAK.join(map(str, values))), BREAK).cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def group_of(key: Column, cuts: list, kind: str) -> Column:
    """How many cuts are at most ``key``, by binary search."""
    points, steps = constant(cuts, kind), [1 << b for b in reversed(range(max(1, len(cuts)).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(points, low + step - 1) <= key, low + step).otherwise(low))


def with_visitors(rows: DataFrame, keys: DataFrame, key: str, wrap: bool = False, backward: bool = False) -> DataFrame:
    """``rows`` with ``_group`` and ``_side`` (0 at home, 1 from behind, -1 from before), visitors added.

    ``keys`` is the key column of the same rows alone, as ``k``, so that finding the cuts reads nothing else.
    Keys are longs or strings without ``BREAK``, never null. With ``wrap`` the first row of all visits the last group.
    """
    kind = dict(keys.dtypes)["k"]
    cuts = cut_points(keys)
    ends = {r.g: (r.a, r.b) for r in keys.groupBy(group_of(F.col("k"), cuts, kind).alias("g")).agg(F.min("k").alias("a"), F.max("k").alias("b")).collect()}
    full = sorted(ends)
    size = len(cuts) + 1
    before, behind = [-1] * size, [-1] * size
    for at, g in enumerate(full):
        before[g] = full[at - 1] if at or wrap else -1
        behind[g] = full[at + 1] if at + 1 < len(full) and backward else -1
    empty = "0" if kind != "string" else ""
    first, last = ([ends[g][i] if g in ends else empty for g in range(size)] for i in (0, 1))
    g, k = F.col("_home"), F.col(key)
    at = lambda values, of: F.get(constant(values, of), g)
    visit = F.struct(g.alias("group"), F.lit(0).alias("side"))
    places = [visit, F.when((k == at(first, kind)) & (at(before, "int") >= 0), F.struct(at(before, "int").alias("group"), F.lit(1).alias("side")))]
    if backward:
        places.append(F.when((k == at(last, kind)) & (at(behind, "int") >= 0), F.struct(at(behind, "int").alias("group"), F.lit(-1).alias("side"))))
    dealt = rows.withColumn("_home", group_of(k, cuts, kind)).withColumn("_visit", F.explode(F.array_compact(F.array(*places))))
    return dealt.withColumns({"_group": F.col("_visit.group"), "_side": F.col("_visit.side")}).drop("_home", "_visit")
