"""Cutting a table into ranges of a key, with cuts that are values of the table itself."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values of an integer key that split the rows about evenly.

    One scan of the key with partial aggregation; what reaches the driver is one value a part.
    """
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(key), shares, max(10_000, 20 * parts))).first()[0]
    return sorted(set(found or []))


def part_of(key: str, bounds: list[int]) -> Column:
    """How many cuts are at most the key (0 for null): the row's part.

    Two short scans of sorted literals, a block of cuts and then the cut in the block, so the work a
    row is in the square root of the number of parts.
    """
    if not bounds:
        return F.lit(0)
    block = math.isqrt(len(bounds)) + 1
    groups = [bounds[i : i + block] for i in range(0, len(bounds), block)]
    value = F.coalesce(F.col(key).cast("long"), F.lit(bounds[0] - 1))
    heads = F.array(*(F.lit(g[0]).cast("long") for g in groups))
    fine = F.array(*(F.array(*(F.lit(x).cast("long") for x in g)) for g in groups))
    coarse = F.size(F.filter(heads, lambda x: x <= value))
    within = F.size(F.filter(F.coalesce(F.get(fine, coarse - 1), F.array().cast("array<long>")), lambda x: x <= value))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * block + within).cast("int")
