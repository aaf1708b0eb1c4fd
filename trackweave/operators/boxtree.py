"""Nearest items by a packed tree of boxes: what may be nearest to a spot, without comparing it with all.

Items of a group (a line's legs, a graph's vertices) are ranked along a curve that keeps neighbours
together: the line itself, or a Z-order of coordinates. ``FANOUT`` neighbours make a node, as many nodes a
node of the next level; each has the box of what it holds. Nodes hold equally many items, so where items
are dense boxes are small, and no extent or density has to be known.

Spots walk down level by level, all together. A node's box bounds from both sides how far its nearest item
is, and what begins beyond the least upper bound is left, so what is kept at a level is what still may be
nearest. That is proof, not search: all nearest items of a spot come out, equals too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators.rows import cut_lineage, running, spread

FANOUT = 64
BOX = ("x0", "x1", "y0", "y1")
#: Bits of a coordinate in the Z-order, and the steps that put a zero behind each bit.
BITS = 30
STEPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def with_z_order(df: DataFrame, x: str, y: str, name: str = "_z") -> DataFrame:
    """``df`` with each point's place on a Z-order curve over the table's extent."""
    low_x, high_x, low_y, high_y = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if low_x is None or low_y is None:
        return df.withColumn(name, F.lit(0).cast("long"))
    cell = lambda c, low, high: F.floor((F.col(c) - low) / max(high - low, 1e-300) * float((1 << BITS) - 1)).cast("long")
    df = df.withColumns({"_zx": cell(x, low_x, high_x), "_zy": cell(y, low_y, high_y)})
    for shift, mask in STEPS:
        df = df.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(mask) for c in ("_zx", "_zy")})
    return df.withColumn(name, F.coalesce(F.col("_zx").bitwiseOR(F.shiftleft("_zy", 1)), F.lit(0).cast("long"))).drop("_zx", "_zy")


def ranked(items: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``items`` with ``rank``, their number (from 0) in the group by ``order``, whatever a group's size."""
    rows = running(spread(items, group, order), F.lit(1).cast("long"), group, order, "rank")
    return rows.withColumn("rank", F.col("rank") - 1).drop("_block")


def _levels(items: DataFrame, group: list[str]) -> list[DataFrame]:
    """The nodes (group, _node, box) of each level, the leaves first; the last has FANOUT a group at most."""
    most = items.agg(F.max("rank")).first()[0] or 0
    grown = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]
    levels: list[DataFrame] = []
    below = items.withColumnRenamed("rank", "_node")
    while most >= FANOUT:
        below = cut_lineage(below.withColumn("_node", F.floor(F.col("_node") / FANOUT)).groupBy(*group, "_node").agg(*grown))
        levels.append(below)
        most //= FANOUT
    return levels


def _bounds(x: str, y: str) -> tuple[Column, Column]:
    """The squares of the distances that the box's nearest item has at least and at most.

    At most: each side of a tight box is touched by an item, at worst at its farther end.
    """
    near = lambda p, a, b: F.greatest(F.lit(0.0), F.col(a) - F.col(p), F.col(p) - F.col(b))
    side = lambda f, p, a, b: f(F.abs(F.col(p) - F.col(a)), F.abs(F.col(p) - F.col(b)))
    square = lambda c: c * c
    x_less, x_more, y_less, y_more = (square(side(f, p, *box)) for p, box in ((x, BOX[:2]), (y, BOX[2:])) for f in (F.least, F.greatest))
    return square(near(x, *BOX[:2])) + square(near(y, *BOX[2:])), F.least(x_less + y_more, x_more + y_less)


def _walked(spots: DataFrame, levels: list[DataFrame], group: list[str], keys: list[str], x: str, y: str, slack: float) -> DataFrame:
    """Spots with ``_up``, the leaves of their group that may hold what is nearest.

    A spot meets a parent's boxes twice: for the least of their bounds, which is added up as they pass, and
    for the boxes within it, so that what goes to a sort or a shuffle is a row a parent and not one a box.
    """
    low, high = _bounds(x, y)
    # a hair more than the bound, for the rounding of the bounds themselves
    reach = F.sqrt(F.col("_bound")) * (1 + 1e-9) + slack + 1e-12
    near = spots.withColumn("_up", F.lit(0).cast("long"))
    for k, nodes in reversed(list(enumerate(levels))):
        boxes, on = nodes.withColumn("_up", F.floor(F.col("_node") / FANOUT)), [*group, "_up"]
        bounds = near.join(boxes, on).groupBy(*near.columns).agg(F.min(high).alias("_bound"))
        if k < len(levels) - 1:
            bounds = bounds.withColumn("_bound", F.min("_bound").over(Window.partitionBy(*group, *keys)))
        near = bounds.join(boxes, on).filter(F.sqrt(low) <= reach).select(*spots.columns, F.col("_node").alias("_up"))
    return near


def may_be_nearest(spots: DataFrame, items: DataFrame, group: list[str], keys: list[str], x: str, y: str, slack: float = 0.0) -> DataFrame:
    """Spots (group, keys, x, y) with those of their group's items (group, rank, box) that may be nearest.

    Rows have the columns of both. Items that are farther than the nearest by ``slack`` at most are among
    them too. A spot is compared with some nodes a level and some leaves' items; a group of FANOUT items or
    fewer is compared whole.
    """
    near = _walked(spots, _levels(items, group), group, keys, x, y, slack)
    return near.join(_leaves(items), [*group, "_up"]).drop("_up")


def _leaves(items: DataFrame) -> DataFrame:
    return items.withColumn("_up", F.floor(F.col("rank") / FANOUT)).drop(*BOX, "rank")


def nearest(spots: DataFrame, items: DataFrame, group: list[str], keys: list[str], x: str, y: str, far: Column, slack: float = 0.0) -> DataFrame:
    """As :func:`may_be_nearest`, but of a leaf only its nearest items by their distance ``far`` (null: all), and
    those that are farther by ``slack`` at most. Pairs of spots and other items are neither sorted nor shuffled."""
    near = _walked(spots, _levels(items, group), group, keys, x, y, slack)
    leaves, on = _leaves(items), [*group, "_up"]
    least = near.join(leaves, on).groupBy(*near.columns).agg(F.min(far).alias("_least"))
    within = F.col("_least").isNull() | (far <= F.col("_least") * (1 + 1e-9) + slack + 1e-12)
    return least.join(leaves, on).filter(within).drop("_up", "_least")
