"""Linear referencing and resampling of a track between two stations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import geo, rounding
from trackweave.operators import boxtree, rows
from trackweave.operators.rows import cut_lineage

STEP = 50.0
#: Digits of a metre to which distances from a line are compared, so that sums don't decide between equals.
DIGITS = 6


def apply_stages(df: DataFrame, stages: list[dict[str, str]]) -> DataFrame:
    for stage in stages:
        df = df.withColumns({name: F.expr(e) for name, e in stage.items()})
    return df


def to_utm(df: DataFrame, zone: int = 51) -> DataFrame:
    """``df`` (lng, lat) with x and y in metres."""
    return apply_stages(df, geo.utm_stages(zone=zone)).drop("u_tau", "u_d", "u_xi", "u_eta")


def from_utm(df: DataFrame, zone: int = 51) -> DataFrame:
    return apply_stages(df, geo.inverse_utm_stages(zone=zone)).drop("v_xi", "v_eta", "w_xi", "w_eta", "v_chi", "v_d")


def legs(points: DataFrame, line: str = "line_id", pos: str = "pt_pos", long: bool = False) -> DataFrame:
    """Segments of planar lines (x, y): x2, y2, their length, cum, the length before them, and rank, their
    number. ``long``: lines may be longer than a task holds."""
    columns = [line, pos, "x", "y", "x2", "y2", "length", "cum", "rank"]
    if long:
        joined = rows.before(rows.spread(points.select(line, pos, "x", "y"), [line], [pos]), [line], [pos], {"_x": "x", "_y": "y", "_pos": pos})
        size = F.when(~F.col("_first"), F.expr(geo.planar("_x", "_y", "x", "y"))).otherwise(0.0)
        summed = rows.running(joined.withColumn("length", size), F.col("length"), [line], [pos], "_end")
        summed = rows.running(summed, F.when(F.col("_first"), 0).otherwise(1).cast("long"), [line], [pos], "_n")
        own = summed.filter("NOT _first").select(line, "_pos", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("_x").alias("x"), F.col("_y").alias("y"), "length", (F.col("_end") - F.col("length")).alias("cum"), (F.col("_n") - 1).alias("rank"))
        return own.withColumnRenamed("_pos", pos).select(*columns)
    w = Window.partitionBy(line).orderBy(pos)
    paired = points.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w), "rank": F.row_number().over(w).cast("long") - 1}).filter("x2 IS NOT NULL")
    sized = paired.withColumn("length", F.expr(geo.planar("x", "y", "x2", "y2")))
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return sized.withColumn("cum", before).select(*columns)


def near_legs(spots: DataFrame, line_legs: DataFrame, keys: list[str], line: str = "line_id") -> DataFrame:
    """Spots (line, keys, px, py) with the legs of their line that may be nearest to them."""
    return boxtree.may_be_nearest(spots, _boxed(line_legs), [line], keys, "px", "py", slack=10.0**-DIGITS)


def _boxed(line_legs: DataFrame) -> DataFrame:
    least, most = (lambda a: F.least(F.col(a), F.col(f"{a}2"))), (lambda a: F.greatest(F.col(a), F.col(f"{a}2")))
    return line_legs.withColumns({"x0": least("x"), "x1": most("x"), "y0": least("y"), "y1": most("y")})


def referenced(spots: DataFrame, line_legs: DataFrame, keys: list[str], line: str = "line_id", pos: str = "pt_pos") -> DataFrame:
    """keys, off, along: how far each spot (line, keys, px, py) is from its line, and how far along it; the
    first of equally near segments (to a micrometre)."""
    share = geo.share_along("px", "py", "x", "y", "x2", "y2")
    off = geo.planar("px", "py", geo.between("x", "x2", share), geo.between("y", "y2", share))
    pairs = boxtree.nearest(spots, _boxed(line_legs), [line], keys, "px", "py", F.expr(off), slack=10.0**-DIGITS).withColumn("_t", F.expr(share))
    off = F.expr(geo.planar("px", "py", geo.between("x", "x2", "_t"), geo.between("y", "y2", "_t")))
    best = pairs.groupBy(line, *keys).agg(F.min(F.struct(F.round(off, DIGITS).alias("near"), F.col(pos).alias("pos"), off.alias("off"), (F.col("cum") + F.col("_t") * F.col("length")).alias("along"))).alias("b"))
    return best.select(line, *keys, "b.off", "b.along")


def samples(ranges: DataFrame, line_legs: DataFrame, step: float = STEP, line: str = "line_id") -> DataFrame:
    """Points every ``step`` metres from ``low`` to ``high`` of each range (line, low, high, reversed).

    line, i (from 1), along, x, y. The far end is always added, even where it falls on the grid; a
    reversed range comes out from its far end. Samples and legs of a line stand in one order, by distance,
    and each sample takes the last leg that begins before it or where it is.
    """
    steps = F.floor((F.col("high") - F.col("low")) / step)
    spread = F.flatten(F.array(F.transform(F.sequence(F.lit(0), steps), lambda k: F.col("low") + k * F.lit(float(step))), F.array("high")))
    grid = ranges.filter("high >= low").select(line, "reversed", F.size(spread).alias("n"), F.posexplode(spread).alias("k", "along"))
    leg = F.struct("cum", "length", "x", "y", "x2", "y2")
    begun = line_legs.select(line, F.lit(None).cast("boolean").alias("reversed"), F.lit(None).cast("int").alias("n"), F.lit(None).cast("int").alias("k"), F.col("cum").alias("along"), F.lit(0).alias("kind"), F.col("pt_pos").cast("long").alias("pos"), leg.alias("leg"))
    asked = grid.select("*", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast(begun.schema["leg"].dataType).alias("leg"))
    w = Window.partitionBy(line).orderBy("along", "kind", "pos").rowsBetween(Window.unboundedPreceding, 0)
    met = begun.unionByName(asked).withColumn("e", F.last("leg", ignorenulls=True).over(w)).filter("kind = 1 AND e IS NOT NULL")
    share = F.when(F.col("e.length") > 0, F.least(F.lit(1.0), (F.col("along") - F.col("e.cum")) / F.nullif(F.col("e.length"), F.lit(0.0)))).otherwise(0.0)
    placed = met.select(line, F.when(F.col("reversed"), F.col("n") - F.col("k")).otherwise(F.col("k") + 1).alias("i"), "along", "e.x", "e.y", "e.x2", "e.y2", share.alias("_t"))
    return placed.select(line, "i", "along", F.expr(geo.between("x", "x2", "_t")).alias("x"), F.expr(geo.between("y", "y2", "_t")).alias("y"))


def export_track(points: DataFrame, stations: DataFrame, start: str, end: str, step: float = STEP, zone: int = 51, exact_rounding: bool = False) -> DataFrame:
    """line_id, i, lng, lat: the track (line_id, pt_pos, lng, lat) from one named station to another, resampled.

    Coordinates have eight digits, rounded as SQL does or, with ``exact_rounding``, by their exact value.
    """
    line_legs = cut_lineage(legs(to_utm(points, zone).select("line_id", "pt_pos", "x", "y")))
    ends = to_utm(stations.filter(F.col("name").isin(start, end)).select("line_id", "name", "lng", "lat"), zone).select("line_id", "name", F.col("x").alias("px"), F.col("y").alias("py"))
    along = referenced(ends, line_legs, ["name"])
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("along")))
    ranges = along.groupBy("line_id").agg(at(start).alias("a"), at(end).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    ranges = ranges.select("line_id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), (F.col("a") > F.col("b")).alias("reversed"))
    found = from_utm(samples(ranges, line_legs, step), zone)
    cut = rounding.half_even if exact_rounding else F.round
    return found.select("line_id", "i", cut(F.col("lng"), 8).alias("lng"), cut(F.col("lat"), 8).alias("lat"))
