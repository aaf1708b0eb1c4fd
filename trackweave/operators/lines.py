"""Lines from relations: parsing one line, grouping and listing many, their stations and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import geo, rounding, text
from trackweave.operators import filters
from trackweave.operators.rows import before, cut_lineage, drop_consecutive, first_seen, keep_first, keep_last, running, running_sum, spread, with_next
from trackweave.sources import elements as el

DEGREE_DIGITS, METRE_DIGITS = 8, 2


# -- one document, one line


def chosen_relation(elems: DataFrame, pick: str = "last") -> DataFrame:
    """The relation that stands for each document: of several, the last (or ``pick='first'``)."""
    rows = elems.filter((F.col("type") == "relation") & filters.tag("route").isin(*filters.ROUTES_PARSED))
    return (keep_last if pick == "last" else keep_first)(rows, ["doc_id"], ["elem_pos"])


def parsed_lines(elems: DataFrame, pick: str = "last") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines, their stations and their points.

    lines: doc_id, name (Unknown without a relation or name). stations: doc_id, pos, name, lat, lng:
    the relation's stop nodes in member order, or all named nodes of the document in element order where
    the relation has no members. points: doc_id, pt_pos, lng, lat along the relation's ways, without
    immediate repeats; a way's own geometry counts first, else its nodes.
    """
    elems = cut_lineage(elems)  # read by every branch below, parsed once
    relation = chosen_relation(elems, pick)
    named = relation.select("doc_id", F.coalesce(filters.tag("name"), F.lit("Unknown")).alias("name"))
    lines = elems.select("doc_id").distinct().join(named, "doc_id", "left").withColumn("name", F.coalesce("name", F.lit("Unknown")))
    members = relation.select("doc_id", F.posexplode("members").alias("member_pos", "member"))
    nodes, ways = el.nodes(elems), el.ways(elems)

    stops = members.filter(filters.is_stop_member()).select("doc_id", "member_pos", F.col("member.ref").alias("id"))
    has_name = F.map_contains_key("tags", F.lit("name"))
    of_members = stops.join(nodes.filter(has_name), ["doc_id", "id"]).select("doc_id", F.col("member_pos").alias("pos"), filters.tag("name").alias("name"), "lat", F.col("lon").alias("lng"))
    bare = relation.filter(F.coalesce(F.size("members"), F.lit(0)) <= 0).select("doc_id")
    loose = elems.filter((F.col("type") == "node") & has_name).join(bare, "doc_id", "left_semi")
    stations = of_members.unionByName(loose.select("doc_id", F.col("elem_pos").alias("pos"), filters.tag("name").alias("name"), "lat", F.col("lon").alias("lng")))

    legs = members.filter("member.type = 'way'").select("doc_id", "member_pos", F.col("member.ref").alias("id")).join(ways.select("doc_id", "id", "geometry", "nodes"), ["doc_id", "id"])
    drawn = legs.filter("geometry IS NOT NULL").select("doc_id", "member_pos", F.posexplode("geometry").alias("in_way", "p")).select("doc_id", "member_pos", "in_way", F.col("p.lon").alias("lng"), F.col("p.lat").alias("lat"))
    linked = legs.filter("geometry IS NULL").select("doc_id", "member_pos", F.posexplode("nodes").alias("in_way", "node"))
    resolved = linked.join(nodes.select("doc_id", F.col("id").alias("node"), F.col("lon").alias("lng"), "lat"), ["doc_id", "node"]).select("doc_id", "member_pos", "in_way", "lng", "lat")
    points = drop_consecutive(drawn.unionByName(resolved), ["doc_id"], ["member_pos", "in_way"], ["lng", "lat"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("member_pos", "in_way")) - 1
    return lines, stations, points.select("doc_id", place.alias("pt_pos"), "lng", "lat")


def unique_stations(stations: DataFrame, line: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Each station name once a line, the first."""
    return keep_first(stations, [line, "name"], [pos])


def simple_lines(elems: DataFrame, line_one_rule: bool = True) -> tuple[DataFrame, DataFrame]:
    """One line a document: the last metro relation's normalised name, and all station-like elements."""
    rows = elems.filter((F.col("type") == "relation") & filters.tag("route").isin(*filters.ROUTES_LINE))
    name = text.line_name(filters.tag("name"), filters.tag("ref"), line_one_rule)
    lines = keep_last(rows, ["doc_id"], ["elem_pos"]).select("doc_id", name.alias("name"))
    return lines, elems.filter(filters.is_station()).select("doc_id", F.col("elem_pos").alias("pos"), filters.tag("name").alias("name"), "lat", F.col("lon").alias("lng"))


# -- many lines


def attach_stations(lines: DataFrame, stations: DataFrame, keys: list[str]) -> DataFrame:
    """Each line (keys, doc_id, first_pos) with the stations that come after its start in the document, each
    name and place once, the first.

    Lines and stations of a document stand in one sequence, where a running count tells how many lines have
    begun before a station. Of one name and place, a station is the first for those lines that began
    since the one before it: a stretch of the lines' numbers, by which they are joined. So no pair is made
    that isn't in the result.
    """
    place = ["doc_id", "name", "lat", "lng"]
    begun = lines.select("doc_id", F.col("first_pos").cast("long").alias("_pos"), F.lit(1).alias("_line"), F.struct(*(c for c in keys if c != "doc_id")).alias("_keys"))
    seen = stations.select("doc_id", F.col("elem_pos").cast("long").alias("_pos"), F.lit(0).alias("_line"), F.struct("elem_pos", "name", "lat", "lng").alias("_stop"))
    sequence = begun.unionByName(seen, allowMissingColumns=True)
    numbered = sequence.withColumn("_n", F.sum("_line").over(Window.partitionBy("doc_id").orderBy("_pos", "_line").rowsBetween(Window.unboundedPreceding, 0)))
    stops = numbered.filter("_line = 0").select("doc_id", "_pos", "_n", "_stop.*")
    since = F.coalesce(F.lag("_n").over(Window.partitionBy(*place).orderBy("_pos")), F.lit(0))
    first = stops.withColumn("_since", since).filter("_n > _since").select("doc_id", "elem_pos", "name", "lat", "lng", F.explode(F.sequence(F.col("_since") + 1, F.col("_n"))).alias("_n"))
    own = numbered.filter("_line = 1").select("doc_id", "_n", "_keys")
    joined = own.join(first, ["doc_id", "_n"])
    return joined.select(*("doc_id" if k == "doc_id" else F.col(f"_keys.{k}").alias(k) for k in keys), "elem_pos", "name", "lat", "lng")


def grouped_lines(elems: DataFrame, bbox=None, line_one_rule: bool = True) -> tuple[DataFrame, DataFrame]:
    """Metro relations by ref (or name): last seen name and ref, number of relations; and their stations.

    Stations repeat in no line (by name and place, the first stays); a line without any goes.
    """
    rows = elems.filter((F.col("type") == "relation") & filters.tag("route").isin(*filters.ROUTES_LINE))
    rows = rows.select("doc_id", "elem_pos", text.line_name(filters.tag("name"), filters.tag("ref"), line_one_rule).alias("name"), filters.tag("ref").alias("ref"))
    keyed = rows.withColumn("line_key", F.when(~text.falsy(F.col("ref")), F.col("ref")).otherwise(F.col("name"))).filter("line_key IS NOT NULL")
    lines = keyed.groupBy("doc_id", "line_key").agg(F.max_by(F.struct("name", "ref"), "elem_pos").alias("last"), F.count("*").alias("relations"), F.min("elem_pos").alias("first_pos"))
    lines = lines.select("doc_id", "line_key", "last.name", "last.ref", "relations", "first_pos", F.lit(2).alias("directions"))
    stops = elems.filter(filters.is_station()).select("doc_id", "elem_pos", filters.tag("name").alias("name"), "lat", F.col("lon").alias("lng"))
    attached = attach_stations(lines, filters.stations_in_bbox(stops, bbox), ["doc_id", "line_key"])
    return lines.join(attached.select("doc_id", "line_key").distinct(), ["doc_id", "line_key"], "left_semi"), attached


def listed_lines(relations: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Lines of relations (pos, name, ref, network, route, from, to), as a listing shows them, one listing
    for each value of ``scope``.

    Relations are one line by network and ref, or network and normalised name; the first relation's
    values count; directions are the distinct ends that aren't both empty, one at least.
    """
    filled = relations.filter(~text.falsy(F.col("name"))).withColumns({c: F.coalesce(c, F.lit("")) for c in ("ref", "network", "route", "from", "to")})
    keyed = filled.withColumn("key", text.line_key(F.col("network"), F.col("ref"), F.col("name"))).withColumn("name", text.list_name(F.col("name")))
    ends = F.count_distinct(F.when((F.col("from") != "") | (F.col("to") != ""), F.struct("from", "to")))
    lines = first_seen(keyed, [*(scope or []), "key"], ["ref", "name", "network", "route", "from", "to"], "pos", directions=F.greatest(ends, F.lit(1)))
    return lines.withColumn("line_id", F.concat("network", F.lit("_"), F.when(F.col("ref") != "", F.col("ref")).otherwise(F.col("name")))).drop("key")


def listing_order() -> list[Column]:
    """Numbered lines first, by number, then the others by text; the first seen first among equals."""
    number = text.whole_number(F.col("ref"))
    return [F.when(number.isNotNull(), 0).otherwise(1), number, F.when(number.isNull(), F.col("ref")), F.col("first_pos")]


def relation_tags(elems: DataFrame) -> DataFrame:
    """Relations of the listed kinds as :func:`listed_lines` takes them, and their ``doc_id``."""
    rows = elems.filter((F.col("type") == "relation") & filters.tag("route").isin(*filters.ROUTES_LISTED))
    return rows.select("doc_id", F.col("elem_pos").alias("pos"), *(filters.tag(t).alias(t) for t in ("name", "ref", "network", "route", "from", "to")))


def station_names(stations: DataFrame, line: str = "doc_id", pos: str = "pos") -> DataFrame:
    """line and names: its stations' names in order."""
    return stations.groupBy(line).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "name"))), lambda s: s["name"]).alias("names"))


def interchanges(line_stations: DataFrame, station: str = "station_id", line: str = "line_id") -> DataFrame:
    """station and interchange: whether it belongs to more than one line."""
    return line_stations.groupBy(station).agg((F.count_distinct(line) > 1).alias("interchange"))


# -- along a line


def segments(points: DataFrame, line: str = "line_id", pos: str = "pt_pos") -> DataFrame:
    """Each point with the next one (lng2, lat2) and the metres between; the last point has none."""
    paired = with_next(points, [line], [pos], {"lng2": "lng", "lat2": "lat"})
    return paired.withColumn("metres", F.when(F.col("has_next"), F.expr(geo.mercator_distance("lng", "lat", "lng2", "lat2"))))


def lengths(points: DataFrame, line: str = "line_id", pos: str = "pt_pos") -> DataFrame:
    """line and length: the sum of its segments, 0 for fewer than two points."""
    return segments(points, line, pos).groupBy(line).agg(F.coalesce(F.sum("metres"), F.lit(0.0)).alias("length"))


def stamped(points: DataFrame, line: str = "line_id", pos: str = "pt_pos", metric: str = "mercator", exact_rounding: bool = False, long: bool = False) -> DataFrame:
    """Points with their distance from the line's start, summed unrounded, given to two digits.

    Rounded as SQL does, or by its exact value with ``exact_rounding``. With ``long``, lines may be longer
    than a task holds: sums of blocks first, then inside the blocks.
    """
    cut = rounding.half_even if exact_rounding else F.round
    step = F.expr((geo.degree_distance if metric == "degree" else geo.mercator_distance)("_lng", "_lat", "lng", "lat"))
    if long:
        moved = before(spread(points, [line], [pos]), [line], [pos], {"_lng": "lng", "_lat": "lat"})
        summed = running(moved, F.coalesce(step, F.lit(0.0)), [line], [pos], "_sum")
    else:
        w = Window.partitionBy(line).orderBy(pos)
        moved = points.withColumns({"_lng": F.lag("lng").over(w), "_lat": F.lag("lat").over(w)})
        summed = moved.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("_sum", running_sum(F.col("_step"), [line], [pos]))
    return summed.withColumn("distance", cut(F.col("_sum"), METRE_DIGITS)).select(*points.columns, "distance")


def station_order(stations: DataFrame, points: DataFrame, line: str = "line_id", pos: str = "pos") -> DataFrame:
    """Stations with ``idx``, the line point that is nearest in degrees (the first of equals; 0 without
    points), and ``place``, their order by it (their own order among equals)."""
    pairs = stations.join(points.select(line, F.col("pt_pos"), F.col("lng").alias("_lng"), F.col("lat").alias("_lat")), line, "left")
    far = F.expr(geo.degree_distance("lng", "lat", "_lng", "_lat"))
    nearest = pairs.groupBy(*stations.columns).agg(F.min(F.struct(far.alias("d"), F.col("pt_pos").alias("pt_pos"))).alias("best"))
    found = nearest.withColumn("idx", F.coalesce("best.pt_pos", F.lit(0))).drop("best")
    return found.withColumn("place", F.row_number().over(Window.partitionBy(line).orderBy("idx", pos)))


def summary(lines: DataFrame, stations: DataFrame, points: DataFrame) -> DataFrame:
    """doc_id, name, number of stations and of points."""
    counts = [df.groupBy("doc_id").agg(F.count("*").alias(n)) for df, n in ((stations, "n_stations"), (points, "n_points"))]
    return lines.join(counts[0], "doc_id", "left").join(counts[1], "doc_id", "left").fillna(0, ["n_stations", "n_points"])
