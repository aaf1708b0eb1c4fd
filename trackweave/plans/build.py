"""Whole tasks put together from the operators: a line's download, a city's listing, a route, an export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators import filters, graph, lines, matching, track
from trackweave.sources import elements as el
from trackweave.sources import geojson


def line_documents(elems: DataFrame, pick: str = "last") -> DataFrame:
    """line_id, name, geojson of every document: parse, drop repeated stations, export. Each has its line's
    name, with or without stations and track."""
    found, stations, points = lines.parsed_lines(elems, pick)
    by_line = lambda rows: rows.withColumnRenamed("doc_id", "line_id")
    return geojson.collections(by_line(found), by_line(lines.unique_stations(stations)), by_line(points))


def city_listing(elems: DataFrame) -> DataFrame:
    """Each document's lines in listing order."""
    return lines.listed_lines(lines.relation_tags(elems), ["doc_id"]).orderBy("doc_id", *lines.listing_order())


def routes(elems: DataFrame, roster: DataFrame, overrides: DataFrame, bbox=None, strict: bool = False, gap_aware: bool = False, close_loops: bool = False, any_node: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stations of the roster's lines, and the distance-stamped track points along them.

    Elements count as the queries for stations and tracks ask for them: metro stations, and ways of the track
    kinds, in the box. With ``any_node`` every named node may be a station and every way a track.
    """
    if any_node:
        found, tracks = filters.stations_in_bbox(el.stations(elems), bbox), el.tracks(elems)
    else:
        found, tracks = el.metro_stations(elems, bbox), el.rail_tracks(elems, bbox)
    stations = matching.route_stations(roster, found, overrides, strict)
    tracks = tracks.withColumns({"graph_id": F.lit("map"), "way_pos": F.struct("doc_id", "way_pos")})
    spots = stations.select(F.lit("map").alias("graph_id"), F.concat_ws(" ", "city", "line").alias("line_id"), "sequence", "lng", "lat")
    walked = graph.route(spots, graph.vertices(tracks), graph.edges(tracks), gap_aware, close_loops)
    return stations, lines.stamped(walked.drop("graph_id"))


def found_paths(edge_table: DataFrame, verts: DataFrame, pairs: DataFrame) -> DataFrame:
    """graph_id, pair_pos, pt_pos, node, lng, lat, distance (in degrees, from the start) along the shortest
    path of each pair (graph_id, pair_pos, start, end)."""
    points = graph.path_points(graph.shortest_paths(edge_table, pairs), verts)
    line = F.concat_ws(" ", "graph_id", "pair_pos")
    return lines.stamped(points.withColumn("line_id", line), metric="degree").drop("line_id")


def exported(feats: DataFrame, start: str, end: str, step: float = track.STEP, zone: int = 51) -> DataFrame:
    """The samples of each file's track between two stations."""
    return track.export_track(geojson.line_points(feats), geojson.station_points(feats), start, end, step, zone)
