"""Predicates and projections over elements, tracks and stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which route tags count where, and which member roles are stops.
ROUTES_PARSED = ("subway", "light_rail", "railway")
ROUTES_LINE = ("subway",)
ROUTES_LISTED = ("subway", "light_rail", "tram")
TRACK_KINDS = ("subway", "light_rail", "rail")
STOP_ROLES = ("stop", "stop_entry_only", "stop_exit_only", "platform", "")
TRACK_TAGS = ("name", "railway", "service", "operator", "layer", "bridge", "tunnel")


def in_bbox(lat: Column, lng: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Whether the point lies in (south, west, north, east), edges included."""
    south, west, north, east = bbox
    return lat.between(south, north) & lng.between(west, east)


def stations_in_bbox(stations: DataFrame, bbox: tuple[float, float, float, float] | None) -> DataFrame:
    """Stations with coordinates in the box; all of them where there is no box."""
    return stations.filter(in_bbox(F.col("lat"), F.col("lng"), bbox)) if bbox else stations


def tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def tagged(df: DataFrame, railway: str | None = None, route: str | None = None) -> DataFrame:
    """Rows with the given railway and route tags; an empty filter passes everything."""
    for name, wanted in (("railway", railway), ("route", route)):
        if wanted:
            df = df.filter(tag(name) == wanted)
    return df


def sound_ways(ways: DataFrame) -> DataFrame:
    """Ways with two nodes or more and a point for every node."""
    return ways.filter((F.size("nodes") >= 2) & (F.size("nodes") == F.size("geometry")))


def is_station() -> Column:
    return F.coalesce(tag("railway") == "station", F.lit(False)) | F.coalesce(tag("station") == "subway", F.lit(False))


def is_metro_station_node() -> Column:
    """Nodes that a station scan asks for."""
    metro = F.coalesce(tag("station") == "subway", F.lit(False)) | F.coalesce(tag("subway") == "yes", F.lit(False))
    return (F.col("type") == "node") & F.coalesce(tag("railway") == "station", F.lit(False)) & metro


def is_stop_member() -> Column:
    return (F.col("member.type") == "node") & F.col("member.role").isin(*STOP_ROLES)


def with_track_tags(tracks: DataFrame) -> DataFrame:
    """``tags`` never null, and the usual ones as columns."""
    filled = tracks.withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))
    return filled.withColumns({name: tag(name) for name in TRACK_TAGS})
