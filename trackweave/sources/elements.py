"""Map elements: from response text, over HTTP, and the query texts that ask for them.

The HTTP scan is a Python data source, so requests run where Spark puts them and fail over between
mirrors inside one read; everything after it works on the ``elements`` table alike.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from trackweave import schema
from trackweave.operators import filters
from trackweave.operators.rows import keep_last
from trackweave.sources import jsonitems

# Service addresses, attempts, pauses and time limits.
MIRRORS = ("https://overpass-api.de/api/interpreter", "https://overpass.kumi.systems/api/interpreter", "https://overpass.private.coffee/api/interpreter")
ATTEMPTS, PAUSE, TIMEOUT = 3, 3.0, 180
USER_AGENT = "trackweave/0.1.1"


def elements(responses: DataFrame, text: str = "value", key: str | None = None) -> DataFrame:
    """The ``elements`` table of response texts: doc_id, elem_pos and the element's fields.

    Without a ``key`` column the text's hash names the document. A text that isn't a response gives no rows.
    """
    doc = F.col(key).cast("string") if key else F.xxhash64(text).cast("string")
    parsed = responses.select(doc.alias("doc_id"), F.from_json(text, schema.RESPONSE).alias("r"))
    return parsed.select("doc_id", F.posexplode("r.elements").alias("elem_pos", "e")).select("doc_id", "elem_pos", "e.*")


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of saved responses, one file a document, named by its path."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    return elements(files, key="file")


def read_large(spark: SparkSession, path: str, size: int = jsonitems.RANGE) -> DataFrame:
    """As :func:`read_elements`, of files that may be larger than a text: element by element, in byte ranges."""
    items = jsonitems.read_items(spark, path, "elements", size).withColumn("e", F.from_json("value", schema.ELEMENT))
    return items.select(F.col("file").alias("doc_id"), F.col("pos").alias("elem_pos"), "e.*")


def nodes(elems: DataFrame) -> DataFrame:
    """Nodes by id; of repeated ids the last counts, and those without id go."""
    return keep_last(elems.filter("type = 'node' AND id IS NOT NULL"), ["doc_id", "id"], ["elem_pos"])


def ways(elems: DataFrame) -> DataFrame:
    return keep_last(elems.filter("type = 'way' AND id IS NOT NULL"), ["doc_id", "id"], ["elem_pos"])


def _is_track() -> Column:
    return (F.col("type") == "way") & (F.size("nodes") >= 2)


def _has_geometry() -> Column:
    return F.size("geometry") > 0


def tracks(elems: DataFrame) -> DataFrame:
    """Ways with two nodes or more as tracks: way_pos, id, nodes, geometry of (lng, lat), tags and the usual ones."""
    points = F.transform("geometry", lambda p: F.struct(p["lon"].alias("lng"), p["lat"].alias("lat")))
    rows = elems.filter(_is_track())
    shaped = rows.select("doc_id", F.col("elem_pos").alias("way_pos"), "id", "nodes", F.coalesce(points, F.array().cast("array<struct<lng:double,lat:double>>")).alias("geometry"), "tags")
    return filters.with_track_tags(shaped)


def way_geometries(elems: DataFrame) -> DataFrame:
    """id and geometry of tracks that have one."""
    return tracks(elems).filter(_has_geometry()).select("doc_id", "way_pos", "id", "geometry")


def track_count(elems: DataFrame) -> DataFrame:
    """doc_id and tracks: how many tracks of a document have a geometry, 0 where none of its elements is one."""
    return elems.groupBy("doc_id").agg(F.count(F.when(_is_track() & _has_geometry(), 1)).alias("tracks"))


def stations(elems: DataFrame) -> DataFrame:
    """name, lat, lng of named nodes, in element order."""
    name = filters.tag("name")
    return elems.filter((F.col("type") == "node") & (F.coalesce(name, F.lit("")) != "")).select("doc_id", F.col("elem_pos").alias("cand_pos"), name.alias("name"), "lat", F.col("lon").alias("lng"))


def relations_named(elems: DataFrame, pattern: str) -> DataFrame:
    """Metro relations whose name holds the pattern, whatever its case: id and name, UNKNOWN for none."""
    rows = elems.filter((F.col("type") == "relation") & (filters.tag("route") == "subway") & filters.tag("name").rlike(f"(?i){pattern}"))
    return rows.select("doc_id", "elem_pos", "id", F.coalesce(filters.tag("name"), F.lit("UNKNOWN")).alias("name"))


def line_relations(elems: DataFrame, line: str, exact: bool = False) -> DataFrame:
    """Relations of the parsed route kinds whose name matches: by unanchored pattern, or equal if ``exact``."""
    name: Column = filters.tag("name")
    return elems.filter((F.col("type") == "relation") & filters.tag("route").isin(*filters.ROUTES_PARSED) & (name == line if exact else name.rlike(line)))


def of_line(elems: DataFrame, line: str) -> DataFrame:
    """Elements of a saved response without the relations of other lines, where any relation is the asked line's
    (as :func:`line_relations` says); all of them where none is."""
    asked = line_relations(elems, line).select("doc_id", "elem_pos").withColumn("_asked", F.lit(True))
    some = asked.select("doc_id").distinct().withColumn("_some", F.lit(True))
    rows = elems.join(asked, ["doc_id", "elem_pos"], "left").join(some, "doc_id", "left")
    kept = (F.col("type") != "relation") | F.col("_asked").isNotNull() | F.col("_some").isNull()
    return rows.filter(F.coalesce(kept, F.lit(True))).drop("_asked", "_some")


def metro_stations(elems: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """As :func:`stations`, of the nodes that a station query asks for, in the box."""
    return filters.stations_in_bbox(stations(elems.filter(filters.is_metro_station_node())), bbox)


def rail_tracks(elems: DataFrame, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """As :func:`tracks`, of the ways that a track query asks for: of the track kinds, with a point in the box."""
    rows = tracks(elems.filter(filters.tag("railway").isin(*filters.TRACK_KINDS)))
    inside = F.exists("geometry", lambda p: filters.in_bbox(p["lat"], p["lng"], bbox)) if bbox else F.lit(True)
    return rows.filter(inside)


# -- query texts


def _box(bbox: tuple[float, float, float, float]) -> str:
    return "(" + ",".join(str(x) for x in bbox) + ")"


def line_query(line: str, bbox: tuple[float, float, float, float]) -> str:
    asked = "".join(f'relation["route"="{r}"]["name"~"{line}"]{_box(bbox)};' for r in filters.ROUTES_PARSED)
    return f"[out:json][timeout:{TIMEOUT}];({asked});out body;>;out geom;"


def track_query(bbox: tuple[float, float, float, float]) -> str:
    asked = "".join(f'way["railway"="{r}"]{_box(bbox)};' for r in filters.TRACK_KINDS)
    return f"[out:json][timeout:{TIMEOUT}];({asked});out geom;"


def station_query(bbox: tuple[float, float, float, float]) -> str:
    asked = "".join(f'node["railway"="station"]["{k}"="{v}"]{_box(bbox)};' for k, v in (("station", "subway"), ("subway", "yes")))
    return f"[out:json][timeout:{TIMEOUT}];({asked});out body;"


def listing_query(bbox: tuple[float, float, float, float]) -> str:
    asked = "".join(f'relation["route"="{r}"]{_box(bbox)};' for r in filters.ROUTES_LISTED)
    return f"[out:json][timeout:{TIMEOUT}];({asked});out tags;"


def listing_box(lat: float, lng: float) -> tuple[float, float, float, float]:
    """The box around a city's centre that lines are listed in."""
    return lat - 0.9, lng - 1.2, lat + 0.9, lng + 1.2


# -- over HTTP


def post(url: str, query: str) -> str:
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    request = Request(url, urlencode({"data": query}).encode(), {"User-Agent": USER_AGENT})
    with urlopen(request, timeout=TIMEOUT) as answer:
        return answer.read().decode()


def fetch(query: str, mirrors: tuple[str, ...] = MIRRORS, attempts: int = ATTEMPTS, pause: float = PAUSE, send: Callable[[str, str], str] = post) -> str:
    """The response text: each mirror in turn, some attempts each, a pause after each failure."""
    error: Exception | None = None
    for mirror in mirrors:
        for _ in range(attempts):
            try:
                text = send(mirror, query)
                json.loads(text)
                return text
            except Exception as e:  # noqa: BLE001 - any failure means the next attempt
                error = e
                time.sleep(pause)
    raise RuntimeError(error)


class OverpassSource(DataSource):
    """``spark.read.format("overpass").option("query", ..).load()``: one row with the response text.

    Options: query, mirrors (comma-separated), attempts, pause.
    """

    @classmethod
    def name(cls) -> str:
        return "overpass"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema):
        return _OverpassReader(self.options)


class _OverpassReader(DataSourceReader):
    def __init__(self, options):
        self.query = options["query"]
        self.mirrors = tuple((options.get("mirrors") or ",".join(MIRRORS)).split(","))
        self.attempts, self.pause = int(options.get("attempts") or ATTEMPTS), float(options.get("pause") or PAUSE)

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple[str]]:
        yield (fetch(self.query, self.mirrors, self.attempts, self.pause),)
