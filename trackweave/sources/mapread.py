"""Map elements as a Spark data source: predicates become query text, a box becomes tiles.

    spark.dataSource.register(MapSource)
    tracks = spark.read.format("map").option("bbox", "38.8,116.8,39.4,117.8").option("tiles", 4).load()
    tracks.filter("type = 'way' AND railway IN ('subway', 'light_rail', 'rail')")

asks for exactly those ways. Filters on ``type``, ``railway``, ``station``, ``subway``, ``route``, ``name``,
``metro`` and, for nodes, on ``lat`` and ``lon`` are pushed (the session has to allow it by
``spark.sql.python.filterPushdown.enabled``, which :func:`read` sets); the rest is Spark's to apply. Tiles are read by tasks of their own; an element that several
tiles send belongs to the one where its first point inside the box lies, so it comes once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains

from trackweave import schema
from trackweave.sources.elements import ATTEMPTS, MIRRORS, PAUSE, TIMEOUT, fetch

KINDS = ("node", "way", "relation")
#: Tags that are columns, and what makes a station a metro station: any of these.
TAGS = ("railway", "station", "subway", "route", "name")
METRO = (("station", "subway"), ("subway", "yes"))
#: What is printed of each kind.
OUT = {"node": "body", "way": "geom", "relation": "body"}

Box = tuple[float, float, float, float]


@dataclass
class Tile(InputPartition):
    number: int
    box: Box
    whole: Box

    def __post_init__(self):
        super().__init__(self.number)


def tiles(box: Box, n: int) -> list[Tile]:
    """The box (south, west, north, east) in n times n tiles, each up to the next one's edge."""
    south, west, north, east = box
    edges = lambda low, high: [low + (high - low) * i / n for i in range(n)] + [high]
    lat, lon = edges(south, north), edges(west, east)
    return [Tile(i * n + j, (lat[i], lon[j], lat[i + 1], lon[j + 1]), box) for i in range(n) for j in range(n)]


def query_text(kinds: Iterable[str], conditions: list[list[tuple[str, str, str]]], box: Box) -> str:
    """The query for elements of the kinds that meet one alternative (tag, operator, value) of each condition."""
    where = "(" + ",".join(str(x) for x in box) + ")"
    asked = "".join(kind + "".join(f'["{t}"{op}"{v}"]' for t, op, v in chosen) + where + ";" for kind in kinds for chosen in product(*conditions))
    out = {OUT[k] for k in kinds}
    return f"[out:json][timeout:{TIMEOUT}];({asked});out {'geom' if 'geom' in out else 'body'};"


def owner(element: dict, whole: Box, n: int) -> int:
    """The tile that the element's first point in the box (or else its first point at all) belongs to."""
    south, west, north, east = whole
    points = [(element.get("lat"), element.get("lon"))] if "lat" in element else [(p["lat"], p["lon"]) for p in element.get("geometry") or [] if p]
    inside = [p for p in points if south <= p[0] <= north and west <= p[1] <= east]
    if not points:
        return 0
    lat, lon = (inside or points)[0]
    place = lambda x, low, high: min(n - 1, max(0, int((x - low) / (high - low) * n))) if high > low else 0
    i, j = place(lat, south, north), place(lon, west, east)
    edges = lambda low, high, k: low + (high - low) * k / n
    # the tiles' edges as tiles() has them, whatever the division above rounds to
    i += (i + 1 < n and lat >= edges(south, north, i + 1)) - (i > 0 and lat < edges(south, north, i))
    j += (j + 1 < n and lon >= edges(west, east, j + 1)) - (j > 0 and lon < edges(west, east, j))
    return i * n + j


class MapSource(DataSource):
    """Options: bbox (south,west,north,east), tiles (a side), mirrors (comma-separated), attempts, pause."""

    @classmethod
    def name(cls) -> str:
        return "map"

    def schema(self) -> str:
        own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.ELEMENT)
        return f"doc_id string, elem_pos int, {own}, {', '.join(f'{t} string' for t in TAGS)}, metro boolean"

    def reader(self, schema):
        return MapReader(self.options)


class MapReader(DataSourceReader):
    def __init__(self, options):
        self.box = tuple(float(x) for x in options["bbox"].split(","))
        self.side = int(options.get("tiles") or 1)
        self.mirrors = tuple((options.get("mirrors") or ",".join(MIRRORS)).split(","))
        self.attempts, self.pause = int(options.get("attempts") or ATTEMPTS), float(options.get("pause") or PAUSE)
        self.kinds: tuple[str, ...] = KINDS
        self.conditions: list[list[tuple[str, str, str]]] = []
        self.edges: list[tuple[str, int, float]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what the query can say; yields what Spark has to apply (boxes too: their edges count)."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if column == "type" and isinstance(f, EqualTo) and value in KINDS:
                self.kinds = (value,)
            elif column == "type" and isinstance(f, In) and set(value) <= set(KINDS):
                self.kinds = tuple(k for k in KINDS if k in value)
            elif column in TAGS and isinstance(f, EqualTo) and _plain(value):
                self.conditions.append([(column, "=", value)])
            elif column in TAGS and isinstance(f, In) and all(map(_plain, value)):
                self.conditions.append([(column, "=", v) for v in value])
            elif column in TAGS and isinstance(f, StringContains) and _plain(value):
                self.conditions.append([(column, "~", re.escape(value).replace("\\", "\\\\"))])
            elif column == "metro" and isinstance(f, EqualTo) and value is True:
                self.conditions.append([(t, "=", v) for t, v in METRO])
            else:
                side = {"lat": (0, 2), "lon": (1, 3)}.get(column)
                if side and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.edges.append(("low", side[0], value))
                elif side and isinstance(f, (LessThan, LessThanOrEqual)):
                    self.edges.append(("high", side[1], value))
                yield f

    def _asked_box(self) -> Box:
        box = list(self.box)
        if self.kinds == ("node",):  # of other kinds lat and lon are null
            for what, i, value in self.edges:
                box[i] = max(box[i], value) if what == "low" else min(box[i], value)
        return tuple(box)

    def partitions(self):
        box = self._asked_box()
        if box[0] > box[2] or box[1] > box[3]:
            return []
        # relations come without places, so no tile could own them
        side = 1 if "relation" in self.kinds else self.side
        return tiles(box, side)

    def read(self, tile: Tile | None) -> Iterator[tuple]:
        if tile is None:  # what comes of no tiles
            return
        side = 1 if "relation" in self.kinds else self.side
        found = json.loads(fetch(query_text(self.kinds, self.conditions, tile.box), self.mirrors, self.attempts, self.pause)).get("elements") or []
        for place, e in enumerate(found):
            if side > 1 and owner(e, tile.whole, side) != tile.number:
                continue
            tags = e.get("tags")
            points = None if e.get("geometry") is None else [None if p is None else {"lat": _number(p.get("lat")), "lon": _number(p.get("lon"))} for p in e["geometry"]]
            members = None if e.get("members") is None else [{"type": m.get("type"), "ref": m.get("ref"), "role": m.get("role")} for m in e["members"]]
            own = tags or {}
            metro = any(own.get(t) == v for t, v in METRO)
            yield (f"{tile.number:06d}", place, e.get("type"), e.get("id"), _number(e.get("lat")), _number(e.get("lon")), e.get("nodes"), points, members, tags, *(own.get(t) for t in TAGS), metro)


def _plain(value) -> bool:
    return isinstance(value, str) and '"' not in value and "\\" not in value


def _number(x):
    return None if x is None else float(x)


def read(spark: SparkSession, box: Box, side: int = 1, **options) -> DataFrame:
    """The elements in a box, to be filtered: doc_id (the tile), elem_pos, the element, its usual tags."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MapSource)
    return spark.read.format("map").options(bbox=",".join(map(str, box)), tiles=side, **options).load()


def track_elements(spark: SparkSession, box: Box, side: int = 1, **options) -> DataFrame:
    """Ways of the track kinds."""
    from trackweave.operators.filters import TRACK_KINDS

    elems = read(spark, box, side, **options)
    return elems.filter((elems["type"] == "way") & elems["railway"].isin(*TRACK_KINDS))


def station_elements(spark: SparkSession, box: Box, side: int = 1, **options) -> DataFrame:
    """Nodes that are metro stations."""
    elems = read(spark, box, side, **options)
    return elems.filter((elems["type"] == "node") & (elems["railway"] == "station") & elems["metro"])
