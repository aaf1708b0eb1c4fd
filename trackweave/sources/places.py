"""Places by name: saved geocoder answers as a table, looked up by candidate names in order."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave import schema
from trackweave.functions import text
from trackweave.operators.rows import cut_lineage, keep_first

HIT = "array<struct<display_name:string,lat:string,lon:string,boundingbox:array<string>>>"


def places(answers: DataFrame, asked: str = "asked", body: str = "body") -> DataFrame:
    """One row for each answered name: the first hit, its numbers parsed; unusable answers go.

    The box comes as south, north, west, east.
    """
    hit = F.get(F.from_json(body, HIT), F.lit(0))
    rows = answers.select(F.col(asked).alias("asked"), hit.alias("h")).filter("h IS NOT NULL")
    box = [F.get("h.boundingbox", F.lit(i)).try_cast("double") for i in range(4)]
    out = rows.select("asked", F.col("h.display_name").alias("name"), F.col("h.lat").try_cast("double").alias("lat"), F.col("h.lon").try_cast("double").alias("lng"), *(b.alias(n) for b, n in zip(box, ("south", "north", "west", "east"), strict=True)))
    return out.filter("lat IS NOT NULL AND lng IS NOT NULL")


def empty_places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"asked string, {schema.PLACE}")


def _first_found(wanted: DataFrame, known: DataFrame, candidates: Column) -> DataFrame:
    tries = wanted.select("wanted", F.posexplode(candidates).alias("try", "asked"))
    return keep_first(tries.join(known, "asked"), ["wanted"], ["try"]).drop("asked", "try")


def find_places(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """For each ``wanted`` name the place of the first candidate name that is known."""
    return _first_found(wanted, known, text.place_candidates(F.col("wanted")))


def find_cities(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """As places, for cities with a usable box; with ``bbox`` as south, west, north, east."""
    whole = known.filter("south IS NOT NULL AND north IS NOT NULL AND west IS NOT NULL AND east IS NOT NULL")
    return _first_found(wanted, whole, text.city_candidates(F.col("wanted"))).withColumn("bbox", F.struct("south", "west", "north", "east"))


# The service and what is asked of it.
SERVICE = "https://nominatim.openstreetmap.org/search"
ASKED = {"format": "json", "limit": 1, "countrycodes": "cn"}
#: Seconds between two requests of a task.
PAUSE = 1.0


def request(query: str, send: Callable[[str], str] | None = None, service: str = SERVICE) -> str | None:
    """The geocoder's answer text, or None on any failure."""
    from urllib.parse import urlencode
    from urllib.request import Request, urlopen

    from trackweave.sources.elements import USER_AGENT

    def over_http(url: str) -> str:
        with urlopen(Request(url, headers={"User-Agent": USER_AGENT}), timeout=30) as answer:
            return answer.read().decode()

    try:
        return (send or over_http)(f"{service}?" + urlencode({"q": query} | ASKED))
    except Exception:  # noqa: BLE001 - a place that can't be asked for is a place not found
        return None


def usable(body: str | None, boxed: bool) -> bool:
    """Whether an answer's first hit has a place, and a whole box where one is needed; as :func:`places` reads it."""
    try:
        hit = json.loads(body or "")[0]
        numbers = [hit["lat"], hit["lon"], *([hit["boundingbox"][i] for i in range(4)] if boxed else [])]
        return all(math.isfinite(float(x)) for x in numbers)
    except (ValueError, TypeError, LookupError):
        return False


def asked_places(wanted: DataFrame, cities: bool = False, answers: DataFrame | None = None, tasks: int = 1, pause: float = PAUSE, service: str = SERVICE) -> DataFrame:
    """asked, body: the answers that ``wanted`` names need, of ``answers`` (asked, body) and newly asked for.

    A name whose saved answers settle it isn't asked for. Of the others each is asked for by its first candidate,
    by the next only where that has no usable answer, and no candidate twice in a task. ``tasks`` ask side by
    side, each ``pause`` seconds apart. The result is written, so nothing is asked again; saved, it is the next
    call's ``answers``.
    """
    find, candidates = (find_cities, text.city_candidates) if cities else (find_places, text.place_candidates)
    names = wanted.select("wanted").filter("wanted <> ''").distinct()
    known = wanted.sparkSession.createDataFrame([], "asked string, body string") if answers is None else answers.select("asked", "body")
    rest = names.join(find(names, places(known)).select("wanted"), "wanted", "left_anti")
    tries = rest.select("wanted", candidates(F.col("wanted")).alias("tries")).repartition(tasks, "wanted")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        had: dict[str, str | None] = {}
        for frame in frames:
            for names_ in frame["tries"]:
                for name in names_:
                    if name not in had:
                        if had:
                            time.sleep(pause)
                        had[name] = request(name, service=service)
                        yield pd.DataFrame({"asked": [name], "body": [had[name]]})
                    if usable(had[name], cities):
                        break

    new = cut_lineage(tries.mapInPandas(ask, "asked string, body string")).filter("body IS NOT NULL")
    return keep_first(known.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))), ["asked"], ["_new"]).drop("_new")
