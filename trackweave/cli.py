"""Command line: download, list, route, export-track, doctor.

    python -m trackweave download --city 大连 --line 13号线 --elements saved.json
"""

from __future__ import annotations

import argparse
import logging
import platform
import sys

from trackweave import __version__


def logger(path: str | None = None) -> logging.Logger:
    log = logging.getLogger("trackweave")
    if not log.handlers:
        log.setLevel(logging.INFO)
        for handler in [logging.StreamHandler(), *([logging.FileHandler(path, encoding="utf-8")] if path else [])]:
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            log.addHandler(handler)
    return log


def doctor() -> dict[str, str]:
    """Versions of what the engine runs on."""
    import pyspark

    return {"trackweave": __version__, "python": sys.version.split()[0], "os": platform.system(), "pyspark": pyspark.__version__}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trackweave")
    sub = top.add_subparsers(dest="command")
    sub.add_parser("doctor")
    for name in ("download", "list", "route", "export-track"):
        p = sub.add_parser(name)
        p.add_argument("--city", required=True)
        if name != "list":
            p.add_argument("--line", required=True)
        if name == "export-track":
            p.add_argument("--start", required=True)
            p.add_argument("--end", required=True)
            p.add_argument("--step", type=float, default=50)
            p.add_argument("--track", help="GeoJSON of the line; data/{city}_{line}.geojson if not given")
        else:
            p.add_argument("--elements", help="a saved response; asked for over HTTP if not given")
            p.add_argument("--geocoder", help="another service to look the city up with")
            p.add_argument("--mirrors", help="other services to ask for elements, comma-separated")
        if name == "route":
            p.add_argument("--tiles", type=int, default=1, help="into how many tiles a side the city's box is cut")
            p.add_argument("--strict", action="store_true", help="match names once")
            p.add_argument("--gap-aware", action="store_true", help="keep the first point after a gap")
            p.add_argument("--close-loops", action="store_true", help="go on from the last station to the first")
        if name == "download":
            p.add_argument("--pick", choices=("last", "first"), default="last", help="which of several relations stands for the line")
        p.add_argument("--output")
    return top


def _city(spark, args):
    from trackweave.sources import places

    wanted = spark.createDataFrame([(args.city,)], "wanted string")
    answers = places.asked_places(wanted, cities=True, service=args.geocoder or places.SERVICE)
    city = places.find_cities(wanted, places.places(answers)).first()
    if city is None:
        raise SystemExit(f"no place named {args.city}")
    return city


def _elements(spark, args, query_of):
    from trackweave.sources import elements as el

    if args.elements:
        return el.read_elements(spark, args.elements)
    spark.dataSource.register(el.OverpassSource)
    source = spark.read.format("overpass").option("query", query_of(_city(spark, args)))
    return el.elements((source.option("mirrors", args.mirrors) if args.mirrors else source).load())


def _route(spark, args):
    """The line's document: stations of its roster, and the track along them."""
    from pyspark.sql import functions as F

    from trackweave.plans import build
    from trackweave.sources import elements as el
    from trackweave.sources import geojson, mapread, roster

    if args.elements:
        elems = el.read_elements(spark, args.elements)
    else:
        city = _city(spark, args)
        box, options = (city["south"], city["west"], city["north"], city["east"]), {"mirrors": args.mirrors} if args.mirrors else {}
        elems = mapread.station_elements(spark, box, args.tiles, **options).unionByName(mapread.track_elements(spark, box, args.tiles, **options))
    own = roster.station_list(spark, args.city, args.line)
    if own.isEmpty():
        raise SystemExit(f"no roster of {args.city} {args.line}")
    stations, points = build.routes(elems, own, roster.overrides(spark), strict=args.strict, gap_aware=args.gap_aware, close_loops=args.close_loops)
    named = own.select(F.concat_ws(" ", "city", "line").alias("line_id"), F.col("line").alias("name")).distinct()
    stops = stations.select(F.concat_ws(" ", "city", "line").alias("line_id"), F.col("sequence").alias("pos"), "name", "lng", "lat")
    return geojson.collections(named, stops, points).first()


def main(argv: list[str] | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command is None:
        top.print_help()
        return 0
    if args.command == "doctor":
        for name, value in doctor().items():
            print(f"{name}: {value}")
        return 0

    from pyspark.sql import SparkSession

    from trackweave.plans import build
    from trackweave.sources import elements as el
    from trackweave.sources import geojson

    spark = SparkSession.builder.appName("trackweave").getOrCreate()
    if args.command == "download":
        box = lambda c: (c["south"], c["west"], c["north"], c["east"])
        elems = _elements(spark, args, lambda c: el.line_query(args.line, box(c)))
        if args.elements:
            elems = el.of_line(elems, args.line)
        document = build.line_documents(elems, args.pick).first()
        if document is None:
            raise SystemExit("the response has no elements")
        target = geojson.save(document["geojson"], args.output or geojson.file_name(args.city, args.line))
        print(f"{document['name']}: {target}")
    elif args.command == "route":
        print(geojson.save(_route(spark, args)["geojson"], args.output or geojson.file_name(args.city, args.line)))
    elif args.command == "list":
        elems = _elements(spark, args, lambda c: el.listing_query(el.listing_box(c["lat"], c["lng"])))
        listed = build.city_listing(elems).select("line_id", "ref", "name", "network", "route", "from", "to", "directions")
        print(*listed.columns, sep="\t")
        for row in listed.toLocalIterator():
            print(*row, sep="\t")
    else:
        feats = geojson.features(spark, args.track or geojson.file_name(args.city, args.line))
        rows = geojson.labelled(build.exported(feats, args.start, args.end, args.step), args.line)
        print(geojson.save_table(rows, args.output or f"output/{args.city}_{args.line}.xlsx", args.line))
    return 0
