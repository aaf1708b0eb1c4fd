from __future__ import annotations

import heapq
import inspect
import json
import math
import random
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

import trackweave
from trackweave import cli, config
from trackweave.functions import geo, rounding, text
from trackweave.operators import filters, graph, lines, matching, track
from trackweave.plans import build, catalog
from trackweave.sources import elements as el
from trackweave.sources import geojson, places, roster

STOPS = [0, 28, 41, 48, 81, 114, 125, 165, 228, 278, 296, 337]


def sample_track() -> dict:
    """A winding line of 338 points with a stop at some of them, by rule."""
    points = [[121.8 + i * 0.0011 + 0.004 * math.sin(i / 9), 39.0 + i * 0.0009 + 0.003 * math.cos(i / 7)] for i in range(338)]
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": points}, "properties": {"name": "L"}}
    old = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": points[:3]}, "properties": {"name": "old"}}
    stops = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": points[i]}, "properties": {"name": f"stop {k}", "line": "L"}} for k, i in enumerate(STOPS)]
    return {"type": "FeatureCollection", "features": [old, line, *stops]}


def plain_mercator(a, b) -> float:
    xy = lambda p: (6378137 * math.radians(p[0]), 6378137 * math.log(math.tan(math.pi / 4 + math.radians(p[1]) / 2)))
    return math.dist(xy(a), xy(b))


def haversine(a, b) -> float:
    (x1, y1), (x2, y2) = (map(math.radians, p) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6371008.8 * math.asin(math.sqrt(h))


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def response(*elems):
    return json.dumps({"elements": list(elems)}, ensure_ascii=False)


def parse(spark, *elems):
    return el.elements(spark.createDataFrame([(response(*elems),)], "value string"))


# -- settings and static tables


def test_settings():
    assert config.get("geometry", "interpolate_distance") == 50
    assert trackweave.__version__ == "0.1.1" and config.get("project", "version") == "0.1.1"
    with pytest.raises(KeyError):
        config.get("geometry", "nothing")


def test_rosters(spark):
    assert roster.override_of("天津", "3号线", "张兴庄") == {"lat": 39.1675, "lng": 117.1989}
    assert roster.override_of("天津", "3号线", "南站") is None
    counts = {(r.city, r.line): r["count"] for r in roster.roster(spark).groupBy("city", "line").count().collect()}
    assert counts == {("天津", "3号线"): 22, ("大连", "13号线"): 12, ("北京", "2号线"): 18}
    assert [r.station for r in roster.station_list(spark, "大连", "13号线").collect()][:2] == ["九里", "十三里"]
    assert roster.station_list(spark, "大连", "1号线").count() == 0
    held = roster.located(roster.roster(spark), roster.overrides(spark)).filter("lat IS NOT NULL").collect()
    assert [(r.station, r.lat, r.lng) for r in held] == [("张兴庄", 39.1675, 117.1989)]
    assert roster.line("北京", "2号线")["loop"] and roster.city("天津")["id"] == "CN_TJ" and roster.city("x") is None


def test_rosters_from_yaml(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "lines.yaml"
    path.write_text("cities:\n  A:\n    lines:\n      L1:\n        ref: '1'\n        stations: [x, y]\n      L2: {ref: '2'}\n", encoding="utf-8")
    found = roster.read_lines(str(path))
    assert found[("A", "L1")]["stations"] == ["x", "y"] and found[("A", "L2")]["stations"] == []


# -- names


@pytest.mark.parametrize(("raw", "wanted"), [("大连地铁13号线：普兰店振兴街-九里", "大连地铁13号线"), (" 3 号线 : a", "3号线"), (None, ""), ("", ""), ("　x　", "x")])
def test_list_names(spark, raw, wanted):
    assert one(spark, text.list_name(F.col("a")), a=raw) == wanted


@pytest.mark.parametrize(("name", "ref", "wanted"), [("地铁 2号线 ", "2", "地铁2号线"), ("x", "1", text.LINE_ONE), ("x", "1E", text.LINE_ONE), ("", "1", None), (None, None, None), ("y", None, "y")])
def test_line_names(spark, name, ref, wanted):
    assert one(spark, text.line_name(F.col("a"), F.col("b")), a=name, b=ref) == wanted


@pytest.mark.parametrize(("a", "b", "wanted"), [("南站", "南", 100), ("红旗南路", "南站", 80), ("天津站", "北京站", 0), ("站", "x", 0), (None, "x", 0), ("地铁九里站", "九里", 100), ("车站站", "站", 0)])
def test_station_scores(spark, a, b, wanted):
    assert one(spark, text.station_score(F.col("a"), F.col("b")), a=a, b=b) == wanted


@pytest.mark.parametrize(("raw", "wanted"), [(" 12 ", 12), ("+3", 3), ("1_0", 10), ("３", 3), ("1__0", None), ("3.0", None), ("1E", None), ("", None), ("99999999999", 99999999999)])
def test_whole_numbers(spark, raw, wanted):
    got = one(spark, text.whole_number(F.col("a")), a=raw)
    assert (None if got is None else int(got)) == wanted


# -- elements


def test_line_without_members(spark):
    for tags in ({"name": "九里"}, {"name": "九里", "railway": "station"}):
        elems = parse(spark, {"type": "relation", "tags": {"route": "subway", "name": "大连地铁13号线"}}, {"type": "node", "lat": 39.0, "lon": 121.0, "tags": tags})
        found, stations, points = lines.parsed_lines(elems)
        assert found.first()["name"] == "大连地铁13号线"
        assert [r.name for r in stations.collect()] == ["九里"] and points.count() == 0
    named, stops = lines.simple_lines(elems)
    assert named.first()["name"] == "大连地铁13号线" and stops.count() == 1


def test_no_relation_is_unknown(spark):
    found, stations, points = lines.parsed_lines(parse(spark, {"type": "node", "id": 1, "tags": {"name": "x"}}))
    assert found.first()["name"] == "Unknown" and stations.count() == 0 and points.count() == 0


def member_document():
    node = lambda i, lat, lon, name=None: {"type": "node", "id": i, "lat": lat, "lon": lon, "tags": {"name": name} if name else {}}
    return [
        {"type": "relation", "tags": {"route": "subway", "name": "ignored"}, "members": []},
        node(1, 1.0, 10.0, "old"), node(1, 1.5, 10.5, "A"), node(2, 2.0, 20.0), node(3, 3.0, 30.0, "C"), node(4, 4.0, 40.0, "D"),
        {"type": "way", "id": 7, "nodes": [1, 2], "geometry": [{"lat": 1.5, "lon": 10.5}, {"lat": 2.0, "lon": 20.0}]},
        {"type": "way", "id": 8, "nodes": [2, 3, 99]},
        {"type": "relation", "tags": {"route": "light_rail", "name": "L"}, "members": [
            {"type": "node", "ref": 3, "role": "stop"}, {"type": "node", "ref": 1, "role": ""}, {"type": "node", "ref": 4, "role": "guard"}, {"type": "node", "ref": 2, "role": "stop"},
            {"type": "node", "ref": 3, "role": "platform"}, {"type": "node", "ref": 1}, {"type": "way", "ref": 7, "role": ""}, {"type": "way", "ref": 8, "role": ""}, {"type": "way", "ref": 55, "role": ""}]},
    ]


def test_line_with_members(spark):
    elems = parse(spark, *member_document())
    found, stations, points = lines.parsed_lines(elems)
    assert found.first()["name"] == "L"
    assert [(r.name, r.lat) for r in stations.orderBy("pos").collect()] == [("C", 3.0), ("A", 1.5), ("C", 3.0)]
    assert [(r.lng, r.lat) for r in points.orderBy("pt_pos").collect()] == [(10.5, 1.5), (20.0, 2.0), (30.0, 3.0)]
    assert [r.name for r in lines.unique_stations(stations).orderBy("pos").collect()] == ["C", "A"]
    assert lines.parsed_lines(elems, "first")[0].first()["name"] == "ignored"
    made = json.loads(build.line_documents(elems).first()["geojson"])
    assert [f["geometry"]["type"] for f in made["features"]] == ["LineString", "Point", "Point"]
    assert made["features"][0]["properties"] == {"name": "L"} and made["features"][1]["geometry"]["coordinates"] == [30.0, 3.0]
    assert [r.n_stations for r in lines.summary(found, stations, points).collect()] == [3]


def test_scans(spark):
    elems = parse(
        spark,
        {"type": "way", "id": 1, "nodes": [1, 2], "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}], "tags": {"railway": "subway", "layer": "-1"}},
        {"type": "way", "id": 2, "nodes": [1]}, {"type": "way", "id": 3, "nodes": [1, 2]},
        {"type": "node", "id": 5, "lat": 1, "lon": 2, "tags": {"name": "S", "railway": "station", "subway": "yes"}}, {"type": "node", "id": 6, "tags": {"name": ""}}, {"type": "node", "id": 7},
        {"type": "relation", "id": 9, "tags": {"route": "subway", "name": "地铁13号线"}}, {"type": "relation", "id": 10, "tags": {"route": "bus", "name": "13"}},
    )
    assert [(r.id, r.railway, r.layer) for r in el.tracks(elems).orderBy("id").collect()] == [(1, "subway", "-1"), (3, None, None)]
    assert [r.id for r in el.way_geometries(elems).collect()] == [1]
    assert [r.name for r in el.stations(elems).collect()] == ["S"]
    assert elems.filter(filters.is_metro_station_node()).count() == 1
    assert [r.id for r in el.relations_named(elems, "13").collect()] == [9]
    assert el.line_relations(elems, "3号线").count() == 1 and el.line_relations(elems, "3号线", exact=True).count() == 0
    assert filters.tagged(el.tracks(elems), railway="subway").count() == 1 and filters.tagged(el.tracks(elems), railway="").count() == 2
    assert el.elements(spark.createDataFrame([("not json",)], "value string")).count() == 0


def test_query_texts():
    box = (38.8, 116.8, 39.4, 117.8)
    assert 'way["railway"="subway"](38.8,116.8,39.4,117.8);' in el.track_query(box)
    assert '"name"~"13号线"' in el.line_query("13号线", box) and "out tags" in el.listing_query(box)
    assert el.station_query(box).count("node[") == 2 and el.listing_box(1.0, 2.0) == (1.0 - 0.9, 2.0 - 1.2, 1.9, 3.2)


def test_mirrors_fail_over():
    asked = []

    def send(url, query):
        asked.append(url)
        if len(asked) < 5:
            raise OSError("down")
        return '{"elements": []}'

    assert el.fetch("q", attempts=3, pause=0, send=send) == '{"elements": []}'
    assert asked == [el.MIRRORS[0]] * 3 + [el.MIRRORS[1]] * 2
    with pytest.raises(RuntimeError):
        el.fetch("q", attempts=1, pause=0, send=lambda u, q: "no json")


def test_http_source_reads_from_a_server(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Answer(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"elements":[{"type":"node","id":1,"tags":{"name":"N"}}]}')

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(el.OverpassSource)
    rows = spark.read.format("overpass").option("query", "x").option("mirrors", f"http://127.0.0.1:{server.server_port}/").option("pause", "0").load()
    assert [r.id for r in el.elements(rows).collect()] == [1]
    server.shutdown()


def test_places(spark):
    hit = lambda name, box: json.dumps([{"display_name": name, "lat": "1.5", "lon": "2.5", "boundingbox": box}])
    known = places.places(spark.createDataFrame([("大连市", hit("D", ["1", "2", "3", "4"])), ("天津 中国", hit("T", None)), ("南", hit("N", None)), ("bad", "[]"), ("worse", "no json")], "asked string, body string"))
    cities = places.find_cities(spark.createDataFrame([("大连",), ("天津",), ("x",)], "wanted string"), known).collect()
    assert [(r.wanted, tuple(r.bbox)) for r in cities] == [("大连", (1.0, 3.0, 2.0, 4.0))] or [(r.wanted, r.south, r.north) for r in cities] == [("大连", 1.0, 2.0)]
    assert {r.wanted: r.name for r in places.find_places(spark.createDataFrame([("天津",), ("南站",), ("bad",)], "wanted string"), known).collect()} == {"天津": "T", "南站": "N"}
    assert places.request("x", send=lambda url: (_ for _ in ()).throw(OSError())) is None


# -- lines


def test_listing(spark):
    rows = [(0, "2号线：a-b", "2", "M", "subway", "a", "b"), (1, "二号线", "2", "M", "subway", "b", "a"), (2, "2号线", "2", "M", "tram", "", ""), (3, "X : y", "", "M", None, None, None), (4, "X", None, "M", "tram", "", ""), (5, "10", "10", "", "subway", "", ""), (6, None, "7", "M", "subway", "", ""), (7, "S", "S1", "M", "subway", "", "")]
    found = lines.listed_lines(spark.createDataFrame(rows, "pos int, name string, ref string, network string, route string, `from` string, `to` string"))
    out = found.orderBy(*lines.listing_order()).collect()
    assert [(r.line_id, r.name, r.directions) for r in out] == [("M_2", "2号线", 2), ("_10", "10", 1), ("M_X", "X", 1), ("M_S1", "S", 1)]


def test_grouped_lines(spark):
    rel = lambda name, ref: {"type": "relation", "tags": {"route": "subway", "name": name, **({"ref": ref} if ref else {})}}
    stop = lambda name, lat: {"type": "node", "lat": lat, "lon": 1.0, "tags": {"name": name, "railway": "station"}}
    elems = parse(spark, rel("2 first", "2"), stop("A", 1.0), rel("2 last", "2"), rel("late", None), stop("A", 1.0), stop("B", 9.0), rel("never", None))
    found, attached = lines.grouped_lines(elems)
    assert {(r.line_key, r.name, r.relations) for r in found.collect()} == {("2", "2 last", 2), ("late", "late", 1)}
    assert sorted((r.line_key, r.name) for r in attached.collect()) == [("2", "A"), ("2", "B"), ("late", "A"), ("late", "B")]
    assert lines.grouped_lines(elems, bbox=(0, 0, 2, 2))[1].count() == 2


# -- matching


def test_second_match_takes_a_neighbour(spark):
    official = roster.roster(spark, {("c", "l"): {"stations": ["红旗南路", "南站", "北", "张兴庄", "无"]}})
    stations = spark.createDataFrame([(0, "红旗南路站", 1.0, 2.0), (1, "北站", 3.0, 4.0), (2, "北", 5.0, 6.0)], "cand_pos long, name string, lat double, lng double")
    first = matching.line_stations(official, stations).orderBy("sequence").collect()
    assert [(r.sequence, r.osm_name, r.score) for r in first] == [(1, "红旗南路站", 100), (2, "红旗南路站", 80), (3, "北站", 100)]
    over = spark.createDataFrame([("c", "l", "张兴庄", 7.0, 8.0)], "city string, line string, station string, lat double, lng double")
    rows = matching.route_stations(official, stations, over).orderBy("sequence").collect()
    assert [(r.sequence, r.name, r.lat, r.origin) for r in rows] == [(1, "红旗南路", 1.0, "map"), (2, "南站", 1.0, "map"), (3, "北", 3.0, "map"), (4, "张兴庄", 7.0, "override")]
    assert matching.route_stations(official, stations, over, strict=True).count() == 4
    assert [r.station for r in matching.unmatched(official, matching.line_stations(official, stations)).orderBy("sequence").collect()] == ["张兴庄", "无"]


# -- a whole track


@pytest.fixture(scope="module")
def saved_track(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("track") / "line.geojson"
    path.write_text(json.dumps(sample_track()), encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def feats(spark, saved_track):
    return geojson.features(spark, saved_track).cache()


def test_length_and_distance(spark, feats):
    points, stations = geojson.line_points(feats), geojson.station_points(feats)
    assert points.count() == 338 and stations.count() == 12
    raw = sample_track()["features"][1]["geometry"]["coordinates"]
    wanted = sum(plain_mercator(a, b) for a, b in zip(raw, raw[1:], strict=False))
    assert lines.lengths(points).first()["length"] == pytest.approx(wanted, abs=0.01)
    assert lines.stamped(points).orderBy(F.desc("pt_pos")).first()["distance"] == pytest.approx(wanted, abs=0.011)
    degrees = sum(math.dist(a, b) for a, b in zip(raw, raw[1:], strict=False))
    assert lines.stamped(points, metric="degree").orderBy(F.desc("pt_pos")).first()["distance"] == pytest.approx(degrees, abs=0.006)
    true = sum(haversine(a, b) for a, b in zip(raw, raw[1:], strict=False))
    assert track.legs(track.to_utm(points)).agg(F.sum("length")).first()[0] == pytest.approx(true, rel=2e-3)


def test_linear_reference(spark, feats):
    points, stations = geojson.line_points(feats), geojson.station_points(feats)
    legs = track.legs(track.to_utm(points))
    spots = track.to_utm(stations).select("line_id", "name", F.col("x").alias("px"), F.col("y").alias("py"))
    along = {r.name: r.along for r in track.referenced(spots, legs, ["name"]).collect()}
    at = {r.pt_pos: r.cum for r in legs.collect()}
    for k, i in enumerate(STOPS[:-1]):
        assert along[f"stop {k}"] == pytest.approx(at[i], abs=0.01)
    order = lines.station_order(stations.withColumn("pos", F.xxhash64("name")), points).orderBy("place").collect()
    assert [r.idx for r in order] == STOPS


def test_export(spark, feats, tmp_path):
    rows = build.exported(feats, "stop 11", "stop 3").orderBy("i").collect()
    legs = track.legs(track.to_utm(geojson.line_points(feats)))
    total = legs.filter(f"pt_pos >= {STOPS[3]}").agg(F.sum("length")).first()[0]
    assert [r.i for r in rows] == list(range(1, math.floor(total / 50) + 3))
    where = {r.name: (r.lng, r.lat) for r in geojson.station_points(feats).collect()}
    for row, name in ((rows[0], "stop 11"), (rows[-1], "stop 3")):
        assert (row.lng, row.lat) == pytest.approx(where[name], abs=2e-7)
    labels = geojson.labelled(build.exported(feats, "stop 11", "stop 3"), "L")
    path = geojson.save_table(labels, str(tmp_path / "x" / "out.xlsx"), "L")
    assert path.endswith("out.xlsx")
    with zipfile.ZipFile(path) as book:
        sheet = ElementTree.fromstring(book.read("xl/worksheets/sheet1.xml"))
        names = ElementTree.fromstring(book.read("xl/workbook.xml"))
    tag = lambda name: "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}" + name
    cells = [["".join(c.itertext()) for c in row] for row in sheet.iter(tag("row"))]
    assert cells[0] == ["名称", "经度", "纬度"] and len(cells) == len(rows) + 1
    assert [(c[0], float(c[1]), float(c[2])) for c in cells[1:]] == [(f"L#{r.i}", r.lng, r.lat) for r in rows]
    assert [int(c.get("width")) for c in sheet.iter(tag("col"))] == [3 + max(len(c[k]) for c in cells) for k in range(3)]
    assert [x.get("name") for x in names.iter(tag("sheet"))] == ["L轨迹"]
    path = geojson.save_table(labels, str(tmp_path / "x" / "out.csv"), "L")
    assert open(path, encoding="utf-8").readline().strip() == "名称,经度,纬度"
    assert build.exported(feats, "stop 11", "nowhere").count() == 0


def test_utm_round_trip(spark):
    rnd = random.Random(1)
    spots = [(i, rnd.uniform(120, 126), rnd.uniform(0.1, 80)) for i in range(300)]
    back = {r.i: r for r in track.from_utm(track.to_utm(spark.createDataFrame(spots, "i int, lng double, lat double")).drop("lng", "lat")).collect()}
    for i, lng, lat in spots:
        assert back[i].lng == pytest.approx(lng, abs=1e-9) and back[i].lat == pytest.approx(lat, abs=1e-9)
    centre = track.to_utm(spark.createDataFrame([(123.0, 0.0)], "lng double, lat double")).first()
    assert centre.x == pytest.approx(500000) and centre.y == pytest.approx(0, abs=1e-6)
    # published values: a zone's edge at the equator, and the quarter meridian's half
    edge = track.to_utm(spark.createDataFrame([(126.0, 0.0), (123.0, 45.0)], "lng double, lat double")).collect()
    assert edge[0].x == pytest.approx(833978.557, abs=0.001) and edge[1].y == pytest.approx(0.9996 * 4984944.378, abs=0.001)


def test_mercator_pair(spark):
    d = spark.range(1).select(F.expr(geo.mercator_distance("117.0557201D", "39.0558987D", "117.0631925D", "39.0671719D")).alias("d")).first()["d"]
    assert d == pytest.approx(1817.70, abs=0.01)


def test_samples_keep_a_doubled_end(spark):
    points = spark.createDataFrame([("l", 0, 0.0, 0.0), ("l", 1, 100.0, 0.0)], "line_id string, pt_pos int, x double, y double")
    ranges = spark.createDataFrame([("l", 0.0, 100.0, False)], "line_id string, low double, high double, reversed boolean")
    assert [(r.i, r.x) for r in track.samples(ranges, track.legs(points), 50.0).orderBy("i").collect()] == [(1, 0.0), (2, 50.0), (3, 100.0), (4, 100.0)]


# -- the graph


def ways(spark, rows):
    made = [("g", i, i, nodes, [(float(n), 0.0) for n in nodes], {"railway": "subway"}) for i, nodes in enumerate(rows)]
    return spark.createDataFrame(made, "graph_id string, way_pos long, id long, nodes array<long>, geometry array<struct<lng:double,lat:double>>, tags map<string,string>")


def test_edges_and_vertices(spark):
    tracks = ways(spark, [[1, 2, 3], [2, 3], [5], [4, 4]])
    found = sorted((r.src, r.dst, r.way) for r in graph.edges(tracks).collect())
    assert found == [(1, 2, 0), (2, 1, 0), (2, 3, 0), (2, 3, 1), (3, 2, 0), (3, 2, 1), (4, 4, 3)]
    assert sorted(r.node for r in graph.vertices(tracks).collect()) == [1, 2, 3, 4]
    assert graph.edges(tracks, railway="rail").count() == 0
    assert graph.counters(tracks).first().asDict() == {"tracks": 4, "ways": 3, "raw_nodes": 7, "nodes": 4}
    uneven = tracks.withColumn("geometry", F.slice("geometry", 1, 2))
    assert sorted({r.way for r in graph.edges(uneven).collect()}) == [1, 3]


def test_paths_and_fixpoint_agree(spark):
    rnd = random.Random(4)
    links = [(rnd.randrange(40), rnd.randrange(40), rnd.randint(1, 30)) for _ in range(90)]
    both = spark.createDataFrame([("g", a, b, float(w)) for a, b, w in links] + [("g", b, a, float(w)) for a, b, w in links], "graph_id string, src long, dst long, distance double")
    pairs = [("g", i, a, b) for i, (a, b) in enumerate((a, b) for a in (0, 1, 2) for b in range(40))] + [("g", 500, 0, 77)]
    paths = {}
    for r in graph.shortest_paths(both, spark.createDataFrame(pairs, "graph_id string, pair_pos long, start long, end long")).collect():
        paths.setdefault(r.pair_pos, {})[r.pt_pos] = r.node
    least = {}
    for r in both.collect():
        least[r.src, r.dst] = min(least.get((r.src, r.dst), math.inf), r.distance)
    dist = {(r.seed, r.node): r.d for r in graph.distances(both.drop("graph_id"), spark.createDataFrame([(0,), (1,), (2,)], "seed long")).collect()}
    assert 500 not in paths
    for _, i, a, b in pairs[:-1]:
        path = [n for _, n in sorted(paths.get(i, {}).items())]
        assert bool(path) == ((a, b) in dist)
        if path:
            assert path[0] == a and path[-1] == b
            assert sum(least[x, y] for x, y in zip(path, path[1:], strict=False)) == dist[a, b]
    assert graph.dijkstra({1: [(2, 1.0), (3, 1.0)], 2: [(4, 1.0)], 3: [(4, 1.0)]}, 1, 4) == [1, 2, 4]
    assert graph.dijkstra({}, 1, 1) == [1]


def test_nearest_by_tree_and_by_all(spark, monkeypatch):
    rnd = random.Random(2)
    verts = spark.createDataFrame([("g", i, rnd.random(), rnd.random(), i) for i in range(400)] + [("g", 999, 9.0, 9.0, 999)], "graph_id string, node long, lng double, lat double, first_pos long")
    spots = spark.createDataFrame([("g", i, rnd.random() * 1.5, rnd.random() * 1.5) for i in range(60)], "graph_id string, s long, lng double, lat double")
    plain = {r.s: r.node for r in graph.nearest_vertices(spots, verts, ["s"]).collect()}
    monkeypatch.setattr(graph, "BROADCAST_STATIONS", 5)
    assert {r.s: r.node for r in graph.nearest_vertices(spots, verts, ["s"]).collect()} == plain and len(plain) == 60


def test_routes_skip_gaps(spark):
    tracks = ways(spark, [[1, 2, 3], [5, 6, 7]])
    stops = spark.createDataFrame([("g", "l", i, float(n), 0.1) for i, n in enumerate((1, 3, 5, 7))], "graph_id string, line_id string, sequence int, lng double, lat double")
    walk = lambda **kw: [r.node for r in graph.route(stops, graph.vertices(tracks), graph.edges(tracks), **kw).orderBy("pt_pos").collect()]
    assert walk() == [1, 2, 3, 6, 7]
    assert walk(gap_aware=True) == [1, 2, 3, 5, 6, 7]
    ring = ways(spark, [[1, 2, 3, 4, 1]])
    around = spark.createDataFrame([("g", "l", i, float(n), 0.1) for i, n in enumerate((1, 2, 3))], "graph_id string, line_id string, sequence int, lng double, lat double")
    closed = [r.node for r in graph.route(around, graph.vertices(ring), graph.edges(ring), close_loops=True).orderBy("pt_pos").collect()]
    assert closed == [1, 2, 3, 2, 1] or closed == [1, 2, 3, 4, 1]


def test_whole_routes(spark):
    metro = {"railway": "station", "station": "subway"}
    nodes = [{"type": "node", "id": i, "lat": 39.0 + i / 100, "lon": 117.0, "tags": {"name": n, **metro} if n else {}} for i, n in enumerate(["甲站", "", "乙"])]
    stop = {"type": "node", "id": 50, "lat": 39.02, "lon": 117.0, "tags": {"name": "甲", "highway": "bus_stop"}}
    line = lambda i, *ids, **tags: {"type": "way", "id": i, "nodes": list(ids), "geometry": [{"lat": 39.0 + k / 100, "lon": 117.0} for k in ids], "tags": tags}
    # the same places in two documents, and a road that is shorter
    documents = [(response(stop, line(8, 0, 1, railway="subway"), line(7, 0, 2, highway="road")),), (response(nodes[0], line(9, 1, 2, railway="rail"), *nodes[1:]),)]
    elems = el.elements(spark.createDataFrame(documents, "value string"))
    official = roster.roster(spark, {("c", "l"): {"stations": ["甲", "乙", "丙"]}})
    stations, points = build.routes(elems, official, roster.overrides(spark))
    assert [(r.name, r.lat) for r in stations.orderBy("sequence").collect()] == [("甲", 39.0), ("乙", 39.02)]
    rows = points.orderBy("pt_pos").collect()
    assert [r.node for r in rows] == [0, 1, 2] and rows[0].distance == 0 and rows[2].distance > 2200
    boxed = build.routes(elems, official, roster.overrides(spark), bbox=(38.9, 116.9, 39.005, 117.1))
    assert [r.name for r in boxed[0].orderBy("sequence").collect()] == ["甲"]
    anything, points = build.routes(elems, official, roster.overrides(spark), any_node=True)
    assert anything.count() == 2 and {r.node for r in points.collect()} <= {0, 1, 2}


def test_interchanges(spark):
    rows = lines.interchanges(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "station_id int, line_id string")).collect()
    assert {r.station_id: r.interchange for r in rows} == {1: True, 2: False}


# -- GeoJSON and the command line


def test_collection_of_stations(spark, tmp_path):
    named = spark.createDataFrame([("l", "大连地铁13号线")], "line_id string, name string")
    stops = spark.createDataFrame([("l", 0, "九里", 121.0, None)], "line_id string, pos int, name string, lng double, lat double")
    body = geojson.collections(named, stops).first()["geojson"]
    made = json.loads(body)
    assert made["type"] == "FeatureCollection" and len(made["features"]) == 1
    assert made["features"][0] == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [121.0, None]}, "properties": {"name": "九里", "line": "大连地铁13号线"}}
    path = geojson.save(body, str(tmp_path / "a" / "b.geojson"))
    assert "九里" in open(path, encoding="utf-8").read()
    assert geojson.file_name("大连", "13号线") == "data/大连_13号线.geojson"


def test_command_line(spark, saved_track, tmp_path, capsys):
    assert cli.main([]) == 0 and cli.main(["doctor"]) == 0
    saved = tmp_path / "saved.json"
    saved.write_text(response(*member_document()), encoding="utf-8")
    target = tmp_path / "line.geojson"
    assert cli.main(["download", "--city", "x", "--line", "L", "--elements", str(saved), "--output", str(target)]) == 0
    assert json.loads(target.read_text(encoding="utf-8"))["features"]
    assert cli.main(["list", "--city", "x", "--elements", str(saved)]) == 0
    assert cli.main(["export-track", "--city", "x", "--line", "13号线", "--start", "stop 1", "--end", "stop 2", "--track", saved_track, "--output", str(tmp_path / "t.csv")]) == 0
    assert "trackweave: 0.1.1" in capsys.readouterr().out


# -- every query against SQL


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_against_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    df = catalog.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    nulls_first = lambda row: [(x is not None, x) for x in row]
    rows = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=nulls_first)
    assert rows
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
            con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
        cursor = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=nulls_first) == rows


# -- whole-table queries without SQL, by brute force

SMALL = "/root/testdata/sf0.001"


def test_every_line_is_referenced(spark):
    tracks = {}
    for r in sorted(catalog.track_events(spark, SMALL).select("line_id", "event_id", "k").collect(), key=lambda r: r.event_id):
        tracks.setdefault(r.line_id, []).append((r.k * 37 % 100, r.k * 59 % 100))

    def off(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.dist(p, (a[0] + dx * t, a[1] + dy * t))

    wanted = {}
    for r in catalog.track_events(spark, SMALL).select("line_id", "event_id", "k").collect():
        pts, spot = tracks[r.line_id], (r.k * 37 % 100 + 3.25, r.k * 59 % 100 - 1.5)
        if len(pts) > 1:
            wanted[r.line_id, r.event_id] = min(off(spot, a, b) for a, b in zip(pts, pts[1:], strict=False))
    found = {(r.line_id, r.event_id): r.off_line for r in catalog.QUERIES["q_project"](spark, SMALL).collect()}
    assert found.keys() == wanted.keys() and max(line for line, _ in found) >= 10
    assert all(abs(found[k] - wanted[k]) <= 0.00051 for k in wanted)


def test_matches_see_every_part(spark):
    parts = [(r.p_partkey, r.p_brand) for r in catalog.table(spark, SMALL, "part").collect()]
    sequence = {}
    for key, brand in parts:
        sequence[brand] = min(key, sequence.get(brand, key))
    official = {n: f"Halt {b[6:]}" if len(b) == 7 else f"No{b}" if n % 3 == 0 else f"{b}站" for b, n in sequence.items()}
    bare = {n: s.removesuffix("站") for n, s in official.items()}
    first = {}
    for key, brand in sorted(parts, key=lambda p: (p[0] % 3, p[0] // 3)):
        first.setdefault(brand[:7], key)

    def best(name):
        hits = [(-100 if name == b else -80, (key % 3, key // 3), key, b) for b, key in first.items() if name in b or b in name]
        return (m := min(hits))[:1] + m[2:] if hits else None

    lat = lambda key: round(38.8 + key * 104729 % 600 / 1000, 3)
    wanted = {n: (official[n], f"地铁{m[2]}", -m[0], lat(m[1])) for n in official if (m := best(bare[n]))}
    assert any(best(bare[n])[1] % 5 == 0 for n in wanted)
    found = {r.sequence: (r.official_name, r.osm_name, r.score, r.lat) for r in catalog.QUERIES["q_fuzzy_match"](spark, SMALL).collect()}
    assert found == wanted

    halts = {n: f"Halt {b[6:]}" for b, n in sequence.items() if len(b) == 7}
    assert {(r.sequence, r.station) for r in catalog.QUERIES["q_unmatched"](spark, SMALL).collect()} == set(halts.items())
    rows = {r.sequence: (r.name, r.lat, r.origin) for r in catalog.QUERIES["q_match_override"](spark, SMALL).collect()}
    taken = {n: best(bare[n]) for n in official if n not in halts}
    firsts = [(m[2], n, m[1]) for n, m in taken.items()]
    again = {n: min((-100 if bare[n] == b else -80, pos, key) for b, pos, key in firsts if b in bare[n] or bare[n] in b)[2] for n in taken}
    odd = {n: (s, 1.5, "override") for n, s in halts.items() if s[-1] in "13579"}
    assert rows == {n: (official[n], lat(key), "map") for n, key in again.items()} | odd
    assert 0 < len(odd) < len(halts)


def test_distances_reach_the_end_or_say_so(spark):
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(6)], "src long, dst long, distance long")
    seeds = spark.createDataFrame([(0,)], "seed long")
    assert {(r.node, r.d) for r in graph.distances(chain, seeds, most_hops=7).collect()} == {(i, i) for i in range(7)}
    with pytest.raises(ValueError, match="3 hops"):
        graph.distances(chain, seeds, most_hops=3)
    looped = spark.createDataFrame([(0, 1, None), (1, 0, None), (0, 2, 4)], "src long, dst long, distance long")
    assert {(r.node, r.d) for r in graph.distances(looped, seeds).collect()} == {(0, 0), (1, None), (2, 4)}
    with pytest.raises(ValueError, match="negative"):
        graph.distances(chain.withColumn("distance", -F.col("distance")), seeds)
    assert inspect.signature(graph.distances).parameters["most_hops"].default is None


def test_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    cut = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: (rounds.append(1), cut(df))[1])
    rows = [(i, i + 1, 1 + i % 3) for i in range(3000)] + [(i + 1, i, 2) for i in range(3000)]
    chain = spark.createDataFrame(rows, "src long, dst long, distance long")
    wanted = {0: 0}
    for i in range(3000):
        wanted[i + 1] = wanted[i] + 1 + i % 3
    found = graph.distances(chain, spark.createDataFrame([(0,)], "seed long")).collect()
    assert {r.node: r.d for r in found} == wanted and len(found) == 3001
    pairs = spark.createDataFrame([(7, 0, 3000), (8, 3000, 0), (9, 5, 5), (10, 0, 9999)], "pair_pos long, start long, end long")
    paths = {}
    for r in sorted(graph.fixpoint_paths(chain, pairs).collect(), key=lambda r: (r.pair_pos, r.pt_pos)):
        paths.setdefault(r.pair_pos, []).append(r.node)
    assert paths == {7: list(range(3001)), 8: list(range(3000, -1, -1)), 9: [5]}
    assert len(rounds) < 300


def test_fixpoint_paths_are_dijkstras(spark):
    rnd = random.Random(6)
    edges, near = [], {}
    for _ in range(14):  # some chains between a few junctions, with ties
        a, b, n = rnd.randrange(6), rnd.randrange(6), rnd.randrange(0, 9)
        walk = [a, *(100 * len(edges) + 1000 + k for k in range(n)), b]
        for x, y in zip(walk, walk[1:], strict=False):
            w = rnd.randrange(1, 4)
            edges += [(x, y, w), (y, x, rnd.choice([w, w + 1]))]
    for x, y, w in edges:
        near.setdefault(x, {})[y] = min(w, near.get(x, {}).get(y, w))
    graph_ = {x: list(own.items()) for x, own in near.items()}
    nodes = sorted(near)
    pairs = [(k, rnd.choice(nodes), rnd.choice(nodes)) for k in range(40)]
    found = {}
    table = spark.createDataFrame(edges, "src long, dst long, distance long")
    for r in sorted(graph.fixpoint_paths(table, spark.createDataFrame(pairs, "pair_pos long, start long, end long")).collect(), key=lambda r: (r.pair_pos, r.pt_pos)):
        found.setdefault(r.pair_pos, []).append(r.node)
    assert found == {k: p for k, s, e in pairs if (p := graph.dijkstra(graph_, s, e))}


def test_checkpoints_need_a_shared_folder(spark):
    from types import SimpleNamespace

    from trackweave.operators.rows import cut_lineage

    away = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://elsewhere:7077")
    with pytest.raises(RuntimeError, match="share"):
        cut_lineage(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=away)))


def test_exact_rounding_is_pythons(spark):
    rnd = random.Random(1)
    values = [2.675, 0.125, 0.375, -2.675, -0.125, 1.005, 0.0, 117.123456785, 1e300, -3.5, 2.5, *(rnd.uniform(-200, 200) for _ in range(3000)), *(rnd.randrange(-(10**6), 10**6) / 1000 + 0.005 for _ in range(3000)), *(rnd.randrange(10**5) / 2**k for k in range(1, 12) for _ in range(50))]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 8):
        rows = df.select("x", rounding.half_even(F.col("x"), digits).alias("r")).collect()
        assert [r.r for r in rows] == [float(round(v, digits)) for v in values]
    points = spark.createDataFrame([("l", i, 117.0 + i / 977, 39.0) for i in range(40)], "line_id string, pt_pos int, lng double, lat double")
    exact, plain = ({r.pt_pos: r.distance for r in lines.stamped(points, exact_rounding=e).collect()} for e in (True, False))
    assert all(abs(exact[k] - plain[k]) <= 0.0100001 for k in plain)


def test_station_names_and_track_counts(spark):
    stations = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a"), ("e", 5, None)], "doc_id string, pos int, name string")
    assert {r.doc_id: r.names for r in lines.station_names(stations).collect()} == {"d": ["a", "b"], "e": [None]}


def test_distances_of_all_seeds(spark):
    near = {}
    for r in catalog._whole_edges(spark, SMALL).collect():
        own = near.setdefault(r.src, {})
        own[r.dst] = min(r.distance, own.get(r.dst, r.distance))
    wanted = set()
    seeds = {r.start for r in catalog._way_ends(spark, SMALL).collect()}
    for seed in seeds:
        least, heap = {}, [(0, seed)]
        while heap:
            d, node = heapq.heappop(heap)
            if node not in least:
                least[node] = d
                for other, w in near.get(node, {}).items():
                    heapq.heappush(heap, (d + w, other))
        wanted |= {(seed, node, d) for node, d in least.items()}
    found = [(r.seed, r.node, r.d) for r in catalog.QUERIES["q_shortest_path"](spark, SMALL).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted and len(seeds) > 5


def test_station_order_takes_points_of_every_line(spark, monkeypatch):
    seen, order = [], lines.station_order
    monkeypatch.setattr(lines, "station_order", lambda stations, points: (seen.append(points.select("line_id").distinct().count()), order(stations, points))[1])
    catalog.QUERIES["q_station_order"](spark, "/root/testdata/sf0.01")
    assert seen == [catalog.table(spark, "/root/testdata/sf0.01", "events").select("user_id").distinct().count()] and seen[0] > 20


def test_distances_begin_at_every_vertex(spark):
    nodes = {r.src for r in catalog._whole_edges(spark, SMALL).collect()}
    starts = {r.start for r in catalog._way_ends(spark, SMALL).collect()}
    found = catalog.QUERIES["q_shortest_path"](spark, SMALL).collect()
    assert {r.seed for r in found} == nodes > starts


def test_paths_lead_from_every_vertex_to_the_next(spark):
    nodes = sorted({r.src for r in catalog._whole_edges(spark, SMALL).filter("src <> dst").collect()})
    ways = {("way", r.way): (r.start, r.end) for r in catalog._way_ends(spark, SMALL).collect()}
    paths = {}
    for r in sorted(catalog.QUERIES["q_paths"](spark, SMALL).collect(), key=lambda r: (r.asked, r.pair_pos, r.pt_pos)):
        paths.setdefault((r.asked, r.pair_pos), []).append(r.node)
    assert {k: (p[0], p[-1]) for k, p in paths.items()} == ways | {("vertex", a): (a, b) for a, b in zip(nodes, nodes[1:], strict=False)}


@pytest.mark.parametrize("name", ["q_tracks", "q_track_count", "q_metro_stations", "q_relations_named", "q_simple_line", "q_grouped_lines", "q_city_listing"])
def test_queries_read_whole_documents(spark, name):
    files = catalog.QUERIES[name](spark, SMALL).inputFiles()
    assert {"part", "events", "orders", "lineitem"} <= {f.rsplit("/", 1)[1].removesuffix(".parquet") for f in files}


def test_track_counts_tell_every_document(spark):
    way = {"type": "way", "id": 1, "nodes": [1, 2], "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}]}
    bare, short, empty = {**way, "geometry": None}, {**way, "nodes": [1]}, {**way, "geometry": []}
    nodeless = {k: v for k, v in way.items() if k != "nodes"}
    texts = {"two": [way, bare, way], "none": [bare, short, empty, nodeless], "other": [{"type": "node", "id": 5}, {"id": 6}]}
    responses = spark.createDataFrame([(k, json.dumps({"elements": v})) for k, v in texts.items()], "k string, value string")
    elems = el.elements(responses, key="k")
    assert {r.doc_id: r.tracks for r in el.track_count(elems).collect()} == {"two": 2, "none": 0, "other": 0}
    assert el.way_geometries(elems).groupBy("doc_id").count().collect() == [("two", 2)]


def test_track_count_has_documents_behind_the_last_way(spark, tmp_path):
    import duckdb

    con = duckdb.connect()
    for name in ("part", "orders", "lineitem", "events"):
        rows = catalog.table(spark, SMALL, name)
        (rows.filter("user_id < 4") if name == "events" else rows).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    found = {r.doc_id: r.tracks for r in catalog.QUERIES["q_track_count"](spark, str(tmp_path)).collect()}
    assert found == dict(con.execute(catalog.ORACLES["q_track_count"]).fetchall())
    assert found.keys() == {"d0", "d1", "d2", "d3"} and found["d0"] > 0 == found["d1"] == found["d2"] == found["d3"]
