"""Sources and sinks against a server of this machine and a folder."""

from __future__ import annotations

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote_plus, urlparse

import pytest
from pyspark.sql import functions as F

from tests.test_rail import response
from trackweave import cli
from trackweave.sources import elements as el
from trackweave.sources import geojson, geowrite, jsonitems, mapread, places, roster

BOX = (38.0, 116.0, 39.0, 118.0)


class Service:
    """Answers like the two services: elements for posted queries, places for names; remembers what was asked."""

    def __init__(self, elements=lambda query: [], hits=None):
        self.queries: list[str] = []
        self.names: list[str] = []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def reply(self, body: str):
                self.send_response(200)
                self.end_headers()
                self.wfile.write(body.encode())

            def do_POST(self):
                query = unquote_plus(self.rfile.read(int(self.headers["Content-Length"])).decode()).removeprefix("data=")
                outer.queries.append(query)
                self.reply(json.dumps({"elements": elements(query)}))

            def do_GET(self):
                name = parse_qs(urlparse(self.path).query)["q"][0]
                outer.names.append(name)
                self.reply((hits or {}).get(name, "[]"))

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}/"


@pytest.fixture
def served():
    made = []

    def make(*args, **kw):
        made.append(Service(*args, **kw))
        return made[-1]

    yield make
    for s in made:
        s.server.shutdown()


# -- the map


def test_predicates_become_the_query(spark, served):
    service = served()
    read = lambda: mapread.read(spark, BOX, mirrors=service.url, pause=0)
    asked = lambda df: (service.queries.clear(), df.collect(), service.queries[:])[2]
    assert asked(mapread.track_elements(spark, BOX, mirrors=service.url, pause=0)) == [el.track_query(BOX)]
    assert asked(mapread.station_elements(spark, BOX, mirrors=service.url, pause=0)) == [el.station_query(BOX)]
    where = "(38.0,116.0,39.0,118.0)"
    assert asked(read().filter("type = 'relation' AND route = 'subway' AND contains(name, '13号线(a')")) == [f'[out:json][timeout:180];(relation["route"="subway"]["name"~"13号线\\\\(a"]{where};);out body;']
    assert asked(read().filter("type = 'node' AND lat > 38.5 AND lon <= 117.5")) == ["[out:json][timeout:180];(node(38.5,116.0,39.0,117.5););out body;"]
    assert asked(read().filter("type = 'node' AND lat > 50")) == []
    assert asked(read().filter("type = 'way' AND (railway = 'rail' OR name = 'x')")) == [f"[out:json][timeout:180];(way{where};);out geom;"]


def test_what_is_not_pushed_is_sparks(spark, served):
    nodes = [{"type": "node", "id": i, "lat": 38.5 + i / 100, "lon": 117.0, "tags": {"railway": "station", "name": f"n{i}"}} for i in range(5)]
    service = served(elements=lambda query: nodes)
    found = mapread.read(spark, BOX, mirrors=service.url, pause=0).filter("type = 'node' AND railway = 'station' AND lat > 38.5 AND id % 2 = 0")
    assert sorted(r.id for r in found.collect()) == [2, 4]
    assert [r.name for r in el.stations(found).orderBy("cand_pos").collect()] == ["n2", "n4"]
    service.queries.clear()
    assert mapread.read(spark, BOX, mirrors=service.url, pause=0).count() == 5 and service.queries == [mapread.query_text(mapread.KINDS, [], BOX)]


def test_tiles_give_every_element_once(spark, served):
    line = lambda i, *at: {"type": "way", "id": i, "nodes": list(range(len(at))), "geometry": [{"lat": a, "lon": o} for a, o in at], "tags": {"railway": "rail"}}
    all_ = [line(1, (38.1, 116.1), (38.9, 117.9)), line(2, (37.0, 115.0), (38.5, 117.0), (38.6, 117.1)), line(3, (38.25, 116.5), (38.2, 116.4)), line(4, (39.0, 118.0), (38.99, 117.99)), line(5, (50.0, 50.0), (51.0, 51.0))]

    def answer(query):
        s, w, n, e = (float(x) for x in query.split('"rail"](')[1].split(")")[0].split(","))
        inside = lambda p: s <= p["lat"] <= n and w <= p["lon"] <= e
        return [x for x in all_ if any(map(inside, x["geometry"])) or x["id"] == 5]

    service = served(elements=answer)
    found = mapread.read(spark, BOX, 4, mirrors=service.url, pause=0).filter("type = 'way' AND railway = 'rail'").collect()
    assert sorted(r.id for r in found) == [1, 2, 3, 4, 5] and len(service.queries) == 16 and len({r.doc_id for r in found}) > 1


# -- the geocoder


def hit(box=("1", "2", "3", "4")):
    return json.dumps([{"display_name": "D", "lat": "1.5", "lon": "2.5", "boundingbox": box and list(box)}])


def test_candidates_are_asked_in_order_until_one_is_usable(spark, served):
    service = served(hits={"城市": hit(None), "城 中国": hit(), "都": hit(), "村市": hit()})
    wanted = spark.createDataFrame([("城",), ("都",), ("村",), ("空",), ("",), (None,), ("城",)], "wanted string")
    answers = places.asked_places(wanted, cities=True, pause=0, service=service.url)
    of = lambda c: [n for n in service.names if n.startswith(c)]
    assert of("城") == ["城", "城市", "城 中国"] and of("都") == ["都"] and of("村") == ["村", "村市"] and of("空") == ["空", "空市", "空 中国"]
    found = places.find_cities(wanted.dropna().distinct(), places.places(answers))
    assert {r.wanted: r.lat for r in found.collect()} == {"城": 1.5, "都": 1.5, "村": 1.5}
    # what is saved isn't asked again; names that came to nothing are
    service.names.clear()
    again = places.asked_places(wanted, cities=True, answers=answers, pause=0, service=service.url)
    assert service.names and all(n.startswith("空") for n in service.names)
    assert again.count() == answers.count()


def test_stations_lose_their_ending(spark, served):
    service = served(hits={"南": hit(None)})
    wanted = spark.createDataFrame([("南站",)], "wanted string")
    answers = places.asked_places(wanted, pause=0, service=service.url)
    assert service.names == ["南站", "南"] and places.find_places(wanted, places.places(answers)).first()["name"] == "D"
    assert not places.usable("[]", False) and not places.usable('[{"lat": "x", "lon": "1"}]', False) and not places.usable(None, True)


def test_command_line_asks_for_city_and_line(spark, served, tmp_path):
    relation = lambda name: {"type": "relation", "id": 1, "tags": {"route": "subway", "name": name}, "members": []}
    service = served(elements=lambda query: [relation("城13号线"), {"type": "node", "id": 2, "lat": 1.0, "lon": 2.0, "tags": {"name": "S"}}], hits={"城市": hit()})
    target = tmp_path / "line.geojson"
    assert cli.main(["download", "--city", "城", "--line", "13号线", "--geocoder", service.url, "--mirrors", service.url, "--output", str(target)]) == 0
    assert service.names == ["城", "城市"] and service.queries == [el.line_query("13号线", (1.0, 3.0, 2.0, 4.0))]
    assert json.loads(target.read_text(encoding="utf-8"))["features"][0]["properties"] == {"name": "S", "line": "城13号线"}
    with pytest.raises(SystemExit, match="no place"):
        cli.main(["list", "--city", "nowhere", "--geocoder", service.url, "--mirrors", service.url])


def test_command_line_walks_a_route(spark, served, tmp_path, monkeypatch):
    monkeypatch.setitem(roster.LINES, ("城", "1号线"), {"stations": ["甲", "乙", "丙"]})
    node = lambda i, name: {"type": "node", "id": i, "lat": 1.0 + i / 100, "lon": 3.0, "tags": {"name": name, "railway": "station", "subway": "yes"}}
    way = {"type": "way", "id": 9, "nodes": [0, 1, 2], "geometry": [{"lat": 1.0 + i / 100, "lon": 3.0} for i in range(3)], "tags": {"railway": "subway"}}
    service = served(elements=lambda query: [node(0, "甲站"), node(2, "乙")] if "node" in query else [way], hits={"城": hit()})
    target = tmp_path / "route.geojson"
    assert cli.main(["route", "--city", "城", "--line", "1号线", "--geocoder", service.url, "--mirrors", service.url, "--strict", "--gap-aware", "--output", str(target)]) == 0
    box = (1.0, 3.0, 2.0, 4.0)
    assert set(service.queries) == {el.station_query(box), el.track_query(box)}
    made = json.loads(target.read_text(encoding="utf-8"))["features"]
    assert [f["properties"]["name"] for f in made] == ["1号线", "甲", "乙"] and made[0]["geometry"]["coordinates"] == [[3.0, 1.0], [3.0, 1.01], [3.0, 1.02]]
    with pytest.raises(SystemExit, match="no roster"):
        cli.main(["route", "--city", "城", "--line", "2号线", "--geocoder", service.url, "--mirrors", service.url])


def test_saved_responses_give_the_asked_line(spark, tmp_path):
    relation = lambda i, name: {"type": "relation", "id": i, "tags": {"route": "subway", "name": name}, "members": []}
    saved, target = tmp_path / "saved.json", tmp_path / "line.geojson"
    saved.write_text(response(relation(1, "Line 1"), relation(2, "Line 2"), relation(3, "Line 1 again"), relation(4, "Line 3"), {"type": "node", "id": 9, "lat": 1, "lon": 1, "tags": {"name": "S"}}), encoding="utf-8")
    named = lambda line, *more: (cli.main(["download", "--city", "x", "--line", line, "--elements", str(saved), "--output", str(target), *more]), json.loads(target.read_text(encoding="utf-8"))["features"][0]["properties"]["line"])[1]
    assert named("Line 2") == "Line 2" and named("Line 1") == "Line 1 again" and named("Line 1", "--pick", "first") == "Line 1" and named("other") == "Line 3"


# -- documents written by tasks


def test_lines_are_written_by_tasks(spark, tmp_path):
    n = 400
    lines = spark.range(n).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("line_id"), F.concat(F.lit('Line "'), F.col("id").cast("string")).alias("name"))
    key = lambda c, every: F.concat(F.lit("a/"), (F.col(c) % every).cast("string"))
    points = spark.range(20_000).select(key("id", 300).alias("line_id"), F.col("id").alias("pt_pos"), (F.col("id") / 7).alias("lng"), (F.col("id") / 11).alias("lat"))
    stations = spark.range(900).select(key("id", n).alias("line_id"), F.col("id").alias("pos"), F.concat(F.lit("站"), F.col("id").cast("string")).alias("name"), F.col("id").cast("double").alias("lng"), F.when(F.col("id") != 5, 1.0).alias("lat"))
    geowrite.write(lines, stations, str(tmp_path / "out"), points)
    wanted = {r.line_id.replace("/", "%2F") + ".geojson": json.loads(r.geojson) for r in geojson.collections(lines, stations, points).collect()}
    assert {f.name: json.loads(f.read_text(encoding="utf-8")) for f in (tmp_path / "out").iterdir()} == wanted and len(wanted) == n
    feats = geojson.features(spark, str(tmp_path / "out"))
    assert geojson.line_points(feats).count() == 20_000 and geojson.station_points(feats).count() == 900


def test_failed_jobs_leave_no_file(spark, tmp_path):
    lines = spark.range(50).select(F.col("id").cast("string").alias("line_id"), F.lit("L").alias("name"))
    bad = lines.withColumn("name", F.when(F.col("line_id") == "31", F.raise_error("no name")).otherwise(F.col("name")))
    none = spark.createDataFrame([], "line_id string, pos long, name string, lng double, lat double")
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of it
        geowrite.write(bad, none, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    geowrite.write(lines, none, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 50
    spark.dataSource.register(geowrite.GeoJsonSink)
    with pytest.raises(Exception, match="columns are missing"):
        lines.write.format("geojson").mode("append").save(str(tmp_path / "out"))


# -- large documents


def odd_element(rnd, i):
    words = ['"', "\\", "\\\\", "{", "}", "[", "]", "x", "é", "站", '"elements": [', "\n"]
    name = "".join(rnd.choice(words) for _ in range(rnd.randrange(9)))
    return {"type": "node", "id": i, "lat": i / 7, "lon": 1.0, "tags": {"name": name, "elements": "[{"}}


def test_large_documents_are_read_in_ranges(spark, tmp_path):
    rnd = random.Random(4)
    for k in range(3):
        head = {"osm3s": {"a": [{"b": 1}], "c": "elements"}, "other": [{"elements": [{"type": "node"}]}]}
        document = head | {"elements": [odd_element(rnd, i) for i in range(60 * k)]} | {"last": [{"x": "}"}]}
        (tmp_path / f"{k}.json").write_text(json.dumps(document, ensure_ascii=bool(k % 2), indent=(None, 1)[k // 2]), encoding="utf-8")
    key = lambda df: sorted((r.doc_id.rsplit("/", 1)[1], r.elem_pos, r.id, r.lat, r.tags["name"]) for r in df.collect())
    plain = key(el.read_elements(spark, str(tmp_path)))
    assert len(plain) == 180
    for size in (97, 1_000, 1 << 20):
        assert key(el.read_large(spark, str(tmp_path), size)) == plain


def test_ranges_begin_anywhere(tmp_path):
    rnd = random.Random(5)
    path = tmp_path / "one.json"
    document = {"features": [odd_element(rnd, i) for i in range(12)] + [{"deep": [[{"a": "\\" * 600}]]}], "end": "\\"}
    path.write_text(json.dumps(document), encoding="utf-8")
    total = path.stat().st_size
    for size in (1, 7, 64, 300, total):
        cuts = [(a, min(total, a + size)) for a in range(0, total, size)]
        parts = [jsonitems._Range(str(path), a, b, "features") for a, b in cuts]
        states = jsonitems.begun([jsonitems.summary(p.tokens(p.start, p.end)) for p in parts])
        found = []
        for part, (inside, stack, before) in zip(parts, states, strict=True):
            assert before == len(found)
            found += [json.loads(x) for x in jsonitems.items(part, inside, stack)]
        assert found == document["features"]


def test_features_of_large_documents(spark, tmp_path):
    point = lambda i: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 2.5]}, "properties": {"name": f"n{i}", "line": "L"}}
    line = {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[i, i / 3] for i in range(500)]}, "properties": {"name": "L"}}
    (tmp_path / "l.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [line, *map(point, range(40))]}), encoding="utf-8")
    rows = lambda df: sorted(tuple(r)[1:] for r in df.collect())
    large = geojson.large_features(spark, str(tmp_path), 512)
    assert rows(large) == rows(geojson.features(spark, str(tmp_path))) and geojson.line_points(large).count() == 500


def test_many_small_documents_are_read_without_a_look(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"{k}.json").write_text(json.dumps({"features": [{"k": k}, {"k": -k}][: k % 3]}), encoding="utf-8")
    monkeypatch.setattr(jsonitems, "begun", lambda summaries: pytest.fail("looked at"))
    found = jsonitems.read_items(spark, str(tmp_path), "features")
    rows = sorted((int(r.file.rsplit("/", 1)[1][:-5]), r.pos, json.loads(r.value)["k"]) for r in found.collect())
    assert rows == [(k, i, (k, -k)[i]) for k in range(300) for i in range(k % 3)]
