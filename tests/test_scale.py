"""Operators where names, points, lines and graphs are many: equal to the plain way, and how much they look at."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_rail import parse, response
from trackweave import cli
from trackweave.operators import boxtree, cutgraph, graph, lines, matching, rows, track
from trackweave.plans import build, catalog


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# -- matching


def test_equal_places_in_two_documents(spark):
    official = spark.createDataFrame([("c", "l", 1, "A"), ("c", "l", 2, "Y"), ("c", "l", 3, "none")], "city string, line string, sequence int, station string")
    stations = spark.createDataFrame([("d1", 0, "A", 1.0, 1.5), ("d1", 1, "B", 2.0, 2.5), ("d2", 0, "X", 3.0, 3.5), ("d2", 1, "Y", 4.0, 4.5), ("d0", 5, "A", 9.0, 9.5)], "doc_id string, cand_pos long, name string, lat double, lng double")
    found = matching.line_stations(official, stations).orderBy("sequence").collect()
    assert [(r.sequence, r.osm_name, r.lat, r.score) for r in found] == [(1, "A", 9.0, 100), (2, "Y", 4.0, 100)]
    assert [r.station for r in matching.unmatched(official, matching.line_stations(official, stations)).collect()] == ["none"]


def test_thresholds_and_scopes(spark):
    official = spark.createDataFrame([("u", 1, "abc"), ("v", 2, "abc"), ("v", 3, "")], "city string, k int, official_name string")
    cands = spark.createDataFrame([("u", 0, "abcd"), ("v", 0, "b"), ("v", 1, "abc"), ("w", 0, "abc")], "city string, cand_pos int, cand_name string")
    best = lambda **kw: {r.k: (r.cand_name, r.score) for r in matching.best_matches(official, cands, ["k"], scope=["city"], **kw).collect()}
    assert best() == {1: ("abcd", 80), 2: ("abc", 100), 3: (None, None)}
    assert best(threshold=90) == {1: (None, None), 2: ("abc", 100), 3: (None, None)}
    assert best(threshold=101) == {1: (None, None), 2: (None, None), 3: (None, None)}


def test_many_names_meet_by_equal_values(spark):
    n = 300_000
    number = lambda c, k: F.lpad(F.conv(F.pmod(F.xxhash64(F.lit(k), c), F.lit(2**31)).cast("string"), 10, 36), 7, "0")
    names = spark.range(n).select(F.lit("c").alias("city"), F.lit("l").alias("line"), F.col("id").cast("int").alias("sequence"), number(F.col("id"), 1).alias("station"))
    # every third candidate holds a name, every third is held by one, the others are strangers
    held = F.when(F.col("id") % 3 == 0, F.concat(F.lit("x"), number(F.col("id") * 2 % n, 1))).when(F.col("id") % 3 == 1, F.substr(number(F.col("id"), 1), F.lit(1), F.lit(6))).otherwise(number(F.col("id"), 2))
    cands = spark.range(n).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("cand_pos"), held.alias("name"), F.lit(0.0).alias("lat"), F.col("id").cast("double").alias("lng"))
    found = matching.line_stations(names, cands)
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    own = {r.sequence: r.station for r in names.collect()}
    best: dict[str, tuple] = {}
    by_name: dict[str, tuple] = {}
    for r in cands.collect():
        key = (r.doc_id, r.cand_pos, r.name)
        by_name[r.name] = min(key, by_name.get(r.name, key))
    for name, key in by_name.items():
        for i in range(len(name)):
            for j in range(i + 1, len(name) + 1):
                part = name[i:j]
                if len(part) < len(name):
                    best[part] = min(key, best.get(part, key))
    wanted = {}
    for k, name in own.items():
        if name in by_name:
            wanted[k] = (by_name[name][2], 100)
            continue
        hits = [best[name]] if name in best else []
        hits += [by_name[p] for i in range(len(name)) for j in range(i + 1, len(name) + 1) if (p := name[i:j]) in by_name]
        if hits:
            wanted[k] = (min(hits)[2], 80)
    assert {r.sequence: (r.osm_name, r.score) for r in found.collect()} == wanted and len(wanted) > n // 3


# -- documents of lines


def test_every_line_has_its_document(spark, tmp_path):
    node = {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0}
    way = {"type": "way", "id": 7, "nodes": [1, 2], "geometry": [{"lat": 1, "lon": 2}, {"lat": 3, "lon": 4}]}
    relation = lambda *members: {"type": "relation", "tags": {"route": "subway", "name": "Line A"}, "members": list(members)}
    leg = {"type": "way", "ref": 7, "role": ""}
    named = {**node, "tags": {"name": "S"}}
    made = {}
    for what, elems in {"track only": [node, way, relation(leg)], "neither": [node, relation({"type": "node", "ref": 99, "role": "stop"})], "both": [named, way, relation(leg, {"type": "node", "ref": 1, "role": "stop"})], "nothing": [node]}.items():
        row = build.line_documents(parse(spark, *elems)).first()
        made[what] = (row["name"], [(f["geometry"]["type"], f["properties"]) for f in json.loads(row["geojson"])["features"]])
    line = ("LineString", {"name": "Line A"})
    assert made == {"track only": ("Line A", [line]), "neither": ("Line A", []), "both": ("Line A", [line, ("Point", {"name": "S", "line": "Line A"})]), "nothing": ("Unknown", [])}
    saved, target = tmp_path / "saved.json", tmp_path / "line.geojson"
    saved.write_text(response(node, relation()), encoding="utf-8")
    assert cli.main(["download", "--city", "x", "--line", "Line A", "--elements", str(saved), "--output", str(target)]) == 0
    assert json.loads(target.read_text(encoding="utf-8")) == {"type": "FeatureCollection", "features": []}


# -- boxes


def test_dense_points_are_compared_with_few(spark, monkeypatch):
    rnd = np.random.default_rng(3)
    n, m = 20_000, 400
    xy = rnd.random((n, 2)) * 1e-6
    xy[: n // 100] = rnd.random((n // 100, 2))  # all but a hundredth lie in a millionth of the extent
    xy[5] = xy[6]
    spots = np.concatenate([rnd.random((m // 2, 2)), rnd.random((m // 2 - 1, 2)) * 1e-6, xy[5:6]])
    verts = spark.createDataFrame([("g", i, float(x), float(y), i) for i, (x, y) in enumerate(xy)], "graph_id string, node long, lng double, lat double, first_pos long")
    asked = spark.createDataFrame([("g", i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "graph_id string, s long, lng double, lat double")
    monkeypatch.setattr(graph, "BROADCAST_STATIONS", 5)
    found = {r.s: r.node for r in graph.nearest_vertices(asked, verts, ["s"]).collect()}
    far = lambda p, q: np.sqrt((p[0] - q[:, 0]) ** 2 + (p[1] - q[:, 1]) ** 2)
    assert all(far(spots[s], xy)[node] == far(spots[s], xy).min() for s, node in found.items()) and len(found) == m
    assert found[m - 1] == 5  # the first of equals
    pairs = graph.near_vertices(asked.withColumnsRenamed({"lng": "s_lng", "lat": "s_lat"}), verts, ["s"]).groupBy("s").count()
    assert pairs.agg(F.max("count")).first()[0] <= 20 * boxtree.FANOUT  # of 312


def test_equal_places_are_one_item(spark, monkeypatch):
    verts = spark.range(3_000).select(F.lit("g").alias("graph_id"), F.col("id").alias("node"), (F.col("id") % 10).cast("double").alias("lng"), F.lit(1.0).alias("lat"), (-F.col("id")).alias("first_pos"))
    spots = spark.range(10).select(F.lit("g").alias("graph_id"), F.col("id").alias("s"), (F.col("id") + 0.25).alias("lng"), F.lit(1.5).alias("lat"))
    met = []
    for name in ("nearest", "may_be_nearest"):  # the pairs that are sorted
        monkeypatch.setattr(boxtree, name, lambda *a, made=getattr(boxtree, name, None), **k: (met.append(made(*a, **k)), met[-1])[1])
    found = {r.s: r.node for r in graph.nearest_vertices(spots, verts, ["s"], few=0).collect()}
    assert found == {s: 2_990 + s for s in range(10)} and met[0].count() == 10


def winding(spark, n: int):
    points = [("l", i, 40 * math.sin(i / n * 9) + i * 100 / n, 30 * math.cos(i / n * 7)) for i in range(n)]
    return spark.createDataFrame(points, "line_id string, pt_pos long, x double, y double")


def test_longer_lines_share_less_with_a_spot(spark):
    rnd = random.Random(8)
    spots = [("l", k, rnd.uniform(-60, 160), rnd.uniform(-60, 60)) for k in range(40)]
    asked = spark.createDataFrame(spots, "line_id string, k long, px double, py double")
    shares = []
    for n in (60, 2_000, 20_000):
        legs = rows.cut_lineage(track.legs(winding(spark, n)))
        shares.append(track.near_legs(asked, legs, ["k"]).count() / (40 * (n - 1)))
        own = legs.orderBy("pt_pos").toPandas()
        found = {r.k: (r.off, r.along) for r in track.referenced(asked, legs, ["k"]).collect()}
        a, b = own[["x", "y"]].to_numpy(), own[["x2", "y2"]].to_numpy()
        for _, k, px, py in spots:
            t = np.clip(((px - a[:, 0]) * (b - a)[:, 0] + (py - a[:, 1]) * (b - a)[:, 1]) / ((b - a) ** 2).sum(1), 0, 1)
            off = np.hypot(px - a[:, 0] - t * (b - a)[:, 0], py - a[:, 1] - t * (b - a)[:, 1])
            i = int(np.argmin(np.round(off, 6)))
            assert found[k] == pytest.approx((off[i], own["cum"][i] + t[i] * own["length"][i]), abs=1e-6)
    assert shares[0] == 1 and shares[1] < 0.2 and shares[2] < shares[1] / 4


def test_few_pairs_of_spots_and_legs_are_sorted(spark, monkeypatch):
    legs = rows.cut_lineage(track.legs(winding(spark, 2_000)))
    asked = spark.range(40).select(F.lit("l").alias("line_id"), F.col("id").alias("k"), (F.col("id") * 5.0 - 60).alias("px"), (F.col("id") * 3.0 - 60).alias("py"))
    met = []
    for name in ("nearest", "may_be_nearest"):  # the pairs that are sorted
        monkeypatch.setattr(boxtree, name, lambda *a, made=getattr(boxtree, name, None), **k: (met.append(made(*a, **k)), met[-1])[1])
    track.referenced(asked, legs, ["k"]).collect()
    assert met[0].count() < 160 and track.near_legs(asked, legs, ["k"]).count() > 40 * boxtree.FANOUT


def test_ties_go_to_the_first_leg(spark):
    points = spark.createDataFrame([("l", i, float(i % 2), float(i // 2 % 2)) for i in range(1000)], "line_id string, pt_pos long, x double, y double")
    spots = spark.createDataFrame([("l", 1, 0.5, 0.5), ("l", 2, -1.0, 0.0)], "line_id string, k long, px double, py double")
    legs = track.legs(points)
    plain = {r.k: r.along for r in track.referenced(spots, legs.filter("pt_pos < 8"), ["k"]).collect()}
    assert {r.k: r.along for r in track.referenced(spots, legs, ["k"]).collect()} == plain


# -- sequences


def test_stations_attach_to_lines_begun_before(spark):
    rnd = random.Random(9)
    begun = [(d, f"k{i}", p) for d in range(3) for i, p in enumerate(rnd.sample(range(100), 12))]
    stops = [(d, p, rnd.choice(["a", "b", None]), rnd.choice([1.0, None]), 2.0) for d in range(4) for p in range(100, 0, -1) if rnd.random() < 0.4]
    stops = [s for s in stops if (s[0], s[1]) not in {(d, p) for d, _, p in begun}]
    found = lines.attach_stations(spark.createDataFrame(begun, "doc_id int, key string, first_pos int"), spark.createDataFrame(stops, "doc_id int, elem_pos int, name string, lat double, lng double"), ["doc_id", "key"])
    assert "NestedLoop" not in plan_of(found)
    wanted = set()
    for d, key, first in begun:
        seen = set()
        for doc, pos, *place in sorted(stops, key=lambda s: s[:2]):
            if doc == d and pos > first and str(place) not in seen:
                seen.add(str(place))
                wanted.add((d, key, pos, *place))
    out = [tuple(r) for r in found.collect()]
    assert set(out) == wanted and len(out) == len(wanted)


def test_long_lines_are_cut_into_blocks(spark):
    n = 30_000
    points = spark.range(n).select(F.when(F.col("id") % 10 == 0, "short").otherwise("long").alias("line_id"), F.col("id").alias("pt_pos"), (F.lit(117.0) + F.floor(F.col("id") / 3) % 977 / 1000).alias("lng"), (F.lit(39.0) + F.floor(F.col("id") / 3) % 499 / 1000).alias("lat")).repartition(9)
    blocks = rows.spread(points, ["line_id"], ["pt_pos"])
    assert blocks.groupBy("line_id", "_block").count().agg(F.max("count")).first()[0] < n // 2
    for one, many in ((lines.stamped(points), lines.stamped(points, long=True)), (rows.drop_consecutive(points, ["line_id"], ["pt_pos"], ["lng", "lat"]), rows.drop_consecutive(points, ["line_id"], ["pt_pos"], ["lng", "lat"], long=True))):
        assert many.columns == one.columns
        whole = lambda df: sorted((r.line_id, r.pt_pos, round(r["distance"]) if "distance" in df.columns else 0) for r in df.collect())
        assert whole(one) == whole(many)
    flat = points.select("line_id", "pt_pos", F.col("lng").alias("x"), F.col("lat").alias("y"))
    own = {(r.line_id, r.pt_pos): r for r in track.legs(flat).collect()}
    for r in track.legs(flat, long=True).collect():
        o = own.pop((r.line_id, r.pt_pos))
        assert (r.rank, r.x, r.y2) == (o["rank"], o.x, o.y2) and r.cum == pytest.approx(o.cum, abs=1e-6)
    assert not own


# -- graphs


def grid(n: int, seed: int):
    rnd = random.Random(seed)
    links = [(y * n + x, y * n + x + step, rnd.randrange(1, 10**6)) for y in range(n) for x in range(n) for step in (1, n) if (x + 1 < n if step == 1 else y + 1 < n)]
    return links + [(b, a, w) for a, b, w in links], [("g", y * n + x, float(x), float(y)) for y in range(n) for x in range(n)]


@pytest.mark.parametrize("most_edges", [10**6, 10])
def test_cut_graphs_give_dijkstras_paths(spark, most_edges):
    links, points = grid(14, 1)
    lone = [(900, 901, 5), (901, 900, 5)]
    near: dict[int, list] = {}
    for a, b, w in links + lone:
        near.setdefault(a, []).append((b, w))
    rnd = random.Random(2)
    pairs = [("g", k, rnd.randrange(196), rnd.randrange(196)) for k in range(25)] + [("g", 90, 0, 901), ("g", 91, 900, 901), ("g", 92, 7, 7), ("h", 93, 1, 2)]
    edges = spark.createDataFrame([("g", *e) for e in links + lone] + [("h", 1, 2, 3), ("h", 1, 2, 4)], "graph_id string, src long, dst long, distance long")
    verts = spark.createDataFrame(points + [("g", 900, 50.0, 50.0), ("g", 901, 51.0, 50.0), ("h", 1, 0.0, 0.0), ("h", 2, 1.0, 0.0)], "graph_id string, node long, lng double, lat double")
    found: dict[int, list] = {}
    for r in sorted(cutgraph.cut_paths(edges, verts, spark.createDataFrame(pairs, "graph_id string, pair_pos long, start long, end long"), size=20, most_edges=most_edges).collect(), key=lambda r: (r.pair_pos, r.pt_pos)):
        found.setdefault(r.pair_pos, []).append(r.node)
    wanted = {k: p for g, k, s, e in pairs if g == "g" and (p := graph.dijkstra(near, s, e))} | {93: [1, 2]}
    assert found == wanted


def test_a_million_vertices_lie_in_bounded_cells(spark):
    verts = spark.range(1_000_000).select(F.lit("g").alias("graph_id"), F.col("id").alias("node"), (F.col("id") % 1000).cast("double").alias("lng"), F.floor(F.col("id") / 1000).cast("double").alias("lat"))
    sizes = cutgraph.cells(verts, 20_000).groupBy("graph_id", "cell").agg(F.count("*").alias("n"), F.countDistinct("node").alias("d")).collect()
    assert len(sizes) == 50 and {(r.n, r.d) for r in sizes} == {(20_000, 20_000)}


def test_routes_cut_graphs_that_are_large(spark, monkeypatch):
    links, points = grid(9, 5)
    edges = spark.createDataFrame([("g", *e) for e in links], "graph_id string, src long, dst long, distance long")
    verts = spark.createDataFrame([(*p, p[1]) for p in points], "graph_id string, node long, lng double, lat double, first_pos long")
    stops = spark.createDataFrame([("g", "l", i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (8, 3), (2, 8)])], "graph_id string, line_id string, sequence int, lng double, lat double")
    plain = graph.route(stops, verts, edges).orderBy("pt_pos").collect()
    monkeypatch.setattr(cutgraph, "MOST_EDGES", 100)
    monkeypatch.setattr(cutgraph, "CELL", 10)
    assert graph.route(stops, verts, edges).orderBy("pt_pos").collect() == plain


def test_targets_bound_what_is_looked_at(spark):
    n = 600
    chain = spark.createDataFrame([(i, i + 1, 2) for i in range(n)] + [(i + 1, i, 2) for i in range(n)], "src long, dst long, distance long")
    pairs = spark.createDataFrame([(300, 310), (300, 303), (50, 40), (60, 99_999)], "seed long, node long")
    known = {(r.seed, r.node): r.d for r in graph.distances(chain, pairs.select("seed"), targets=pairs).collect()}
    wanted = {(s, x): 2 * abs(s - x) for s, far in ((300, 10), (50, 10), (60, 0)) for x in range(s - far, s + far + 1)}
    assert known == wanted


def test_bounded_relaxation_without_contraction(spark, monkeypatch):
    links, _ = grid(12, 7)
    edges = spark.createDataFrame([(a, b, float(w)) for a, b, w in links], "src long, dst long, distance double")
    pairs = [(0, 13), (0, 3), (77, 90)]
    monkeypatch.setattr(graph, "PARTS", 2)
    near: dict[int, list] = {}
    for a, b, w in links:
        near.setdefault(a, []).append((b, w))
    length = lambda a, b: sum(min(w for o, w in near[x] if o == y) for x, y in zip(p, p[1:], strict=False)) if (p := graph.dijkstra(near, a, b)) else None
    bound = {s: max(length(s, t) for a, t in pairs if a == s) for s, _ in pairs}
    known = {(r.seed, r.node): r.d for r in graph.distances(edges, spark.createDataFrame(pairs, "seed long, node long").select("seed"), targets=spark.createDataFrame(pairs, "seed long, node long")).collect()}
    assert known == {(s, x): d for s in bound for x in near if (d := length(s, x)) <= bound[s]}
    assert 0 < len(known) < 2 * len(near)


def test_found_paths_are_stamped_in_degrees(spark):
    rows_ = catalog.QUERIES["q_find_path"](spark, "/root/testdata/sf0.001").collect()
    assert rows_ and all(r.distance == 0 for r in rows_ if r.pt_pos == 0)
