"""The rail graph: edges and vertices of tracks, nearest vertices, shortest paths, routes.

``graph_id`` keeps several graphs (cities) apart in one table, ``way_pos`` the ways, in order: a number, or a
struct of document and number. Rail graphs are long chains, so paths are
found by Dijkstra's method with one graph a task by default. Graphs that no task holds are cut into cells
(:mod:`trackweave.operators.cutgraph`), or relaxed over joins, which takes chains out first.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackweave.functions import geo
from trackweave.operators import boxtree, filters
from trackweave.operators.rows import cut_lineage, free, keep_first

#: Stations up to which every vertex is compared with all of them (40 bytes each, broadcast).
BROADCAST_STATIONS = 10_000
#: Tables of known distances before they are merged.
PARTS = 8


def _steps(tracks: DataFrame) -> DataFrame:
    """Adjacent nodes of every sound way: way_pos, pt_pos, way, a, b, their points, metres, tags."""
    points = filters.sound_ways(tracks).select("graph_id", "way_pos", F.col("id").alias("way"), "tags", F.posexplode(F.arrays_zip("nodes", "geometry")).alias("pt_pos", "p"))
    flat = points.select("graph_id", "way_pos", "way", "tags", "pt_pos", F.col("p.nodes").alias("a"), F.col("p.geometry.lng").alias("lng"), F.col("p.geometry.lat").alias("lat"))
    w = Window.partitionBy("graph_id", "way_pos").orderBy("pt_pos")
    paired = flat.withColumns({"b": F.lead("a").over(w), "lng2": F.lead("lng").over(w), "lat2": F.lead("lat").over(w), "_more": F.lead(F.lit(1)).over(w)})
    return paired.filter("_more = 1").withColumn("metres", F.expr(geo.mercator_distance("lng", "lat", "lng2", "lat2")))


def edges(tracks: DataFrame, railway: str | None = None, route: str | None = None) -> DataFrame:
    """graph_id, src, dst, way, distance, tags: both directions of every step, once a way (the first)."""
    steps = _steps(filters.tagged(tracks, railway, route))
    ahead = steps.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), "way", F.col("metres").alias("distance"), "tags", "way_pos", "pt_pos", F.lit(0).alias("back"))
    back = ahead.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"), "way", "distance", "tags", "way_pos", "pt_pos", F.lit(1).alias("back"))
    return keep_first(ahead.unionByName(back), ["graph_id", "src", "dst", "way"], ["way_pos", "pt_pos", "back"]).drop("way_pos", "pt_pos", "back")


def vertices(tracks: DataFrame, railway: str | None = None, route: str | None = None) -> DataFrame:
    """graph_id, node, lng, lat, first_pos: each node's first point, and its place in order of first sight."""
    sound = filters.sound_ways(filters.tagged(tracks, railway, route))
    points = sound.select("graph_id", "way_pos", F.posexplode(F.arrays_zip("nodes", "geometry")).alias("pt_pos", "p"))
    first = keep_first(points.withColumn("node", F.col("p.nodes")), ["graph_id", "node"], ["way_pos", "pt_pos"])
    return first.select("graph_id", "node", F.col("p.geometry.lng").alias("lng"), F.col("p.geometry.lat").alias("lat"), F.struct("way_pos", "pt_pos").alias("first_pos"))


def counters(tracks: DataFrame, railway: str | None = None, route: str | None = None) -> DataFrame:
    """Tracks, ways used, nodes they name, nodes of the graph."""
    sound = filters.sound_ways(filters.tagged(tracks, railway, route))
    return tracks.agg(F.count("*").alias("tracks")).join(sound.agg(F.count("*").alias("ways"), F.coalesce(F.sum(F.size("nodes")), F.lit(0)).alias("raw_nodes"))).join(sound.select(F.explode("nodes").alias("n")).agg(F.count_distinct("n").alias("nodes")))


def nearest_vertices(stations: DataFrame, verts: DataFrame, station: list[str], few: int | None = None) -> DataFrame:
    """station keys, node: the vertex of the station's graph that is nearest in degrees, the first of equals.

    Few stations (``few``, or BROADCAST_STATIONS) go to every vertex and each task keeps one candidate a station;
    many walk down a packed tree of boxes over the vertices (:mod:`trackweave.operators.boxtree`), so that density doesn't matter.
    There, of vertices at one place only the first is in the tree.
    """
    spots = stations.select("graph_id", *station, F.col("lng").alias("s_lng"), F.col("lat").alias("s_lat"))
    if spots.count() <= (BROADCAST_STATIONS if few is None else few):
        return _nearest(verts.join(F.broadcast(spots), "graph_id"), station).drop("d")
    first = verts.groupBy("graph_id", "lng", "lat").agg(F.min(F.struct("first_pos", "node")).alias("f")).select("graph_id", "f.node", "lng", "lat", "f.first_pos")
    far = F.expr(geo.degree_distance("s_lng", "s_lat", "lng", "lat"))
    return _nearest(boxtree.nearest(spots, _boxed(first), ["graph_id"], station, "s_lng", "s_lat", far), station).drop("d")


def near_vertices(spots: DataFrame, verts: DataFrame, station: list[str]) -> DataFrame:
    """Spots (graph_id, station keys, s_lng, s_lat) with the vertices that may be nearest to them."""
    return boxtree.may_be_nearest(spots, _boxed(verts), ["graph_id"], station, "s_lng", "s_lat")


def _boxed(verts: DataFrame) -> DataFrame:
    placed = boxtree.with_z_order(verts.select("graph_id", "node", "lng", "lat", "first_pos"), "lng", "lat")
    items = cut_lineage(boxtree.ranked(placed, ["graph_id"], ["_z", "node"]).drop("_z"))
    return items.withColumns({"x0": F.col("lng"), "x1": F.col("lng"), "y0": F.col("lat"), "y1": F.col("lat")})


def _nearest(pairs: DataFrame, station: list[str]) -> DataFrame:
    far = F.expr(geo.degree_distance("s_lng", "s_lat", "lng", "lat"))
    best = pairs.groupBy("graph_id", *station).agg(F.min(F.struct(far.alias("d"), "first_pos", "node")).alias("b"))
    return best.select("graph_id", *station, F.col("b.node").alias("node"), F.col("b.d").alias("d"))


# -- shortest paths


def dijkstra(graph: dict[int, list[tuple[int, float]]], start: int, end: int) -> list[int]:
    """Nodes of the shortest path, [] where there is none; among equals the predecessor that settles first."""
    if start == end:
        return [start]
    dist, before, done = {start: 0.0}, {}, set()
    heap = [(0.0, start)]
    while heap:
        d, node = heapq.heappop(heap)
        if node in done:
            continue
        if node == end:
            path = [end]
            while path[-1] != start:
                path.append(before[path[-1]])
            return path[::-1]
        done.add(node)
        for other, weight in graph.get(node, ()):
            if other not in dist or d + weight < dist[other]:
                dist[other], before[other] = d + weight, node
                heapq.heappush(heap, (d + weight, other))
    return []


def shortest_paths(edge_table: DataFrame, pairs: DataFrame) -> DataFrame:
    """graph_id, pair_pos, pt_pos, node of the path of each pair (graph_id, pair_pos, start, end).

    One graph and its pairs in a task, graphs in parallel. Pairs without a path give no rows.
    """

    def solve(key, links: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        graph: dict[int, list[tuple[int, float]]] = {}
        for a, b, w in zip(links["src"], links["dst"], links["distance"], strict=True):
            graph.setdefault(int(a), []).append((int(b), float(w)))
        rows = [(key[0], int(p), i, n) for p, s, e in zip(wanted["pair_pos"], wanted["start"], wanted["end"], strict=True) for i, n in enumerate(dijkstra(graph, int(s), int(e)))]
        return pd.DataFrame(rows, columns=["graph_id", "pair_pos", "pt_pos", "node"])

    light = edge_table.groupBy("graph_id", "src", "dst").agg(F.min("distance").alias("distance"))
    wanted = pairs.filter("start IS NOT NULL AND end IS NOT NULL").select(F.col("graph_id").alias("pair_graph"), "pair_pos", "start", "end")
    return light.groupBy("graph_id").cogroup(wanted.groupBy("pair_graph")).applyInPandas(solve, "graph_id string, pair_pos long, pt_pos int, node long")


def distances(edge_table: DataFrame, seeds: DataFrame, most_hops: int | None = None, contract: bool | None = None, targets: DataFrame | None = None) -> DataFrame:
    """seed, node, d for all nodes that the seeds (seed) reach, by relaxing all frontiers together.

    A round is one join and one aggregation, written; what reaches the driver is the nearest open distance
    and whether there is any. With ``targets`` (seed, node) only what lies no farther from a seed than its
    farthest target comes out, and what lies beyond the targets' distances so far isn't looked at: seeds without a
    target that can be reached have themselves only. With ``most_hops``, paths of more raise an
    error, as negative distances do. ``contract`` first takes out what has two neighbours or fewer
    (:func:`_contracted`), so that long chains cost the logarithm of their length; by default that is done
    where distances are whole numbers, whose sums don't depend on the order.
    """
    light = cut_lineage(edge_table.groupBy("src", "dst").agg(F.min("distance").alias("w")))
    kind = light.schema["w"].dataType
    if not light.filter("w < 0").isEmpty():
        raise ValueError("negative distances")
    seeds = cut_lineage(seeds.select("seed").distinct())
    if targets is not None:
        targets = cut_lineage(targets.select("seed", "node").distinct())
    stay = seeds if targets is None else cut_lineage(seeds.union(targets.select("node")).distinct())
    taken: list[DataFrame] = []
    if most_hops is None and (isinstance(kind, (T.IntegralType, T.DecimalType)) if contract is None else contract):
        light, taken = _contracted(light, stay)
    known = _relaxed(light, seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast(kind).alias("d")), targets, most_hops)
    bounds = None
    if targets is not None:
        far = targets.join(known, ["seed", "node"]).groupBy("seed").agg(F.max("d").alias("bound"))
        bounds = cut_lineage(seeds.join(far, "seed", "left").select("seed", F.coalesce("bound", F.lit(0).cast(kind)).alias("bound")))
        known = cut_lineage(_within(known, bounds))
    for entries in reversed(taken):
        back = entries.join(known, F.col("src") == F.col("node")).groupBy("seed", "dst").agg(F.min(F.col("d") + F.col("w")).alias("d"))
        back = back.select("seed", F.col("dst").alias("node"), "d")
        grown = cut_lineage(known.unionByName(back if bounds is None else _within(back, bounds)))
        free(known)
        free(entries)
        known = grown
    return known


def _within(labels: DataFrame, bounds: DataFrame) -> DataFrame:
    """Labels (seed, node, d) up to their seed's bound; a null bound is none."""
    return labels.join(bounds, "seed").filter("bound IS NULL OR d <= bound").drop("bound")


def _relaxed(light: DataFrame, labels: DataFrame, targets: DataFrame | None, most_hops: int | None) -> DataFrame:
    """seed, node, d from the first labels on, bucket by bucket of distance.

    What is known is a list of tables, one a round, merged now and then; open labels are a table of
    their own, of which a round takes those that are at most one longest edge farther than the nearest.
    What is farther than all of a seed's targets are known to be goes.
    """
    opened = cut_lineage(labels)
    parts = [cut_lineage(labels)]
    width = None if most_hops is not None else light.agg(F.max("w")).first()[0]
    least = lambda tables: reduce(DataFrame.unionByName, tables).groupBy("seed", "node").agg(F.min("d").alias("d"))
    hops = 0
    while True:
        rows, low = opened.agg(F.count("*"), F.min("d")).first()
        if not rows:
            break
        if most_hops is not None and hops >= most_hops:
            raise ValueError(f"distances still improve after {most_hops} hops")
        hops += 1
        soon = F.lit(True) if low is None or width is None else F.coalesce(F.col("d") <= F.lit(low) + F.lit(width), F.lit(False))
        reached = opened.filter(soon).join(light, F.col("node") == F.col("src")).groupBy("seed", "dst").agg(F.min(F.col("d") + F.col("w")).alias("d"))
        seen = least(parts).select("seed", F.col("node").alias("dst"), F.col("d").alias("old"), F.lit(True).alias("seen"))
        better = F.col("seen").isNull() | (F.col("d") < F.col("old")) | (F.col("old").isNull() & F.col("d").isNotNull())
        new = cut_lineage(reached.join(seen, ["seed", "dst"], "left").filter(better).select("seed", F.col("dst").alias("node"), "d"))
        parts.append(new)
        rest = opened.filter(~soon).unionByName(new).groupBy("seed", "node").agg(F.min("d").alias("d"))
        if len(parts) > PARTS:
            merged = cut_lineage(least(parts))
            for part in parts[:-1]:
                free(part)
            parts = [merged, new]
        if targets is not None:
            found = targets.join(least(parts), ["seed", "node"], "left").groupBy("seed").agg(F.max("d").alias("far"), F.count("d").alias("n"), F.count("*").alias("all"))
            rest = _within(rest, found.select("seed", F.when(F.col("n") == F.col("all"), F.col("far")).alias("bound")))
        after = cut_lineage(rest)
        free(opened)
        opened = after
    known = cut_lineage(least(parts))
    for part in (*parts, opened):
        free(part)
    return known


def _contracted(light: DataFrame, seeds: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The edges (src, dst, w) without nodes of two neighbours or fewer, and round by round the edges into
    the nodes that were taken out, by which they get their distances in the end.

    A round takes out nodes no two of which touch, a share of each chain, and lays an edge over each; it
    goes on while a tenth of the nodes goes. Seeds stay.
    """
    taken: list[DataFrame] = []
    while True:
        pairs = light.filter("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v"))
        pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
        stays = seeds.select(F.col("seed").alias("u"), F.lit(True).alias("stays"))
        degrees = cut_lineage(pairs.groupBy("u").agg(F.count("*").alias("n")).join(stays, "u", "left"))
        is_thin = (F.col("n") <= 2) & F.col("stays").isNull()
        nodes, thin_nodes = degrees.agg(F.count("*"), F.count(F.when(is_thin, 1))).first()
        if 10 * thin_nodes < nodes or not thin_nodes:
            return light, taken
        thin = cut_lineage(degrees.filter(is_thin).select("u", F.xxhash64(F.lit(len(taken)), "u").alias("h")))
        free(degrees)
        beside = pairs.join(thin, "u").join(thin.select(F.col("u").alias("v"), F.col("h").alias("g")), "v")
        held_back = beside.filter((F.col("g") < F.col("h")) | ((F.col("g") == F.col("h")) & (F.col("v") < F.col("u")))).select("u").distinct()
        chosen = cut_lineage(thin.join(held_back, "u", "left_anti").select(F.col("u").alias("node")))
        if 10 * (picked := chosen.count()) < nodes or not picked:
            return light, taken
        into = light.filter("src <> dst").join(chosen, F.col("dst") == F.col("node"), "left_semi")
        out = light.filter("src <> dst").join(chosen, F.col("src") == F.col("node"), "left_semi")
        rest = light.join(chosen, F.col("src") == F.col("node"), "left_anti").join(chosen, F.col("dst") == F.col("node"), "left_anti")
        over = into.alias("i").join(out.alias("o"), F.col("i.dst") == F.col("o.src")).filter("i.src <> o.dst").select("i.src", "o.dst", (F.col("i.w") + F.col("o.w")).alias("w"))
        taken.append(cut_lineage(into))
        light = cut_lineage(rest.unionByName(over).groupBy("src", "dst").agg(F.min("w").alias("w")))


def fixpoint_paths(edge_table: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_pos, pt_pos, node of the path of each pair (pair_pos, start, end), by :func:`distances`.

    For graphs that no task holds: of the predecessors on a shortest path the nearest counts, of equally
    near ones the first, as in :func:`dijkstra` where distances are above 0. The walk back doubles its
    stride, so its rounds are the logarithm of the longest path. Pairs without a path give no rows.
    """
    wanted = cut_lineage(pairs.filter("start IS NOT NULL AND end IS NOT NULL").select("pair_pos", "start", "end"))
    light = cut_lineage(edge_table.filter("src <> dst").groupBy("src", "dst").agg(F.min("distance").alias("w")))
    ends = wanted.select(F.col("start").alias("seed"), F.col("end").alias("node"))
    known = distances(light.withColumnRenamed("w", "distance"), ends.select("seed"), targets=ends)
    tight = known.alias("p").join(light.alias("l"), F.col("p.node") == F.col("l.src")).join(known.alias("n"), (F.col("n.seed") == F.col("p.seed")) & (F.col("n.node") == F.col("l.dst")) & (F.col("n.d") == F.col("p.d") + F.col("l.w")))
    jump = cut_lineage(tight.filter("n.node <> n.seed").groupBy(F.col("n.seed").alias("seed"), F.col("n.node").alias("node")).agg(F.min(F.struct("p.d", "p.node"))["node"].alias("prior")))
    walked = cut_lineage(wanted.join(known, (F.col("start") == F.col("seed")) & (F.col("end") == F.col("node"))).select("pair_pos", "seed", "node", F.lit(0).cast("long").alias("back")))
    stride = 1
    while True:
        more = cut_lineage(walked.join(jump, ["seed", "node"]).select("pair_pos", "seed", F.col("prior").alias("node"), (F.col("back") + stride).alias("back")))
        if more.isEmpty():
            break
        walked, stride = cut_lineage(walked.unionByName(more)), 2 * stride
        jump = cut_lineage(jump.join(jump.select("seed", F.col("node").alias("prior"), F.col("prior").alias("next")), ["seed", "prior"]).select("seed", "node", F.col("next").alias("prior")))
    place = F.row_number().over(Window.partitionBy("pair_pos").orderBy(F.col("back").desc())) - 1
    return walked.select("pair_pos", place.alias("pt_pos"), "node")


def path_points(paths: DataFrame, verts: DataFrame) -> DataFrame:
    """The paths' nodes with their points."""
    return paths.join(verts.select("graph_id", "node", "lng", "lat"), ["graph_id", "node"])


def route(stations: DataFrame, verts: DataFrame, edge_table: DataFrame, gap_aware: bool = False, close_loops: bool = False, cell: int | None = None) -> DataFrame:
    """graph_id, line_id, pt_pos, node, lng, lat along each line's stations (graph_id, line_id, sequence, lng, lat).

    Each station goes to its nearest vertex, each hop to the next takes the shortest path, hops without
    one are left out. A later hop drops its first point, even after a gap unless ``gap_aware``;
    ``close_loops`` adds the hop from the last station to the first. A graph of more than
    ``cutgraph.MOST_EDGES`` edges is cut into cells, and any is with ``cell``, the vertices of one.
    """
    from trackweave.operators import cutgraph

    largest = 0 if cell else edge_table.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    cut = bool(cell) or largest > cutgraph.MOST_EDGES
    solve = (lambda pairs: cutgraph.cut_paths(edge_table, verts, pairs, cell or cutgraph.CELL)) if cut else (lambda pairs: shortest_paths(edge_table, pairs))
    at = nearest_vertices(stations, verts, ["line_id", "sequence"])
    w = Window.partitionBy("graph_id", "line_id").orderBy("sequence")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    target = F.lead("node").over(w)
    if close_loops:
        target = F.coalesce(target, F.when(F.count("*").over(whole) > 2, F.first("node").over(whole)))
    hops = at.select("graph_id", "line_id", "sequence", F.col("node").alias("start"), target.alias("end")).filter("end IS NOT NULL")
    numbered = hops.withColumn("pair_pos", F.xxhash64("line_id", "sequence"))
    paths = path_points(solve(numbered.select("graph_id", "pair_pos", "start", "end").distinct()), verts)
    walked = numbered.select("graph_id", "line_id", "sequence", "pair_pos").join(paths, ["graph_id", "pair_pos"])
    by_hop = Window.partitionBy("graph_id", "line_id").orderBy("sequence", "pt_pos")
    first_hop = F.min("sequence").over(Window.partitionBy("graph_id", "line_id"))
    kept = walked.withColumns({"_first": first_hop, "_before": F.lag("node").over(by_hop)})
    repeats = (F.col("_before") == F.col("node")) if gap_aware else F.lit(True)
    kept = kept.filter(~((F.col("pt_pos") == 0) & (F.col("sequence") > F.col("_first")) & repeats))
    return kept.select("graph_id", "line_id", (F.row_number().over(by_hop) - 1).alias("pt_pos"), "node", "lng", "lat")
