"""Shortest paths over graphs that no task holds: the graph is cut into cells, paths cross them.

Vertices are ranked along a Z-order curve and dealt to cells of so many, so a cell is bounded whatever the
graph's size and density. The ends of edges between cells, and of the wanted paths, are gates. One task a
cell finds how far its gates are from one another inside; with the edges between cells that makes the
overlay, a graph of gates only, which is solved whole where a task holds it, cut again where it is
still large, and relaxed over joins where cutting no longer makes it smaller. What its paths pass of a
cell is walked again in that cell's task.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackweave.operators import boxtree, graph
from trackweave.operators.rows import cut_lineage

#: Vertices of a cell, and edges of a graph that one task solves whole.
CELL, MOST_EDGES = 20_000, 2_000_000


def cells(verts: DataFrame, size: int = CELL) -> DataFrame:
    """graph_id, node, cell: each graph's vertices (graph_id, node, lng, lat) in cells of ``size`` or fewer."""
    placed = boxtree.with_z_order(verts.select("graph_id", "node", "lng", "lat"), "lng", "lat")
    return boxtree.ranked(placed, ["graph_id"], ["_z", "node"]).select("graph_id", "node", F.floor(F.col("rank") / size).alias("cell"))


def gates_reached(links: dict[int, list[tuple[int, float]]], start: int, gates: set[int]) -> dict[int, float]:
    """The gates that are reached from ``start`` without passing another, and how far they are."""
    dist, found, done = {start: 0}, {}, set()
    heap = [(0, start)]
    while heap:
        d, node = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if node in gates and node != start:
            found[node] = d
            continue
        for other, weight in links.get(node, ()):
            if other not in dist or d + weight < dist[other]:
                dist[other] = d + weight
                heapq.heappush(heap, (d + weight, other))
    return found


def _links(table: pd.DataFrame) -> dict[int, list[tuple[int, float]]]:
    links: dict[int, list[tuple[int, float]]] = {}
    for a, b, w in zip(table["src"].tolist(), table["dst"].tolist(), table["distance"].tolist(), strict=True):
        links.setdefault(a, []).append((b, w))
    return links


def cut_paths(edge_table: DataFrame, verts: DataFrame, pairs: DataFrame, size: int = CELL, most_edges: int = MOST_EDGES) -> DataFrame:
    """graph_id, pair_pos, pt_pos, node of a shortest path of each pair (graph_id, pair_pos, start, end).

    edge_table: graph_id, src, dst, distance; verts has all its nodes. As
    :func:`trackweave.operators.graph.shortest_paths`, but of equally long paths any may come out. No task
    gets more than a cell, or an overlay of ``most_edges``.
    """
    wanted = cut_lineage(pairs.filter("start IS NOT NULL AND end IS NOT NULL").select("graph_id", "pair_pos", "start", "end"))
    place = cut_lineage(cells(verts, size))
    of = lambda name: place.select("graph_id", F.col("node").alias(name), F.col("cell").alias(f"{name}_cell"))
    light = edge_table.filter("src <> dst").groupBy("graph_id", "src", "dst").agg(F.min("distance").alias("distance"))
    placed = cut_lineage(light.join(of("src"), ["graph_id", "src"]).join(of("dst"), ["graph_id", "dst"]))
    crossing = placed.filter("src_cell <> dst_cell").select("graph_id", "src", "dst", "distance")
    inside = placed.filter("src_cell = dst_cell").select("graph_id", F.col("src_cell").alias("cell"), "src", "dst", "distance")
    ends = [crossing.select("graph_id", F.col(c).alias("node")) for c in ("src", "dst")] + [wanted.select("graph_id", F.col(c).alias("node")) for c in ("start", "end")]
    gates = cut_lineage(ends[0].union(ends[1]).union(ends[2]).union(ends[3]).distinct().join(place, ["graph_id", "node"]))

    kind = placed.schema["distance"].dataType.simpleString()

    def across(key, links: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        steps, stops = _links(links), set(own["node"].tolist())
        rows = [(key[0], g, other, d) for g in stops for other, d in gates_reached(steps, g, stops).items()]
        return pd.DataFrame(rows, columns=["graph_id", "src", "dst", "distance"])

    by_cell = inside.groupBy("graph_id", "cell")
    through = by_cell.cogroup(gates.groupBy("graph_id", "cell")).applyInPandas(across, f"graph_id string, src long, dst long, distance {kind}")
    overlay = cut_lineage(crossing.unionByName(through))
    coarse = cut_lineage(_overlay_paths(overlay, gates, verts, wanted, size, most_edges))

    w = Window.partitionBy("graph_id", "pair_pos").orderBy("pt_pos")
    steps = coarse.withColumn("next", F.lead("node").over(w)).filter("next IS NOT NULL").select("graph_id", "pair_pos", "pt_pos", F.col("node").alias("src"), F.col("next").alias("dst"))
    steps = cut_lineage(steps.join(of("src"), ["graph_id", "src"]).join(of("dst"), ["graph_id", "dst"]))
    asked = steps.filter("src_cell = dst_cell").select("graph_id", F.col("src_cell").alias("cell"), "src", "dst").distinct()

    def walk(key, links: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        steps_ = _links(links) if len(own) else {}
        rows = [(key[0], a, b, i, n) for a, b in zip(own["src"].tolist(), own["dst"].tolist(), strict=True) for i, n in enumerate(graph.dijkstra(steps_, a, b)[1:], 1)]
        return pd.DataFrame(rows, columns=["graph_id", "src", "dst", "inner", "node"])

    walked = by_cell.cogroup(asked.groupBy("graph_id", "cell")).applyInPandas(walk, "graph_id string, src long, dst long, inner int, node long")
    inner = steps.filter("src_cell = dst_cell").join(walked, ["graph_id", "src", "dst"]).select("graph_id", "pair_pos", "pt_pos", "inner", "node")
    over = steps.filter("src_cell <> dst_cell").select("graph_id", "pair_pos", "pt_pos", F.lit(1).alias("inner"), F.col("dst").alias("node"))
    first = coarse.filter("pt_pos = 0").select("graph_id", "pair_pos", F.lit(-1).alias("pt_pos"), F.lit(0).alias("inner"), "node")
    order = Window.partitionBy("graph_id", "pair_pos").orderBy("pt_pos", "inner")
    every = first.unionByName(over).unionByName(inner)
    return every.select("graph_id", "pair_pos", (F.row_number().over(order) - 1).alias("pt_pos"), "node")


def _overlay_paths(overlay: DataFrame, gates: DataFrame, verts: DataFrame, wanted: DataFrame, size: int, most_edges: int) -> DataFrame:
    largest = overlay.groupBy("graph_id").count().agg(F.max("count")).first()[0] or 0
    if largest <= most_edges:
        return graph.shortest_paths(overlay, wanted)
    points = cut_lineage(verts.select("graph_id", "node", "lng", "lat").join(gates.select("graph_id", "node"), ["graph_id", "node"]))
    if 2 * points.count() <= verts.count():
        return cut_paths(overlay, points, wanted, size, most_edges)
    of = lambda name: F.struct("graph_id", F.col(name).alias("node"))
    paths = graph.fixpoint_paths(overlay.select(of("src").alias("src"), of("dst").alias("dst"), "distance"), wanted.select(of("pair_pos").alias("pair_pos"), of("start").alias("start"), of("end").alias("end")))
    return paths.select("pair_pos.graph_id", F.col("pair_pos.node").alias("pair_pos"), "pt_pos", F.col("node.node").alias("node"))
