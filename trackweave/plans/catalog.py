"""The registered rail-network queries over the test tables, and their SQL counterparts.

Those over map responses are in :mod:`trackweave.plans.mapped`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import geo, text
from trackweave.operators import filters, graph, lines, matching, track
from trackweave.operators.rows import before, cut_lineage, drop_consecutive, keep_first, keep_last, shared_path, spread
from trackweave.plans import build, mapped
from trackweave.plans.tables import BOX, EVENTS, STEP, lat, lng, sampled_line, sql_lat, sql_lng, staged, table, track_events, tracks
from trackweave.sources import geojson, geowrite


def q_bbox_filter(spark, sf_dir):
    spots = table(spark, sf_dir, "part").select("p_partkey", lat("p_partkey").alias("lat"), lng("p_partkey").alias("lng"))
    return filters.stations_in_bbox(spots, BOX).select("p_partkey", F.round("lat", 3).alias("lat"), F.round("lng", 3).alias("lng"))


def q_keep_first(spark, sf_dir):
    return keep_first(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), ["p_name"], ["p_partkey"])


def q_drop_consecutive(spark, sf_dir):
    return drop_consecutive(track_events(spark, sf_dir), ["line_id"], ["ts"], ["lng", "lat"]).select("line_id", "event_id", "k")


def q_track_tags(spark, sf_dir):
    sound = filters.sound_ways(tracks(spark, sf_dir))
    return sound.select("id", "name", "railway", F.coalesce("service", F.lit("none")).alias("service"), F.size("nodes").alias("n_nodes"))


def q_normalize_names(spark, sf_dir):
    raw = F.concat(F.lit(" 地铁 "), F.col("p_name"), F.lit("："), F.col("p_brand"), F.lit("站　"))
    ref = (F.col("p_partkey") % 20).cast("string")
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), ref.alias("ref"))
    return rows.select("p_partkey", text.list_name(F.col("raw")).alias("listed"), text.line_name(F.col("raw"), F.col("ref")).alias("line"), text.station_name(F.col("raw")).alias("station"))


def _relations(spark, sf_dir) -> DataFrame:
    """Orders as line relations."""
    n = F.pmod(F.col("o_custkey"), F.lit(40))
    silent = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"),
        F.col("o_orderpriority").alias("network"),
        F.when(n == 0, "").when(n == 7, "7E").otherwise(n.cast("string")).alias("ref"),
        F.concat(F.lit("Line "), n.cast("string"), F.lit(":"), F.col("o_orderstatus")).alias("name"),
        F.lit("subway").alias("route"),
        F.when(silent, "").otherwise(F.col("o_orderstatus")).alias("from"),
        F.when(silent, "").otherwise(F.year("o_orderdate").cast("string")).alias("to"),
    )


_RELATIONS = """relations as (
    select o_orderkey as pos, o_orderpriority as network,
      case o_custkey % 40 when 0 then '' when 7 then '7E' else cast(o_custkey % 40 as varchar) end as ref,
      'Line ' || (o_custkey % 40) || ':' || o_orderstatus as name, 'subway' as route,
      case when o_orderstatus = 'P' then '' else o_orderstatus end as "from",
      case when o_orderstatus = 'P' then '' else cast(year(o_orderdate) as varchar) end as "to"
    from orders)"""


def q_line_listing(spark, sf_dir):
    listed = lines.listed_lines(_relations(spark, sf_dir))
    return listed.select("line_id", "ref", "name", "network", "directions", "first_pos", F.row_number().over(Window.partitionBy("network").orderBy(*lines.listing_order())).alias("place"))


def q_last_relation(spark, sf_dir):
    last = keep_last(_relations(spark, sf_dir), ["network"], ["pos"])
    return last.select("network", "pos", text.line_name(F.col("name"), F.col("ref")).alias("name"))


def _stops(spark, sf_dir) -> DataFrame:
    """Suppliers as stations among the orders' relations, 27 of them in a document of 4000 relations."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.floor(key / 27).alias("doc_id"), (key * 148).alias("elem_pos"), F.concat(F.lit("Stop "), F.pmod(key, F.lit(7)).cast("string")).alias("name"), (F.lit(38.8) + F.pmod(key, F.lit(7)).cast("double") / 100).alias("lat"), (F.lit(116.8) + F.pmod(key, F.lit(2)).cast("double") / 10).alias("lng"))


def q_station_attach(spark, sf_dir):
    rows = _relations(spark, sf_dir).withColumn("doc_id", F.floor(F.col("pos") / 4000))
    seen = rows.groupBy("doc_id", "network", "ref").agg(F.min("pos").alias("first_pos"), F.count("*").alias("relations"))
    attached = lines.attach_stations(seen, _stops(spark, sf_dir), ["doc_id", "network", "ref"])
    return attached.groupBy("doc_id", "network", "ref").agg(F.count("*").alias("n_stations"), F.sum("elem_pos").alias("pos_sum"), F.min("name").alias("first_name"))


def q_member_join(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relation"), F.struct(F.lit("node").alias("type"), F.col("l_partkey").alias("ref"), F.when(F.col("l_returnflag") == "N", "stop").when(F.col("l_returnflag") == "R", "").otherwise("guide").alias("role")).alias("member"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    stops = members.filter(filters.is_stop_member()).select("relation", F.col("member.ref").alias("id")).join(nodes, "id")
    return stops.groupBy("relation").agg(F.count("*").alias("n_stops"), F.sum("p_size").alias("size_sum"), F.min("p_name").alias("first_name"))


def _official(spark, sf_dir) -> DataFrame:
    """Brands as a roster: some with a prefix, some with an ending, those of one digit under names that no candidate has."""
    names = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("sequence"))
    odd = F.when(F.length("p_brand") == 7, F.concat(F.lit("Halt "), F.substring("p_brand", 7, 1))).when(F.col("sequence") % 3 == 0, F.concat(F.lit("No"), F.col("p_brand"))).otherwise(F.concat(F.col("p_brand"), F.lit("站")))
    return names.select(F.lit("c").alias("city"), F.lit("l").alias("line"), F.col("sequence").cast("int").alias("sequence"), odd.alias("station"))


def _candidates(spark, sf_dir) -> DataFrame:
    """All parts as stations, under their brands' first seven characters; three documents share each place."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("d"), (key % 3).cast("string")).alias("doc_id"), F.floor(key / 3).alias("cand_pos"), F.concat(F.lit("地铁"), F.substring("p_brand", 1, 7)).alias("name"), lat("p_partkey").alias("lat"), lng("p_partkey").alias("lng"))


_MATCH = f"""names as (
    select p_brand, min(p_partkey) as sequence from part group by p_brand),
  official as (
    select sequence, case when length(p_brand) = 7 then 'Halt ' || substr(p_brand, 7, 1) when sequence % 3 = 0 then 'No' || p_brand else p_brand || '站' end as station from names),
  normal as (select *, regexp_replace(station, '站$', '') as a from official),
  cands as (
    select p_partkey % 3 as doc_id, p_partkey // 3 as cand_pos, substr(p_brand, 1, 7) as b, {sql_lat("p_partkey")} as lat, {sql_lng("p_partkey")} as lng from part),
  scored as (
    select n.sequence, n.station, c.doc_id, c.cand_pos, c.b, c.lat, c.lng, case when a = b then 100 else 80 end as score
    from normal n join cands c on a = b or contains(a, b) or contains(b, a)),
  best as (select * from scored qualify row_number() over (partition by sequence order by score desc, doc_id, cand_pos) = 1)"""


def q_fuzzy_match(spark, sf_dir):
    found = matching.line_stations(_official(spark, sf_dir), _candidates(spark, sf_dir))
    return found.select("sequence", "official_name", "osm_name", "score", F.round("lat", 3).alias("lat"))


def q_match_override(spark, sf_dir):
    """Overrides for the stations whose names end in an odd digit; the other unmatched ones leave gaps."""
    roster = _official(spark, sf_dir)
    named = roster.filter("station RLIKE '[13579]$'").select("city", "line", "station", F.lit(1.5).alias("lat"), F.lit(2.5).alias("lng"))
    rows = matching.route_stations(roster, _candidates(spark, sf_dir), named)
    return rows.select("sequence", "name", F.round("lat", 3).alias("lat"), F.round("lng", 3).alias("lng"), "origin")


def q_unmatched(spark, sf_dir):
    roster = _official(spark, sf_dir)
    return matching.unmatched(roster, matching.line_stations(roster, _candidates(spark, sf_dir))).select("sequence", "station")


def q_edges(spark, sf_dir):
    return graph.edges(tracks(spark, sf_dir)).select("src", "dst", "way", F.round("distance", 2).alias("distance"))


def q_nearest_node(spark, sf_dir):
    spots = table(spark, sf_dir, "supplier").select(F.lit("map").alias("graph_id"), "s_suppkey", (lng("s_suppkey") + 0.0004).alias("lng"), (lat("s_suppkey") + 0.0003).alias("lat"))
    return graph.nearest_vertices(spots, graph.vertices(tracks(spark, sf_dir)), ["s_suppkey"]).select("s_suppkey", "node")


def q_nearest_many(spark, sf_dir):
    """Every customer's nearest part in its graph, by the tree; parts' places repeat, so the first of equals."""
    verts = table(spark, sf_dir, "part").select((F.col("p_size") % 3).alias("graph_id"), F.col("p_partkey").alias("node"), lng("p_partkey").alias("lng"), lat("p_partkey").alias("lat"), F.col("p_partkey").alias("first_pos"))
    spots = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 3).alias("graph_id"), "c_custkey", (lng("c_custkey") + 0.0004).alias("lng"), (lat("c_custkey") + 0.0003).alias("lat"))
    return graph.nearest_vertices(spots, verts, ["c_custkey"], few=0).select("c_custkey", "node")


def q_station_order(spark, sf_dir):
    points = sampled_line(spark, sf_dir)
    stations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 20).cast("long").alias("line_id"), F.col("n_nationkey").alias("pos"), "n_name", (lng("n_nationkey") + 0.0004).alias("lng"), (lat("n_nationkey") + 0.0003).alias("lat"))
    return lines.station_order(stations, points).select("line_id", "n_name", "idx", "place")


def q_length(spark, sf_dir):
    return lines.lengths(sampled_line(spark, sf_dir), pos="ts").select("line_id", F.round("length", 2).alias("length"))


def q_cum_distance(spark, sf_dir):
    return lines.stamped(sampled_line(spark, sf_dir), pos="ts").select("line_id", "event_id", F.round("distance", 1).alias("distance"))


def _long_lines(spark, sf_dir) -> DataFrame:
    """All events of a type as one line, in time."""
    return track_events(spark, sf_dir).select(F.col("event_type").alias("line_id"), "ts", "event_id", "lng", "lat")


def q_long_lines(spark, sf_dir):
    """Five lines as long as the table, stamped in whole metres without the points that repeat the one before."""
    kept = drop_consecutive(_long_lines(spark, sf_dir), ["line_id"], ["ts"], ["lng", "lat"], long=True)
    return lines.stamped(kept, pos="ts", long=True).select("line_id", "event_id", F.round("distance").alias("distance"))


def q_interchange(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("station_id"), F.col("l_suppkey").alias("line_id"))
    return lines.interchanges(uses)


def _whole_edges(spark, sf_dir) -> DataFrame:
    """The tracks' edges with whole metres, so that sums are exact."""
    return graph.edges(tracks(spark, sf_dir)).select("src", "dst", F.round("distance").cast("long").alias("distance"))


def _way_ends(spark, sf_dir) -> DataFrame:
    """way, and its first and last node."""
    return filters.sound_ways(tracks(spark, sf_dir)).select(F.col("id").alias("way"), F.get("nodes", F.lit(0)).alias("start"), F.get("nodes", F.size("nodes") - 1).alias("end"))


def q_shortest_path(spark, sf_dir):
    """From every vertex that has an edge, itself included."""
    whole = _whole_edges(spark, sf_dir)
    return graph.distances(whole, whole.select(F.col("src").alias("seed")).distinct()).select("seed", "node", "d")


def q_paths(spark, sf_dir):
    """From every vertex to the one after it, and from every way's first node to its last, by relaxation up to
    the last node's distance."""
    whole = _whole_edges(spark, sf_dir)
    nodes = whole.filter("src <> dst").select(F.lit(0).alias("all"), F.col("src").alias("end")).distinct()
    follow = before(spread(nodes, ["all"], ["end"]), ["all"], ["end"], {"start": "end"}).filter("NOT _first")
    asked = lambda kind, pos: F.struct(F.lit(kind).alias("asked"), F.col(pos).alias("pos")).alias("pair_pos")
    pairs = follow.select(asked("vertex", "start"), "start", "end").unionByName(_way_ends(spark, sf_dir).select(asked("way", "way"), "start", "end"))
    return graph.fixpoint_paths(whole, pairs).select("pair_pos.asked", F.col("pair_pos.pos").alias("pair_pos"), "pt_pos", "node")


def q_find_path(spark, sf_dir):
    """The shortest way from every way's first node to its last, stamped in degrees."""
    own = tracks(spark, sf_dir)
    pairs = _way_ends(spark, sf_dir).select(F.lit("map").alias("graph_id"), F.col("way").alias("pair_pos"), "start", "end")
    found = build.found_paths(_fine_edges(own), graph.vertices(own), pairs)
    return found.select("pair_pos", "pt_pos", "node", "distance")


def _route_stops(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.lit("map").alias("graph_id"), F.col("n_regionkey").alias("line_id"), F.col("n_nationkey").alias("sequence"), lng("n_nationkey").alias("lng"), lat("n_nationkey").alias("lat"))


def _fine_edges(own: DataFrame) -> DataFrame:
    """Edges with whole micrometres: exact sums, and next to no two ways of one length."""
    return graph.edges(own).withColumn("distance", F.round(F.col("distance") * 1_000_000).cast("long"))


def q_route(spark, sf_dir):
    """The regions' nations in order, over a graph that is cut into cells of 16 vertices."""
    own = tracks(spark, sf_dir)
    walked = graph.route(_route_stops(spark, sf_dir), graph.vertices(own), _fine_edges(own), cell=16)
    return lines.stamped(walked).select("line_id", "pt_pos", "node", F.round("distance", 1).alias("distance"))


def _planar(spark, sf_dir) -> DataFrame:
    """Lines on a plane with whole coordinates."""
    rows = track_events(spark, sf_dir)
    return rows.select("line_id", F.col("event_id").alias("pt_pos"), F.pmod(F.col("k") * 37, F.lit(100)).cast("double").alias("x"), F.pmod(F.col("k") * 59, F.lit(100)).cast("double").alias("y"))


_LEGS = """pts as (
    select line_id, event_id as pt_pos, cast((k * 37) % 100 as double) as x, cast((k * 59) % 100 as double) as y from track_events),
  nexts as (
    select *, lead(x) over w as x2, lead(y) over w as y2 from pts window w as (partition by line_id order by pt_pos)),
  sized as (select *, sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) as length from nexts where x2 is not null),
  legs as (
    select *, coalesce(sum(length) over (partition by line_id order by pt_pos rows between unbounded preceding and 1 preceding), 0e0) as cum
    from sized)"""


def q_project(spark, sf_dir):
    """Each event's place, moved a little, on the line of its user: how far off it is, and how far along."""
    planar = _planar(spark, sf_dir)
    legs = cut_lineage(track.legs(planar))
    spots = planar.select("line_id", F.col("pt_pos").alias("event_id"), (F.col("x") + 3.25).alias("px"), (F.col("y") - 1.5).alias("py"))
    return track.referenced(spots, legs, ["event_id"]).select("line_id", "event_id", F.round("off", 3).alias("off_line"), F.round("along", 2).alias("along"))


def q_resample(spark, sf_dir):
    legs = track.legs(_planar(spark, sf_dir))
    ends = legs.groupBy("line_id").agg(F.max(F.col("cum") + F.col("length")).alias("total"))
    ranges = ends.select("line_id", F.lit(10.5).alias("low"), F.floor("total").cast("double").alias("high"), (F.col("line_id") % 2 == 1).alias("reversed"))
    return track.samples(ranges, legs, 400.0).select("line_id", "i", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


def q_utm(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (lng("p_partkey") + 4).alias("lng"), lat("p_partkey").alias("lat"))
    back = track.from_utm(track.to_utm(rows).drop("lng", "lat"))
    return back.select("p_partkey", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


def _documents(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users as lines with their tracks, the first ones with a region's nations as stations."""
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("line_id")).distinct()
    stops = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("line_id"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.round(lng("n_nationkey"), 3).alias("lng"), F.round(lat("n_nationkey"), 3).alias("lat"))
    named = users.union(stops.select("line_id")).distinct().withColumn("name", F.concat(F.lit("Line "), F.col("line_id").cast("string")))
    return named, stops, sampled_line(spark, sf_dir)


def _features(feats: DataFrame, line: Column) -> DataFrame:
    kept = feats.withColumn("flat", F.when(F.col("kind") == "Point", F.array(F.from_json("coordinates", "array<double>"))).otherwise(F.from_json("coordinates", "array<array<double>>")))
    return kept.select(line.alias("line_id"), F.col("pos").alias("i"), "kind", "name", "line", F.size("flat").alias("n_points"), F.round(F.get(F.get("flat", F.size("flat") - 1), F.lit(0)), 3).alias("lng"))


def q_geojson(spark, sf_dir):
    """Each line's document as a text, read again feature by feature."""
    made = geojson.collections(*_documents(spark, sf_dir))
    parsed = geojson.parsed_features(made.select(F.col("line_id").cast("string").alias("file"), F.col("geojson").alias("value")))
    return _features(parsed, F.col("file"))


def q_geojson_files(spark, sf_dir):
    """Each line's document as a file that tasks write, read again in byte ranges."""
    named, stops, points = _documents(spark, sf_dir)
    folder = shared_path(spark, "documents")
    geowrite.write(named, stops, folder, points)
    return _features(geojson.large_features(spark, folder), F.regexp_extract("file", r"([^/]*)\.geojson$", 1))


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")} | mapped.QUERIES


# -- the same in SQL

_STRIP = lambda x: f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_STEPS = f"""moved as (
    select *, lag(lng) over w as l_lng, lag(lat) over w as l_lat from track_events window w as (partition by line_id order by ts)),
  steps as (select *, coalesce({STEP}, 0e0) as step from moved)"""
_EDGES = f"""paired as (
    select line_id, ts, event_id, k as a, lng, lat, lead(k) over w as b, lead(lng) over w as l_lng, lead(lat) over w as l_lat
    from track_events window w as (partition by line_id order by ts, event_id)),
  steps as (select *, {STEP} as metres from paired where b is not null),
  both_ways as (
    select a as src, b as dst, line_id as way, metres as distance, ts, 0 as back from steps
    union all select b, a, line_id, metres, ts, 1 from steps),
  edges as (select * from both_ways qualify row_number() over (partition by src, dst, way order by ts, back) = 1)"""


#: Distances over edges of whole units from the seeds, and the paths back over the first of equal predecessors.
def _walk(seeds: str, scale: str = "1") -> str:
    return f"""light as (select src, dst, min(cast(round(distance * {scale}) as bigint)) as w from edges where src <> dst group by src, dst),
  dist(seed, node, d) using key (seed, node) as (
    select distinct seed, seed, cast(0 as bigint) from ({seeds}) starts
    union
    select n.seed, n.dst, n.d from (
      select x.seed, l.dst, min(x.d + l.w) as d from dist x join light l on x.node = l.src group by x.seed, l.dst) n
    left join recurring.dist b on b.seed = n.seed and b.node = n.dst where b.d is null or n.d < b.d)"""


_ENDS = """ends as (
    select line_id as way, arg_min(k, (ts, event_id)) as start, arg_max(k, (ts, event_id)) as "end" from track_events group by line_id having count(*) >= 2)"""
_SEEDS, _ALL = "select start as seed from ends", "select src as seed from edges"
_BACK = """before as (
    select n.seed, n.node, arg_min(p.node, (p.d, p.node)) as prior from dist n join light l on l.dst = n.node join dist p on p.seed = n.seed and p.node = l.src and p.d + l.w = n.d
    where n.node <> n.seed group by n.seed, n.node),
  traced as (
    select pair_pos, start, "end" as node, 0 as back from pairs join dist on seed = start and node = "end"
    union all
    select t.pair_pos, t.start, b.prior, t.back + 1 from traced t join before b on b.seed = t.start and b.node = t.node where t.node <> t.start)"""

ORACLES = {
    "q_bbox_filter": f"""with spots as (select p_partkey, {sql_lat("p_partkey")} as lat, {sql_lng("p_partkey")} as lng from part)
select p_partkey, round(lat, 3) as lat, round(lng, 3) as lng from spots where lat between 38.9e0 and 39.2e0 and lng between 116.9e0 and 117.3e0""",
    "q_keep_first": "select p_partkey, p_name, p_brand from part qualify row_number() over (partition by p_name order by p_partkey) = 1",
    "q_drop_consecutive": f"""with {EVENTS},
  marked as (select *, row_number() over w as r, lag(lng) over w as l_lng, lag(lat) over w as l_lat from track_events window w as (partition by line_id order by ts))
select line_id, event_id, k from marked where r = 1 or l_lng is distinct from lng or l_lat is distinct from lat""",
    "q_track_tags": f"""with {EVENTS}
select line_id as id, 'way ' || line_id as name, min(event_type) as railway, 'none' as service, cast(count(*) as integer) as n_nodes
from track_events group by line_id having count(*) >= 2""",
    "q_normalize_names": f"""with rows_ as (
    select p_partkey, ' 地铁 ' || p_name || '：' || p_brand || '站　' as raw, cast(p_partkey % 20 as varchar) as ref from part)
select p_partkey, {_STRIP("replace(split_part(" + _STRIP("replace(raw, '：', ':')") + ", ':', 1), ' ', '')")} as listed,
  case when ref in ('1', '1E') then '{text.LINE_ONE}' else {_STRIP("replace(raw, '地铁 ', '地铁')")} end as line,
  regexp_replace({_STRIP("replace(replace(replace(replace(raw, '地铁', ''), '轨道交通', ''), '车站', ''), '站点', '')")}, '站$', '') as station
from rows_""",
    "q_line_listing": f"""with {_RELATIONS},
  keyed as (
    select *, replace(split_part(name, ':', 1), ' ', '') as listed, case when network <> '' and ref <> '' then ref else replace(split_part(name, ':', 1), ' ', '') end as part from relations),
  found as (
    select network, arg_min(ref, pos) as ref, arg_min(listed, pos) as name, min(pos) as first_pos,
      greatest(count(distinct case when "from" <> '' or "to" <> '' then "from" || '|' || "to" end), 1) as directions
    from keyed group by network, part)
select network || '_' || case when ref <> '' then ref else name end as line_id, ref, name, network, directions, first_pos,
  row_number() over (partition by network order by case when regexp_matches(ref, '^[0-9]+$') then 0 else 1 end, try_cast(ref as bigint), ref, first_pos) as place
from found""",
    "q_last_relation": f"""with {_RELATIONS}
select network, pos, case when ref in ('1', '1E') then '{text.LINE_ONE}' else name end as name from relations
qualify row_number() over (partition by network order by pos desc) = 1""",
    "q_station_attach": f"""with {_RELATIONS},
  seen as (select pos // 4000 as doc_id, network, ref, min(pos) as first_pos from relations group by doc_id, network, ref),
  stops as (
    select s_suppkey // 27 as doc_id, s_suppkey * 148 as elem_pos, 'Stop ' || (s_suppkey % 7) as name, s_suppkey % 7 as y, s_suppkey % 2 as x from supplier),
  attached as (
    select seen.doc_id, network, ref, elem_pos, name from seen join stops on seen.doc_id = stops.doc_id and elem_pos > first_pos
    qualify row_number() over (partition by seen.doc_id, network, ref, name, y, x order by elem_pos) = 1)
select doc_id, network, ref, count(*) as n_stations, cast(sum(elem_pos) as bigint) as pos_sum, min(name) as first_name from attached group by doc_id, network, ref""",
    "q_member_join": """select l_orderkey as relation, count(*) as n_stops, cast(sum(p_size) as bigint) as size_sum, min(p_name) as first_name
from lineitem join part on l_partkey = p_partkey where l_returnflag in ('N', 'R') group by l_orderkey""",
    "q_fuzzy_match": f"with {_MATCH} select cast(sequence as integer) as sequence, station as official_name, '地铁' || b as osm_name, score, round(lat, 3) as lat from best",
    "q_match_override": f"""with {_MATCH},
  again as (
    select n.sequence, n.station, s.lat, s.lng, case when n.a = s.b then 100 else 80 end as score, s.sequence as pos
    from normal n join best s on n.a = s.b or contains(n.a, s.b) or contains(s.b, n.a)
    qualify row_number() over (partition by n.sequence order by score desc, pos) = 1)
select cast(o.sequence as integer) as sequence, o.station as name, round(case when g.lat is not null then g.lat else 1.5e0 end, 3) as lat,
  round(case when g.lat is not null then g.lng else 2.5e0 end, 3) as lng, case when g.lat is not null then 'map' else 'override' end as origin
from official o left join again g on o.sequence = g.sequence where g.lat is not null or regexp_matches(o.station, '[13579]$')""",
    "q_unmatched": f"""with {_MATCH}
select cast(sequence as integer) as sequence, station from normal n where not exists (select 1 from cands where contains(a, b) or contains(b, a))""",
    "q_edges": f"with {EVENTS}, {_EDGES} select src, dst, way, round(distance, 2) as distance from edges",
    "q_nearest_node": f"""with {EVENTS},
  verts as (select k as node, lng, lat, line_id, ts from track_events qualify row_number() over (partition by k order by line_id, ts) = 1),
  spots as (select s_suppkey, {sql_lng("s_suppkey")} + 0.0004e0 as x, {sql_lat("s_suppkey")} + 0.0003e0 as y from supplier)
select s_suppkey, node from spots cross join verts
qualify row_number() over (partition by s_suppkey order by sqrt((x - lng) * (x - lng) + (y - lat) * (y - lat)), line_id, ts) = 1""",
    "q_nearest_many": f"""with verts as (select p_size % 3 as graph_id, p_partkey as node, {sql_lng("p_partkey")} as lng, {sql_lat("p_partkey")} as lat from part),
  spots as (select c_nationkey % 3 as graph_id, c_custkey, {sql_lng("c_custkey")} + 0.0004e0 as x, {sql_lat("c_custkey")} + 0.0003e0 as y from customer)
select c_custkey, node from spots join verts on verts.graph_id = spots.graph_id
qualify row_number() over (partition by c_custkey order by sqrt((x - lng) * (x - lng) + (y - lat) * (y - lat)), node) = 1""",
    "q_station_order": f"""with {EVENTS},
  stations as (
    select n_nationkey % 20 as line_id, n_nationkey as pos, n_name, {sql_lng("cast(n_nationkey as bigint)")} + 0.0004e0 as x, {sql_lat("cast(n_nationkey as bigint)")} + 0.0003e0 as y from nation),
  best as (
    select s.line_id, s.pos, s.n_name, e.event_id as idx from stations s left join track_events e on e.line_id = s.line_id
    qualify row_number() over (partition by s.pos order by sqrt((x - lng) * (x - lng) + (y - lat) * (y - lat)), event_id) = 1)
select cast(line_id as bigint) as line_id, n_name, coalesce(idx, 0) as idx, row_number() over (partition by line_id order by coalesce(idx, 0), pos) as place from best""",
    "q_length": f"with {EVENTS}, {_STEPS} select line_id, round(sum(step), 2) as length from steps group by line_id",
    "q_cum_distance": f"""with {EVENTS}, {_STEPS}
select line_id, event_id, round(round(sum(step) over (partition by line_id order by ts rows unbounded preceding), 2), 1) as distance from steps""",
    "q_long_lines": f"""with {EVENTS},
  moved as (
    select event_type as line_id, ts, event_id, lng, lat, lag(lng) over w as l_lng, lag(lat) over w as l_lat from track_events window w as (partition by event_type order by ts)),
  steps as (select *, coalesce({STEP}, 0e0) as step from moved where l_lng is null or l_lng <> lng or l_lat <> lat)
select line_id, event_id, round(round(sum(step) over (partition by line_id order by ts rows unbounded preceding), 2)) as distance from steps""",
    "q_interchange": "select l_partkey as station_id, count(distinct l_suppkey) > 1 as interchange from lineitem group by l_partkey",
    "q_shortest_path": f"""with recursive {EVENTS}, {_EDGES}, {_walk(_ALL)}
select seed, node, d from dist""",
    "q_paths": f"""with recursive {EVENTS}, {_EDGES}, {_ENDS}, {_walk(_ALL)},
  pairs as (
    select {{'asked': 'way', 'pos': way}} as pair_pos, start, "end" from ends
    union all select {{'asked': 'vertex', 'pos': s}}, s, lead(s) over (order by s) from (select distinct src as s from light)), {_BACK}
select pair_pos.asked as asked, pair_pos.pos as pair_pos, cast(row_number() over (partition by pair_pos order by back desc) - 1 as integer) as pt_pos, node from traced""",
    "q_find_path": f"""with recursive {EVENTS}, {_EDGES}, {_ENDS}, {_walk(_SEEDS, "1000000")},
  verts as (select k as node, lng, lat from track_events qualify row_number() over (partition by k order by line_id, ts) = 1),
  pairs as (select way as pair_pos, start, "end" from ends), {_BACK},
  placed as (select pair_pos, row_number() over (partition by pair_pos order by back desc) - 1 as pt_pos, node from traced),
  moved as (
    select p.*, lng, lat, lag(lng) over w as l_lng, lag(lat) over w as l_lat from placed p join verts v on v.node = p.node window w as (partition by pair_pos order by pt_pos)),
  stamps as (select *, coalesce(sqrt((l_lng - lng) * (l_lng - lng) + (l_lat - lat) * (l_lat - lat)), 0e0) as step from moved)
select pair_pos, cast(pt_pos as integer) as pt_pos, node, round(sum(step) over (partition by pair_pos order by pt_pos rows unbounded preceding), 2) as distance from stamps""",
    "q_route": f"""with recursive {EVENTS}, {_EDGES}, {_walk(_ALL, "1000000")},
  verts as (select k as node, lng, lat, line_id as way, ts from track_events qualify row_number() over (partition by k order by line_id, ts) = 1),
  stops as (
    select n_regionkey as line_id, n_nationkey as sequence, node from nation cross join verts
    qualify row_number() over (partition by n_nationkey order by sqrt(power({sql_lng("cast(n_nationkey as bigint)")} - lng, 2) + power({sql_lat("cast(n_nationkey as bigint)")} - lat, 2)), way, ts) = 1),
  pairs as (
    select sequence as pair_pos, line_id, node as start, lead(node) over (partition by line_id order by sequence) as "end" from stops), {_BACK},
  walked as (
    select p.line_id, t.pair_pos, t.node, row_number() over (partition by t.pair_pos order by back desc) - 1 as spot, min(t.pair_pos) over (partition by p.line_id) as first_pos
    from traced t join pairs p on p.pair_pos = t.pair_pos),
  placed as (
    select line_id, row_number() over (partition by line_id order by pair_pos, spot) - 1 as pt_pos, node from walked where spot > 0 or pair_pos = first_pos),
  moved as (
    select p.*, lng, lat, lag(lng) over w as l_lng, lag(lat) over w as l_lat from placed p join verts v on v.node = p.node window w as (partition by p.line_id order by pt_pos)),
  stamped as (select *, coalesce({STEP}, 0e0) as step from moved)
select line_id, cast(pt_pos as integer) as pt_pos, node, round(round(sum(step) over (partition by line_id order by pt_pos rows unbounded preceding), 2), 1) as distance from stamped""",
    "q_project": f"""with {EVENTS}, {_LEGS},
  spots as (select line_id, pt_pos as event_id, x + 3.25e0 as px, y - 1.5e0 as py from pts),
  shares as (
    select s.line_id, event_id, px, py, x, y, x2, y2, pt_pos, cum, length,
      case when (x2 - x) * (x2 - x) + (y2 - y) * (y2 - y) = 0 then 0e0
        else greatest(0e0, least(1e0, ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)))) end as t
    from spots s join legs on s.line_id = legs.line_id),
  far as (
    select *, sqrt((px - (x + (x2 - x) * t)) * (px - (x + (x2 - x) * t)) + (py - (y + (y2 - y) * t)) * (py - (y + (y2 - y) * t))) as off from shares)
select line_id, event_id, round(off, 3) as off_line, round(cum + t * length, 2) as along from far
qualify row_number() over (partition by line_id, event_id order by round(off, 6), pt_pos) = 1""",
    "q_resample": f"""with {EVENTS}, {_LEGS},
  ranges as (
    select line_id, 10.5e0 as low, floor(max(cum + length)) as high, line_id % 2 = 1 as turned, max(pt_pos) as last_pos from legs group by line_id),
  counted as (select *, cast(floor((high - low) / 400) as bigint) as steps from ranges where high >= low),
  grid as (
    select line_id, turned, steps + 2 as n, k, low + k * 400e0 as along, last_pos from counted, unnest(range(0, steps + 1)) r(k)
    union all select line_id, turned, steps + 2, steps + 1, high, last_pos from counted),
  met as (
    select g.*, x, y, x2, y2, case when length > 0 then least(1e0, (along - cum) / length) else 0e0 end as t
    from grid g join legs l on l.line_id = g.line_id and along >= cum and (along < cum + length or pt_pos = last_pos))
select line_id, cast(case when turned then n - k else k + 1 end as bigint) as i, round(x + (x2 - x) * t, 2) as x, round(y + (y2 - y) * t, 2) as y from met""",
    "q_utm": f"""with spots as (select p_partkey, {sql_lng("p_partkey")} + 4 as lng, {sql_lat("p_partkey")} as lat from part),
  {staged(geo.utm_stages(), "spots", "u_")},
  flat as (select p_partkey, x, y from u_2),
  {staged(geo.inverse_utm_stages(), "flat", "v_")}
select p_partkey, round(x, 2) as x, round(y, 2) as y, round(lng, 6) as lng, round(lat, 6) as lat from v_3""",
    "q_geojson": f"""with {EVENTS},
  numbered as (
    select n_regionkey as line_id, n_nationkey as pos, n_name as name, round({sql_lng("cast(n_nationkey as bigint)")}, 3) as lng from nation),
  feats as (
    select line_id, -1 as pos, 'LineString' as kind, 'Line ' || line_id as name, null as line, count(*) as n, round(arg_max(lng, event_id), 3) as lng
    from track_events e group by line_id
    union all select line_id, pos, 'Point', name, 'Line ' || line_id, 1, lng from numbered)
select cast(line_id as varchar) as line_id, cast(row_number() over (partition by line_id order by pos) - 1 as integer) as i, kind, name, line, cast(n as integer) as n_points, lng from feats""",
} | mapped.ORACLES
ORACLES["q_geojson_files"] = ORACLES["q_geojson"]
