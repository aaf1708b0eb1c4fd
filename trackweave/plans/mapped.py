"""Registered queries over map responses: the test tables told as element JSON, read back by the sources.

Parts become nodes, users' events ways, orders relations with their line items as members. Documents hold
so many keys each (``PARTS``, ``USERS``, ``ORDERS``), so larger tables make more documents and not larger
ones. Responses have all kinds of elements, except those of q_rail_tracks. Every query goes through the
library's own readers and operators; the SQL counterparts take the tables as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.functions import geo, text
from trackweave.operators import filters, graph, lines
from trackweave.plans import build
from trackweave.plans.tables import BOX, EVENTS, STEP, lat, lng, sampled_line, sql_lat, sql_lng, staged, table, track_events, tracks
from trackweave.sources import elements as el
from trackweave.sources import geojson, places, roster

#: Keys a document: of parts, users and orders.
PARTS, USERS, ORDERS = 53, 4, 400
WAY_KINDS = ("subway", "light_rail", "rail", "tram")
#: Kinds of elements; members come with relations.
ALL = ("node", "way", "relation", "members")


def _tags(**values: Column) -> Column:
    """A map of the tags that have a value."""
    pairs = F.array(*(F.struct(F.lit(k.rstrip("_")).alias("key"), v.cast("string").alias("value")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def _flag(size: str, every: int, value: str) -> Column:
    return F.when(F.col(size) % every == 0, F.lit(value))


def _doc(key: str, each: int) -> Column:
    return F.floor(F.col(key) / each)


def _nodes(spark, sf_dir) -> DataFrame:
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") % 13 == 0, F.lit("")).when(F.col("p_size") % 11 != 0, F.col("p_name"))
    tags = _tags(name=name, railway=_flag("p_size", 3, "station"), station=_flag("p_size", 4, "subway"), subway=_flag("p_size", 5, "yes"))
    there = F.col("p_size") % 17 != 0
    node = F.struct(F.lit("node").alias("type"), F.col("p_partkey").alias("id"), F.when(there, lat("p_partkey")).alias("lat"), F.when(there, lng("p_partkey")).alias("lon"), tags.alias("tags"))
    return part.select(_doc("p_partkey", PARTS).alias("doc"), (F.col("p_partkey") * 7).alias("pos"), F.lit(0).alias("kind"), F.to_json(node).alias("e"))


def _ways(spark, sf_dir) -> DataFrame:
    events = track_events(spark, sf_dir).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("ts", "k", "lng", "lat"))).alias("p"), F.min("event_type").alias("railway"))
    # every other way is of a kind by its number
    kinds = F.array(*map(F.lit, WAY_KINDS))
    kind = F.when(F.col("line_id") % 2 == 0, F.col("railway")).otherwise(F.get(kinds, (F.floor(F.col("line_id") / 2) % len(WAY_KINDS)).cast("int")))
    shape = F.when(F.col("line_id") % 3 != 0, F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lng"].alias("lon"))))
    way = F.struct(F.lit("way").alias("type"), F.col("line_id").alias("id"), F.transform("p", lambda x: x["k"]).alias("nodes"), shape.alias("geometry"), _tags(railway=kind, name=F.concat(F.lit("way "), F.col("line_id").cast("string"))).alias("tags"))
    return events.select(_doc("line_id", USERS).alias("doc"), (F.col("line_id") * 13 + 1).alias("pos"), F.lit(1).alias("kind"), F.to_json(way).alias("e"))


def _relations(spark, sf_dir, with_members: bool) -> DataFrame:
    """Orders, those without line items as relations without members."""
    orders = table(spark, sf_dir, "orders")
    fields = []
    if with_members:
        doc = _doc("l_orderkey", ORDERS)
        is_way = (F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 2 == 0)
        role = F.when(F.col("l_returnflag") == "N", "stop").when(F.col("l_returnflag") == "R", "").otherwise("guide")
        ref = F.when(is_way, doc * USERS + F.col("l_suppkey") % (USERS + 2)).otherwise(doc * PARTS + F.col("l_partkey") % PARTS)
        member = F.struct("l_linenumber", F.when(is_way, "way").otherwise("node").alias("type"), ref.alias("ref"), role.alias("role"))
        members = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(member)), lambda m: F.struct(m["type"].alias("type"), m["ref"].alias("ref"), m["role"].alias("role"))).alias("members"))
        orders = orders.join(members, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        fields = ["members"]
    n = F.col("o_custkey") % 40
    silent = F.col("o_orderstatus") == "P"
    route = F.element_at(F.array(*map(F.lit, ("subway", "light_rail", "tram", "railway", "bus"))), (F.col("o_custkey") % 5 + 1).cast("int"))
    title = F.concat(F.when(F.col("o_custkey") % 9 == 8, "地铁 ").otherwise(""), F.lit("Line "), n.cast("string"), F.lit(":"), F.col("o_orderstatus"))
    tags = _tags(route=route, name=F.when(F.col("o_custkey") % 23 != 0, title), ref=F.when(n == 0, "").when(n == 7, "7E").otherwise(n.cast("string")), network=F.col("o_orderpriority"), from_=F.when(~silent, F.col("o_orderstatus")), to=F.when(~silent, F.year("o_orderdate").cast("string")))
    relation = F.struct(F.lit("relation").alias("type"), F.col("o_orderkey").alias("id"), *fields, tags.alias("tags"))
    return orders.select(_doc("o_orderkey", ORDERS).alias("doc"), F.col("o_orderkey").alias("pos"), F.lit(2).alias("kind"), F.to_json(relation).alias("e"))


def responses(spark, sf_dir, kinds: tuple[str, ...] = ALL) -> DataFrame:
    """doc_id and value: one response text a document, with elements of the given kinds."""
    made = [rows for kind, rows in (("node", _nodes), ("way", _ways)) if kind in kinds]
    every = [rows(spark, sf_dir) for rows in made] + ([_relations(spark, sf_dir, "members" in kinds)] if "relation" in kinds else [])
    listed = reduce(DataFrame.unionByName, every).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "kind", "e"))).alias("all"))
    body = F.concat(F.lit('{"elements":['), F.array_join(F.transform("all", lambda x: x["e"]), ","), F.lit("]}"))
    return listed.select(F.concat(F.lit("d"), F.col("doc").cast("string")).alias("doc_id"), body.alias("value"))


def elements(spark, sf_dir, *kinds: str) -> DataFrame:
    return el.elements(responses(spark, sf_dir, kinds or ALL), key="doc_id")


def _mapped(*kinds: str) -> str:
    """The elements of the given kinds in SQL."""
    placed = {
        "node": f"select p_partkey // {PARTS} as doc, p_partkey * 7 as pos, 0 as kind, p_partkey as id from part",
        "way": f"select distinct user_id // {USERS} as doc, user_id * 13 + 1 as pos, 1 as kind, user_id as id from events",
        "relation": f"select o_orderkey // {ORDERS} as doc, o_orderkey as pos, 2 as kind, o_orderkey as id from orders",
    }
    return f"""{EVENTS},
  members as (
    select l_orderkey as id, l_orderkey // {ORDERS} as doc, l_linenumber, case when l_linestatus = 'F' and l_linenumber % 2 = 0 then 'way' else 'node' end as type,
      case when l_linestatus = 'F' and l_linenumber % 2 = 0 then l_orderkey // {ORDERS} * {USERS} + l_suppkey % {USERS + 2} else l_orderkey // {ORDERS} * {PARTS} + l_partkey % {PARTS} end as ref,
      case l_returnflag when 'N' then 'stop' when 'R' then '' else 'guide' end as role
    from lineitem),
  placed as (
    select *, row_number() over (partition by doc order by pos, kind) - 1 as elem_pos from ({" union all ".join(placed[k] for k in kinds or placed if k in placed)})),
  nodes as (
    select doc, elem_pos, p_partkey as id, case when p_size % 13 = 0 then '' when p_size % 11 <> 0 then p_name end as name,
      case when p_size % 17 <> 0 then {sql_lat("p_partkey")} end as lat, case when p_size % 17 <> 0 then {sql_lng("p_partkey")} end as lng,
      p_size % 3 = 0 as rail, p_size % 4 = 0 as metro, p_size % 5 = 0 as yes
    from placed join part on kind = 0 and id = p_partkey),
  ways as (
    select doc, elem_pos, p.id, case when p.id % 2 = 0 then min(event_type) else {list(WAY_KINDS)}[p.id // 2 % {len(WAY_KINDS)} + 1] end as railway, count(*) as n
    from placed p join track_events e on kind = 1 and p.id = line_id group by doc, elem_pos, p.id),
  relations as (
    select doc, elem_pos, o_orderkey as id, ['subway', 'light_rail', 'tram', 'railway', 'bus'][o_custkey % 5 + 1] as route,
      case when o_custkey % 23 <> 0 then case when o_custkey % 9 = 8 then '地铁 ' else '' end || 'Line ' || (o_custkey % 40) || ':' || o_orderstatus end as name,
      case o_custkey % 40 when 0 then '' when 7 then '7E' else cast(o_custkey % 40 as varchar) end as ref, o_orderpriority as network,
      case when o_orderstatus <> 'P' then o_orderstatus end as "from", case when o_orderstatus <> 'P' then cast(year(o_orderdate) as varchar) end as "to"
    from placed join orders on kind = 2 and id = o_orderkey),
  titled as (
    select *, case when ref in ('1', '1E') and name <> '' then '{text.LINE_ONE}' else replace(name, '地铁 ', '地铁') end as title from relations)"""


_PARSED = f"""{_mapped()},
  chosen as (
    select * from relations where route in ('subway', 'light_rail', 'railway') qualify row_number() over (partition by doc order by elem_pos desc) = 1),
  own as (
    select c.doc, m.type, m.ref, m.role, row_number() over (partition by c.doc order by l_linenumber, m.type, m.ref, m.role) - 1 as member_pos
    from chosen c join members m on m.id = c.id),
  stops as (
    select own.doc, member_pos as pos, name, lat, lng from own join nodes n on n.doc = own.doc and n.id = ref
    where type = 'node' and role in ('stop', '') and name is not null
    union all
    select n.doc, n.elem_pos, n.name, lat, lng from nodes n join chosen c on c.doc = n.doc where n.name is not null and not exists (select 1 from members m where m.id = c.id)),
  drawn as (
    select own.doc, member_pos, e.ts, case when ref % 3 <> 0 then e.lng else n.lng end as lng, case when ref % 3 <> 0 then e.lat else n.lat end as lat
    from own join ways w on w.doc = own.doc and w.id = ref and type = 'way' join track_events e on e.line_id = ref
    left join nodes n on n.doc = own.doc and n.id = k where ref % 3 <> 0 or n.id is not null),
  marked as (
    select *, row_number() over w as r, lag(lng) over w as l_lng, lag(lat) over w as l_lat from drawn window w as (partition by doc order by member_pos, ts)),
  points as (
    select doc, row_number() over (partition by doc order by member_pos, ts) - 1 as pt_pos, lng, lat from marked
    where r = 1 or l_lng is distinct from lng or l_lat is distinct from lat),
  named as (select d.doc, coalesce(name, 'Unknown') as name from (select distinct doc from placed) d left join chosen c on c.doc = d.doc)"""


def q_parse_line(spark, sf_dir):
    """Lines, stations and points of every document, one below the other."""
    found, stations, points = lines.parsed_lines(elements(spark, sf_dir))
    out = [
        found.select("doc_id", F.lit("line").alias("what"), F.lit(0).alias("pos"), "name", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng")),
        stations.select("doc_id", F.lit("station"), "pos", "name", "lat", "lng"),
        points.select("doc_id", F.lit("point"), F.col("pt_pos"), F.lit(None).cast("string"), "lat", "lng"),
    ]
    return out[0].union(out[1]).union(out[2]).withColumns({"lat": F.round("lat", 3), "lng": F.round("lng", 3)})


def q_line_summary(spark, sf_dir):
    return lines.summary(*lines.parsed_lines(elements(spark, sf_dir)))


def q_station_names(spark, sf_dir):
    """Each line's station names in order, every name once."""
    _, stations, _ = lines.parsed_lines(elements(spark, sf_dir))
    named = lines.station_names(lines.unique_stations(stations))
    return named.select("doc_id", F.size("names").alias("n"), F.array_join("names", "|").alias("names"))


def q_tracks(spark, sf_dir):
    found = el.tracks(elements(spark, sf_dir))
    return found.select("doc_id", "way_pos", "id", "name", "railway", F.coalesce("service", F.lit("none")).alias("service"), F.size("nodes").alias("n_nodes"), F.size("geometry").alias("n_points"), F.round(F.get("geometry", F.size("geometry") - 1)["lng"], 3).alias("last_lng"))


def q_rail_tracks(spark, sf_dir):
    """What a track query asks for: ways of the track kinds with a point in the box."""
    found = el.rail_tracks(elements(spark, sf_dir, "way"), BOX)
    return found.select("doc_id", "way_pos", "id", "railway", F.size("geometry").alias("n_points"))


def q_track_count(spark, sf_dir):
    return el.track_count(elements(spark, sf_dir))


def q_metro_stations(spark, sf_dir):
    found = el.stations(elements(spark, sf_dir).filter(filters.is_metro_station_node()))
    return found.select("doc_id", "cand_pos", "name", F.round("lat", 3).alias("lat"), F.round("lng", 3).alias("lng"))


def q_relations_named(spark, sf_dir):
    """Metro relations with "line 1" in their names, and those of the parsed kinds of line 3."""
    elems = elements(spark, sf_dir)
    some = el.relations_named(elems, "line 1").select("doc_id", "elem_pos", "id", "name")
    return some.withColumn("asked", F.lit("1")).unionByName(el.line_relations(elems, "Line 3").select("doc_id", "elem_pos", "id", filters.tag("name").alias("name"), F.lit("3").alias("asked")))


def q_simple_line(spark, sf_dir):
    found, stations = lines.simple_lines(elements(spark, sf_dir))
    counted = stations.groupBy("doc_id").agg(F.count("*").alias("n_stations"), F.count("name").alias("n_named"), F.sum("pos").alias("pos_sum"))
    return found.join(counted, "doc_id")


def q_grouped_lines(spark, sf_dir):
    found, stations = lines.grouped_lines(elements(spark, sf_dir), BOX)
    counted = stations.groupBy("doc_id", "line_key").agg(F.count("*").alias("n_stations"), F.sum("elem_pos").alias("pos_sum"))
    return found.join(counted, ["doc_id", "line_key"])


def q_city_listing(spark, sf_dir):
    listed = build.city_listing(elements(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*lines.listing_order()))
    return listed.select("doc_id", "line_id", "ref", "name", "network", "route", "from", "to", "directions", "first_pos", place.alias("place"))


def q_line_documents(spark, sf_dir):
    """What a download writes: each document's GeoJSON, read again feature by feature; one row without any."""
    made = build.line_documents(elements(spark, sf_dir))
    feats = geojson.parsed_features(made.select(F.col("line_id").alias("file"), F.col("geojson").alias("value")))
    size = F.when(F.col("kind") == "LineString", F.size(F.from_json("coordinates", "array<array<double>>"))).when(F.col("kind") == "Point", 1)
    rows = made.select(F.col("line_id").alias("doc_id"), F.col("name").alias("title")).join(feats.withColumnRenamed("file", "doc_id"), "doc_id", "left")
    return rows.select("doc_id", "title", "pos", "kind", "name", "line", size.alias("n_points"))


# -- tracks, GeoJSON, places


def q_track_counters(spark, sf_dir):
    return graph.counters(tracks(spark, sf_dir))


def q_filtered_edges(spark, sf_dir):
    """Edges of the ways of one kind of three and one route of two."""
    kind = lambda n, *names: F.get(F.array(*map(F.lit, names)), (F.col("id") % n).cast("int"))
    tagged = tracks(spark, sf_dir).withColumn("tags", F.create_map(F.lit("railway"), kind(3, "subway", "rail", "tram"), F.lit("route"), kind(2, "a", "b")))
    return graph.edges(tagged, railway="rail", route="b").select("src", "dst", "way", F.round("distance", 2).alias("distance"))


def q_degree_distance(spark, sf_dir):
    return lines.stamped(sampled_line(spark, sf_dir), pos="ts", metric="degree").select("line_id", "event_id", "distance")


def _track_files(spark, sf_dir) -> DataFrame:
    """file and value: each user's track as GeoJSON, an older line before it, with points named by event type
    and two named start and end."""
    feature = lambda kind, at, name: F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), at.alias("coordinates")).alias("geometry"), F.struct(name.alias("name"), F.lit("L").alias("line")).alias("properties"))
    point = lambda x: F.array(x["lng"], x["lat"])
    rows = track_events(spark, sf_dir).groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "lng", "lat", "event_type"))).alias("p"))
    line = lambda p: F.to_json(feature("LineString", F.transform(p, point), F.lit("L")))
    spot = lambda x, y, name: F.to_json(feature("Point", F.array(F.lit(117.0) + x, F.lit(38.9) + y), F.lit(name)))
    m = (F.col("line_id") % 90).cast("double")
    parts = F.flatten(F.array(F.array(line(F.slice("p", 1, 3)), line(F.col("p"))), F.transform("p", lambda x: F.to_json(feature("Point", point(x), x["event_type"]))), F.array(spot(m / 1000 + 0.00037, m / 700 + 0.00041, "start"), spot(0.61 - m / 300, 0.33 - m / 600, "end"))))
    return rows.select(F.col("line_id").cast("string").alias("file"), F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(parts, ","), F.lit("]}")).alias("value"))


def q_geojson_read(spark, sf_dir):
    """The points of each file's last line, and its points by name, the last of each."""
    feats = geojson.parsed_features(_track_files(spark, sf_dir))
    points = geojson.line_points(feats).select("line_id", F.lit("line").alias("what"), F.col("pt_pos").alias("pos"), "lng", "lat")
    spots = geojson.station_points(feats).select("line_id", F.col("name").alias("what"), "pos", "lng", "lat")
    return points.union(spots).withColumns({"lng": F.round("lng", 6), "lat": F.round("lat", 6)})


def q_export_track(spark, sf_dir):
    """Each file's track from start to end, a sample every 20 km."""
    found = build.exported(geojson.parsed_features(_track_files(spark, sf_dir)), "start", "end", 20_000.0)
    return found.select("line_id", "i", "lng", "lat")


def q_export_table(spark, sf_dir):
    """The same as the export's rows: label, longitude, latitude."""
    found = build.exported(geojson.parsed_features(_track_files(spark, sf_dir)), "start", "end", 20_000.0)
    return geojson.labelled(found, "13号线").toDF("label", "lng", "lat")


def q_station_scores(spark, sf_dir):
    """Every part's brand, written three ways, against the next part's, cut short for some, by score."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey") % 3
    asked = part.select(F.col("p_partkey").alias("key"), F.when(k == 0, F.concat("p_brand", F.lit("车站"))).when(k == 1, F.concat(F.lit("地铁"), "p_brand", F.lit("站"))).otherwise(F.concat(F.lit(" 轨道交通"), "p_brand")).alias("asked"))
    short = F.when(F.col("p_partkey") % 5 < 3, F.substring("p_brand", 1, 7)).otherwise(F.col("p_brand"))
    known = part.select((F.col("p_partkey") - 1).alias("key"), F.concat(short, F.lit("站点")).alias("known"))
    return asked.join(known, "key").select("key", text.station_score(F.col("asked"), F.col("known")).alias("score"))


def q_places(spark, sf_dir):
    """Nations' names looked up as places (with an ending that goes) and as cities."""
    nation = table(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey"), F.col("n_name")
    asked = F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(name, F.lit("市"))).otherwise(F.concat(name, F.lit(" 中国")))
    number = lambda c: (c.cast("double") / 2).cast("string")
    hit = F.struct(asked.alias("display_name"), F.when(k % 7 == 6, "bad").otherwise(number(k)).alias("lat"), number(k + 100).alias("lon"), F.array(number(k), number(k + 1), F.when(k % 5 == 4, "?").otherwise(number(k + 2)), number(k + 3)).alias("boundingbox"))
    answers = nation.select(asked.alias("asked"), F.when(k % 8 == 7, "[]").otherwise(F.to_json(F.array(hit))).alias("body"))
    known = places.places(answers)
    spots = places.find_places(nation.select(F.concat(name, F.lit("站")).alias("wanted")), known).select("wanted", "name", "lat", "lng", F.lit(None).cast("double").alias("north"), F.lit(None).cast("double").alias("west"))
    cities = places.find_cities(nation.select(name.alias("wanted")), known).select("wanted", "name", "lat", "lng", F.col("bbox.north").alias("north"), F.col("bbox.west").alias("west"))
    return spots.unionByName(cities)


def q_roster(spark, sf_dir):
    """Customers as stations of lines, a nation's market segments, in order; those in debt have coordinates."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("city"), F.col("c_mktsegment").alias("line"), F.col("c_name").alias("station"), "c_custkey", "c_acctbal")
    listed = customer.groupBy("city", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "station"))), lambda s: s["station"]).alias("stations"))
    known = customer.filter("c_acctbal < 0").select("city", "line", "station", lat("c_custkey").alias("lat"), lng("c_custkey").alias("lng"))
    return roster.located(roster.of_lists(listed), known).withColumns({"lat": F.round("lat", 3), "lng": F.round("lng", 3)})


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_")}


# -- the same in SQL

_FILES = f"""{EVENTS},
  spots as (
    select line_id, 'start' as name, 117e0 + (cast(line_id % 90 as double) / 1000 + 0.00037e0) as lng, 38.9e0 + (cast(line_id % 90 as double) / 700 + 0.00041e0) as lat, count(*) + 2 as pos from track_events group by line_id
    union all
    select line_id, 'end', 117e0 + (0.61e0 - cast(line_id % 90 as double) / 300), 38.9e0 + (0.33e0 - cast(line_id % 90 as double) / 600), count(*) + 3 from track_events group by line_id)"""

_EXPORT = f"""with {_FILES},
  {staged(geo.utm_stages(), "track_events", "p_")},
  nexts as (select line_id, event_id as pt_pos, x, y, lead(x) over w as x2, lead(y) over w as y2 from p_2 window w as (partition by line_id order by event_id)),
  sized as (select *, sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) as length from nexts where x2 is not null),
  legs as (select *, coalesce(sum(length) over (partition by line_id order by pt_pos rows between unbounded preceding and 1 preceding), 0e0) as cum from sized),
  {staged(geo.utm_stages(), "spots", "s_")},
  shares as (
    select s.line_id, name, s.x as px, s.y as py, legs.x, legs.y, x2, y2, length, cum, pt_pos,
      case when length = 0 then 0e0 else greatest(0e0, least(1e0, ((s.x - legs.x) * (x2 - legs.x) + (s.y - legs.y) * (y2 - legs.y)) / ((x2 - legs.x) * (x2 - legs.x) + (y2 - legs.y) * (y2 - legs.y)))) end as t
    from s_2 s join legs on s.line_id = legs.line_id),
  best as (
    select line_id, name, cum + t * length as along from shares
    qualify row_number() over (partition by line_id, name order by round(sqrt(power(px - (x + (x2 - x) * t), 2) + power(py - (y + (y2 - y) * t), 2)), 6), pt_pos) = 1),
  ranges as (
    select line_id, min(along) as low, max(along) as high, max(case when name = 'start' then along end) > max(case when name = 'end' then along end) as turned,
      cast(floor((max(along) - min(along)) / 20000) as bigint) as steps from best group by line_id),
  grid as (
    select line_id, turned, steps + 2 as n, k, low + k * 20000e0 as along from ranges, unnest(range(0, steps + 1)) r(k)
    union all select line_id, turned, steps + 2, steps + 1, high from ranges),
  met as (
    select g.*, x, y, x2, y2, case when length > 0 then least(1e0, (along - cum) / length) else 0e0 end as t
    from grid g join legs l on l.line_id = g.line_id and along >= cum
    qualify row_number() over (partition by g.line_id, k order by pt_pos desc) = 1),
  flat as (select line_id, case when turned then n - k else k + 1 end as i, x + (x2 - x) * t as x, y + (y2 - y) * t as y from met),
  {staged(geo.inverse_utm_stages(), "flat", "v_")}"""

ORACLES = {
    "q_parse_line": f"""with {_PARSED}
select 'd' || doc as doc_id, 'line' as what, 0 as pos, name, cast(null as double) as lat, cast(null as double) as lng from named
union all select 'd' || doc, 'station', cast(pos as integer), name, round(lat, 3), round(lng, 3) from stops
union all select 'd' || doc, 'point', cast(pt_pos as integer), null, round(lat, 3), round(lng, 3) from points""",
    "q_line_summary": f"""with {_PARSED}
select 'd' || n.doc as doc_id, name, coalesce(s.n, 0) as n_stations, coalesce(p.n, 0) as n_points from named n
left join (select doc, count(*) as n from stops group by doc) s on s.doc = n.doc left join (select doc, count(*) as n from points group by doc) p on p.doc = n.doc""",
    "q_station_names": f"""with {_PARSED},
  firsts as (select * from stops qualify row_number() over (partition by doc, name order by pos) = 1)
select 'd' || doc as doc_id, cast(count(*) as integer) as n, string_agg(name, '|' order by pos) as names from firsts group by doc""",
    "q_tracks": f"""with {_mapped()}
select 'd' || doc as doc_id, cast(elem_pos as integer) as way_pos, id, 'way ' || id as name, railway, 'none' as service, cast(n as integer) as n_nodes,
  cast(case when id % 3 <> 0 then n else 0 end as integer) as n_points,
  case when id % 3 <> 0 then round((select arg_max(lng, ts) from track_events e where e.line_id = ways.id), 3) end as last_lng
from ways where n >= 2""",
    "q_rail_tracks": f"""with {_mapped('way')}
select 'd' || doc as doc_id, cast(elem_pos as integer) as way_pos, id, railway, cast(n as integer) as n_points from ways
where n >= 2 and id % 3 <> 0 and railway in ('subway', 'light_rail', 'rail')
  and exists (select 1 from track_events e where e.line_id = ways.id and lat between {BOX[0]} and {BOX[2]} and lng between {BOX[1]} and {BOX[3]})""",
    "q_track_count": f"""with {_mapped()}
select 'd' || d.doc as doc_id, count(w.id) as tracks from (select distinct doc from placed) d
left join ways w on w.doc = d.doc and n >= 2 and w.id % 3 <> 0 group by d.doc""",
    "q_metro_stations": f"""with {_mapped()}
select 'd' || doc as doc_id, cast(elem_pos as integer) as cand_pos, name, round(lat, 3) as lat, round(lng, 3) as lng from nodes where name <> '' and rail and (metro or yes)""",
    "q_relations_named": f"""with {_mapped()}
select 'd' || doc as doc_id, cast(elem_pos as integer) as elem_pos, id, name, '1' as asked from relations where route = 'subway' and name ilike '%line 1%'
union all select 'd' || doc, cast(elem_pos as integer), id, name, '3' from relations where route in ('subway', 'light_rail', 'railway') and contains(name, 'Line 3')""",
    "q_simple_line": f"""with {_mapped()},
  last_ as (select doc, title from titled where route = 'subway' qualify row_number() over (partition by doc order by elem_pos desc) = 1),
  counted as (select doc, count(*) as n_stations, count(name) as n_named, cast(sum(elem_pos) as bigint) as pos_sum from nodes where rail or metro group by doc)
select 'd' || l.doc as doc_id, title as name, n_stations, n_named, pos_sum from last_ l join counted c on c.doc = l.doc""",
    "q_grouped_lines": f"""with {_mapped()},
  keyed as (select *, case when ref <> '' then ref else title end as line_key from titled where route = 'subway'),
  grouped as (
    select doc, line_key, arg_max(struct_pack(title := title, ref := ref), elem_pos) as last_, count(*) as relations, min(elem_pos) as first_pos
    from keyed where line_key is not null group by doc, line_key),
  attached as (
    select g.doc, line_key, n.elem_pos from grouped g join nodes n on n.doc = g.doc and n.elem_pos > first_pos
    where (rail or metro) and lat between {BOX[0]} and {BOX[2]} and lng between {BOX[1]} and {BOX[3]}
    qualify row_number() over (partition by g.doc, line_key, n.name, lat, lng order by n.elem_pos) = 1),
  counted as (select doc, line_key, count(*) as n_stations, cast(sum(elem_pos) as bigint) as pos_sum from attached group by doc, line_key)
select 'd' || g.doc as doc_id, g.line_key, last_.title as name, last_.ref as ref, relations, cast(first_pos as integer) as first_pos, 2 as directions, n_stations, pos_sum
from grouped g join counted c on c.doc = g.doc and c.line_key = g.line_key""",
    "q_city_listing": f"""with {_mapped()},
  filled as (
    select doc, elem_pos, route, replace(split_part(name, ':', 1), ' ', '') as listed, ref, network, coalesce("from", '') as "from", coalesce("to", '') as "to"
    from relations where route in ('subway', 'light_rail', 'tram') and name <> ''),
  keyed as (select *, case when network <> '' and ref <> '' then ref else listed end as part from filled),
  found as (
    select doc, network, arg_min(ref, elem_pos) as ref, arg_min(listed, elem_pos) as name, arg_min(route, elem_pos) as route, arg_min("from", elem_pos) as "from",
      arg_min("to", elem_pos) as "to", min(elem_pos) as first_pos, greatest(count(distinct case when "from" <> '' or "to" <> '' then "from" || '|' || "to" end), 1) as directions
    from keyed group by doc, network, part)
select 'd' || doc as doc_id, network || '_' || case when ref <> '' then ref else name end as line_id, ref, name, network, route, "from", "to", directions, cast(first_pos as integer) as first_pos,
  row_number() over (partition by doc order by case when regexp_matches(ref, '^[0-9]+$') then 0 else 1 end, try_cast(ref as bigint), ref, first_pos) as place
from found""",
    "q_line_documents": f"""with {_PARSED},
  firsts as (select * from stops qualify row_number() over (partition by doc, name order by pos) = 1),
  feats as (
    select doc, -1 as pos, 'LineString' as kind, null as name, count(*) as n from points group by doc
    union all select doc, pos, 'Point', name, 1 from firsts)
select 'd' || n.doc as doc_id, n.name as title, case when kind is not null then cast(row_number() over (partition by n.doc order by f.pos) - 1 as integer) end as pos, kind,
  case kind when 'Point' then f.name when 'LineString' then n.name end as name, case when kind = 'Point' then n.name end as line, cast(n as integer) as n_points
from named n left join feats f on f.doc = n.doc""",
    "q_track_counters": f"""with {EVENTS}, sizes as (select line_id, count(*) as n from track_events group by line_id)
select count(*) as tracks, count(case when n >= 2 then 1 end) as ways, cast(sum(case when n >= 2 then n else 0 end) as bigint) as raw_nodes,
  (select count(distinct k) from track_events e join sizes s on s.line_id = e.line_id and s.n >= 2) as nodes from sizes""",
    "q_filtered_edges": f"""with {EVENTS},
  paired as (
    select line_id, ts, k as a, lng, lat, lead(k) over w as b, lead(lng) over w as l_lng, lead(lat) over w as l_lat
    from track_events where line_id % 3 = 1 and line_id % 2 = 1 window w as (partition by line_id order by ts, event_id)),
  steps as (select *, {STEP} as metres from paired where b is not null),
  both_ways as (select a as src, b as dst, line_id as way, metres, ts, 0 as back from steps union all select b, a, line_id, metres, ts, 1 from steps)
select src, dst, way, round(metres, 2) as distance from both_ways qualify row_number() over (partition by src, dst, way order by ts, back) = 1""",
    "q_degree_distance": f"""with {EVENTS},
  moved as (select *, lag(lng) over w as l_lng, lag(lat) over w as l_lat from track_events window w as (partition by line_id order by ts)),
  steps as (select *, coalesce(sqrt((l_lng - lng) * (l_lng - lng) + (l_lat - lat) * (l_lat - lat)), 0e0) as step from moved)
select line_id, event_id, round(sum(step) over (partition by line_id order by ts rows unbounded preceding), 2) as distance from steps""",
    "q_geojson_read": f"""with {_FILES},
  numbered as (select *, row_number() over (partition by line_id order by event_id) - 1 as i from track_events)
select cast(line_id as varchar) as line_id, 'line' as what, cast(i as integer) as pos, round(lng, 6) as lng, round(lat, 6) as lat from numbered
union all
select cast(line_id as varchar), event_type, cast(max(i) + 2 as integer), round(arg_max(lng, i), 6), round(arg_max(lat, i), 6) from numbered group by line_id, event_type
union all select cast(line_id as varchar), name, cast(pos as integer), round(lng, 6), round(lat, 6) from spots""",
    "q_export_track": f"""{_EXPORT}
select cast(line_id as varchar) as line_id, i, round(lng, 8) as lng, round(lat, 8) as lat from v_3""",
    "q_export_table": f"""{_EXPORT}
select '13号线#' || i as label, round(lng, 8) as lng, round(lat, 8) as lat from v_3""",
    "q_station_scores": """with pairs as (
    select x.p_partkey as key, x.p_brand as a, case when y.p_partkey % 5 < 3 then substr(y.p_brand, 1, 7) else y.p_brand end as b
    from part x join part y on y.p_partkey = x.p_partkey + 1)
select key, case when a = b then 100 when contains(a, b) or contains(b, a) then 80 else 0 end as score from pairs""",
    "q_places": """with known as (
    select case n_nationkey % 3 when 0 then n_name when 1 then n_name || '市' else n_name || ' 中国' end as asked, n_nationkey / 2e0 as lat, (n_nationkey + 100) / 2e0 as lng,
      (n_nationkey + 1) / 2e0 as north, case when n_nationkey % 5 <> 4 then (n_nationkey + 2) / 2e0 end as west
    from nation where n_nationkey % 7 <> 6 and n_nationkey % 8 <> 7),
  tries as (
    select n_name || '站' as wanted, 0 as city, unnest([n_name || '站', n_name, n_name || '站 中国']) as asked, unnest([0, 1, 2]) as try from nation
    union all select n_name, 1, unnest([n_name, n_name || '市', n_name || ' 中国']), unnest([0, 1, 2]) from nation)
select wanted, known.asked as name, lat, lng, case when city = 1 then north end as north, case when city = 1 then west end as west
from tries join known on known.asked = tries.asked where city = 0 or west is not null qualify row_number() over (partition by wanted, city order by try) = 1""",
    "q_roster": f"""select cast(c_nationkey as varchar) as city, c_mktsegment as line, cast(row_number() over (partition by c_nationkey, c_mktsegment order by c_custkey) as integer) as sequence, c_name as station,
  case when c_acctbal < 0 then round({sql_lat("c_custkey")}, 3) end as lat, case when c_acctbal < 0 then round({sql_lng("c_custkey")}, 3) end as lng from customer""",
}
