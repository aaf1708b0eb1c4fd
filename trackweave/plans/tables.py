"""What the registered queries share: the test tables as points and tracks, and the same in SQL.

The tables hold no map data, so ids become pseudo-coordinates and ``events`` become tracks: a user is a
way, its events in time are the way's nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.functions import geo
from trackweave.operators import filters

BOX = (38.9, 116.9, 39.2, 117.3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lng(i: str) -> Column:
    return F.lit(116.8) + F.pmod(F.col(i) * 7919, F.lit(1000)).cast("double") / F.lit(1000.0)


def lat(i: str) -> Column:
    return F.lit(38.8) + F.pmod(F.col(i) * 104729, F.lit(600)).cast("double") / F.lit(1000.0)


def sql_lng(i: str) -> str:
    return f"(116.8e0 + cast(({i} * 7919) % 1000 as double) / 1000e0)"


def sql_lat(i: str) -> str:
    return f"(38.8e0 + cast(({i} * 104729) % 600 as double) / 1000e0)"


def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_id, ts, event_id, k, lng, lat, event_type of every event."""
    rows = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return rows.select(F.col("user_id").alias("line_id"), "ts", "event_id", "k", "event_type", lng("k").alias("lng"), lat("k").alias("lat"))


EVENTS = f"""events_k as (
    select user_id as line_id, ts, event_id, event_type, cast(json_extract(props, '$.k') as bigint) as k from events),
  track_events as (select *, {sql_lng("k")} as lng, {sql_lat("k")} as lat from events_k)"""


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tracks: one way a user."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "k", "lng", "lat")))
    ways = track_events(spark, sf_dir).groupBy("line_id").agg(ordered.alias("p"), F.min("event_type").alias("kind"))
    shaped = ways.select(
        F.lit("map").alias("graph_id"), F.col("line_id").alias("way_pos"), F.col("line_id").alias("id"),
        F.transform("p", lambda x: x["k"]).alias("nodes"), F.transform("p", lambda x: F.struct(x["lng"].alias("lng"), x["lat"].alias("lat"))).alias("geometry"),
        F.create_map(F.lit("railway"), F.col("kind"), F.lit("name"), F.concat(F.lit("way "), F.col("line_id").cast("string"))).alias("tags"),
    )
    return filters.with_track_tags(shaped)


def sampled_line(spark, sf_dir) -> DataFrame:
    return track_events(spark, sf_dir).withColumn("pt_pos", F.col("event_id"))


# -- the same in SQL

STEP = f"sqrt(pow({geo.RADIUS} * radians(lng) - {geo.RADIUS} * radians(l_lng), 2) + pow({geo.RADIUS} * ln(tan(pi() / 4 + radians(lat) / 2)) - {geo.RADIUS} * ln(tan(pi() / 4 + radians(l_lat) / 2)), 2))"


def staged(stages: list[dict[str, str]], source: str, name: str) -> str:
    parts, last = [], source
    for i, stage in enumerate(stages):
        columns = ", ".join(f"{e} as {c}" for c, e in stage.items())
        parts.append(f"{name}{i} as (select *, {columns} from {last})")
        last = f"{name}{i}"
    return ",\n  ".join(parts)
