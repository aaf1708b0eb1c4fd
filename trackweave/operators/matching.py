"""Official station names matched to map stations: the best-scoring candidate, the first of equals.

"First" is the order of elements: by document, then by place in it. The winner is carried through the
aggregation with all it has, so equal places in two documents can't be mixed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackweave.functions import text

THRESHOLD = 60


def candidate_name(*columns: str) -> Column:
    """The first of the columns that isn't null or empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in columns))


def parts_of(name: Column, sizes: list[int]) -> Column:
    """The distinct parts of a name that have one of the given lengths and aren't all of it."""
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda i: F.substr(name, i, n))
    fitting = F.filter(F.array(*(F.lit(n) for n in sizes)).cast("array<int>"), lambda n: n < F.length(name))
    return F.array_distinct(F.flatten(F.transform(fitting, cut)))


def _sizes(names: DataFrame, column: str) -> list[int]:
    """The lengths that names have: no more than the longest name has letters."""
    return sorted(r[0] for r in names.select(F.length(column)).distinct().collect())


def best_matches(official: DataFrame, candidates: DataFrame, keys: list[str], scope: list[str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """Each row of ``official`` (keys, official_name) with its best of ``candidates`` (cand_name, cand_pos and
    what else they have; doc_id where they come from several documents).

    Names are normalised once a side and met as distinct names, by equal values only. Equal names score
    ``MATCH``. Names that hold one another are found in an index of parts: the parts of one side's names, of
    lengths that the other side has, are joined with the other side's names. Parts of candidates are
    grouped first, so one that many names hold leads to its best candidate alone. The work grows with the
    names' number and length, whatever holds what. A candidate may serve several rows. Columns are null
    where no candidate reaches the threshold.
    """
    scope = scope or []
    extra = [c for c in candidates.columns if c not in scope]
    order = F.struct(*(F.col(c) for c in ("doc_id", "cand_pos") if c in extra))
    left = official.withColumn("_a", text.station_name(F.col("official_name")))
    right = candidates.withColumn("_b", text.station_name(F.col("cand_name"))).filter("_b <> ''")
    named = right.groupBy(*scope, "_b").agg(F.min(order).alias("_order"), F.min_by(F.struct(*extra), order).alias("_won"))
    names = left.select(*scope, "_a").distinct().filter("_a <> ''")

    first = [F.min("_order").alias("_order"), F.min_by("_won", "_order").alias("_won")]
    own_parts = names.select(*scope, "_a", F.explode(parts_of(F.col("_a"), _sizes(named, "_b"))).alias("_part"))
    held_parts = named.select(*scope, F.explode(parts_of(F.col("_b"), _sizes(names, "_a"))).alias("_part"), "_order", "_won").groupBy(*scope, "_part").agg(*first)
    met = [
        (names.join(named.withColumnRenamed("_b", "_a"), [*scope, "_a"]), text.MATCH),
        (own_parts.join(named.withColumnRenamed("_b", "_part"), [*scope, "_part"]), text.PART_MATCH),
        (names.join(held_parts.withColumnRenamed("_part", "_a"), [*scope, "_a"]), text.PART_MATCH),
    ]
    found = [rows.select(*scope, "_a", F.lit(score).alias("score"), "_order", "_won") for rows, score in met if score >= threshold]
    if not found:
        found = [met[0][0].filter("false").select(*scope, "_a", F.lit(text.MATCH).alias("score"), "_order", "_won")]
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    best = every.groupBy(*scope, "_a").agg(F.min_by(F.struct("score", "_won"), F.struct((-F.col("score")).alias("less"), "_order")).alias("_best"))
    chosen = best.select(*scope, "_a", F.col("_best.score").alias("score"), *(F.col(f"_best._won.{c}").alias(c) for c in extra))
    return left.join(chosen, [*scope, "_a"], "left").drop("_a")


def line_stations(roster: DataFrame, stations: DataFrame) -> DataFrame:
    """Roster rows (city, line, sequence, station) with the map station that matches; unmatched ones go.

    stations: name, cand_pos, lat, lng, and doc_id where there are several documents.
    """
    own = [c for c in ("doc_id", "cand_pos", "lat", "lng") if c in stations.columns]
    found = best_matches(roster.withColumn("official_name", F.col("station")), stations.select(F.col("name").alias("cand_name"), *own), ["city", "line", "sequence"])
    return found.filter("cand_name IS NOT NULL").select("city", "line", "sequence", "official_name", F.col("cand_name").alias("osm_name"), "lat", "lng", "score")


def unmatched(roster: DataFrame, matched: DataFrame) -> DataFrame:
    return roster.join(matched, ["city", "line", "sequence"], "left_anti")


def route_stations(roster: DataFrame, stations: DataFrame, overrides: DataFrame, strict: bool = False) -> DataFrame:
    """The stations of a route with coordinates: sequence, name, lat, lng, and where they come from.

    Names are matched twice, the second time among the first pass's finds of the same line only, so a
    name that failed may still take a neighbour's station that holds it; ``strict`` keeps the first pass.
    What stays unmatched takes its override; without one it goes, leaving a gap in the sequence.
    """
    first = line_stations(roster, stations)
    if strict:
        found = roster.join(first.select("city", "line", "sequence", "lat", "lng"), ["city", "line", "sequence"], "left").withColumn("official_name", F.col("station"))
    else:
        again = first.select("city", "line", F.col("osm_name").alias("cand_name"), F.col("sequence").alias("cand_pos"), "lat", "lng")
        found = best_matches(roster.withColumn("official_name", F.col("station")), again, ["city", "line", "sequence"], scope=["city", "line"])
    fallback = overrides.select("city", "line", "station", F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"))
    rows = found.join(fallback, ["city", "line", "station"], "left")
    origin = F.when(F.col("lat").isNotNull(), "map").when(F.col("o_lat").isNotNull(), "override")
    return rows.select("city", "line", "sequence", F.col("station").alias("name"), F.coalesce("lat", "o_lat").alias("lat"), F.coalesce("lng", "o_lng").alias("lng"), origin.alias("origin")).filter("lat IS NOT NULL")
