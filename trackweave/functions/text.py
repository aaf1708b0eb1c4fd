"""Name normalisation and scoring as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that station names lose, the ending that goes once, and the line that two refs stand for.
STATION_WORDS = ("地铁", "轨道交通", "车站", "站点")
STATION_END = "站"
METRO_SPACED, METRO = "地铁 ", "地铁"
LINE_ONE_REFS, LINE_ONE = ("1", "1E"), "北京地铁1号线/八通线"
CITY_END, COUNTRY_END = "市", " 中国"
WIDE_DIGITS = "０１２３４５６７８９"

MATCH, PART_MATCH, NO_MATCH = 100, 80, 0


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def falsy(c: Column) -> Column:
    return F.coalesce(c == "", F.lit(True))


def list_name(c: Column) -> Column:
    """A line's name for listing: up to the first colon of either width, without blanks; null gives ''."""
    cut = F.substring_index(strip(F.replace(F.coalesce(c, F.lit("")), F.lit("："), F.lit(":"))), ":", 1)
    return strip(F.replace(cut, F.lit(" "), F.lit("")))


def line_name(name: Column, ref: Column, line_one_rule: bool = True) -> Column:
    """A line's display name; null for none. Refs 1 and 1E stand for one named line unless switched off."""
    plain = strip(F.replace(name, F.lit(METRO_SPACED), F.lit(METRO)))
    if line_one_rule:
        plain = F.when(ref.isin(*LINE_ONE_REFS), F.lit(LINE_ONE)).otherwise(plain)
    return F.when(falsy(name), F.lit(None).cast("string")).otherwise(plain)


def station_name(c: Column) -> Column:
    """A station's name for matching."""
    for word in STATION_WORDS:
        c = F.replace(c, F.lit(word), F.lit(""))
    return F.regexp_replace(strip(c), STATION_END + "$", "")


def score_normalised(a: Column, b: Column) -> Column:
    """Score of two names that are normalised already."""
    return (
        F.when(falsy(a) | falsy(b), F.lit(NO_MATCH))
        .when(a == b, F.lit(MATCH))
        .when(a.contains(b) | b.contains(a), F.lit(PART_MATCH))
        .otherwise(F.lit(NO_MATCH))
    )


def station_score(a: Column, b: Column) -> Column:
    """100 for equal names, 80 where one holds the other, else 0."""
    return score_normalised(station_name(a), station_name(b))


def line_key(network: Column, ref: Column, name: Column) -> Column:
    """What makes two relations one line: network and ref where both are there, else network and name."""
    network, ref = F.coalesce(network, F.lit("")), F.coalesce(ref, F.lit(""))
    return F.struct(network.alias("network"), F.when((network != "") & (ref != ""), ref).otherwise(list_name(name)).alias("part"))


def whole_number(c: Column) -> Column:
    """The number that a text states: blanks around it, a sign, wide digits and single underscores are fine."""
    text = F.translate(strip(c), WIDE_DIGITS, "0123456789")
    return F.when(text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("decimal(38,0)"))


def place_candidates(c: Column) -> Column:
    """Names to look a place up by, in order."""
    return F.array(c, F.replace(c, F.lit(STATION_END), F.lit("")), F.concat(c, F.lit(COUNTRY_END)))


def city_candidates(c: Column) -> Column:
    return F.array(c, F.concat(c, F.lit(CITY_END)), F.concat(c, F.lit(COUNTRY_END)))
