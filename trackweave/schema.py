"""Schemas of raw map elements and of the tables that the operators hand to each other.

Every table is keyed by the document or line it belongs to and carries an explicit position, since
first-wins and last-wins rules need an order that rows don't have.
"""

from __future__ import annotations

from pyspark.sql import types as T

POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
LNGLAT = T.StructType([T.StructField("lng", T.DoubleType()), T.StructField("lat", T.DoubleType())])
MEMBER = T.StructType([T.StructField("type", T.StringType()), T.StructField("ref", T.LongType()), T.StructField("role", T.StringType())])
ELEMENT = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("nodes", T.ArrayType(T.LongType())),
        T.StructField("geometry", T.ArrayType(POINT)),
        T.StructField("members", T.ArrayType(MEMBER)),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    ]
)
RESPONSE = T.StructType([T.StructField("elements", T.ArrayType(ELEMENT))])
PLACE = "name string, lat double, lng double, south double, north double, west double, east double"
ROSTER = "city string, line string, sequence int, station string"
OVERRIDE = "city string, line string, station string, lat double, lng double"
