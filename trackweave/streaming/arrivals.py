"""Responses and track points that arrive over time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackweave.functions.geo import RADIUS
from trackweave.sources import elements as el


def element_stream(spark: SparkSession, path: str) -> DataFrame:
    """The elements of response files as they appear in a folder."""
    return el.elements(spark.readStream.text(path, wholetext=True))


def station_stream(spark: SparkSession, path: str) -> DataFrame:
    """Named nodes of arriving responses; a name and place once a document, whatever is sent again."""
    return el.stations(element_stream(spark, path)).dropDuplicates(["doc_id", "name", "lat", "lng"])


def stamped_stream(points: DataFrame) -> DataFrame:
    """line_id, pt_pos, distance of arriving track points (line_id string, pt_pos long, lng, lat doubles).

    The state of a line is its last point and the metres to it, however many points have come. A line's
    points are taken by position within a batch; one whose position was passed already goes.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("pt_pos", kind="stable").drop_duplicates("pt_pos")
        last, x, y, total = state.get if state.exists else (None, 0.0, 0.0, 0.0)
        if last is not None:
            rows = rows[rows["pt_pos"] > last]
        if not len(rows):
            return
        xs = RADIUS * np.radians(rows["lng"].to_numpy(float))
        ys = RADIUS * np.log(np.tan(np.pi / 4 + np.radians(rows["lat"].to_numpy(float)) / 2))
        start = (xs[0], ys[0]) if last is None else (x, y)
        steps = np.hypot(np.diff(xs, prepend=start[0]), np.diff(ys, prepend=start[1]))
        sums = total + np.cumsum(steps)
        state.update((int(rows["pt_pos"].iloc[-1]), float(xs[-1]), float(ys[-1]), float(sums[-1])))
        yield pd.DataFrame({"line_id": key[0], "pt_pos": rows["pt_pos"].to_numpy(), "distance": np.round(sums, 2)})

    return points.groupBy("line_id").applyInPandasWithState(run, "line_id string, pt_pos long, distance double", "last long, x double, y double, total double", "append", GroupStateTimeout.NoTimeout)
