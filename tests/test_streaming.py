from __future__ import annotations

import json

from pyspark.sql import functions as F

from trackweave.operators import lines
from trackweave.streaming import arrivals


def test_distances_survive_batches(spark, tmp_path):
    schema = "line_id string, pt_pos long, lng double, lat double"
    rows = [(f"l{i % 2}", i, 116.8 + i / 100, 38.8 + (i % 5) / 100) for i in range(40)]
    folder = str(tmp_path / "points")
    query = None
    for k in range(3):
        spark.createDataFrame(rows[k * 15 : (k + 1) * 15] + rows[:2], schema).coalesce(1).write.mode("append").parquet(folder)
        if query is None:
            stream = arrivals.stamped_stream(spark.readStream.schema(schema).parquet(folder))
            query = stream.writeStream.format("memory").queryName("stamped").outputMode("append").start()
        query.processAllAvailable()
    query.stop()
    got = {(r.line_id, r.pt_pos): r.distance for r in spark.table("stamped").collect()}
    wanted = lines.stamped(spark.createDataFrame(rows, schema)).select("line_id", "pt_pos", F.col("distance")).collect()
    assert len(got) == len(rows)
    for r in wanted:
        assert abs(got[r.line_id, r.pt_pos] - r.distance) < 0.02


def test_stations_come_once(spark, tmp_path):
    for k, name in enumerate(("A", "A", "B")):
        (tmp_path / f"{k}.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": name}}]}))
    query = arrivals.station_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("stations").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.name for r in spark.table("stations").collect()) == ["A", "B"]
