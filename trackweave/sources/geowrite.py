"""GeoJSON documents written by tasks: one file a line, points as they stream by, all or none of a job.

Rows of a line come sorted to one task, which writes its file point by point, so a line is as long as its
file may be and nothing is collected. Files are staged under the job's own folder; what the job's
successful tasks have staged is moved into place at the end, and a failed job leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from trackweave.sources.jsonitems import opened

HEAD, POINT, STATION = 0, 1, 2
#: Pieces of text that are written together.
HELD = 10_000
COLUMNS = ("line_id", "part", "pos", "name", "label", "lng", "lat")


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: list[str]


class GeoJsonSink(DataSource):
    """``write.format("geojson").save(folder)`` of rows as :func:`rows_of` makes them."""

    @classmethod
    def name(cls) -> str:
        return "geojson"

    def writer(self, schema, overwrite: bool):
        return GeoJsonWriter(self.options["path"].rstrip("/"), schema.names)


class GeoJsonWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str]):
        if missing := set(COLUMNS) - set(columns):
            raise ValueError(f"columns are missing: {sorted(missing)}")
        self.path, self.job = path, f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        files, root = opened(self.path)
        own = f"{root}/{self.job}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
        files.create_dir(own)
        names, text = [], None
        current, what, first, name = object(), HEAD, True, None
        dumps = lambda x: json.dumps(x, ensure_ascii=False)

        held: list[str] = []

        def put(s: str) -> None:
            held.append(s)
            if len(held) >= HELD:
                flush()

        def flush() -> None:
            text.write("".join(held).encode())
            held.clear()

        def end() -> None:
            if text is not None:
                put(track_end() if what == POINT else "")
                put("]}")
                flush()
                text.close()

        track_end = lambda: f']}},"properties":{{"name":{dumps(name)}}}}}'
        try:
            for batch in batches:
                for line, part, label, called, lng, lat in zip(*(batch.column(c).to_pylist() for c in ("line_id", "part", "label", "name", "lng", "lat")), strict=True):
                    if line != current:
                        end()
                        current, what, first, name = line, HEAD, True, None
                        names.append(quote("" if line is None else str(line), safe="") + ".geojson")
                        text = files.open_output_stream(f"{own}/{names[-1]}")
                        put('{"type":"FeatureCollection","features":[')
                    if part == HEAD:
                        name = called
                    elif part == POINT:
                        put("," if what == POINT else '{"type":"Feature","geometry":{"type":"LineString","coordinates":[')
                        put(dumps([lng, lat]))
                        what, first = POINT, False
                    else:
                        put(track_end() if what == POINT else "")
                        what = STATION
                        put(("" if first else ",") + dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [lng, lat]}, "properties": {"name": label, "line": name}}))
                        first = False
            end()
        finally:
            if text is not None and not text.closed:
                text.close()
        return Staged(own, names)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = opened(self.path)
        for message in messages:
            for name in message.files if message else ():
                files.move(f"{message.folder}/{name}", f"{root}/{name}")
        files.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[Staged | None]) -> None:
        from pyarrow import fs

        files, root = opened(self.path)
        if files.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.job}")


def rows_of(lines: DataFrame, stations: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """Lines (line_id, name), stations (line_id, pos, name, lng, lat) and points (line_id, pt_pos, lng, lat) as
    the rows of their documents."""
    text, number = (lambda: F.lit(None).cast("string")), (lambda: F.lit(None).cast("double"))
    shaped = lambda df, part, pos, name, label, lng, lat: df.select(F.col("line_id").cast("string").alias("line_id"), F.lit(part).alias("part"), pos.cast("long").alias("pos"), name.alias("name"), label.alias("label"), lng.alias("lng"), lat.alias("lat"))
    made = shaped(lines, HEAD, F.lit(0), F.col("name"), text(), number(), number())
    made = made.unionByName(shaped(stations, STATION, F.col("pos"), text(), F.col("name"), F.col("lng"), F.col("lat")))
    return made if points is None else made.unionByName(shaped(points, POINT, F.col("pt_pos"), text(), text(), F.col("lng"), F.col("lat")))


def write(lines: DataFrame, stations: DataFrame, path: str, points: DataFrame | None = None) -> None:
    """One GeoJSON file a line in the folder, named by the line's id (percent-encoded)."""
    rows = rows_of(lines, stations, points)
    rows.sparkSession.dataSource.register(GeoJsonSink)
    dealt = rows.repartition("line_id").sortWithinPartitions("line_id", "part", "pos")
    dealt.write.format("geojson").mode("append").save(path)
