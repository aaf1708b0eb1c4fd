"""GeoJSON in and out, and the tabular track export."""

from __future__ import annotations

import json
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr
from zipfile import ZIP_DEFLATED, ZipFile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.operators.rows import keep_last
from trackweave.sources import jsonitems

FEATURE = "type string, geometry string, properties map<string,string>"
FEATURE_TYPE = "struct<type:string,geometry:string,properties:map<string,string>>"


def features(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, kind, name, line, coordinates (text) of every feature of the files."""
    return parsed_features(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def large_features(spark: SparkSession, path: str, size: int = jsonitems.RANGE) -> DataFrame:
    """As :func:`features`, of files that may be larger than a text: feature by feature, in byte ranges."""
    return _fields(jsonitems.read_items(spark, path, "features", size).select("file", "pos", F.from_json("value", FEATURE).alias("f")))


def parsed_features(texts: DataFrame) -> DataFrame:
    """As :func:`features`, of texts (file, value)."""
    rows = texts.select("file", F.from_json("value", f"features array<{FEATURE_TYPE}>").alias("doc")).select("file", F.posexplode("doc.features").alias("pos", "f"))
    return _fields(rows)


def _fields(rows: DataFrame) -> DataFrame:
    return rows.select("file", "pos", F.get_json_object("f.geometry", "$.type").alias("kind"), F.try_element_at("f.properties", F.lit("name")).alias("name"), F.try_element_at("f.properties", F.lit("line")).alias("line"), F.get_json_object("f.geometry", "$.coordinates").alias("coordinates"))


def line_points(feats: DataFrame) -> DataFrame:
    """line_id, pt_pos, lng, lat of each file's line; of several lines the last counts."""
    last = keep_last(feats.filter("kind = 'LineString'"), ["file"], ["pos"])
    points = last.select(F.col("file").alias("line_id"), F.posexplode(F.from_json("coordinates", "array<array<double>>")).alias("pt_pos", "p"))
    return points.select("line_id", "pt_pos", F.get("p", F.lit(0)).alias("lng"), F.get("p", F.lit(1)).alias("lat"))


def station_points(feats: DataFrame) -> DataFrame:
    """line_id, pos, name, lng, lat; of points of one name the last counts."""
    last = keep_last(feats.filter("kind = 'Point'"), ["file", "name"], ["pos"])
    xy = F.from_json("coordinates", "array<double>")
    return last.select(F.col("file").alias("line_id"), "pos", "name", F.get(xy, F.lit(0)).alias("lng"), F.get(xy, F.lit(1)).alias("lat"))


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")).alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"})


def collections(lines: DataFrame, stations: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """line_id, name, geojson of every line: one LineString feature if it has points, then its stations.

    lines: line_id, name; stations: line_id, pos, name, lng, lat; points: line_id, pt_pos, lng, lat. A line
    has its document, whatever it has of the others.
    """
    ordered = lambda pos, *cols: F.array_sort(F.collect_list(F.struct(pos, *cols)))
    own = lines.select("line_id", "name").join(stations.groupBy("line_id").agg(ordered("pos", "name", "lng", "lat").alias("stations")), "line_id", "left")
    if points is not None:
        own = own.join(points.groupBy("line_id").agg(ordered("pt_pos", "lng", "lat").alias("points")), "line_id", "left")
    else:
        own = own.withColumn("points", F.lit(None).cast("array<struct<pt_pos:int,lng:double,lat:double>>"))
    stops = F.transform("stations", lambda s: _feature("Point", F.array(s["lng"], s["lat"]), F.struct(s["name"].alias("name"), F.col("name").alias("line"))))
    track = _feature("LineString", F.transform("points", lambda p: F.array(p["lng"], p["lat"])), F.struct(F.col("name").alias("name")))
    shapes = F.when(F.size("points") > 0, F.array(track))
    none = F.array().cast("array<string>")
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.concat(F.coalesce(shapes, none), F.coalesce(stops, none)), ","), F.lit("]}"))
    return own.select("line_id", "name", body.alias("geojson"))


def save(text: str, path: str) -> str:
    """Writes one document, indented, making its folder."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(json.loads(text), ensure_ascii=False, indent=2), encoding="utf-8")
    return str(target)


def file_name(city: str, line: str) -> str:
    return f"data/{city}_{line}.geojson"


# The export's sheet, header and label.
SHEET, HEADER, LABEL = "{line}轨迹", ("名称", "经度", "纬度"), "{line}#"


def labelled(samples: DataFrame, line: str) -> DataFrame:
    """Samples (line_id, i, lng, lat) as rows of the export: label, longitude, latitude, in order."""
    name, lng, lat = HEADER
    return samples.orderBy("line_id", "i").select(F.concat(F.lit(LABEL.format(line=line)), F.col("i").cast("string")).alias(name), F.col("lng").alias(lng), F.col("lat").alias(lat))


#: Rows that a sheet can have, and what its name can't.
SHEET_ROWS, NOT_IN_NAMES = 1_048_576, "[]:*?/\\"


def save_table(rows: DataFrame, path: str, line: str) -> str:
    """One line's export, as a workbook where the name asks for it, else as CSV.

    The rows of one sheet come to the driver, as many as a sheet can have; more are an error in a workbook.
    """
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    if path.endswith(".xlsx"):
        table = rows.limit(SHEET_ROWS).toPandas()  # one more than fit below the header
        if len(table) == SHEET_ROWS:
            raise ValueError(f"a sheet has no more than {SHEET_ROWS} rows")
        _workbook(path, SHEET.format(line=line), [table.columns.tolist(), *table.itertuples(index=False)])
    else:
        rows.toPandas().to_csv(path, index=False)
    return path


def _workbook(path: str, title: str, rows: list) -> None:
    """One sheet of texts and numbers, its columns as wide as their longest value and three more."""
    title = "".join("_" if c in NOT_IN_NAMES else c for c in title)[:31]
    text = lambda v: "" if v is None or v != v else v if isinstance(v, str) else repr(float(v))
    widths = [3 + max(len(text(row[i])) for row in rows) for i in range(len(rows[0]))]

    def cell(v) -> str:
        if isinstance(v, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        return f"<c><v>{text(v)}</v></c>" if text(v) else "<c/>"

    main, office, head = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    package, kind = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
    link = lambda target, what: f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/{what}" Target="{target}"/></Relationships>'
    parts = {
        "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": link("xl/workbook.xml", "officeDocument"),
        "xl/workbook.xml": f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name={quoteattr(title)} sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": link("worksheets/sheet1.xml", "worksheet"),
    }
    with ZipFile(path, "w", ZIP_DEFLATED) as book:
        for name, body in parts.items():
            book.writestr(name, body)
        with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
            cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
            sheet.write(f'{head}<worksheet xmlns="{main}"><cols>{cols}</cols><sheetData>'.encode())
            for row in rows:
                sheet.write(f"<row>{''.join(map(cell, row))}</row>".encode())
            sheet.write(b"</sheetData></worksheet>")
