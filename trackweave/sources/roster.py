"""Static tables: station rosters in operating order, and coordinates that override the map's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave import schema

# Cities with their network, and their lines with ref, kind and stations in order.
CITIES = {
    "天津": {"id": "CN_TJ", "network": ("TJ_METRO", "天津轨道交通")},
    "大连": {"id": "CN_DL", "network": ("DL_METRO", "大连地铁")},
    "北京": {"id": "CN_BJ", "network": ("BJ_METRO", "北京地铁")},
}
LINES = {
    ("天津", "3号线"): {
        "id": "TJ_LINE_3", "name": "天津地铁3号线", "ref": "3", "type": "subway", "loop": False,
        "stations": ["南站", "杨伍庄", "学府工业区", "高新区", "大学城", "华苑", "王顶堤", "红旗南路", "周邓纪念馆", "天塔", "吴家窑", "西康路", "营口道", "和平路", "津湾广场", "天津站", "金狮桥", "中山路", "北站", "铁东路", "张兴庄", "小淀"],
    },
    ("大连", "13号线"): {
        "id": "DL_LINE_13", "name": "大连地铁13号线", "ref": "13", "type": "subway", "loop": False,
        "stations": ["九里", "十三里", "二十里堡", "三十里堡", "石河黄旗", "普湾体育场", "石河北海", "长店堡", "大医三院", "海湾高中", "普兰店开发区", "普兰店振兴街"],
    },
    ("北京", "2号线"): {
        "id": "BJ_LINE_2", "name": "北京地铁2号线", "ref": "2", "type": "subway", "loop": True,
        "stations": ["西直门", "车公庄", "阜成门", "复兴门", "长椿街", "宣武门", "和平门", "前门", "崇文门", "北京站", "建国门", "朝阳门", "东四十条", "东直门", "雍和宫", "安定门", "鼓楼大街", "积水潭"],
    },
}
OVERRIDES = [("天津", "3号线", "张兴庄", 39.1675, 117.1989)]


def roster(spark: SparkSession, lines: dict | None = None) -> DataFrame:
    """city, line, sequence (from 1) and station of every line."""
    rows = [(city, line, i, s) for (city, line), own in (LINES if lines is None else lines).items() for i, s in enumerate(own["stations"], 1)]
    return spark.createDataFrame(rows, schema.ROSTER)


def of_lists(lines: DataFrame) -> DataFrame:
    """As :func:`roster`, of a table of lines (city, line, stations)."""
    rows = lines.select("city", "line", F.posexplode("stations").alias("at", "station"))
    return rows.select("city", "line", (F.col("at") + 1).alias("sequence"), "station")


def located(stations: DataFrame, known: DataFrame) -> DataFrame:
    """Roster rows with the coordinates that override the map's, null where none do."""
    return stations.join(known.select("city", "line", "station", "lat", "lng"), ["city", "line", "station"], "left").select("city", "line", "sequence", "station", "lat", "lng")


def station_list(spark: SparkSession, city: str, line: str) -> DataFrame:
    """The stations of one line in order; none for an unknown line."""
    return roster(spark).filter((F.col("city") == city) & (F.col("line") == line)).orderBy("sequence")


def overrides(spark: SparkSession, rows: list | None = None) -> DataFrame:
    return spark.createDataFrame(OVERRIDES if rows is None else rows, schema.OVERRIDE)


def override_of(city: str, line: str, station: str) -> dict | None:
    """The overriding coordinates of one station, or None."""
    return next(({"lat": lat, "lng": lng} for c, n, s, lat, lng in OVERRIDES if (c, n, s) == (city, line, station)), None)


def city(name: str) -> dict | None:
    return CITIES.get(name)


def line(city_name: str, line_name: str) -> dict | None:
    return LINES.get((city_name, line_name))


def read_lines(path: str) -> dict:
    """Lines of a YAML file of the form cities -> lines -> stations; needs PyYAML."""
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f) or {}
    return {(c, n): {**own, "stations": own.get("stations") or []} for c, about in (data.get("cities") or {}).items() for n, own in (about.get("lines") or {}).items()}
