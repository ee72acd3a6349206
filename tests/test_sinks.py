"""Sinks with their schemas, map documents, exports, and labels in a viewport."""

import datetime
import json

import numpy as np
from pyspark.sql import functions as F

from aerolens import schemas
from aerolens.operators import frames, levels, raster
from aerolens.sources import sinks


def _row(kind, k):
    value = {"double": k + 0.5, "int": k, "bigint": k, "string": f"s{k}"}
    return tuple(None if (i + k) % 5 == 0 else value[f.dataType.simpleString()] for i, f in enumerate(kind.fields))


def test_tables_come_back_in_their_schemas(spark, tmp_path):
    for name, kind in (("cells", schemas.CELL), ("projection", schemas.PROJECTION), ("trials", schemas.TRIAL)):
        rows = [_row(kind, k) for k in range(7)]
        sinks.write_tsv(spark.createDataFrame(rows, kind).coalesce(1), str(tmp_path / name))
        got = spark.read.schema(kind).option("sep", "\t").option("header", True).csv(str(tmp_path / name))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows))
        assert next((tmp_path / name).glob("*.csv")).read_text().splitlines()[0] == "\t".join(kind.names)


def test_coverage_by_video(spark, tmp_path):
    kind = schemas.struct(video=schemas.S, **{f.name: f.dataType for f in schemas.COVERAGE.fields})
    rows = [(v, float(t), 1200.0, 80.0, 6.7, 53.6, "ok") if t else (v, 0.0, None, None, None, None, "no_focal") for v in ("A.MP4", "B.MP4") for t in range(3)]
    sinks.write_tsv(spark.createDataFrame(rows, kind), str(tmp_path / "coverage"), partition="video")
    assert {p.name for p in (tmp_path / "coverage").iterdir() if p.is_dir()} == {"video=A.MP4", "video=B.MP4"}
    got = spark.read.option("sep", "\t").option("header", True).schema(kind).csv(str(tmp_path / "coverage"))
    assert sorted(map(repr, map(tuple, got.select(*kind.names).collect()))) == sorted(map(repr, rows))


def test_map_document_has_all_groups(spark):
    points = spark.createDataFrame([("b", 1.5, ["x"]), ("a", None, [])], "name string, lat double, imgs array<string>")
    camps = spark.createDataFrame([], "name string, alt int")
    (row,) = sinks.map_document({"points": points, "camps": camps}, kinds=[{"id": "item", "title": "вещь"}], zone=[[1, 2.5], [3, 4]]).collect()
    assert json.loads(row["json"]) == {"kinds": [{"id": "item", "title": "вещь"}], "zone": [[1, 2.5], [3, 4]], "points": [{"name": "a", "lat": None, "imgs": []}, {"name": "b", "lat": 1.5, "imgs": ["x"]}], "camps": []}


def test_messages_as_text(spark):
    at = datetime.datetime(2026, 8, 11, 9, 5)
    rows = [("t", 1, at, "Ann", " hi \n", None, None), ("t", 2, at, None, None, "data/x.jpg", None), ("t", 3, at, "Bo", "gone", None, "pin")]
    got = sinks.message_lines(spark.createDataFrame(rows, "topic string, id long, ts timestamp_ntz, sender string, text string, media string, action string")).orderBy("id").collect()
    assert [r["line"] for r in got] == ["[2026-08-11 09:05] #1 Ann:\nhi\n", "[2026-08-11 09:05] #2 : [медиа: data/x.jpg]\n"]


def test_labels_only_where_they_are_seen(spark):
    line = [(40.0 + k / 1000, 73.0) for k in range(200)]
    df = spark.createDataFrame([(line, 15, True), (line, 14, True), ([(10.0, 10.0)], 15, False), (line[:50], 16, False)], "line array<struct<lat: double, lon: double>>, zoom int, minor boolean")
    seen = frames.in_view(40.0, 40.2, 72.9, 73.1)
    got = [[round(v["lat"], 3) for v in r[0]] for r in df.select(frames.label_places(F.col("line"), F.col("zoom"), F.col("minor"), seen)).collect()]
    inside = [round(a, 3) for a, _ in line if 40.01 <= a <= 40.19]
    assert got[0] == [inside[int(len(inside) * s)] for s in (1 / 6, 1 / 2, 5 / 6)] and got[1] == [] and got[2] == []
    assert got[3] == [inside[: len([a for a in inside if a < 40.05])][20]]


def test_ways_end_at_the_frame_and_lines_are_in_degrees(spark):
    y, x = np.mgrid[:60, :60]
    _, wx, wy = raster.Terrain(((x - 30.0) ** 2 + (y - 30.0) ** 2) * 1.0).descend(np.array([5.0]), np.array([30.0]), cell=10.0, frame=(0, 0, 15, 60))
    assert 3 < len(wx) and wx.max() < 15
    lines = spark.createDataFrame([(1.0, "a", 0, 2.0, 3.0)], "level double, line string, i int, x double, y double")
    assert tuple(levels.in_degrees(lines, 40.0, 73.0, 0.001, 0.002).first())[3:] == (39.997, 73.004)
