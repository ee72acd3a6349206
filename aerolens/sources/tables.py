"""Scans of telemetry, detections, tracks, signatures, manifests, lines and page assets."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..functions.scalars import number
from ..functions.text import asset_paths


def _tsv(spark: SparkSession, path: str, schema: StructType, header: bool, **options) -> DataFrame:
    text = StructType([StructField(f.name, StringType()) for f in schema.fields])
    if header:  # by name: columns may come in any order, and more may follow
        return spark.read.csv(path, sep="\t", header=True, **options)
    return spark.read.csv(path, sep="\t", header=False, schema=text, **options)


def telemetry(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Telemetry of all sidecars under path, with their video. Empty cells are null; a row with a cell that is no number goes."""
    raw = _tsv(spark, path, schemas.TELEMETRY, True).withColumn("video", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.gps)?\.tsv$", 1))
    names = [n for n in (columns or schemas.TELEMETRY.fieldNames()) if n in raw.columns]
    bad = F.lit(False)
    for n in names:
        bad = bad | (F.col(n).isNotNull() & (F.trim(n) != "") & number(F.col(n)).isNull())
    return raw.where(~bad).select("video", *[number(F.col(n)).alias(n) for n in names])


def detections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=False, schema=schemas.DETECTION)


def tracks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, schema=schemas.TRACK, enforceSchema=False)


def candidates(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """('tracks' or 'detections', rows with ord, their order in the file), told by the first line."""
    first = spark.read.text(path).limit(1).collect()
    kind = "tracks" if first and first[0][0].startswith("track\t") else "detections"
    return kind, _ordinal((tracks if kind == "tracks" else detections)(spark, path))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, sep="\t", header=True, schema=schemas.COVERAGE, enforceSchema=False)
    return df.withColumn("video", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.coverage)?\.tsv$", 1))


def signatures(spark: SparkSession, path: str) -> DataFrame:
    """A table with a preamble of comment lines. An empty one is an error."""
    df = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
    if df.isEmpty():
        raise ValueError(f"no signature in {path}")
    return df


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=False, schema=schemas.MANIFEST).where("path is not null and path <> ''")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths and lengths of all files below path; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "length")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(video, time_s, lat, lon, alt_m) of all sidecars under path that have a place; no rows if there is no sidecar."""
    try:
        rows = telemetry(spark, path, ["time_s", "lat", "lon", "alt_m"])
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], "video string, time_s double, lat double, lon double, alt_m double")
    return rows.where("lat is not null and lon is not null")


def sidecars(files: DataFrame, tasks: DataFrame, token: str, path: str = "path") -> DataFrame:
    """tasks with the path of the first sidecar, by name, of a video that begins with DJI_ and the task's token; null if there is none.

    Tokens are prefixes of few different lengths, so files meet them by equality.
    """
    lengths = [r[0] for r in tasks.select(F.length(token)).distinct().collect() if r[0]]
    name = F.regexp_extract(F.col(path), r"DJI_([^/]*)\.MP4\.gps\.tsv$", 1)
    cut = F.explode(F.array(*[F.left(name, F.lit(n)) for n in lengths], F.lit(None).cast("string")))
    first = files.where(name != "").select(cut.alias(token), F.col(path).alias("p_")).groupBy(token).agg(F.min("p_").alias("path"))
    return tasks.join(first, token, "left")


def on_days(files: DataFrame, days: list[str], name: str = "name") -> DataFrame:
    """Files whose names carry one of the days yyyymmdd after their first four letters."""
    return files.where(F.substring(F.col(name), 5, 8).isin(days))


def _ordinal(df: DataFrame) -> DataFrame:
    """df with ord: rows of one file in the order in which they stand there."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def gpx_points(spark: SparkSession, path: str, tag: str = "trkpt") -> DataFrame:
    """(ord, lat, lon, name): points of a track in its order, or named way points."""
    df = spark.read.format("xml").option("rowTag", tag).schema("_lat double, _lon double, name string").load(path)
    return _ordinal(df.select(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "name"))


def kml_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, line): lines and outer rings of polygons of two points or more; of one name, the last."""
    ring = "struct<LinearRing: struct<coordinates: string>>"
    schema = f"name string, LineString struct<coordinates: string>, Polygon struct<outerBoundaryIs: {ring}>"
    df = _ordinal(spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path))
    text = F.coalesce("LineString.coordinates", "Polygon.outerBoundaryIs.LinearRing.coordinates")
    points = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    at = lambda p, i: F.get(F.split(p, ","), F.lit(i)).cast("double")
    line = F.transform(points, lambda p: F.struct(at(p, 1).alias("lat"), at(p, 0).alias("lon")))
    rows = df.select(F.coalesce("name", F.lit("")).alias("name"), line.alias("line"), "ord").where("size(line) > 1")
    return rows.groupBy("name").agg(F.max_by("line", "ord").alias("line"))


def scales(rows: DataFrame) -> DataFrame:
    """(video, t, obj8px_cm) of coverage rows; null unless the status is ok."""
    return rows.select("video", "t", F.when(F.col("status") == "ok", F.col("obj8px_cm")).alias("obj8px_cm"))


def polygon(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.from_json("value", "array<array<double>>").alias("ring"))


def page_assets(pages: DataFrame, key: str, html: str) -> DataFrame:
    return pages.select(key, F.explode(asset_paths(F.col(html))).alias("asset"))
