"""Whole flights: from telemetry to what was seen at what scale, to the cells of a polygon, and from pixels to placed tracks.

Telemetry is (video, t, lat, lon, alt, yaw, pitch) of the camera; terrain is a grid (iy, ix, z) whose corner (0, 0) lies at (lat0, lon0), with
dlat and dlon degrees from one place to the next, northern rows first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import written
from . import coverage, detect, raster, spatial, timeseries, tracking

#: Seconds around a sample whose focal estimates count, how many there must be, and the frame whose middle is looked at.
FOCAL_REACH, FOCAL_LEAST, FRAME = 20.0, 3, (1920, 1080)


@dataclass(frozen=True)
class Ground:
    """A terrain grid and where it lies."""

    grid: DataFrame
    lat0: float
    lon0: float
    dlat: float
    dlon: float

    def place(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """(x, y) in grid units."""
        return (lon - self.lon0) / self.dlon, (self.lat0 - lat) / self.dlat

    def lat_lon(self, x: Column, y: Column) -> tuple[Column, Column]:
        return self.lat0 - y * self.dlat, self.lon0 + x * self.dlon


def poses(telemetry: DataFrame, step: float, key: str = "video") -> DataFrame:
    """(video, i, t, lat, lon, alt, yaw, pitch) at regular times of each video; yaw is unwrapped before it is interpolated."""
    others = ["lat", "lon", "alt", "pitch"]
    rows = timeseries.unwrap_degrees(telemetry.where("yaw is not null"), [key], "t", "yaw", "turned").select(key, "t", F.col("turned").alias("yaw"), *others)
    rows = rows.unionByName(telemetry.where("yaw is null").select(key, "t", F.lit(None).cast("double").alias("yaw"), *others))
    return timeseries.interpolate_each(timeseries.resample(telemetry, [key], "t", step), rows, [key], "t", ["yaw", *others]).select(key, "i", "t", "yaw", *others)


def looks(at: DataFrame, ground: Ground, ident: list[str]) -> DataFrame:
    """Where the middle of the frame meets the ground: ident, hit_lat, hit_lon and dist_m of each pose, null if it meets none."""
    w, h = (F.lit(float(v)) for v in FRAME)
    d = scalars.ray(scalars.turn_full(F.col("yaw")), F.col("pitch"), w / 2, h / 2, w, h, F.lit(1000.0))  # the middle needs no focal length
    x, y = ground.place(F.col("lat"), F.col("lon"))
    east, north = 1 / (scalars.lon_metres(F.col("lat")) * ground.dlon), -1 / (scalars.LAT_M * ground.dlat)
    rays = at.withColumn("d_", d).select(F.struct(*ident).alias("id"), x.alias("x"), y.alias("y"), F.col("alt"), (F.col("d_.e") * east).alias("e"), (F.col("d_.n") * north).alias("n"), F.col("d_.u").alias("u"))
    got = raster.cast(rays, ground.grid, "id")
    lat, lon = ground.lat_lon(F.col("hit_x"), F.col("hit_y"))
    return got.select("id.*", lat.alias("hit_lat"), lon.alias("hit_lon"), F.col("dist").alias("dist_m"))


def focal_series(telemetry: DataFrame, shifts: DataFrame, key: str = "video", **pairs: float) -> DataFrame:
    """(video, t, f) of believable focal lengths, half way between the frames of each pan pair.

    shifts: (video, t0, dx, dy), how far the image moved from t0 on; a pair without one can't be read and tells nothing.
    """
    turned = timeseries.unwrap_degrees(telemetry, [key], "t", "yaw", "turned").select(key, "t", F.col("turned").alias("yaw"), "pitch")
    found = written(timeseries.pan_pairs(turned, key, **pairs).join(shifts.select(key, "t0", "dx", "dy"), [key, "t0"]), "pairs")
    times = F.array(*[F.struct(F.lit(n).alias("of"), t.alias("t")) for n, t in (("a", F.col("t0")), ("b", F.col("t1")), ("m", (F.col("t0") + F.col("t1")) / 2))])
    at = timeseries.interpolate(found.select(*found.columns, F.explode(times).alias("e")).select(*found.columns, "e.*"), turned, [key], "t", ["yaw", "pitch"])
    of = [F.max(F.when(F.col("of") == n, F.col(c))).alias(f"{c}_{n}") for c in ("yaw", "pitch") for n in "abm"]
    found = at.groupBy(*found.columns).agg(*of)
    f = scalars.focal_from_turn(F.col("dx"), F.col("dy"), F.col("yaw_b") - F.col("yaw_a"), F.col("pitch_b") - F.col("pitch_a"), F.col("pitch_m"))
    return found.select(key, ((F.col("t0") + F.col("t1")) / 2).alias("t"), f.alias("f")).where(scalars.in_focal_band(F.col("f")))


def scale_samples(telemetry: DataFrame, focals: DataFrame, ground: Ground, step: float = 2.0, reach: float = FOCAL_REACH, key: str = "video") -> DataFrame:
    """(video, i, t, f_px, dist_m, gsd_cm, obj8px_cm, status) at regular times: the median focal length around each and what the middle of the frame shows.

    Without a focal length nothing is cast and the status is no_focal.
    """
    at = timeseries.range_median(poses(telemetry, step, key), focals, [key], "t", "f", reach, FOCAL_LEAST, "f_px")
    hits = looks(at.where("f_px is not null"), ground, [key, "i"])
    return coverage.classify(at.select(key, "i", "t", "f_px").join(hits.select(key, "i", "dist_m"), [key, "i"], "left"))


def polygon_hits(telemetry: DataFrame, ground: Ground, ring: list[tuple[float, float]], samples: DataFrame, pad: float, step: float = 2.0, key: str = "video") -> DataFrame:
    """(video, t, lat, lon, obj8px_cm) of all looks that meet the ground in the ring's box and `pad` metres around; the scale is that of the sample of the same tenth of a second, if it is known."""
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    at = poses(telemetry, step, key)
    hits = at.select(key, "i", "t").join(looks(at, ground, [key, "i"]), [key, "i"])
    wide = F.lit(pad) / scalars.lon_metres(F.lit(sum(lats) / len(lats)))
    inside = F.col("hit_lat").between(min(lats) - pad / scalars.LAT_M, max(lats) + pad / scalars.LAT_M) & F.col("hit_lon").between(F.lit(min(lons)) - wide, F.lit(max(lons)) + wide)
    return coverage.with_scale(hits.where(inside).select(key, "t", F.col("hit_lat").alias("lat"), F.col("hit_lon").alias("lon")), samples)


def polygon_cells(hits: DataFrame, ground: Ground, ring: list[tuple[float, float]], cell: float = 30.0, radius: float = 75.0, visible: float = 100.0) -> DataFrame:
    """(lat, lon, alt_m, looked, seen, best_obj8_cm, min_dist_m) of the cells of the ring, against hits (lat, lon, obj8px_cm).

    Distances are on the plane at the ring's mean latitude.
    """
    spark = hits.sparkSession
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    scale = scalars.lon_metres(F.lit(sum(lats) / len(lats)))
    d_lat = cell / scalars.LAT_M
    rows = spark.range(int((max(lats) - min(lats)) / d_lat) + 1).select((F.lit(min(lats)) + (F.col("id") + 0.5) * d_lat).alias("lat"))
    d_lon = F.lit(cell) / scale
    across = F.sequence(F.lit(0).cast("long"), F.floor((max(lons) - F.lit(min(lons))) / d_lon))
    cells = rows.select("lat", F.explode(F.transform(across, lambda k: F.lit(min(lons)) + (k + 0.5) * d_lon)).alias("lon"))
    cells = cells.where((F.col("lat") < max(lats)) & (F.col("lon") < max(lons)) & spatial.in_polygon(F.col("lon"), F.col("lat"), [(b, a) for a, b in ring]))
    gx, gy = ground.place(F.col("lat"), F.col("lon"))
    cells = cells.withColumn("cell", F.struct("lat", "lon")).withColumn("gx", gx).withColumn("gy", gy)
    cells = raster.bilinear_join(cells, ground.grid, "cell", "gx", "gy", "alt_m")
    plane = lambda df: df.withColumn("x", F.col("lon") * scale).withColumn("y", F.col("lat") * scalars.LAT_M)
    out = spatial.cover_cells(plane(cells).select("cell", "alt_m", "x", "y"), plane(hits).select("x", "y", F.col("obj8px_cm").alias("obj8")), "cell", radius, visible)
    return out.select("cell.lat", "cell.lon", "alt_m", "looked", "seen", F.col("best_obj8").alias("best_obj8_cm"), F.col("min_dist").alias("min_dist_m"))


def placed_tracks(pixels: DataFrame, frames: DataFrame, telemetry: DataFrame, top: int = tracking.TOP, density: float = detect.DENSITY, tile: int | None = None) -> DataFrame:
    """Tracks of rare colours, best first in each video, with the place of the telemetry row nearest to their best time.

    pixels: (frame, y, x, L, a, b); frames: (frame, video, t, dx, dy), each sampled frame with its shift from the one before. A frame
    without a rare pixel still counts as a sample.
    """
    found = detect.blobs(pixels, density, tile=tile)
    best = detect.top_k(found, ["frame"], [F.col("score").desc(), F.col("y"), F.col("x")], top)
    lists = best.groupBy("frame").agg(F.collect_list(F.struct("x", "y", "w", "h", "score")).alias("blobs"))  # `top` at most
    tracks = tracking.build_tracks(frames.join(lists, "frame", "left").select("video", "t", "dx", "dy", "blobs"), top=top)
    at = timeseries.asof_nearest(tracks.withColumnRenamed("t_best", "at_"), telemetry.where("lat is not null and lon is not null").select("video", F.col("t").alias("at_"), "lat", "lon", "alt"), ["video"], "at_", ["lat", "lon", "alt"])
    return at.select("video", "track", F.col("at_").alias("t_best"), "t0", "t1", "x", "y", "w", "h", "score", *[F.col(f"near.{c}").alias(c) for c in ("lat", "lon", "alt")])
