"""Frame indexes: sampling, ranges, still stretches, segments and headers; contrast limits of decoded planes."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: failures in a row that end a segment.
FAILURES = 3


def sample_frames(frames: DataFrame, n: str, native: str, fps: float) -> DataFrame:
    """Every k-th frame, k the native rate over fps, with its time t."""
    step = F.greatest(F.lit(1), F.bround(F.col(native) / fps)).cast("long")
    return frames.where(F.col(n) % step == 0).withColumn("t", F.col(n) / F.col(native))


def in_range(t: Column, t0: float, t1: float) -> Column:
    """From t0 to t1; 0 for t1 leaves the end open."""
    return (t >= t0) & (t <= t1) if t1 else t >= t0


def still(df: DataFrame, key: str, t: str, difference: str, least: float) -> DataFrame:
    """Add still: whether this frame and the one before differ by less than `least`."""
    w = Window.partitionBy(key).orderBy(t)
    return df.withColumn("still", F.coalesce((F.col(difference) < least) & F.lag(difference).over(w).isNotNull(), F.lit(False)))


def until(df: DataFrame, key: str, t: str, t1: float) -> DataFrame:
    """Rows of each key before the first one later than t1, in order of n: what follows is not read. 0 leaves the end open."""
    if not t1:
        return df
    first = F.min(F.when(F.col(t) > t1, F.col("n"))).over(Window.partitionBy(key))
    return df.withColumn("stop_", first).where(F.col("stop_").isNull() | (F.col("n") < F.col("stop_"))).drop("stop_")


def segments(df: DataFrame, key: str, t: str, ok: str, moved: str | None = None, failures: int = FAILURES) -> DataFrame:
    """The frames that make up segments, with their segment, numbered from 1.

    The first frame of a key begins a segment, and so does every `failures`-th failure in a row, which starts the count anew.
    Other failures are left out, and so are frames that have not moved. A segment of one frame is none.
    """
    w = Window.partitionBy(key).orderBy(t)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = df.withColumn("first_", F.row_number().over(w) == 1).withColumn("fails_", ~F.coalesce(F.col(ok), F.lit(False)) & ~F.col("first_"))
    x = x.withColumn("good_", F.sum((~F.col("fails_")).cast("int")).over(upto))
    nth = F.sum(F.col("fails_").cast("int")).over(Window.partitionBy(key, "good_").orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("start_", F.col("first_") | (F.col("fails_") & (nth % failures == 0)))
    x = x.withColumn("segment", F.sum(F.col("start_").cast("int")).over(upto))
    stays = ~F.col("fails_") if moved is None else ~F.col("fails_") & F.coalesce(F.col(moved), F.lit(False))
    x = x.where(F.col("start_") | stays)
    x = x.withColumn("size_", F.count("*").over(Window.partitionBy(key, "segment"))).where("size_ > 1")
    return x.withColumn("segment", F.dense_rank().over(Window.partitionBy(key).orderBy("segment"))).drop("first_", "fails_", "good_", "start_", "size_")


def header(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """For each key and column, the first value that is there; combined before the shuffle."""
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(f"{c}_") for c in columns]
    return df.groupBy(key).agg(*first).select(key, *[F.col(f"{c}_.{c}").alias(c) for c in columns])


def span(df: DataFrame, key: str, column: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(column).alias("low"), F.max(column).alias("high"))


def label_places(line: Column, zoom: Column, minor: Column, seen: Callable[[Column], Column] | None = None) -> Column:
    """Vertices of a contour that carry its label: of those that are seen (all, if nothing else is asked), the middle one, and those at a sixth and
    five sixths of more than 80. Minor contours have labels from zoom 15 on; a contour of which nothing is seen has none."""
    there = line if seen is None else F.filter(line, seen)
    n = F.size(there)
    at = lambda share: F.get(there, F.floor(n * share).cast("int"))
    places = F.when(n > 80, F.array(at(1 / 6), at(1 / 2), at(5 / 6))).when(n > 0, F.array(at(1 / 2))).otherwise(F.slice(there, 1, 0))
    return F.when(minor & (zoom < 15), F.slice(places, 1, 0)).otherwise(places)


def in_view(south: float, north: float, west: float, east: float, rim: float = 0.05) -> Callable[[Column], Column]:
    """Whether a vertex (lat, lon) lies in a viewport, by `rim` of its size within its edges."""
    dy, dx = (north - south) * rim, (east - west) * rim
    return lambda v: v["lat"].between(south + dy, north - dy) & v["lon"].between(west + dx, east - dx)


def equalize(plane: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited adaptive equalization of an eight-bit plane, blended between the tiles' curves."""
    h, w = plane.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    curves = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            tile = plane[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            hist = np.bincount(tile.ravel(), minlength=256).astype(float)
            most = max(1.0, limit * tile.size / 256)
            over = np.maximum(hist - most, 0).sum()
            curves[i, j] = np.cumsum(np.minimum(hist, most) + over / 256) * 255 / max(1, tile.size)
    fy = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1)
    fx = np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    y0, x0 = np.minimum(fy.astype(int), tiles - 2 if tiles > 1 else 0), np.minimum(fx.astype(int), tiles - 2 if tiles > 1 else 0)
    y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
    ay, ax = (fy - y0)[:, None], (fx - x0)[None]
    c = lambda a, b: curves[a[:, None], b[None], plane]
    out = (c(y0, x0) * (1 - ax) + c(y0, x1) * ax) * (1 - ay) + (c(y1, x0) * (1 - ax) + c(y1, x1) * ax) * ay
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def with_retry(run: Callable[[], object], waits: tuple = (20, 40, 60), sleep: Callable[[float], None] = time.sleep, hopeless: str = "quota") -> object:
    """run(), again after each wait if it fails; the last failure is raised, and at once one that tells of a used-up quota."""
    for wait in waits:
        try:
            return run()
        except OSError as e:
            if hopeless and hopeless in str(e).lower():
                raise
            sleep(wait)
    return run()
