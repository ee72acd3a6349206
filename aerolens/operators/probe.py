"""Recall of the detector on injected objects."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import drop_written, written

#: Sizes in pixels and contrasts of the grid, steps and margin of the lattice of sites, blobs that are looked through.
SIZES = (2, 3, 4, 5, 6, 8, 12, 16, 24, 32, 48)
CONTRASTS = (10.0, 20.0, 40.0, 80.0)
SITE_STEP, MARGIN = 64, 64
TOP, TOP_TIGHT = 25, 10
#: Pixels around an object's middle, besides half its size, and around a box, in which a blob counts.
REACH, RIM = 6.0, 2
#: Pixels of a side of the tiles on which objects and blobs meet, and pairs of both that are compared together at most, about.
TILE, PAIRS = 64, 1 << 20


def grid(spark: SparkSession, backgrounds: list[str], repeats: int) -> DataFrame:
    """All trials: background, size, contrast, repeat. Its size is that of the constants."""
    rows = lambda name, values: spark.createDataFrame([(v,) for v in values], [name])
    return rows("bg", backgrounds).crossJoin(rows("size", SIZES)).crossJoin(rows("contrast", CONTRASTS)).crossJoin(spark.range(repeats).withColumnRenamed("id", "repeat"))


def _first(places: pa.Table, blobs: pa.Table) -> pa.Table:
    """The least rank of a tile's blobs that match, for each place of a tile that has one. Blobs are gone through by rank, and a place that has met its own goes."""
    x, y, reach = (places.column(c).to_numpy().astype(float) for c in ("x", "y", "reach"))
    rank = blobs.column("rank").to_numpy()
    order = np.argsort(rank, kind="stable")
    bx, by, w, h = (blobs.column(c).to_numpy().astype(float)[order] for c in ("bx", "by", "w", "h"))
    rank, first = rank[order], np.full(len(x), -1)
    left, start, size = np.arange(len(x)), 0, 64
    while len(left) and start < len(rank):
        end = min(start + max(1, min(size, PAIRS // len(left))), len(rank))
        k = slice(start, end)
        px, py = x[left, None], y[left, None]
        match = np.sqrt((bx[k] + w[k] / 2 - px) ** 2 + (by[k] + h[k] / 2 - py) ** 2) <= reach[left, None]
        match |= (px >= bx[k] - RIM) & (px <= bx[k] + w[k] + RIM) & (py >= by[k] - RIM) & (py <= by[k] + h[k] + RIM)
        some = match.any(1)
        first[left[some]] = rank[k][match[some].argmax(1)]
        left, start, size = left[~some], end, size * 2
    got = np.flatnonzero(first >= 0)
    return pa.table([places.column("place").take(pa.array(got)), pa.array(first[got], pa.int64())], names=["place", "rank"])


def first_match(objects: DataFrame, blobs: DataFrame, key: str) -> DataFrame:
    """Rank (from 0) and score of the first blob near or around each object (frame, x, y, size); -1 if none is.

    Both meet on tiles of their frame: an object on those within reach of it, a blob on those of its box and the rim. Objects of one
    place and size are one, and of blobs with one box only the first counts. Ranks of a frame are unique, keys of objects too.
    """
    over = lambda low, high: F.explode(F.sequence(F.floor(low / TILE), F.floor(high / TILE)))
    reach = REACH + F.col("size") / 2
    spot = ["frame", "x", "y", "size"]
    there = " and ".join(f"{c} is not null" for c in spot)
    places = written(objects.where(there).select(*spot).distinct().withColumn("place", F.monotonically_increasing_id()), "places")
    own = places.withColumn("reach", reach).withColumn("i_", over(F.col("x") - reach, F.col("x") + reach)).withColumn("j_", over(F.col("y") - reach, F.col("y") + reach))
    b = blobs.where("frame is not null and x is not null and y is not null and w is not null and h is not null and rank is not null")
    b = b.groupBy("frame", F.col("x").alias("bx"), F.col("y").alias("by"), "w", "h").agg(F.min(F.struct(F.col("rank").cast("long").alias("rank"), "score")).alias("m_"))
    b = written(b.select("frame", "bx", "by", "w", "h", "m_.rank", "m_.score"), "boxes")
    wide = b.select("frame", "bx", "by", "w", "h", "rank")
    wide = wide.withColumn("i_", over(F.col("bx") - RIM, F.col("bx") + F.col("w") + RIM)).withColumn("j_", over(F.col("by") - RIM, F.col("by") + F.col("h") + RIM))
    tile = ["frame", "i_", "j_"]
    kind = StructType([StructField("place", LongType()), StructField("rank", LongType())])
    met = own.drop("size").groupBy(*tile).cogroup(wide.groupBy(*tile)).applyInArrow(_first, kind)
    best = places.join(met.groupBy("place").agg(F.min("rank").alias("rank")), "place").join(b.select("frame", "rank", "score"), ["frame", "rank"])
    best = written(best.select(*spot, F.col("rank").cast(blobs.schema["rank"].dataType).alias("rank"), "score"), "first-match")
    drop_written(places, b)
    return objects.join(best, spot, "left").select(*objects.columns, F.coalesce("rank", F.lit(-1)).alias("rank"), "score")


def recall(trials: DataFrame, cells: DataFrame, keys: list[str], hit: Column, clean: Column) -> DataFrame:
    """n and recall of the clean trials of every cell; recall is null where there are none."""
    got = trials.where(clean).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("recall"))
    return cells.select(*keys).distinct().join(got, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def report(df: DataFrame, row: str, col: str, values: list, value: Column) -> DataFrame:
    return df.groupBy(row).pivot(col, values).agg(value)


def patch_class(p: DataFrame, key: str, light: str = "L") -> DataFrame:
    """snow, scree or none of each patch, by median and shares of lightness."""
    g = p.groupBy(key).agg(F.median(light).alias("med"), F.avg((F.col(light) >= 170).cast("int")).alias("bright"), F.avg((F.col(light) <= 170).cast("int")).alias("dark"))
    return g.select(key, F.when((F.col("med") >= 200) & (F.col("bright") >= 0.9), "snow").when((F.col("med") <= 130) & (F.col("dark") >= 0.9), "scree").alias("class"))


def size_range(recalls: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """(keys, low, high) of the sizes whose recall is at least `least`, for each background and contrast, or whatever keys say."""
    return recalls.where(F.col("recall") >= least).groupBy(*keys).agg(F.min("size").alias("low"), F.max("size").alias("high"))


def rank_report(trials: DataFrame, top: int = TOP, tight: int = TOP_TIGHT) -> DataFrame:
    """For each size, of the clean trials: how many, how many found, the median rank of these, shares among the first blobs, and
    medians of peak over contrast, mean over peak, and the clipped share."""
    found = F.col("rank") >= 0
    among = lambda k: F.avg((found & (F.col("rank") < k)).cast("int"))
    g = trials.where("dirty = 0").groupBy("size")
    return g.agg(
        F.count("*").alias("n"), F.count_if(found).alias("found"), F.median(F.when(found, F.col("rank"))).alias("rank_med"), among(tight).alias("tight"), among(top).alias("wide"),
        F.median(F.col("de_peak") / F.col("contrast")).alias("peak_med"), F.median(F.col("de_mean") / F.greatest("de_peak", F.lit(1e-6))).alias("mean_med"), F.median("clipped").alias("clipped_med"),
    )


def clean_counts(blobs: DataFrame, frame: str = "frame") -> DataFrame:
    """Median, least and most blobs of the frames without objects."""
    n = blobs.groupBy(frame).agg(F.count("*").alias("n"))
    return n.agg(F.median("n").alias("med"), F.min("n").alias("low"), F.max("n").alias("high"))


def sites(frames: DataFrame, w: str = "w", h: str = "h", step: int = SITE_STEP, margin: int = MARGIN) -> DataFrame:
    """frames with the places (x, y) of a lattice over each; a frame too small for its margins has none."""
    at = lambda c: F.when(F.col(c) > 2 * margin, F.sequence(F.lit(margin), F.col(c) - margin - 1, F.lit(step)))
    return frames.withColumn("y", F.explode(at(h))).withColumn("x", F.explode(at(w))).select(*frames.columns, "x", "y")
