"""Nearest signatures, robust spread and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import box, colour_distance, timecode
from ..session import written
from . import boxes as boxes_
from . import nearest, orderstats

#: Signatures that every item is compared with at most; more are searched.
MOST_SIGNATURES = 256
#: Tolerances of chroma and lightness, and pixels of a crop on each side of its middle.
TOL_AB, TOL_L, CROP = 8.0, 28.0, 128
#: Where a colour was measured, classes of signatures, and the chroma below which one is neutral.
SOURCES, KINDS, NEUTRAL = ("маска", "bbox", "нет"), ("предмет", "контроль", "ловушка"), 8.0


def nearest_signature(items: DataFrame, signatures: DataFrame, key: str, name: str, order: str) -> DataFrame:
    """items (key, L, a, b) with the nearest signature (name, L, a, b), its distance and both parts; of equals, the first by order.

    A few signatures are compared with every item; more are searched by nearest.nearest, in the space where a unit is the tolerance on each axis.
    """
    s = written(signatures.select(F.col(order).alias("o"), F.col(name).alias("name"), *[F.col(c).cast("double").alias(c) for c in "Lab"]), "signatures")
    parts = lambda x, y: (F.hypot(x["a"] - y["a"], x["b"] - y["b"]), F.abs(x["L"] - y["L"]))
    if s.limit(MOST_SIGNATURES + 1).count() <= MOST_SIGNATURES:
        pairs = items.crossJoin(F.broadcast(s.select(F.struct("*").alias("s_"))))  # at most MOST_SIGNATURES
        d = parts(F.struct(*"Lab"), F.col("s_"))
        best = F.min(F.struct(colour_distance(*d).alias("d"), F.col("s_.o").alias("o"), F.col("s_").alias("object")))
        got = pairs.groupBy(key).agg(best.alias("m_")).select(key, F.col("m_.d").alias("dist"), F.col("m_.object").alias("object"))
    else:
        places = [F.col(c) for c in "Lab"]
        between = lambda p, o: colour_distance(F.hypot(p[1] - o["a"], p[2] - o["b"]), F.abs(p[0] - o["L"]))
        got = nearest.nearest(items, key, places, s, places, places, between, ["o", "name"], [TOL_L, TOL_AB, TOL_AB])
    out = items.join(got, key, "left")
    d_ab, d_l = parts(F.struct(*"Lab"), F.col("object"))
    return out.select(*items.columns, F.col("object.name").alias("nearest"), "dist", d_ab.alias("d_ab"), d_l.alias("d_l"))


def median_and_mad(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, med, mad): the median, and the median of the absolute differences from it. A null key is left out."""
    own = df.where(F.col(key).isNotNull()).select(key, value)
    med = orderstats.quantiles(own, [key], F.col(value), [0.5]).select(key, "n", F.col("q")[0].alias("med"))
    mad = orderstats.quantiles(own.join(med, key), [key], F.abs(F.col(value) - F.col("med")), [0.5]).select(key, F.col("q")[0].alias("mad"))
    return med.join(mad, key)


def box_colour(pixels: DataFrame, boxes: DataFrame, key: str, means: tuple[str, ...] = ()) -> DataFrame:
    """(key, L, a, b, source): medians in CIE units over the rare pixels of each box, or over all if fewer than three are rare; and mean_{c}, the whole part of the mean, for each of means.

    pixels: (frame, x, y, L, a, b, rare) in eight-bit planes. A box without a pixel has no colour. Keys of boxes are unique.
    """
    got = boxes_.box_values(pixels, boxes, key, tuple("Lab"), means, "rare")
    source = F.when(F.col("n").isNull(), SOURCES[2]).when(F.col("m") >= boxes_.LEAST_RARE, SOURCES[0]).otherwise(SOURCES[1])
    lab = [(F.col("q.L") * 100 / 255).alias("L"), (F.col("q.a") - 128).alias("a"), (F.col("q.b") - 128).alias("b")]
    return got.select(key, *lab, source.alias("source"), *[F.col(f"means.{c}").cast("int").alias(f"mean_{c}") for c in means])


def box_mean(pixels: DataFrame, boxes: DataFrame, key: str, columns: tuple = ("r", "g", "b")) -> DataFrame:
    """(key, columns): whole parts of the means over each box's pixels. Keys of boxes are unique."""
    got = boxes_.box_values(pixels, boxes, key, (), tuple(columns))
    return got.where("n is not null").select(key, *[F.col(f"means.{c}").cast("int").alias(c) for c in columns])


def spread(df: DataFrame, key: str) -> DataFrame:
    """(key, n, L, a, b, spread_L, spread_ab): medians, the median distance of L from its own and that of (a, b) from theirs. A null key is left out."""

    def medians(rows: DataFrame, of: dict[str, Column]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("of_"), c.cast("double").alias("x_")) for k, c in of.items()]))
        q = orderstats.quantiles(rows.select(key, each.alias("e_")).select(key, "e_.*"), [key, "of_"], F.col("x_"), [0.5])
        return q.groupBy(key).agg(*[F.max(F.when(F.col("of_") == k, F.col("q")[0])).alias(k) for k in of])

    own = df.where(F.col(key).isNotNull()).select(key, *"Lab")
    med = medians(own, {f"{c}_": F.col(c) for c in "Lab"})
    far = {"spread_L": F.abs(F.col("L") - F.col("L_")), "spread_ab": F.hypot(F.col("a") - F.col("a_"), F.col("b") - F.col("b_"))}
    got = own.groupBy(key).agg(F.count("*").alias("n")).join(med, key).join(medians(own.join(med, key), far), key)
    return got.select(key, "n", *[F.col(f"{c}_").alias(c) for c in "Lab"], *far)


def usable(signatures: DataFrame, kind: str = "kind", chroma: str = "C", neutral: bool = False) -> tuple[DataFrame, DataFrame]:
    """(objects, traps): signatures of objects and controls, without nearly neutral ones unless these are asked for, and traps."""
    own = signatures.where(F.col(kind).isin(*KINDS[:2]))
    return own if neutral else own.where(F.col(chroma) >= NEUTRAL), signatures.where(F.col(kind) == KINDS[2])


def group_rank(keys: list[str], order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")


def resorted(df: DataFrame, distance: str, order: str) -> DataFrame:
    """By distance, what has none last, in the original order."""
    return df.orderBy(F.col(distance).asc_nulls_last(), F.col(order))


def annotated(df: DataFrame, new: list[str], file: str, group: str, order: list[Column]) -> DataFrame:
    """df with rank in its file and rank_in_group by order, then the new columns, then all others.

    Rows are dealt to parts in order of file and rank, and a part's rows count on from the number of those in the parts before it, so that no task
    holds a whole file or group; rows that are equal in all of order are in one part. A null file or group is one of its own.
    """
    parts = written(df.repartitionByRange(file, *order).withColumn("part_", F.spark_partition_id()), "parts")
    n = parts.groupBy(F.col(file).alias("file_"), F.col(group).alias("group_"), F.col("part_").alias("at_")).agg(F.count("*").alias("n_"))
    before = lambda *keys: F.coalesce(F.sum("n_").over(Window.partitionBy(*keys).orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    in_file = n.groupBy("file_", "at_").agg(F.sum("n_").alias("n_")).select("file_", "at_", before("file_").alias("in_file_"))
    in_group = n.select("file_", "group_", "at_", before("file_", "group_").alias("in_group_"))
    at = (F.col("part_") == F.col("at_")) & F.col(file).eqNullSafe(F.col("file_"))
    own = parts.select("*", group_rank([file, "part_"], order).alias("rank_"), group_rank([file, group, "part_"], order).alias("rank_in_group_"))
    own = own.join(in_file, at).drop("file_", "at_").join(in_group, at & F.col(group).eqNullSafe(F.col("group_")))
    old = [c for c in df.columns if c not in new]
    return own.select((F.col("rank_") + F.col("in_file_")).alias("rank"), (F.col("rank_in_group_") + F.col("in_group_")).alias("rank_in_group"), *new, *old)


def with_crop(tracks: DataFrame, crops: DataFrame, folder: str = "folder", ident: str = "track", t: str = "t_best", bbox: str = "bbox", path: str = "path") -> DataFrame:
    """tracks with crop, the path of their picture, null if it is not there, and its upper left corner in the frame.

    A picture lies in crops beside the table, whose directory is `folder`, and is called after the track's number and best time, t0003_02m05s.jpg. It
    reaches CROP pixels around the middle of the box, less at the edges of the frame: the corner is never negative.
    """
    name = F.format_string("t%04d_%s.jpg", F.col(ident).cast("int"), timecode(F.col(t)))
    middle = box(F.col(bbox))
    corner = F.struct(F.greatest(F.lit(0), middle["cx"] - CROP).alias("x"), F.greatest(F.lit(0), middle["cy"] - CROP).alias("y"))
    there = crops.groupBy(F.regexp_replace(path, "/[^/]*$", "").alias("folder_"), F.substring_index(path, "/", -1).alias("name_")).agg(F.min(path).alias("crop"))
    out = tracks.withColumn("folder_", F.concat(F.col(folder), F.lit("/crops"))).withColumn("name_", name).withColumn("corner", corner)
    return out.join(there, ["folder_", "name_"], "left").drop("folder_", "name_")


def top(df: DataFrame, order: list[Column], n: int = 10) -> DataFrame:
    """The first n rows, for a report."""
    return df.orderBy(*order).limit(n)
