"""What was seen at what scale: status of samples, summaries of videos, shares of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import orderstats

#: Pixels that an object needs, and sizes of objects in metres.
PIXELS, OBJECTS = 8, (1.00, 0.60, 0.17)


def status(dist: Column, focal: Column) -> Column:
    """no_focal goes first: without a focal length nothing is cast."""
    return F.when(focal.isNull(), "no_focal").when(dist.isNull(), "above_horizon").otherwise("ok")


def classify(df: DataFrame, dist: str = "dist_m", focal: str = "f_px") -> DataFrame:
    """Add gsd_cm, obj8px_cm and status; every row gets one of the three."""
    gsd = F.try_divide(F.col(dist), F.col(focal)) * 100
    return df.withColumn("gsd_cm", gsd).withColumn("obj8px_cm", gsd * PIXELS).withColumn("status", status(F.col(dist), F.col(focal)))


def summarize(df: DataFrame, key: str = "video", gsd: str = "gsd_cm", state: str = "status") -> DataFrame:
    """One row a key: counts, shares of states, median and 90th percentile, and the share of all samples that shows each object.

    Without a single known scale, what is about scale is null.
    """
    known = F.when(F.col(state) == "ok", F.col(gsd))
    any_, n = F.count(known) > 0, F.count("*")
    shows = [F.when(any_, F.count_if(known <= s * 100 / PIXELS) / n).alias(f"shows_{round(s * 100)}") for s in OBJECTS]
    counts = df.groupBy(key).agg(n.alias("n"), (F.count_if(F.col(state) == "no_focal") / n).alias("no_focal"), (F.count_if(F.col(state) == "above_horizon") / n).alias("sky"), *shows)
    q = orderstats.quantiles(df, [key], known, [0.5, 0.9]).select(F.col(key).alias("key_"), "q")
    out = counts.join(q, F.col(key).eqNullSafe(F.col("key_")))
    med = F.col("q")[0]
    return out.select(key, "n", "no_focal", "sky", med.alias("gsd_med"), F.col("q")[1].alias("gsd_p90"), (med * PIXELS).alias("obj8_med"), *[f"shows_{round(s * 100)}" for s in OBJECTS])


def cell_totals(cells: DataFrame) -> DataFrame:
    n = F.count("*")
    share = lambda c: F.try_divide(F.count_if(c), n)
    blind = F.col("looked") == 0
    return cells.agg(n.alias("n"), F.count_if(blind).alias("blind"), F.count_if(F.col("seen") == 1).alias("seen"), share(blind).alias("blind_share"), F.min(F.when(blind, F.col("alt_m"))).alias("blind_low"), F.max(F.when(blind, F.col("alt_m"))).alias("blind_high"))


def hits_by_video(hits: DataFrame) -> DataFrame:
    return hits.groupBy("video").agg(F.count("*").alias("hits"), F.count("obj8px_cm").alias("scaled")).orderBy(F.col("hits").desc(), "video")


def with_scale(hits: DataFrame, samples: DataFrame) -> DataFrame:
    """hits with obj8px_cm of the sample of the same video and tenth of a second, null unless its status is ok."""
    tenth = F.round(F.col("t") * 10).cast("long")
    s = samples.select("video", tenth.alias("tenth"), F.when(F.col("status") == "ok", F.col("obj8px_cm")).alias("obj8px_cm"))
    return hits.withColumn("tenth", tenth).join(s, ["video", "tenth"], "left").drop("tenth")
