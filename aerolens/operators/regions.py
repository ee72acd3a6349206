"""Regions of pixels over tiles: cleaned and numbered tile by tile, joined over the seams, summed up once.

A tile is one group, with as much of its surroundings as cleaning looks at, so an image of any size costs time in
proportion to its rare pixels and a task holds one tile. Regions of two tiles are one if pixels on both sides of their seam touch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written
from .components import components

#: Pixels around a tile that opening and closing may reach, and one more.
RIM = 8
TILE = 512
_PARTS = "frame string, node string, y int, x int, x0 int, y0 int, x1 int, y1 int, area long, total double, top double"


def _tile_parts(tile: int):
    """Rows of one tile: a region each (y null), and a pixel each that lies on the tile's edge (area null)."""
    from .detect import cleaned, label, region_stats  # detect uses this module as well

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        frame, ty, tx = key
        y0, x0, side = ty * tile - RIM, tx * tile - RIM, tile + 2 * RIM
        mask, weight = np.zeros((side, side), bool), np.zeros((side, side))
        mask[p.y - y0, p.x - x0] = True
        weight[p.y - y0, p.x - x0] = p.rarity
        inner = np.s_[RIM:-RIM, RIM:-RIM]
        lab = label(cleaned(mask)[inner])
        s = region_stats(lab, weight[inner])
        node = [f"{ty}.{tx}.{k}" for k in s.label]
        out = pd.DataFrame({"frame": frame, "node": node, "y": None, "x": None, "x0": s.x0 + tx * tile, "y0": s.y0 + ty * tile, "x1": s.x1 + tx * tile, "y1": s.y1 + ty * tile, "area": s.area, "total": s.total, "top": s.top})
        edge = np.zeros(lab.shape, bool)
        edge[[0, -1]] = edge[:, [0, -1]] = True
        ys, xs = np.nonzero(edge & (lab > 0))
        rim = pd.DataFrame({"frame": frame, "node": [f"{ty}.{tx}.{k}" for k in lab[ys, xs]], "y": ys + ty * tile, "x": xs + tx * tile})
        return pd.concat([out.astype(object), rim.astype(object)], ignore_index=True).reindex(columns=_PARTS.replace(",", "").split()[::2])

    return run


def tiled_blobs(rare: DataFrame, mode: str = "sum", tile: int = TILE) -> DataFrame:
    """(frame, x, y, w, h, area, score) of the blobs of rare pixels (frame, y, x, rarity), as detect.frame_blobs finds them in a whole frame."""
    from .detect import LEAST_AREA, MOST_AREA

    home = lambda c: F.explode(F.sequence(F.floor((F.col(c) - RIM) / tile), F.floor((F.col(c) + RIM) / tile)))
    dealt = rare.withColumn("ty", home("y")).withColumn("tx", home("x"))
    parts = written(dealt.groupBy("frame", "ty", "tx").applyInPandas(_tile_parts(tile), _PARTS), "parts")
    rim = parts.where("y is not null").select("frame", "node", "y", "x")
    # Towards the right and down, each pair of touching pixels is met once; those of one tile are joined already.
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    ahead = rim.select("frame", F.col("node").alias("from"), "y", "x", steps.alias("s")).select("frame", "from", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    name = lambda n: F.struct("frame", F.col(n).alias("node"))
    seams = ahead.join(rim, ["frame", "y", "x"]).where(F.col("from") != F.col("node")).select(name("from").alias("a"), name("node").alias("b")).distinct()
    same = components(seams).select("node.*", F.col("component.node").alias("region"))
    own = parts.where("y is null").drop("y", "x").join(same, ["frame", "node"], "left").withColumn("region", F.coalesce("region", "node"))
    g = own.groupBy("frame", "region").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area"), F.sum("total").alias("total"), F.max("top").alias("top"))
    score = {"sum": F.col("total"), "mean": F.col("total") / F.col("area"), "max": F.col("top")}[mode]
    side = lambda a, b: (F.col(b) - F.col(a) + 1).cast("int")
    out = g.where(F.col("area").between(LEAST_AREA, MOST_AREA)).select("frame", "x", "y", side("x", "x1").alias("w"), side("y", "y1").alias("h"), F.col("area").cast("int").alias("area"), score.alias("score"))
    out = written(out, "blobs")
    drop_written(parts)
    return out
