"""Rays against terrain of any size, by a pyramid of greatest heights.

The terrain is cut into square leaves of BLOCK cells, and 2 x 2 tiles make one of the level above, up to tiles as long as a
ray; a tile knows its greatest height. A ray goes from tile to tile: where it stays above the greatest height of the tile
that it is in, of the largest such level, it leaves that tile in one step; where it does not, it is marched over the leaf's heights, which come
with a rim so that a step and its refinement need no other leaf. All rays go one tile further a round, and
a ray that has ended takes no part in the next one. The result is that of marching every step.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_written, written
from .raster import MOST, STEP, Terrain

#: Cells of a leaf's side, and rays that meet one leaf in one task at most, about.
BLOCK, RAYS = 64, 20_000
LAST = int(MOST / STEP)


def rim(cell: float) -> int:
    """Cells around a leaf that a step which ends in it may come from."""
    return math.ceil(STEP / cell) + 1


def top_level(cell: float, block: int = BLOCK) -> int:
    """The level whose tiles are as long as a ray."""
    return max(0, math.ceil(math.log2(MOST / (cell * block))))


def leaves(grid: DataFrame, cell: float, block: int = BLOCK) -> DataFrame:
    """(ty, tx, points) of all leaves: places in the leaf with its rim, row by row, and heights."""
    m = rim(cell)
    side = block + 1 + 2 * m
    home = lambda c: F.sequence(F.ceil((F.col(c) - (block + m)) / block), F.floor((F.col(c) + m) / block))
    dealt = grid.where("z is not null").withColumn("ty", F.explode(home("iy"))).withColumn("tx", F.explode(home("ix"))).where("ty >= 0 and tx >= 0")
    place = (F.col("iy") - F.col("ty") * block + m) * side + F.col("ix") - F.col("tx") * block + m
    return dealt.groupBy("ty", "tx").agg(F.collect_list(F.struct(place.cast("int").alias("p"), F.col("z").cast("double").alias("z"))).alias("points"))  # side ** 2 at most


def pyramid(grid: DataFrame, cell: float, block: int = BLOCK) -> DataFrame:
    """(level, ty, tx, top) of all tiles; top is infinite if a height is missing in a tile, so that no ray jumps over a gap."""
    home = lambda c: F.sequence(F.ceil((F.col(c) - block) / block), F.floor(F.col(c) / block))
    dealt = grid.where("z is not null").withColumn("ty", F.explode(home("iy"))).withColumn("tx", F.explode(home("ix"))).where("ty >= 0 and tx >= 0")
    full = F.count("*") == (block + 1) ** 2
    base = dealt.groupBy("ty", "tx").agg(F.when(full, F.max("z").cast("double")).otherwise(float("inf")).alias("top"))
    up = base.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top_level(cell, block)))))
    above = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).alias(c)
    tiles = up.select("level", above("ty"), above("tx"), "top").groupBy("level", "ty", "tx").agg(F.max("top").alias("top"), F.count("*").alias("n"))
    whole = F.col("n") == F.pow(F.lit(4.0), F.col("level"))
    return tiles.select("level", "ty", "tx", F.when(whole, F.col("top")).otherwise(float("inf")).alias("top"))


_RAY = ("x", "y", "alt", "e", "n", "u")


def _looked(active: DataFrame, tiles: DataFrame, cell: float, block: int, levels: int) -> DataFrame:
    """active rays (id, ray, k, up) with jump, the last step in the largest tile that they clear, and with ty, tx and last, the leaf that they are in and the last step in it; both null beyond the terrain."""
    r = lambda c: F.col(f"ray.{c}")
    size = F.pow(F.lit(2.0), F.col("level")) * block
    looks = active.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    ends = []
    for tile, c, way in (("ty", "y", "n"), ("tx", "x", "e")):
        looks = looks.withColumn(tile, F.floor((r(c) + r(way) * F.col("k") * (STEP / cell)) / size))
        ahead = F.ceil(F.try_divide((F.col(tile) + 1) * size - r(c), r(way) * (STEP / cell))) - 1
        back = F.floor(F.try_divide(r(c) - F.col(tile) * size, -r(way) * (STEP / cell)))
        ends.append(F.when(r(way) > 0, ahead).when(r(way) < 0, back).otherwise(F.lit(LAST)))
    last = F.greatest(F.col("k"), F.least(F.lit(LAST), *ends)).cast("int")
    looks = looks.withColumn("last", last)
    height = lambda k: r("alt") - r("lift") + r("u") * F.col(k) * STEP
    met = looks.join(tiles, ["level", "ty", "tx"])
    clear = F.least(height("k"), height("last")) > F.col("top")
    leaf = F.max(F.when(F.col("level") == 0, F.struct("ty", "tx", "last")))
    return met.groupBy("id").agg(F.any_value("ray").alias("ray"), F.any_value("k").alias("k"), F.any_value("up").alias("up"), F.max(F.when(clear, F.col("last"))).alias("jump"), leaf.alias("leaf_")).select("id", "ray", "k", "up", "jump", "leaf_.*")


def _march(cell: float, block: int):
    m = rim(cell)
    side = block + 1 + 2 * m

    def run(rays: pd.DataFrame, leaf: pd.DataFrame) -> pd.DataFrame:
        if not len(rays):
            return pd.DataFrame({"id": [], "state": [], "step": [], "dist": []})
        z = np.full(side * side, np.nan)
        if len(leaf):
            got = leaf.points.iloc[0]
            z[[p["p"] for p in got]] = [p["z"] for p in got]
        ray = {c: rays[c].to_numpy(float) for c in (*_RAY, "lift")}
        x0, y0 = rays.tx.iloc[0] * block - m, rays.ty.iloc[0] * block - m
        up, out, step, dist = Terrain(z.reshape(side, side)).march(ray["x"] - x0, ray["y"] - y0, ray["alt"] - ray["lift"], ray["e"], ray["n"], ray["u"], rays.k.to_numpy(int), rays["last"].to_numpy(int), rays.up.to_numpy(bool), cell)
        state = np.where(~np.isnan(step), 2, np.where(out, 3, np.where(up, 1, 0)))  # 0 below, 1 above: goes on; 2 hit; 3 out
        return pd.DataFrame({"id": rays.id, "state": state, "step": step, "dist": dist})

    return run


def cast_pyramid(rays: DataFrame, grid: DataFrame, key: str, cell: float = 1.0, forks: tuple = (0.0,), block: int = BLOCK) -> DataFrame:
    """(key, lift, step, dist, hit_x, hit_y) of rays (key, x, y, alt, e, n, u) for each lift of the terrain (iy, ix, z), of any size.

    The same as raster.cast_rays: the march of steps of 5 to 6000, where a ray that starts below the ground
    is skipped until it is above, and ends where a height is missing. Keys are unique; heights that are null count as missing.
    """
    tiles, ground = written(pyramid(grid, cell, block), "pyramid"), written(leaves(grid, cell, block), "leaves")
    own = rays.select(key, F.explode(F.array(*[F.lit(float(f)) for f in forks])).alias("lift"), *[F.col(c).cast("double").alias(c) for c in _RAY])
    all_ = written(own.select(F.struct(key, "lift").alias("id"), F.struct(*_RAY, "lift").alias("ray"), F.lit(1).alias("k"), F.lit(False).alias("up")), "rays")
    active, done, made = all_, None, [tiles, ground]
    id_type = all_.schema["id"].dataType.simpleString()
    while not active.isEmpty():
        looked = written(_looked(active, tiles, cell, block, top_level(cell, block)), "looked")
        test = looked.where("jump is null and last is not null")
        parts = test.groupBy("ty", "tx").agg(F.ceil(F.count("*") / RAYS).cast("int").alias("parts"))
        floor_ = ground.join(parts, ["ty", "tx"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        test = test.join(parts, ["ty", "tx"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select("id", "ray.*", "k", "last", "up", "ty", "tx", "part")
        group = ["ty", "tx", "part"]
        marched = test.groupBy(*group).cogroup(floor_.groupBy(*group)).applyInPandas(_march(cell, block), f"id {id_type}, state int, step double, dist double")
        marched = written(marched, "marched")
        jumped = looked.where("jump is not null").select("id", "ray", (F.col("jump") + 1).alias("k"), F.lit(True).alias("up"))
        went = marched.where("state < 2").join(looked.select("id", "ray", "last"), "id").select("id", "ray", (F.col("last") + 1).alias("k"), (F.col("state") == 1).alias("up"))
        active = jumped.unionByName(went).where(F.col("k") <= LAST)
        hit = marched.where("state = 2").select("id", "step", "dist")
        done = hit if done is None else done.unionByName(hit)
        made += [looked, marched]
    found = all_.select("id", "ray") if done is None else all_.select("id", "ray").join(done, "id", "left")
    if done is None:
        found = found.withColumn("step", F.lit(None).cast("double")).withColumn("dist", F.lit(None).cast("double"))
    place = lambda c, d: (F.col(f"ray.{c}") + F.col(f"ray.{d}") * F.col("dist") / cell).alias(f"hit_{c}")
    out = written(found.select("id.*", "step", "dist", place("x", "e"), place("y", "n")), "casts")
    drop_written(all_, *made)
    return out
