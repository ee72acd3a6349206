"""Radius joins, polygons, polylines and grids on a local plane."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _tile(x: str, y: str, size: float) -> Column:
    return F.struct(F.floor(F.col(x) / size).alias("i"), F.floor(F.col(y) / size).alias("j"))


def radius_join(left: DataFrame, right: DataFrame, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pairs within radius, with their distance dist. Both sides meet on tiles of that size by equality, so no
    product is formed; the right side's columns get the prefix r_."""
    near = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    tile = _tile(f"r_{x}", f"r_{y}", radius)
    steps = F.array(*[F.struct((tile["i"] + a).alias("i"), (tile["j"] + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    near = near.withColumn("tile_", F.explode(steps))
    own = left.withColumn("tile_", _tile(x, y, radius))
    d = F.hypot(F.col(x) - F.col(f"r_{x}"), F.col(y) - F.col(f"r_{y}"))
    return own.join(near, "tile_").withColumn("dist", d).where(F.col("dist") <= radius).drop("tile_")


def nearest_distance(cells: DataFrame, hits: DataFrame, key: str, radius: float, x: str = "x", y: str = "y") -> DataFrame:
    """(key, min_dist) of every cell over all hits, infinite if there is none.

    Tiles of `radius`, twice that and so on are told occupied or empty first. A cell's level is the finest whose nine
    tiles around it hold a hit. Tiles one level finer, within the reach that this bounds, are compared by their edges, and
    only hits of tiles that may hold the nearest one are looked at.
    """
    ends = [F.min(x), F.max(x), F.min(y), F.max(y)]
    box, span = hits.agg(*ends).first(), cells.agg(*ends).first()
    if box[0] is None or span[0] is None:
        return cells.select(key, F.lit(float("inf")).alias("min_dist"))
    extent = max(max(box[i + 1], span[i + 1]) - min(box[i], span[i]) for i in (0, 2))
    top = 1 + max(0, math.ceil(math.log(max(extent, radius) / radius, 2)))
    size = lambda level: F.pow(F.lit(2.0), level) * radius

    def tiles(df: DataFrame, reach: int) -> DataFrame:
        """df with level and the tiles (i, j) of that level up to `reach` around each row."""
        at = df if "level" in df.columns else df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
        for name, c in (("i", x), ("j", y)):
            own = F.floor(F.col(c) / size(F.col("level")))
            at = at.withColumn(name, F.explode(F.sequence(own - reach, own + reach)) if reach else own)
        return at

    dealt = tiles(hits.select(x, y), 0)
    occupied = dealt.select("level", "i", "j").distinct()
    near = tiles(cells.select(key, x, y), 1).join(occupied, ["level", "i", "j"])
    level = near.groupBy(key).agg(F.min("level").alias("level"), F.first(x).alias(x), F.first(y).alias(y))
    # Fine tiles under the coarse tile that a cell's level asks for.
    up = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("up")
    fine = occupied.select(F.col("level").alias("f"), F.col("i").alias("fi"), F.col("j").alias("fj"), up).where("up = 1 or f = 0")
    coarse = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("up")))
    fine = fine.select("f", "fi", "fj", (F.col("f") + F.col("up")).alias("level"), coarse("fi").alias("i"), coarse("fj").alias("j"))
    pick = tiles(level, 3).join(fine, ["level", "i", "j"])
    low = lambda c, i: F.greatest(F.col(i) * size(F.col("f")) - F.col(c), F.col(c) - (F.col(i) + 1) * size(F.col("f")), F.lit(0.0))
    far = lambda c, i: F.greatest(F.abs(F.col(c) - F.col(i) * size(F.col("f"))), F.abs(F.col(c) - (F.col(i) + 1) * size(F.col("f"))))
    pick = pick.select(key, x, y, "f", "fi", "fj", F.hypot(low(x, "fi"), low(y, "fj")).alias("low_"), F.min(F.hypot(far(x, "fi"), far(y, "fj"))).over(Window.partitionBy(key)).alias("bound_"))
    pick = pick.where(F.col("low_") <= F.col("bound_") * (1 + 1e-9)).select(key, F.col(x).alias("cx_"), F.col(y).alias("cy_"), F.col("f").alias("level"), F.col("fi").alias("i"), F.col("fj").alias("j"))
    got = pick.join(dealt, ["level", "i", "j"]).groupBy(key).agg(F.min(F.hypot(F.col("cx_") - F.col(x), F.col("cy_") - F.col(y))).alias("min_dist"))
    return cells.select(key).join(got, key, "left").withColumn("min_dist", F.coalesce("min_dist", F.lit(float("inf"))))


def cover_cells(cells: DataFrame, hits: DataFrame, key: str, radius: float, visible: float = 100.0, obj: str = "obj8", x: str = "x", y: str = "y") -> DataFrame:
    """For each cell: looked (a hit in reach), seen (one that shows objects of `visible` cm), best_obj8, min_dist over all hits."""
    near = radius_join(cells.select(key, x, y), hits.select(x, y, obj), radius, x, y)
    agg = near.groupBy(key).agg(F.bool_or(F.coalesce(F.col(f"r_{obj}") <= visible, F.lit(False))).alias("seen"), F.min(f"r_{obj}").alias("best_obj8"))
    out = cells.join(agg, key, "left").join(nearest_distance(cells, hits, key, radius, x, y), key, "left")
    return out.withColumn("looked", F.col("seen").isNotNull().cast("int")).withColumn("seen", F.coalesce(F.col("seen").cast("int"), F.lit(0)))


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the closed ring; an edge takes its lower end and leaves its upper one."""
    out = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            crosses = (F.lit(y1) > y) != (F.lit(y2) > y)
            left = x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1
            out = out != (crosses & left)
    return out


def in_polygon_column(x: Column, y: Column, ring: Column) -> Column:
    """The same for a ring in a column: an array of (x, y)."""
    n = F.size(ring)

    def step(acc: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        left = x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"]
        return acc != F.coalesce(((a["y"] > y) != (b["y"] > y)) & left, F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), step)


def grid_cells(x0: Column, x1: Column, y0: Column, y1: Column, step: float) -> Column:
    """Array of centres (x, y) of the cells of a box."""
    axis = lambda lo, hi: F.filter(F.transform(F.sequence(F.lit(0), F.floor((hi - lo) / step)), lambda i: lo + (i + 0.5) * step), lambda v: v < hi)
    return F.flatten(F.transform(axis(x0, x1), lambda a: F.transform(axis(y0, y1), lambda b: F.struct(a.alias("x"), b.alias("y")))))


def to_line(x: Column, y: Column, line: list[tuple[float, float]]) -> Column:
    """Least distance to a polyline; null below two points."""
    out = []
    for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False):
        dx, dy = x2 - x1, y2 - y1
        length = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / length)) if length else F.lit(0.0)
        out.append(F.hypot(x - (F.lit(x1) + t * dx), y - (F.lit(y1) + t * dy)))
    return F.least(*out) if len(out) > 1 else out[0] if out else F.lit(None).cast("double")
