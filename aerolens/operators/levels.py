"""Level lines of a terrain of any size: crossings of grid edges, joined from cell to cell and put in order by jumping pointers.

A grid edge is crossed by a level if one end is below it and the other is not. Within a cell each line goes from one crossed
edge to another with the higher ground on its left, so a crossing has one successor at most, whichever tile or task its cells are in. Lines
are then put in order for all cells at once: every crossing looks twice as far ahead each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_written, written

#: Edges of a cell around it: lower, right, upper, left, as the ends that they join, counted against the clock with y upwards.
_ENDS = ((0, 1), (1, 2), (2, 3), (3, 0))


def crossings(grid: DataFrame, levels: list[float]) -> DataFrame:
    """(level, at, next, x, y): each crossing with the one that follows on its line and its own place; a line's last crossing follows nothing and has no row.

    at and next are (iy, ix, across): the edge from that grid point along x, or along y. A cell that lacks a height has no lines; a line goes apart
    over two higher corners, that is, of a cell's four crossings those around each lower corner are joined.
    """
    corner = lambda dy, dx: grid.select((F.col("iy") - dy).alias("iy"), (F.col("ix") - dx).alias("ix"), F.col("z").cast("double").alias(f"z{dy}{dx}")).where("z" + f"{dy}{dx} is not null")
    c = corner(0, 0).join(corner(0, 1), ["iy", "ix"]).join(corner(1, 0), ["iy", "ix"]).join(corner(1, 1), ["iy", "ix"])
    cells = c.select("iy", "ix", F.array("z00", "z01", "z11", "z10").alias("z"), F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level"))
    cells = cells.where((F.array_min("z") < F.col("level")) & (F.array_max("z") >= F.col("level")))
    up = [F.col("z")[k] >= F.col("level") for k in range(4)]
    iy, ix = F.col("iy"), F.col("ix")
    edge = lambda y, x, across: F.struct(y.cast("long").alias("iy"), x.cast("long").alias("ix"), F.lit(across).alias("across"))
    edges = [edge(iy, ix, True), edge(iy, ix + 1, False), edge(iy + 1, ix, True), edge(iy, ix, False)]
    share = lambda k: (F.col("level") - F.col("z")[k[0]]) / (F.col("z")[k[1]] - F.col("z")[k[0]])
    px = [ix + share((0, 1)), (ix + 1).cast("double"), ix + share((3, 2)), ix.cast("double")]
    py = [iy.cast("double"), iy + share((1, 2)), (iy + 1).cast("double"), iy + share((0, 3))]
    # Going round, a line enters where the ground falls below the level and leaves at the next edge where it rises again.
    falls, rises = ([up[a] & ~up[b] if way else ~up[a] & up[b] for a, b in _ENDS] for way in (True, False))
    out = []
    for k in range(4):
        leave = F.lit(None).cast(edges_type())
        for ahead in (3, 2, 1):
            leave = F.when(rises[(k + ahead) % 4], edges[(k + ahead) % 4]).otherwise(leave)
        out.append(F.when(falls[k], F.struct(edges[k].alias("at"), leave.alias("next"), px[k].alias("x"), py[k].alias("y"))))
    ends = F.explode(F.array_compact(F.array(*out)))
    return cells.select("level", ends.alias("s")).select("level", "s.*")


def edges_type() -> str:
    return "struct<iy: bigint, ix: bigint, across: boolean>"


def level_lines(grid: DataFrame, levels: list[float], thin: int = 1) -> DataFrame:
    """(level, line, i, x, y): the points of all level lines of a grid (iy, ix, z), in order, with the higher ground on the left where y grows upwards.

    line is the number of the edge that a line begins at, a closed one at its least edge, where it also ends. thin keeps every thin-th point of
    each line from its first. Lines of which a single point is left are left out.
    """
    seg = written(crossings(grid, levels), "segments")
    # The last crossing of an open line is nobody's start; its place is that of the edge that it lies on.
    node = lambda c: F.struct("level", c).alias("n")
    starts = seg.select(node("at"), F.struct("level", F.col("next").alias("at")).alias("next"))
    last = seg.select(F.struct("level", F.col("next").alias("at")).alias("n")).join(starts.select("n"), "n", "left_anti").distinct()
    chain = written(starts.unionByName(last.select("n", F.lit(None).cast(starts.schema["next"].dataType).alias("next"))), "chain")
    # far: where 2^r steps lead; steps: how many until the end; low: the least edge on the way. A closed line never ends, and its low comes to rest.
    now = written(chain.select("n", F.col("next").alias("far"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("n").alias("low")), "jumps")
    made = [seg, chain, now]
    while True:
        ahead = now.select(F.col("n").alias("far"), F.col("far").alias("far2"), F.col("steps").alias("steps2"), F.col("low").alias("low2"))
        nxt = now.join(ahead, "far", "left").select("n", F.col("far2").alias("far"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.least("low", "low2").alias("low"), ((F.col("low2") < F.col("low")) | (F.col("far").isNotNull() & F.col("far2").isNull())).alias("moved"))
        nxt = written(nxt, "jumps")
        made.append(nxt)
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            break
    # Closed lines are opened at their least edge, and the steps to that cut are counted the same way.
    closed = now.where("far is not null").select("n", F.col("low").alias("head"))
    cut = chain.join(closed, "n").select("n", "head", F.when(F.col("next") == F.col("head"), None).otherwise(F.col("next")).alias("far"))
    ring = written(cut.select("n", "head", "far", F.when(F.col("far").isNull(), 0).otherwise(1).cast("long").alias("steps")), "rings")
    made.append(ring)
    while not ring.where("far is not null").isEmpty():
        ahead = ring.select(F.col("n").alias("far"), F.col("far").alias("far2"), F.col("steps").alias("steps2"))
        ring = written(ring.join(ahead, "far", "left").select("n", "head", F.col("far2").alias("far"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")), "rings")
        made.append(ring)
    # Of an open line every crossing knows how far the end is; the line goes by its end, and its first crossing is the farthest.
    opened = now.where("far is null").select("n", "steps")
    tail = _ends(chain, opened, made)
    whole = tail.unionByName(ring.select("n", F.col("head").alias("line"), "steps", F.lit(True).alias("closed")))
    size = F.max("steps").over(Window.partitionBy("line"))
    ranked = whole.withColumn("size", size).withColumn("i", F.col("size") - F.col("steps"))
    place = _places(grid, ranked)
    again = place.where("closed and i = 0").withColumn("i", F.col("size") + 1)
    all_ = place.unionByName(again).where(f"size > 0 and i % {int(thin)} = 0")
    all_ = all_.withColumn("left", F.count("*").over(Window.partitionBy("line"))).where("left > 1")
    out = written(all_.select("n.level", F.struct("line.at.iy", "line.at.ix", "line.at.across").alias("line"), (F.col("i") / thin).cast("long").alias("i"), "x", "y"), "lines")
    drop_written(*made)
    return out


def in_degrees(lines: DataFrame, lat0: float, lon0: float, dlat: float, dlon: float) -> DataFrame:
    """(level, line, i, lat, lon) with six decimals: lines of a grid whose corner (0, 0) lies at (lat0, lon0), northern rows first."""
    return lines.select("level", "line", "i", F.round(lat0 - F.col("y") * dlat, 6).alias("lat"), F.round(lon0 + F.col("x") * dlon, 6).alias("lon"))


def _ends(chain: DataFrame, opened: DataFrame, made: list) -> DataFrame:
    """(n, line, steps, closed) of open lines: line is the end of each crossing's way, found by the same jumps."""
    now = written(chain.join(opened, "n").select("n", F.coalesce("next", "n").alias("line"), "steps"), "ends")
    made.append(now)
    while True:
        ahead = now.select(F.col("n").alias("line"), F.col("line").alias("on"))
        nxt = written(now.join(ahead, "line").select("n", F.col("on").alias("line"), "steps", (F.col("on") != F.col("line")).alias("moved")), "ends")
        made.append(nxt)
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return now.withColumn("closed", F.lit(False))


def _places(grid: DataFrame, ranked: DataFrame) -> DataFrame:
    """ranked with the place (x, y) of each crossing on its edge."""
    own = ranked.select("*", F.col("n.at.iy").alias("iy"), F.col("n.at.ix").alias("ix"), F.when(F.col("n.at.across"), F.col("n.at.iy")).otherwise(F.col("n.at.iy") + 1).alias("jy"), F.when(F.col("n.at.across"), F.col("n.at.ix") + 1).otherwise(F.col("n.at.ix")).alias("jx"))
    a = grid.select(F.col("iy").cast("long"), F.col("ix").cast("long"), F.col("z").cast("double").alias("za"))
    b = grid.select(F.col("iy").cast("long").alias("jy"), F.col("ix").cast("long").alias("jx"), F.col("z").cast("double").alias("zb"))
    t = (F.col("n.level") - F.col("za")) / (F.col("zb") - F.col("za"))
    move: Column = F.when(F.col("n.at.across"), t).otherwise(0.0)
    return own.join(a, ["iy", "ix"]).join(b, ["jy", "jx"]).withColumn("x", F.col("ix") + move).withColumn("y", F.col("iy") + t - move).drop("iy", "ix", "jy", "jx", "za", "zb")
