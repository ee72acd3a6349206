"""Points in many polygons, by a raster cover of each ring.

A ring is laid over square tiles of a power of two, so that some thirty cover its longer side. Tiles that no edge
comes near lie wholly inside or outside, which is told once for each; a point in such a tile meets no edge at all.
Points in the other tiles are tested against the edges that reach their row of tiles, and no others: the edges that pass
a height are put in order once for all points of that height, so points and edges do not meet in pairs. Points of one place are one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..session import drop_written, written

#: Tiles along the longer side of a ring, about.
ACROSS = 32
#: Places of a row of tiles that a task tests at a time, about.
PLACES = 100_000


def _tile(c: Column, level: Column) -> Column:
    return F.floor(c / F.pow(F.lit(2.0), level))


def ring_edges(rings: DataFrame, ring: str = "ring", seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """(ring, level, x1, y1, x2, y2) of all edges of closed rings (ring, seq, x, y); a point without a place is left out."""
    there = rings.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(ring).alias("ring"), F.col(seq).alias("seq"), F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"))
    w, all_ = Window.partitionBy("ring").orderBy("seq"), Window.partitionBy("ring")
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = there.withColumn("x2", F.coalesce(F.lead("x1").over(w), first("x1"))).withColumn("y2", F.coalesce(F.lead("y1").over(w), first("y1")))
    side = F.greatest(F.max("x1").over(all_) - F.min("x1").over(all_), F.max("y1").over(all_) - F.min("y1").over(all_))
    level = F.coalesce(F.ceil(F.log2(F.nullif(side, F.lit(0.0)) / ACROSS)), F.lit(0)).cast("int")
    return out.select("ring", level.alias("level"), "x1", "y1", "x2", "y2")


def _rows(edges: DataFrame) -> DataFrame:
    """Edges with each row j of tiles that they reach; a hair more, so that rounding leaves out none."""
    slack = F.pow(F.lit(2.0), F.col("level")) * 1e-9
    lo, hi = (_tile(f(F.col("y1"), F.col("y2")) + s * slack, F.col("level")) for f, s in ((F.least, -1), (F.greatest, 1)))
    return edges.withColumn("j", F.explode(F.sequence(lo, hi)))


def _touched(rows: DataFrame) -> DataFrame:
    """(ring, level, i, j) of all tiles that an edge reaches."""
    size = F.pow(F.lit(2.0), F.col("level"))
    lean = F.coalesce(F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), F.lit(0.0))
    flat = F.col("y1") == F.col("y2")
    at = lambda edge: F.col("x1") + (F.greatest(F.least(edge, F.greatest("y1", "y2")), F.least("y1", "y2")) - F.col("y1")) * lean
    a, b = F.when(flat, F.col("x1")).otherwise(at(F.col("j") * size)), F.when(flat, F.col("x2")).otherwise(at((F.col("j") + 1) * size))
    span = F.sequence(_tile(F.least(a, b) - size * 1e-9, F.col("level")), _tile(F.greatest(a, b) + size * 1e-9, F.col("level")))
    return rows.withColumn("i", F.explode(span)).select("ring", "level", "i", "j").distinct()


def _crossing(y: Column) -> Column:
    """Where the edge passes the height y; null if it does not. An edge takes its lower end and leaves its upper one."""
    passes = (F.col("y1") > y) != (F.col("y2") > y)
    return F.when(passes, (y - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + F.col("x1"))


def cover(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tiles, rows): tiles (ring, level, i, j, inside), where inside is null if edges decide and tiles outside are left out;
    rows are the edges by row of tiles."""
    rows = written(_rows(edges), "rows")
    touched = _touched(rows)
    middle = (F.col("j") + F.lit(0.5)) * F.pow(F.lit(2.0), F.col("level"))
    cuts = rows.select("ring", "level", "j", _crossing(middle).alias("at")).where("at is not null")
    # Between one cut and the next, in order, the row's middle is inside at every second one.
    w = Window.partitionBy("ring", "level", "j").orderBy("at")
    spans = cuts.withColumn("n", F.row_number().over(w)).withColumn("end", F.lead("at").over(w)).where("n % 2 = 1 and end is not null")
    size = F.pow(F.lit(2.0), F.col("level"))
    lo, hi = F.ceil(F.col("at") / size - 0.5), F.floor(F.col("end") / size - 0.5)
    inner = spans.where(lo <= hi).select("ring", "level", F.explode(F.sequence(lo, hi)).alias("i"), "j").distinct()
    tiles = inner.join(touched, ["ring", "level", "i", "j"], "left_anti").withColumn("inside", F.lit(True)).unionByName(touched.withColumn("inside", F.lit(None).cast("boolean")))
    return written(tiles, "tiles"), rows


def _odd(key: tuple[pa.Scalar, ...], places: pa.Table, edges: pa.Table) -> pa.Table:
    """The places of a row of tiles that lie to the left of an odd number of a ring's edges."""
    px, py = (places.column(c).to_numpy() for c in ("px", "py"))
    x1, y1, x2, y2 = (edges.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))
    order = np.argsort(py, kind="stable")
    heights, start = np.unique(py[order], return_index=True)
    odd = np.zeros(len(px), bool)
    for y, mine in zip(heights, np.split(order, start[1:]), strict=True):
        passes = np.flatnonzero((y1 > y) != (y2 > y))
        at = (y - y1[passes]) * ((x2[passes] - x1[passes]) / (y2[passes] - y1[passes])) + x1[passes]
        if len(mine) > 1:
            odd[mine] = (len(at) - np.searchsorted(np.sort(at), px[mine], "right")) % 2 == 1
        else:
            odd[mine] = np.count_nonzero(at > px[mine]) % 2 == 1
    return pa.table([px[odd], py[odd], pa.array([key[0].as_py()] * int(odd.sum()), key[0].type)], names=["px", "py", "ring"])


def in_rings(points: DataFrame, key: str, rings: DataFrame, x: str = "x", y: str = "y", ring: str = "ring", seq: str = "seq") -> DataFrame:
    """(key, ring) of each point and each ring that holds it, by the even-odd rule.

    rings: (ring, seq, x, y), closed from the last point to the first. An edge takes its lower end and leaves its upper one, and
    a point counts what lies strictly to its right. Points without a place lie in none; a ring of fewer than three points holds nothing.
    """
    tiles, rows = cover(ring_edges(rings, ring, seq))
    levels = [r[0] for r in tiles.select("level").distinct().collect()]  # powers of two of ring sizes: few
    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("point"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    places = own.select("px", "py").distinct()
    places = places.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    places = places.withColumn("i", _tile(F.col("px"), F.col("level"))).withColumn("j", _tile(F.col("py"), F.col("level")))
    met = written(places.join(tiles, ["level", "i", "j"]).select("ring", "level", "j", "px", "py", "inside"), "met")
    at = ["ring", "level", "j"]
    near = met.where("inside is null").select(*at, "px", "py")
    # A row with many places is tested by several tasks, each at heights of its own.
    parts = near.groupBy(*at).agg(F.ceil(F.count("*") / PLACES).alias("parts"))
    near = near.join(parts, at).withColumn("part", F.pmod(F.xxhash64("py"), "parts"))
    cut = rows.join(parts, at).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(*at, "part", "x1", "y1", "x2", "y2")
    kind = StructType([StructField("px", DoubleType()), StructField("py", DoubleType()), StructField("ring", met.schema["ring"].dataType)])
    tested = near.groupBy(*at, "part").cogroup(cut.groupBy(*at, "part")).applyInArrow(_odd, kind)
    out = met.where("inside").select("px", "py", "ring").unionByName(tested)
    out = written(own.join(out, ["px", "py"]).select(F.col("point").alias(key), F.col("ring").alias(ring)), "in-rings")
    drop_written(tiles, rows, met)
    return out
