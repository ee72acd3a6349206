"""Queries over many rings, lines, signatures and rays from the given tables, with the same in DuckDB SQL by brute force."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, cover, levels, nearest, pyramid, raster
from .survey import SQL, _t, query

_RINGS = "SELECT c_nationkey AS ring, c_custkey AS seq, (c_nationkey * 397 % 1000 + c_custkey * 7919 % 401 - 200)::DOUBLE AS x, (c_nationkey * 211 % 1000 + c_custkey * 104729 % 389 - 190)::DOUBLE AS y FROM customer"
_PLACES = "SELECT o_orderkey AS id, o_orderkey * 7919 % 1201 + 0.25 AS x, o_custkey * 31 % 1187 + 0.75 AS y FROM orders"


def _places(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 7919 % 1201 + 0.25).alias("x"), (F.col("o_custkey") * 31 % 1187 + 0.75).alias("y"))


@query(f"""
WITH r AS ({_RINGS}), p AS ({_PLACES}),
e AS (SELECT ring, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM r WINDOW w AS (PARTITION BY ring ORDER BY seq)),
h AS (SELECT id, ring FROM p JOIN e ON (y1 > y) <> (y2 > y) AND x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT id, ring FROM h""")
def q68_points_in_rings(spark, sf_dir):
    """Each order's place with each nation's ring that holds it; a ring has a corner for each customer."""
    n, k = F.col("c_nationkey"), F.col("c_custkey")
    rings = _t(spark, sf_dir, "customer").select(n.alias("ring"), k.alias("seq"), (n * 397 % 1000 + k * 7919 % 401 - 200).cast("double").alias("x"), (n * 211 % 1000 + k * 104729 % 389 - 190).cast("double").alias("y"))
    return cover.in_rings(_places(spark, sf_dir), "id", rings)


_LINES = "SELECT p_size AS line, p_partkey AS seq, (p_size * 389 % 1000 + p_partkey * 7919 % 211)::DOUBLE AS x, (p_size * 563 % 1000 + p_partkey * 31 % 197)::DOUBLE AS y FROM part"


@query(f"""
WITH l AS ({_LINES}), p AS (SELECT c_custkey AS id, c_custkey * 7919 % 1201 + 0.25 AS x, c_custkey * 31 % 1187 + 0.75 AS y FROM customer),
s AS (SELECT line, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM l WINDOW w AS (PARTITION BY line ORDER BY seq)),
t AS (SELECT id, line, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, coalesce(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / nullif(pow(x2 - x1, 2) + pow(y2 - y1, 2), 0), 0))) AS t FROM p, s WHERE x2 IS NOT NULL),
d AS (SELECT id, line, sqrt(pow(x - (x1 + t * dx), 2) + pow(y - (y1 + t * dy), 2)) AS d FROM t)
SELECT id, round(min(d), 6) AS dist, count(DISTINCT line) AS lines FROM d GROUP BY id""")
def q69_nearest_line(spark, sf_dir):
    """Each customer's distance to the nearest of the lines through the parts of a size."""
    size, k, c = F.col("p_size"), F.col("p_partkey"), F.col("c_custkey")
    lines = _t(spark, sf_dir, "part").select(size.alias("line"), k.alias("seq"), (size * 389 % 1000 + k * 7919 % 211).cast("double").alias("x"), (size * 563 % 1000 + k * 31 % 197).cast("double").alias("y"))
    points = _t(spark, sf_dir, "customer").select(c.alias("id"), (c * 7919 % 1201 + 0.25).alias("x"), (c * 31 % 1187 + 0.75).alias("y"))
    known = lines.groupBy("line").count().where("count > 1").agg(F.count("*").alias("lines"))
    return nearest.nearest_line(points, "id", lines).select("id", F.round("dist", 6).alias("dist")).join(F.broadcast(known))  # one row


_SIGNS = "SELECT p_partkey AS ord, (p_partkey * 7919 % 1000) / 10.0 AS l, (p_partkey * 104729 % 1201) / 10.0 - 60 AS a, (p_partkey * 31 % 1187) / 10.0 - 60 AS b FROM part"


@query(f"""
WITH s AS ({_SIGNS}), i AS (SELECT c_custkey AS id, (c_custkey * 31 % 997) / 10.0 AS l, (c_custkey * 7919 % 1193) / 10.0 - 60 AS a, (c_custkey * 613 % 1181) / 10.0 - 60 AS b FROM customer),
d AS (SELECT id, ord, round(sqrt(pow(sqrt(pow(i.a - s.a, 2) + pow(i.b - s.b, 2)) / 8, 2) + pow(abs(i.l - s.l) / 28, 2)), 9) AS dist FROM i, s)
SELECT id, round(min(dist), 6) AS dist, round(min(dist), 6) = 0 AS same FROM d GROUP BY id""")
def q70_nearest_of_many_signatures(spark, sf_dir):
    """Each customer's distance to the nearest signature; there is one for each part, so they are searched, not compared."""
    tenth = lambda c, m, n, off=0: (F.col(c) * m % n) / 10.0 - off
    lab = lambda c, f: [tenth(c, m, n, off).alias(x) for x, (m, n, off) in zip("Lab", f, strict=True)]
    s = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("name"), *lab("p_partkey", ((7919, 1000, 0), (104729, 1201, 60), (31, 1187, 60))))
    i = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), *lab("c_custkey", ((31, 997, 0), (7919, 1193, 60), (613, 1181, 60))))
    dist = F.round(F.round("dist", 9), 6)  # as in SQL
    return annotate.nearest_signature(i, s, "id", "name", "ord").select("id", dist.alias("dist"), (dist == 0).alias("same"))


#: Terrain from order lines: a height for each of 40 x 40 places, the mean of the quantities there on a slope. Places without a line are missing.
_TERRAIN = "SELECT iy, ix, 200 + 3.0 * ix + 2.0 * iy + avg(q) AS z FROM (SELECT l_orderkey % 40 AS iy, l_partkey % 40 AS ix, l_quantity AS q FROM lineitem) GROUP BY iy, ix"
_CAMERAS = """SELECT s_suppkey AS id, 2 + (s_suppkey * 31 % 350) / 10.0 AS x, 2 + (s_suppkey * 17 % 350) / 10.0 AS y, 420.0 + s_suppkey % 90 AS alt,
 sin(radians(s_suppkey * 37 % 360)) * cos(radians(-15.0 - s_suppkey % 50)) AS e, cos(radians(s_suppkey * 37 % 360)) * cos(radians(-15.0 - s_suppkey % 50)) AS n, sin(radians(-15.0 - s_suppkey % 50)) AS u FROM supplier"""


def _terrain(spark, sf_dir):
    g = _t(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("iy"), (F.col("l_partkey") % 40).alias("ix")).agg(F.avg("l_quantity").alias("q"))
    return g.select("iy", "ix", (200 + 3.0 * F.col("ix") + 2.0 * F.col("iy") + F.col("q")).alias("z"))


def _cameras(spark, sf_dir):
    s, el = F.col("s_suppkey"), F.radians(F.lit(-15.0) - F.col("s_suppkey") % 50)
    az = F.radians(s * 37 % 360)
    return _t(spark, sf_dir, "supplier").select(s.alias("id"), (2 + (s * 31 % 350) / 10.0).alias("x"), (2 + (s * 17 % 350) / 10.0).alias("y"), (F.lit(420.0) + s % 90).alias("alt"), (F.sin(az) * F.cos(el)).alias("e"), (F.cos(az) * F.cos(el)).alias("n"), F.sin(el).alias("u"))


@query(f"""
WITH g AS MATERIALIZED ({_TERRAIN}), r AS ({_CAMERAS}), f AS (SELECT r.*, lift FROM r, (VALUES (0.0), (30.0), (-30.0)) v(lift)),
s AS (SELECT id, lift, d, x + e * d / 10 AS px, y + n * d / 10 AS py, alt + u * d - lift AS h FROM f, (SELECT unnest(range(5, 6001, 5)) AS d)),
c AS (SELECT s.*, floor(px)::BIGINT AS cx, floor(py)::BIGINT AS cy, px - floor(px) AS fx, py - floor(py) AS fy FROM s),
k AS (SELECT id, lift, d, h - (a.z * (1 - fx) * (1 - fy) + b.z * fx * (1 - fy) + e.z * (1 - fx) * fy + j.z * fx * fy) AS gap FROM c LEFT JOIN g a ON a.iy = cy AND a.ix = cx LEFT JOIN g b ON b.iy = cy AND b.ix = cx + 1 LEFT JOIN g e ON e.iy = cy + 1 AND e.ix = cx LEFT JOIN g j ON j.iy = cy + 1 AND j.ix = cx + 1),
o AS (SELECT id, lift, min(d) FILTER (gap > 0) AS up, min(d) FILTER (gap IS NULL) AS out FROM k GROUP BY ALL),
m AS (SELECT k.id, k.lift, min(d) AS step FROM k JOIN o USING (id, lift) WHERE gap <= 0 AND d > up AND (out IS NULL OR d < out) GROUP BY ALL)
SELECT f.id, f.lift::DOUBLE AS lift, m.step::DOUBLE AS step FROM f LEFT JOIN m USING (id, lift)""")
def q71_rays_over_pyramid(spark, sf_dir):
    """Where each camera's ray meets the terrain as it is, raised and lowered, by tiles of greatest heights."""
    out = pyramid.cast_pyramid(_cameras(spark, sf_dir), _terrain(spark, sf_dir), "id", cell=10.0, forks=(0.0, 30.0, -30.0), block=16)
    return out.select("id", "lift", "step")


@query(f"""
WITH q AS ({SQL["q71_rays_over_pyramid"]}), b AS (SELECT id, max(step) FILTER (lift = 0) AS base, max(CASE WHEN step IS NULL THEN 1 ELSE 0 END) AS lost FROM q GROUP BY id)
SELECT id, CASE WHEN base IS NULL THEN 'no_hit' WHEN lost = 1 THEN 'poloho' ELSE 'hit' END AS verdict FROM b""")
def q72_fork_verdicts(spark, sf_dir):
    """Which rays hold when the terrain is raised or lowered: none, some or all of their forks hit."""
    casts = pyramid.cast_pyramid(_cameras(spark, sf_dir), _terrain(spark, sf_dir), "id", cell=10.0, forks=(0.0, 30.0, -30.0), block=16)
    out = raster.verdicts(casts, "id", flat_m=1e9)
    return out.select("id", F.when(F.col("verdict") == "ok", "hit").otherwise(F.col("verdict")).alias("verdict"))


@query(f"""
WITH g AS MATERIALIZED ({_TERRAIN}), v AS (SELECT unnest([225.0, 250.0, 300.0, 340.0, 400.0]) AS level),
c AS (SELECT a.iy, a.ix, a.z AS z0, b.z AS z1, d.z AS z2, e.z AS z3 FROM g a JOIN g b ON b.iy = a.iy AND b.ix = a.ix + 1 JOIN g d ON d.iy = a.iy + 1 AND d.ix = a.ix + 1 JOIN g e ON e.iy = a.iy + 1 AND e.ix = a.ix),
e AS (SELECT iy, ix, true AS across, z0 AS p, z1 AS q FROM c UNION SELECT iy, ix + 1, false, z1, z2 FROM c UNION SELECT iy + 1, ix, true, z3, z2 FROM c UNION SELECT iy, ix, false, z0, z3 FROM c),
x AS (SELECT DISTINCT level, CASE WHEN across THEN ix + (level - p) / (q - p) ELSE ix END AS x, CASE WHEN across THEN iy ELSE iy + (level - p) / (q - p) END AS y FROM e, v WHERE (p >= level) <> (q >= level))
SELECT level::DOUBLE AS level, count(*) AS points, round(sum(x), 5) AS x, round(sum(y), 5) AS y FROM x GROUP BY level""")
def q76_level_lines(spark, sf_dir):
    """The points of all level lines of the terrain from order lines, each once, in sum; their order is held in the tests."""
    lines = levels.level_lines(_terrain(spark, sf_dir), [225.0, 250.0, 300.0, 340.0, 400.0])
    once = lines.select("level", "x", "y").distinct()  # a closed line ends where it began
    return once.groupBy("level").agg(F.count("*").alias("points"), F.round(F.sum("x"), 5).alias("x"), F.round(F.sum("y"), 5).alias("y"))
