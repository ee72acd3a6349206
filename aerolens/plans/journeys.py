"""Whole life cycles as queries: telemetry to the cells of a polygon, telemetry to a summary of scales, pixels to placed tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage, flights, timeseries
from .many import _TERRAIN, _terrain
from .survey import _TURNS, _events, _t, query

#: Where the terrain's corner lies, and degrees from one place to the next.
_LAT0, _LON0, _DEG = 40.0, 73.0, 0.0003
_AXES = ("lat", "lon", "alt", "yaw", "pitch")


def _telemetry_sql(yaw: str, pitch: str) -> str:
    return f"""e AS (SELECT user_id AS video, epoch_us(ts) / 3.6e9 AS t, {_LAT0} - {_DEG} * (2 + (event_id * 17 % 350) / 10.0) AS lat, {_LON0} + {_DEG} * (2 + (event_id * 31 % 350) / 10.0) AS lon, 420.0 + event_id % 90 AS alt, {yaw} AS yaw, {pitch} AS pitch FROM events)"""


def _telemetry(spark, sf_dir, yaw, pitch):
    k = F.col("event_id")
    lat, lon = _LAT0 - _DEG * (2 + (k * 17 % 350) / 10.0), _LON0 + _DEG * (2 + (k * 31 % 350) / 10.0)
    return _events(spark, sf_dir).select(F.col("user_id").alias("video"), (F.col("us") / 3.6e9).alias("t"), lat.alias("lat"), lon.alias("lon"), (420.0 + k % 90).alias("alt"), yaw.cast("double").alias("yaw"), pitch.cast("double").alias("pitch"))


def _poses_sql(step: float) -> str:
    """pose(video, i, t, lat, lon, alt, yaw, pitch) from e."""
    ends = lambda k: ", ".join(f"u.{c} AS {c}{k}" for c in ("t", *_AXES))
    mid = ", ".join(f"CASE WHEN t1 IS NULL OR t1 = t0 THEN {c}0 ELSE {c}0 + ({c}1 - {c}0) * ((t - t0) / (t1 - t0)) END AS {c}" for c in _AXES)
    return f"""d AS (SELECT *, yaw - lag(yaw) OVER w AS d, first_value(yaw) OVER w AS y0 FROM e WINDOW w AS (PARTITION BY video ORDER BY t)),
s AS (SELECT *, d - floor((d + 180) / 360) * 360 AS s FROM d),
u AS MATERIALIZED (SELECT video, t, lat, lon, alt, pitch, y0 + sum(coalesce(CASE WHEN s = -180 AND d > 0 THEN 180 ELSE s END, 0)) OVER (PARTITION BY video ORDER BY t ROWS UNBOUNDED PRECEDING) AS yaw FROM s),
grid AS (SELECT video, i, lo + i * {step} AS t FROM (SELECT video, min(t) AS lo, max(t) AS hi FROM u GROUP BY 1), LATERAL (SELECT unnest(range(0, floor((hi - lo) / {step})::BIGINT + 1)) AS i)),
before AS (SELECT grid.*, {ends(0)} FROM grid ASOF JOIN u ON grid.video = u.video AND grid.t >= u.t),
around AS (SELECT before.*, {ends(1)} FROM before ASOF LEFT JOIN u ON before.video = u.video AND before.t <= u.t),
pose AS MATERIALIZED (SELECT video, i, t, {mid} FROM around)"""


def _ground_sql(x: str, y: str, name: str) -> tuple[str, str]:
    """(joins, height) of the terrain at (x, y)."""
    corners = " ".join(f"LEFT JOIN ground {name}{k} ON {name}{k}.iy = floor({y})::BIGINT + {k // 2} AND {name}{k}.ix = floor({x})::BIGINT + {k % 2}" for k in range(4))
    fx, fy = f"({x} - floor({x}))", f"({y} - floor({y}))"
    return corners, f"({name}0.z * (1 - {fx}) * (1 - {fy}) + {name}1.z * {fx} * (1 - {fy}) + {name}2.z * (1 - {fx}) * {fy} + {name}3.z * {fx} * {fy})"


def _casts_sql(poses: str) -> str:
    """hit(video, i, lat, lon, dist) of the looks of poses that meet the ground; 20 halvings of the step that does."""
    march, z = _ground_sql("px", "py", "g")
    halve, zm = _ground_sql("mx", "my", "b")
    return f"""ground AS MATERIALIZED ({_TERRAIN}),
ray AS MATERIALIZED (SELECT video, i, (lon - {_LON0}) / {_DEG} AS x, ({_LAT0} - lat) / {_DEG} AS y, alt, sin(radians(yaw)) * cos(radians(pitch)) / (cos(radians(lat)) * 111320.0 * {_DEG}) AS e, -cos(radians(yaw)) * cos(radians(pitch)) / (111132.0 * {_DEG}) AS n, sin(radians(pitch)) AS u FROM {poses}),
step AS (SELECT video, i, d, x + e * d AS px, y + n * d AS py, alt + u * d AS h FROM ray, (SELECT unnest(range(5, 6001, 5)) AS d)),
gap AS MATERIALIZED (SELECT video, i, d, h - {z} AS gap FROM step {march}),
seen AS (SELECT video, i, min(d) FILTER (gap > 0) AS up, min(d) FILTER (gap IS NULL) AS out FROM gap GROUP BY ALL),
met AS (SELECT gap.video, gap.i, min(d) AS d FROM gap JOIN seen USING (video, i) WHERE gap <= 0 AND d > up AND (out IS NULL OR d < out) GROUP BY ALL),
half AS (SELECT ray.*, d::DOUBLE - 5 AS lo, d::DOUBLE AS hi, 0 AS k FROM met JOIN ray USING (video, i)
 UNION ALL SELECT video, i, x, y, alt, e, n, u, CASE WHEN alt + u * mid - {zm} > 0 THEN mid ELSE lo END, CASE WHEN alt + u * mid - {zm} > 0 THEN hi ELSE mid END, k + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, x + e * (lo + hi) / 2 AS mx, y + n * (lo + hi) / 2 AS my FROM half WHERE k < 20) m {halve}),
hit AS MATERIALIZED (SELECT video, i, {_LAT0} - (y + n * hi) * {_DEG} AS lat, {_LON0} + (x + e * hi) * {_DEG} AS lon, hi AS dist FROM half WHERE k = 20)"""


def _ground(spark, sf_dir):
    return flights.Ground(_terrain(spark, sf_dir), _LAT0, _LON0, _DEG, _DEG)


_RING = [(39.9975, 73.0015), (39.9968, 73.0085), (39.9945, 73.0062), (39.9912, 73.0091), (39.9921, 73.0022), (39.995, 73.0041)]
_EDGES = ", ".join(f"({a}, {b}, {c}, {d})" for (a, b), (c, d) in zip(_RING, _RING[1:] + _RING[:1], strict=True))
_LATS, _LONS = [p[0] for p in _RING], [p[1] for p in _RING]
_SCALE = f"(cos(radians({sum(_LATS) / len(_LATS)!r})) * 111320.0)"
_CELL, _REACH, _PAD = 60.0, 75.0, 135.0


@query(f"""
WITH RECURSIVE {_telemetry_sql("(event_id * 37 % 360 - 180)::DOUBLE", "-15.0 - event_id % 50")}, {_poses_sql(48.0)}, {_casts_sql("pose")},
f AS (SELECT user_id AS video, epoch_us(ts) / 3.6e9 AS t, 1000.0 + event_id % 2000 AS f FROM events WHERE event_type = 'view'),
focal AS (SELECT p.video, p.i, CASE WHEN count(f.f) >= 3 THEN median(f.f) END AS f FROM pose p LEFT JOIN f ON f.video = p.video AND abs(f.t - p.t) <= 40 GROUP BY ALL),
near AS MATERIALIZED (SELECT lat, lon, dist / f * 800 AS o8 FROM hit JOIN focal USING (video, i) WHERE lat BETWEEN {min(_LATS)} - {_PAD} / 111132.0 AND {max(_LATS)} + {_PAD} / 111132.0 AND lon BETWEEN {min(_LONS)} - {_PAD} / {_SCALE} AND {max(_LONS)} + {_PAD} / {_SCALE}),
lattice AS (SELECT {min(_LATS)} + (i + 0.5) * ({_CELL} / 111132.0) AS lat, {min(_LONS)} + (j + 0.5) * ({_CELL} / {_SCALE}) AS lon FROM range(200) a(i), range(200) b(j)),
ring(y1, x1, y2, x2) AS (VALUES {_EDGES}),
cell AS MATERIALIZED (SELECT lat, lon, (lon - {_LON0}) / {_DEG} AS px, ({_LAT0} - lat) / {_DEG} AS py FROM lattice, ring WHERE lat < {max(_LATS)} AND lon < {max(_LONS)} GROUP BY lat, lon
 HAVING count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1) % 2 = 1),
far AS (SELECT c.lat, c.lon, o8, sqrt(pow((n.lon - c.lon) * {_SCALE}, 2) + pow((n.lat - c.lat) * 111132.0, 2)) AS d FROM cell c LEFT JOIN near n ON true),
sum_ AS (SELECT lat, lon, coalesce(max((d <= {_REACH})::INT), 0) AS looked, coalesce(max((d <= {_REACH} AND coalesce(o8, 1e9) <= 100)::INT), 0) AS seen, min(o8) FILTER (d <= {_REACH}) AS best, min(d) AS low FROM far GROUP BY ALL)
SELECT round(lat, 7) AS lat, round(lon, 7) AS lon, round({_ground_sql("px", "py", "t")[1]}, 4) AS alt_m, looked, seen, round(best, 3) AS best_obj8_cm, round(low, 3) AS min_dist_m FROM sum_ JOIN cell USING (lat, lon) {_ground_sql("px", "py", "t")[0]}""")
def q73_polygon_journey(spark, sf_dir):
    """Telemetry to looks at the ground to the cells of a polygon, with the scale of the look's own sample."""
    k = F.col("event_id")
    telemetry, ground = _telemetry(spark, sf_dir, k * 37 % 360 - 180, -15.0 - k % 50), _ground(spark, sf_dir)
    focals = _events(spark, sf_dir).where("event_type = 'view'").select(F.col("user_id").alias("video"), (F.col("us") / 3.6e9).alias("t"), (1000.0 + k % 2000).alias("f"))
    samples = flights.scale_samples(telemetry, focals, ground, 48.0, 40.0)
    hits = flights.polygon_hits(telemetry, ground, _RING, samples, _PAD, 48.0)
    out = flights.polygon_cells(hits, ground, _RING, _CELL, _REACH)
    return out.select(F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.round("alt_m", 4).alias("alt_m"), "looked", "seen", F.round("best_obj8_cm", 3).alias("best_obj8_cm"), F.round("min_dist_m", 3).alias("min_dist_m"))


_PAIRS = _TURNS.replace("user_id", "video").replace("SELECT video, epoch_us(ts) / 3.6e9 AS t, (event_id * 37 % 11)::DOUBLE AS yaw, (event_id % 3)::DOUBLE AS pitch FROM events", "SELECT * FROM tele")


@query(f"""
WITH RECURSIVE {_telemetry_sql("(event_id * 37 % 11)::DOUBLE", "-(event_id % 3)::DOUBLE - 20").replace("e AS", "tele AS", 1)},
pairs AS (WITH RECURSIVE {_PAIRS}, c AS (SELECT video, min(i) AS i FROM m GROUP BY 1 UNION ALL SELECT c.video, a.nx FROM c JOIN after a ON a.video = c.video AND a.i = c.i WHERE a.nx IS NOT NULL)
 SELECT c.video, c.i AS k, m.t AS t0, x.yaw AS ya, x.pitch AS pa, y.yaw AS yb, y.pitch AS pb FROM c JOIN m ON m.video = c.video AND m.i = c.i JOIN v x ON x.video = c.video AND x.i = c.i JOIN v y ON y.video = c.video AND y.i = c.i + 1),
mid0 AS (SELECT p.*, t0 + 0.25 AS tm, u.t AS ta, u.pitch AS pl FROM pairs p ASOF JOIN tele u ON p.video = u.video AND p.t0 + 0.25 >= u.t),
mid AS (SELECT q.*, CASE WHEN u.t IS NULL OR u.t = ta THEN pl ELSE pl + (u.pitch - pl) * ((tm - ta) / (u.t - ta)) END AS pm FROM mid0 q ASOF LEFT JOIN tele u ON q.video = u.video AND q.tm <= u.t),
turn AS (SELECT video, tm AS t, yb - ya AS dyaw, pb - pa AS dpitch, pm, -30.0 - (round(t0 * 2)::BIGINT + video) % 40 AS dx, 25.0 + (round(t0 * 2)::BIGINT + video * 3) % 30 AS dy FROM mid),
focals AS (SELECT video, t, f FROM (SELECT video, t, CASE WHEN abs(dyaw) > 2 * abs(dpitch) THEN -dx / nullif(radians(dyaw) * cos(radians(pm)), 0) WHEN abs(dpitch) > 2 * abs(dyaw) THEN dy / nullif(radians(dpitch), 0) END AS f FROM turn) WHERE f BETWEEN 1000 AND 20000),
e AS (SELECT * FROM tele), {_poses_sql(48.0)},
focal AS MATERIALIZED (SELECT p.video, p.i, CASE WHEN count(f.f) >= 3 THEN median(f.f) END AS f FROM pose p LEFT JOIN focals f ON f.video = p.video AND abs(f.t - p.t) <= 60 GROUP BY ALL),
asked AS MATERIALIZED (SELECT pose.* FROM pose JOIN focal USING (video, i) WHERE f IS NOT NULL), {_casts_sql("asked")},
done AS (SELECT focal.video, focal.i, f, dist / f * 100 AS gsd FROM focal LEFT JOIN hit USING (video, i))
SELECT video, count(*) AS n, round(count(*) FILTER (f IS NULL) / count(*), 6) AS no_focal, round(count(*) FILTER (f IS NOT NULL AND gsd IS NULL) / count(*), 6) AS sky, round(median(gsd), 4) AS gsd_med, round(quantile_cont(gsd, 0.9), 4) AS gsd_p90,
 round(median(gsd) * 8, 3) AS obj8_med, CASE WHEN count(gsd) > 0 THEN round(count(*) FILTER (gsd <= 2.125) / count(*), 6) END AS shows_17 FROM done GROUP BY video""")
def q74_scale_journey(spark, sf_dir):
    """Telemetry to pan pairs, focal lengths, scales around each sample, looks at the ground and one row a video."""
    k = F.col("event_id")
    telemetry = _telemetry(spark, sf_dir, k * 37 % 11, -(k % 3) - 20)
    pairs = timeseries.pan_pairs(telemetry, "video")
    half = F.round(F.col("t0") * 2).cast("long")
    shifts = pairs.select("video", "t0", (-30.0 - (half + F.col("video")) % 40).alias("dx"), (25.0 + (half + F.col("video") * 3) % 30).alias("dy"))
    focals = flights.focal_series(telemetry, shifts)
    out = coverage.summarize(flights.scale_samples(telemetry, focals, _ground(spark, sf_dir), 48.0, 60.0))
    return out.select("video", "n", *[F.round(c, d).alias(c) for c, d in (("no_focal", 6), ("sky", 6), ("gsd_med", 4), ("gsd_p90", 4), ("obj8_med", 3), ("shows_17", 6))])


@query()
def q75_track_journey(spark, sf_dir):
    """Pixels to blobs of rare colours to tracks with the place of the nearest telemetry row. Its state is ordered, so there is no SQL."""
    li = _t(spark, sf_dir, "lineitem")
    frame, block = F.col("l_orderkey") % 60, F.col("l_partkey") % 90
    spot = F.explode(F.sequence(F.lit(0), F.lit(8)))
    # Each line is a patch of 3 x 3 pixels on its order's frame; patches of returned lines have a colour of their own.
    rare = F.col("l_returnflag") == "R"
    px = li.select(frame.cast("string").alias("frame"), block.alias("x0"), (F.col("l_suppkey") % 70).alias("y0"), F.when(rare & (F.col("l_linenumber") == 7), 200).otherwise(60).alias("L"), F.when(rare & (F.col("l_linenumber") == 7), 90 + F.col("l_partkey") % 4 * 30).otherwise(128).cast("int").alias("a"), spot.alias("k"))
    px = px.groupBy("frame", (F.col("y0") * 4 + F.floor(F.col("k") / 3)).cast("int").alias("y"), (F.col("x0") * 4 + F.col("k") % 3).cast("int").alias("x")).agg(F.max("L").alias("L"), F.max("a").alias("a")).withColumn("b", F.lit(128))
    names = px.select("frame").distinct().withColumn("n", F.col("frame").cast("int"))
    frames = names.select("frame", F.concat(F.lit("v"), F.floor(F.col("n") / 20).cast("string")).alias("video"), (F.col("n") % 20).cast("double").alias("t"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    telemetry = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("v"), (F.col("s_suppkey") % 3).cast("string")).alias("video"), (F.col("s_suppkey") % 97 / 4).alias("t"), (39.0 + F.col("s_suppkey") / 100).alias("lat"), (73.0 + F.col("s_nationkey") / 100).alias("lon"), F.col("s_acctbal").alias("alt"))
    return flights.placed_tracks(px, frames, telemetry, density=0.01, tile=128)
