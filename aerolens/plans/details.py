"""Queries of the operators that survey.py leaves out, over whole tables, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules, scalars, text
from ..operators import annotate, catalog, coverage, frames, ingest, probe, raster, spatial, timeseries
from ..sources import sinks, tables
from ..streaming import increments
from .survey import _events, _t, query


@query("""
WITH t AS (SELECT p_partkey AS task, lpad((p_partkey % 700)::VARCHAR, 4, '0') AS token FROM part),
f AS (SELECT 'data/day' || c_nationkey || '/DJI_' || lpad((c_custkey % 600)::VARCHAR, 4, '0') || '_' || c_custkey || '.MP4.gps.tsv' AS path FROM customer)
SELECT task, token, min(path) AS path, CASE WHEN min(path) IS NULL THEN 'miss' ELSE 'there' END AS verdict FROM t LEFT JOIN f ON path LIKE '%/DJI_' || token || '%' GROUP BY ALL""")
def q41_sidecars(spark, sf_dir):
    tasks = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("task"), F.lpad((F.col("p_partkey") % 700).cast("string"), 4, "0").alias("token"))
    c = _t(spark, sf_dir, "customer")
    files = c.select(F.format_string("data/day%s/DJI_%s_%s.MP4.gps.tsv", "c_nationkey", F.lpad((F.col("c_custkey") % 600).cast("string"), 4, "0"), "c_custkey").alias("path"))
    found = tables.sidecars(files, tasks, "token")
    return raster.with_misses(found, tasks.select("task", F.lit("there").alias("verdict")), "task").select("task", "token", "path", "verdict")


_STEPS = """e AS (SELECT user_id, epoch_us(ts) / 3.6e9 AS t, (event_id * 37 % 11)::DOUBLE AS yaw, (event_id % 5)::DOUBLE AS pitch FROM events),
s AS (SELECT user_id, min(t) AS t0, min(t) + 40 AS t1 FROM e GROUP BY 1),
g AS (SELECT user_id, k, t0 + k * 0.125 AS t FROM s, LATERAL (SELECT unnest(range(0, 2 * floor((t1 - t0) / 0.25)::BIGINT + 1)) AS k)),
p AS (SELECT g.*, e.t AS ta, e.yaw AS ya, e.pitch AS pa FROM g ASOF JOIN e ON g.user_id = e.user_id AND g.t >= e.t),
n AS (SELECT p.*, e.t AS tb, e.yaw AS yb, e.pitch AS pb FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.t <= e.t),
v AS (SELECT user_id, k, t, CASE WHEN tb IS NULL OR tb = ta THEN ya ELSE ya + (yb - ya) * ((t - ta) / (tb - ta)) END AS yaw, CASE WHEN tb IS NULL OR tb = ta THEN pa ELSE pa + (pb - pa) * ((t - ta) / (tb - ta)) END AS pitch FROM n),
d AS (SELECT user_id, k, t AS a, lead(t, 2) OVER w AS b, lead(yaw, 2) OVER w - yaw AS dyaw, lead(pitch, 2) OVER w - pitch AS dpitch, lead(pitch) OVER w AS pitch FROM v WINDOW w AS (PARTITION BY user_id ORDER BY k)),
i AS (SELECT user_id, k // 2 AS i, a, dyaw, dpitch, pitch, (user_id * 31 + k // 2 * 7) % 23 <> 22 OR k < 60 AS readable, -30.0 - (user_id + k // 2) % 40 AS dx, 25.0 + (user_id * 3 + k // 2) % 30 AS dy FROM d WHERE k % 2 = 0 AND b IS NOT NULL),
r AS (SELECT *, min(CASE WHEN NOT readable THEN i END) OVER (PARTITION BY user_id) AS stop FROM i),
f AS (SELECT *, CASE WHEN abs(dyaw) > 0.2 AND abs(dyaw) > 2 * abs(dpitch) THEN -dx / nullif(radians(dyaw) * cos(radians(pitch)), 0) WHEN abs(dpitch) > 0.2 THEN dy / nullif(radians(dpitch), 0) END AS f FROM r WHERE stop IS NULL OR i < stop)"""


def _focal_steps(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", (F.col("us") / 3.6e9).alias("t"), (F.col("event_id") * 37 % 11).cast("double").alias("yaw"), (F.col("event_id") % 5).cast("double").alias("pitch"))
    spans = e.groupBy("user_id").agg(F.min("t").alias("t0")).withColumn("t1", F.col("t0") + 40)
    i, u = F.col("i"), F.col("user_id")
    pairs = timeseries.step_pairs(e, spans, "user_id")
    pairs = timeseries.until_failure(pairs, "user_id", "i", ((u * 31 + i * 7) % 23 != 22) | (i < 30))
    dx, dy = -30.0 - (u + i) % 40, 25.0 + (u * 3 + i) % 30
    return pairs.withColumn("f", scalars.focal_from_step(dx, dy, F.col("dyaw"), F.col("dpitch"), F.col("pitch"), 0.2))


@query(f"WITH {_STEPS} SELECT user_id, i, round(a, 6) AS a, round(f, 4) AS f, coalesce(f BETWEEN 1000 AND 20000, false) AS believed FROM f")
def q42_focal_steps(spark, sf_dir):
    return _focal_steps(spark, sf_dir).select("user_id", "i", F.round("a", 6).alias("a"), F.round("f", 4).alias("f"), scalars.in_focal_band(F.col("f")).alias("believed"))


@query(f"WITH {_STEPS} SELECT user_id, count(*) AS n, round(quantile_cont(f, 0.5), 4) AS med, round(quantile_cont(f, 0.25), 4) AS q25, round(quantile_cont(f, 0.75), 4) AS q75 FROM f WHERE f > 0 GROUP BY 1")
def q43_focal_quartiles(spark, sf_dir):
    out = timeseries.focal_quartiles(_focal_steps(spark, sf_dir), "user_id")
    return out.select("user_id", "n", *[F.round(c, 4).alias(c) for c in ("med", "q25", "q75")])


_LABEL = """CASE s_suppkey % 5 WHEN 0 THEN 'scan-' || lpad((s_suppkey * 7919 % 240000)::VARCHAR, 6, '0') WHEN 1 THEN 'heli C' || lpad((s_suppkey % 50)::VARCHAR, 4, '0') || '/x'
 WHEN 2 THEN 'DJI_20260811' || lpad((s_suppkey * 7919 % 240000)::VARCHAR, 6, '0') || '_0001_Z.JPG, see it' WHEN 3 THEN 'DJI_20260811' || lpad((s_suppkey * 7919 % 240000)::VARCHAR, 6, '0') || ' cut' ELSE 'DJI_20260811' || lpad((s_suppkey * 7919 % 240000)::VARCHAR, 6, '0') || '_0001_Z' END"""
_SOURCE = """CASE WHEN c_custkey % 3 = 0 THEN 'helicopter/C' || lpad((c_custkey % 60)::VARCHAR, 4, '0') || '.MP4' ELSE 'drone/d' || c_nationkey || '/DJI_20260811' || lpad((c_custkey * 7919 % 240000)::VARCHAR, 6, '0') || '_0001_Z' || CASE WHEN c_custkey % 2 = 0 THEN '.JPG' ELSE '.MP4' END END"""


@query(f"""
WITH l AS (SELECT s_suppkey AS point, {_LABEL} AS label FROM supplier), c AS (SELECT DISTINCT {_SOURCE} AS path FROM customer),
t AS (SELECT point, unnest(list_distinct(list_concat(regexp_extract_all(label, 'DJI_[0-9]{{14}}_[0-9]{{4}}_Z(\\.JPG)?'), regexp_extract_all(label, 'C[0-9]{{4}}'), list_transform(regexp_extract_all('^' || label || '$', '[^0-9][0-9]{{6}}[^0-9]'), lambda x: x[2:7]),
 list_transform(list_filter(regexp_extract_all(label || '$', 'DJI_[0-9]{{14}}[^0-9].{{0,6}}'), lambda x: NOT regexp_matches(x, 'DJI_[0-9]{{14}}_[0-9]{{4}}_Z')), lambda x: x[13:18])))) AS token FROM l)
SELECT DISTINCT point, path FROM t JOIN c ON contains(regexp_extract(path, '[^/]*$'), replace(token, '.JPG', '')) AND (path LIKE '%.JPG') = (token LIKE '%.JPG')""")
def q44_source_paths(spark, sf_dir):
    labels = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point"), F.expr(_LABEL.replace("VARCHAR", "STRING")).alias("label"))
    sources = _t(spark, sf_dir, "customer").select(F.expr(_SOURCE.replace("VARCHAR", "STRING")).alias("path"))
    return catalog.source_paths(labels, "point", "label", sources)


@query("""
WITH p AS (SELECT (l_orderkey % 40)::VARCHAR AS frame, l_partkey % 200 AS x, l_suppkey % 90 AS y, floor(l_quantity * 5) AS L, floor(l_discount * 1000) + 100 AS a, floor(l_tax * 1000) + 90 AS b, l_linenumber >= 5 AS rare FROM lineitem),
b AS (SELECT p_partkey AS box, (p_partkey % 40)::VARCHAR AS frame, greatest(0, p_partkey * 7 % 210 - 5) AS x0, greatest(0, p_partkey * 11 % 95 - 3) AS y0, p_size % 20 AS w, p_size % 13 AS h FROM part),
j AS (SELECT * FROM b JOIN p USING (frame) WHERE x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h),
m AS (SELECT box, count(*) FILTER (rare) AS n, median(L) AS la, median(a) AS aa, median(b) AS ba, median(L) FILTER (rare) AS lr, median(a) FILTER (rare) AS ar, median(b) FILTER (rare) AS br, trunc(avg(L))::INT AS ml FROM j GROUP BY 1)
SELECT box, round(CASE WHEN n >= 3 THEN lr ELSE la END * 100 / 255, 6) AS "L", round(CASE WHEN n >= 3 THEN ar ELSE aa END - 128, 6) AS a, round(CASE WHEN n >= 3 THEN br ELSE ba END - 128, 6) AS b,
 CASE WHEN n >= 3 THEN 'маска' WHEN n IS NOT NULL THEN 'bbox' ELSE 'нет' END AS source, ml AS mean_l FROM (SELECT box FROM b) LEFT JOIN m USING (box)""")
def q45_box_colours(spark, sf_dir):
    li, pa = _t(spark, sf_dir, "lineitem"), F.col("p_partkey")
    pixels = li.select((F.col("l_orderkey") % 40).cast("string").alias("frame"), (F.col("l_partkey") % 200).alias("x"), (F.col("l_suppkey") % 90).alias("y"), F.floor(F.col("l_quantity") * 5).alias("L"), (F.floor(F.col("l_discount") * 1000) + 100).alias("a"), (F.floor(F.col("l_tax") * 1000) + 90).alias("b"), (F.col("l_linenumber") >= 5).alias("rare"))
    boxes = _t(spark, sf_dir, "part").select(pa.alias("box"), (pa % 40).cast("string").alias("frame"), (pa * 7 % 210 - 5).alias("x"), (pa * 11 % 95 - 3).alias("y"), (F.col("p_size") % 20).alias("w"), (F.col("p_size") % 13).alias("h"))
    out = annotate.box_colour(pixels, boxes, "box", ("L",))
    return out.select("box", *[F.round(c, 6).alias(c) for c in "Lab"], "source", F.col("mean_L").alias("mean_l"))


@query("""
WITH h AS (SELECT event_id, user_id AS video, epoch_us(ts) / 1e6 % 1000 AS t FROM events WHERE event_type = 'view'),
s AS (SELECT user_id AS video, round(epoch_us(ts) / 1e6 % 1000 * 10)::BIGINT AS tenth, max(CASE WHEN event_type = 'purchase' THEN value END) AS scale FROM events WHERE event_type <> 'view' GROUP BY ALL),
j AS (SELECT h.video, event_id, scale FROM h LEFT JOIN s ON h.video = s.video AND round(h.t * 10)::BIGINT = s.tenth)
SELECT video, count(*) AS hits, count(scale) AS scaled FROM j GROUP BY 1""")
def q46_hits_by_video(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.col("user_id").alias("video"), (F.col("us") / 1e6 % 1000).alias("t"), "event_type", "value")
    rows = e.where("event_type <> 'view'").groupBy("video", F.round(F.col("t") * 10).alias("k")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("obj8px_cm"))
    rows = rows.select("video", (F.col("k") / 10).alias("t"), "obj8px_cm", F.when(F.col("obj8px_cm").isNotNull(), "ok").otherwise("no_focal").alias("status"))
    return coverage.hits_by_video(coverage.with_scale(e.where("event_type = 'view'").select("video", "event_id", "t"), tables.scales(rows).withColumn("status", F.lit("ok"))))


@query("""
WITH c AS (SELECT CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END AS looked, CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END AS seen, c_acctbal AS alt_m FROM customer)
SELECT count(*) AS n, count(*) FILTER (looked = 0) AS blind, count(*) FILTER (seen = 1) AS seen, round(count(*) FILTER (looked = 0) / count(*), 2) AS blind_share, min(alt_m) FILTER (looked = 0) AS blind_low, max(alt_m) FILTER (looked = 0) AS blind_high FROM c""")
def q47_cell_totals(spark, sf_dir):
    k = F.col("c_custkey") % 3
    out = coverage.cell_totals(_t(spark, sf_dir, "customer").select((k > 0).cast("int").alias("looked"), (k == 2).cast("int").alias("seen"), F.col("c_acctbal").alias("alt_m")))
    return out.withColumn("blind_share", F.round("blind_share", 2))


@query("""
WITH x AS (SELECT p_brand, l_quantity * 5 AS l, l_discount * 1000 AS a, l_tax * 1000 AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
m AS (SELECT p_brand, count(*) AS n, median(l) AS ml, median(a) AS ma, median(b) AS mb FROM x GROUP BY 1)
SELECT p_brand, any_value(n) AS n, any_value(ml) AS "L", round(any_value(ma), 6) AS a, round(any_value(mb), 6) AS b, round(median(abs(l - ml)), 6) AS spread_L, round(median(sqrt(pow(a - ma, 2) + pow(b - mb, 2))), 6) AS spread_ab FROM x JOIN m USING (p_brand) GROUP BY 1""")
def q48_colour_spread(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", (F.col("l_quantity") * 5).alias("L"), (F.col("l_discount") * 1000).alias("a"), (F.col("l_tax") * 1000).alias("b"))
    return annotate.spread(x, "p_brand").select("p_brand", "n", "L", *[F.round(c, 6).alias(c) for c in ("a", "b", "spread_L", "spread_ab")])


@query("""
WITH e AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS n, event_type NOT IN ('view', 'click') AS ok, value > 20 AS moved FROM events),
f AS (SELECT *, NOT ok AND n > 1 AS fail FROM e),
g AS (SELECT *, sum((NOT fail)::INT) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS island FROM f),
h AS (SELECT *, n = 1 OR (fail AND sum(fail::INT) OVER (PARTITION BY user_id, island ORDER BY n ROWS UNBOUNDED PRECEDING) % 3 = 0) AS start FROM g),
s AS (SELECT *, sum(start::INT) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS seg FROM h),
k AS (SELECT *, count(*) OVER (PARTITION BY user_id, seg) AS size FROM s WHERE start OR (NOT fail AND moved))
SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY seg) AS segment FROM k WHERE size > 1""")
def q49_segments(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us", (~F.col("event_type").isin("view", "click")).alias("ok"), (F.col("value") > 20).alias("moved"))
    return frames.segments(e, "user_id", "us", "ok", "moved").select("event_id", F.col("segment").cast("long").alias("segment"))


@query("""
WITH e AS (SELECT 'DJI_20260811' || lpad((user_id * 61 % 240000)::VARCHAR, 6, '0') || '_0001_Z.MP4' AS video, user_id, epoch_us(ts) // 1000 % 80000000 AS ms, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 1000 % 80000000 ORDER BY event_id) AS r, event_id FROM events),
u AS (SELECT video, ms, event_id, (user_id * 61 % 240000) AS hms, row_number() OVER w AS n, lead(ms) OVER w AS nxt FROM e WHERE r = 1 WINDOW w AS (PARTITION BY video ORDER BY ms)),
c AS (SELECT *, coalesce(nxt, ms + 33) AS e, coalesce(try_strptime('20260811' || lpad(hms::VARCHAR, 6, '0'), '%Y%m%d%H%M%S'), TIMESTAMP '2026-01-01 00:00:00') + to_milliseconds(ms) AS clock FROM u)
SELECT video, n AS number, n || chr(10) || lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0')
 || ' --> ' || lpad((e // 3600000)::VARCHAR, 2, '0') || ':' || lpad((e // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((e // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((e % 1000)::VARCHAR, 3, '0') || chr(10)
 || '<font size="28">SrtCnt : ' || n || ', DiffTime: ' || greatest(1, e - ms) || 'ms' || chr(10) || strftime(clock, '%Y-%m-%d %H:%M:%S.%g') || chr(10) || '[latitude: ' || event_id % 90 || '] [longitude: ' || event_id % 180 || '] [altitude: ] </font>' || chr(10) AS block FROM c""")
def q50_subtitles(spark, sf_dir):
    clock = F.col("user_id") * 61 % 240000
    name = F.format_string("DJI_20260811%06d_0001_Z.MP4", clock)
    ms = F.floor(F.col("us") / 1000) % 80_000_000
    e = _events(spark, sf_dir).select(name.alias("video"), ms.alias("ms"), "event_id")
    e = e.groupBy("video", "ms").agg(F.min("event_id").alias("event_id"))
    e = e.select("video", (F.col("ms") / 1000).alias("time_s"), (F.col("event_id") % 90).alias("lat"), (F.col("event_id") % 180).alias("lon"), F.lit(None).cast("string").alias("alt_m"))
    return sinks.subtitles(e)


_TRIALS = """SELECT (l_partkey % 2)::VARCHAR AS bg, list_extract([2, 3, 4, 5, 6, 8, 12, 16, 24, 32, 48], (l_suppkey % 11 + 1)::INT) AS size, list_extract([10.0, 20.0, 40.0, 80.0], (l_orderkey % 4 + 1)::INT)::DOUBLE AS contrast,
 (l_linenumber * 7 + l_orderkey) % 45 - 1 AS rank, (l_returnflag = 'R')::INT AS dirty, l_quantity AS de_peak, l_quantity * l_discount AS de_mean, l_tax AS clipped FROM lineitem"""


def _trials(spark, sf_dir):
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), k.cast("int") + 1)
    c = F.col
    return _t(spark, sf_dir, "lineitem").select(
        (c("l_partkey") % 2).cast("string").alias("bg"), pick(probe.SIZES, c("l_suppkey") % 11).alias("size"), pick(probe.CONTRASTS, c("l_orderkey") % 4).alias("contrast"), ((c("l_linenumber") * 7 + c("l_orderkey")) % 45 - 1).alias("rank"),
        (c("l_returnflag") == "R").cast("int").alias("dirty"), c("l_quantity").alias("de_peak"), (c("l_quantity") * c("l_discount")).alias("de_mean"), c("l_tax").alias("clipped"),
    )


@query(f"""
WITH t AS ({_TRIALS}) SELECT size, count(*) AS n, count(*) FILTER (rank >= 0) AS found, median(rank) FILTER (rank >= 0) AS rank_med, round(avg((rank >= 0 AND rank < 10)::INT), 6) AS tight, round(avg((rank >= 0 AND rank < 25)::INT), 6) AS wide,
 round(median(de_peak / contrast), 6) AS peak_med, round(median(de_mean / greatest(de_peak, 1e-6)), 6) AS mean_med, round(median(clipped), 6) AS clipped_med FROM t WHERE dirty = 0 GROUP BY 1""")
def q51_rank_report(spark, sf_dir):
    out = probe.rank_report(_trials(spark, sf_dir))
    return out.select("size", "n", "found", "rank_med", *[F.round(c, 6).alias(c) for c in out.columns[4:]])


@query(f"""
WITH t AS ({_TRIALS}), g AS (SELECT bg, size, contrast, avg((rank BETWEEN 0 AND 24)::INT) AS recall FROM t WHERE dirty = 0 GROUP BY ALL)
SELECT bg, contrast, min(size) AS low, max(size) AS high FROM g WHERE recall >= 0.5 GROUP BY ALL""")
def q52_size_range(spark, sf_dir):
    keys = ["bg", "size", "contrast"]
    t = _trials(spark, sf_dir)
    return probe.size_range(probe.recall(t, t, keys, F.col("rank").between(0, probe.TOP - 1), F.col("dirty") == 0), ["bg", "contrast"])


@query("""
WITH p AS (SELECT CASE c_nationkey % 3 WHEN 0 THEN 'item' WHEN 1 THEN 'rope' ELSE 'trace' END AS kind, CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'open' WHEN 2 THEN 'rejected' ELSE 'closed' END AS status,
 CASE WHEN c_custkey % 7 < 5 THEN c_custkey % 7 END AS num, CASE c_custkey % 7 WHEN 5 THEN 'v' WHEN 6 THEN 'x' END AS tag FROM customer)
SELECT 'ТОЧНО вещи' AS preset, count(*) AS n FROM p WHERE kind = 'item' AND status = 'confirmed' UNION ALL SELECT 'На передачу штабу', count(*) FROM p WHERE status = 'open' AND (tag = 'v' OR num >= 3)
UNION ALL SELECT 'Ложные (калибровка)', count(*) FROM p WHERE status = 'rejected' UNION ALL SELECT 'Активные', count(*) FROM p WHERE status IN ('confirmed', 'open') UNION ALL SELECT 'Всё', count(*) FROM p""")
def q53_presets(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 3
    pick = lambda at, *values: F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)
    p = _t(spark, sf_dir, "customer").select(pick(n, "item", "rope", "trace").alias("kind"), pick(k % 4, "confirmed", "open", "rejected", "closed").alias("status"), F.when(k % 7 < 5, k % 7).alias("conf_num"), F.when(k % 7 == 5, "v").when(k % 7 == 6, "x").alias("conf_tag"))
    one = p.agg(*[F.count_if(catalog.preset(name)).alias(name) for name in catalog.PRESETS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("preset"), F.col(f"`{name}`").alias("n")) for name in catalog.PRESETS])).alias("r_")).select("r_.*")


@query("""
WITH f AS (SELECT p_partkey AS frame, p_size * 10 AS w, p_size * 7 + 60 AS h FROM part)
SELECT frame, x, y FROM f, LATERAL (SELECT unnest(range(64, h - 64, 64)) AS y), LATERAL (SELECT unnest(range(64, w - 64, 64)) AS x)""")
def q54_sites(spark, sf_dir):
    f = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame"), (F.col("p_size") * 10).alias("w"), (F.col("p_size") * 7 + 60).alias("h"))
    return probe.sites(f).select("frame", "x", "y")


@query("""
WITH f AS (SELECT DISTINCT 'r/analysis/' || CASE c_custkey % 3 WHEN 0 THEN 'scans' WHEN 1 THEN 'scans-low' ELSE 'pilot' END || '/' || CASE WHEN c_nationkey % 2 = 0 THEN 'DJI_2026081' || c_nationkey % 9 || '_' || c_nationkey ELSE 'C00' || c_nationkey END AS dir, c_custkey % 5 = 0 AS has FROM customer),
d AS (SELECT DISTINCT dir, regexp_extract(dir, '[^/]*$') AS name FROM f WHERE has)
SELECT CASE WHEN dir LIKE '%/scans-low/%' THEN 'Перескан с ослабленными порогами' WHEN dir LIKE '%/pilot/%' THEN 'Район находок (пилот)' WHEN name LIKE 'DJI_2026%' THEN 'Дрон ' || name[11:12] || '.' || name[9:10] ELSE 'Вертолёт' END AS grp, count(*) AS n, min(name) AS first, string_agg(name, ',' ORDER BY name) AS names FROM d GROUP BY 1""")
def q55_montages(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    top = F.element_at(F.array(*map(F.lit, ("scans", "scans-low", "pilot"))), (k % 3).cast("int") + 1)
    name = F.when(n % 2 == 0, F.format_string("DJI_2026081%s_%s", n % 9, n)).otherwise(F.format_string("C00%s", n))
    files = _t(spark, sf_dir, "customer").select(F.concat(F.lit("r/analysis/"), top, F.lit("/"), name, F.when(k % 5 == 0, "/montage_00.jpg").otherwise("/montage_01.jpg")).alias("path"))
    dirs = catalog.montages(files, {"/analysis/scans": None, "/analysis/scans-low": "Перескан с ослабленными порогами", "/analysis/pilot": "Район находок (пилот)"})
    g = catalog.grouped(dirs, "grp", ["name", "dir"])
    return g.select("grp", F.size("rows").cast("long").alias("n"), F.col("rows")[0]["name"].alias("first"), F.array_join("rows.name", ",").alias("names"))


@query("""
WITH o AS (SELECT p_partkey AS obj, p_partkey % 50 AS frame, p_partkey * 7 % 300 AS x, p_partkey * 13 % 200 AS y, p_size AS size FROM part),
b AS (SELECT l_partkey % 50 AS frame, l_orderkey * 3 % 300 AS bx, l_suppkey * 5 % 200 AS by_, l_linenumber AS w, l_linenumber + 2 AS h, l_extendedprice AS score, row_number() OVER (PARTITION BY l_partkey % 50 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) - 1 AS rank FROM lineitem),
m AS (SELECT obj, min(rank) AS rank, arg_min(score, rank) AS score FROM o JOIN b USING (frame) WHERE sqrt(pow(bx + w / 2 - x, 2) + pow(by_ + h / 2 - y, 2)) <= 6 + size / 2 OR (x BETWEEN bx - 2 AND bx + w + 2 AND y BETWEEN by_ - 2 AND by_ + h + 2) GROUP BY 1)
SELECT obj, coalesce(rank, -1) AS rank, score FROM o LEFT JOIN m USING (obj)""")
def q56_first_match(spark, sf_dir):
    k, c = F.col("p_partkey"), F.col
    objects = _t(spark, sf_dir, "part").select(k.alias("obj"), (k % 50).alias("frame"), (k * 7 % 300).alias("x"), (k * 13 % 200).alias("y"), c("p_size").alias("size"))
    li = _t(spark, sf_dir, "lineitem").withColumn("frame", c("l_partkey") % 50)
    rank = annotate.group_rank(["frame"], [c("l_extendedprice").desc(), c("l_orderkey"), c("l_linenumber")]) - 1
    blobs = li.select("frame", (c("l_orderkey") * 3 % 300).alias("x"), (c("l_suppkey") * 5 % 200).alias("y"), c("l_linenumber").alias("w"), (c("l_linenumber") + 2).alias("h"), c("l_extendedprice").alias("score"), rank.alias("rank"))
    return probe.first_match(objects, blobs, "obj").select("obj", "rank", "score")


@query("""
WITH f AS (SELECT o_custkey % 20 AS video, o_orderkey AS n, CASE o_custkey % 20 % 3 WHEN 0 THEN 25.0 WHEN 1 THEN 29.97 ELSE 5.0 END AS native FROM orders),
s AS (SELECT *, greatest(1, CASE native WHEN 25.0 THEN 2 WHEN 29.97 THEN 3 ELSE 0 END) AS step FROM f),
t AS (SELECT video, n, n / native AS t FROM s WHERE n % step = 0), x AS (SELECT *, min(CASE WHEN t > 400 THEN n END) OVER (PARTITION BY video) AS stop FROM t)
SELECT video, n, round(t, 6) AS t FROM x WHERE t >= 10 AND (stop IS NULL OR n < stop)""")
def q57_sampled_frames(spark, sf_dir):
    v = F.col("o_custkey") % 20
    f = _t(spark, sf_dir, "orders").select(v.alias("video"), F.col("o_orderkey").alias("n"), F.when(v % 3 == 0, 25.0).when(v % 3 == 1, 29.97).otherwise(5.0).alias("native"))
    t = frames.sample_frames(f, "n", "native", 10.0)
    return frames.until(t, "video", "t", 400.0).where(frames.in_range(F.col("t"), 10.0, 0.0)).select("video", "n", F.round("t", 6).alias("t"))


@query("""
WITH c AS (SELECT c_custkey AS id, 39 + c_custkey % 100 / 50.0 AS lat, 72 + c_custkey % 77 / 40.0 AS lon, (c_custkey * 13 % 360)::DOUBLE AS yaw, -(c_custkey % 80)::DOUBLE AS pitch, (c_custkey * 17 % 256)::DOUBLE AS l, (c_custkey * 5 % 256)::DOUBLE AS a, (c_custkey * 29 % 256)::DOUBLE AS b FROM customer),
r AS (SELECT *, radians(yaw) + atan2(100.0 - 960, 1500) AS az, radians(pitch) - atan2(700.0 - 540, 1500) AS el FROM c)
SELECT id, round(sqrt(pow((lat - 40) * 111132, 2) + pow((lon - 73) * 111320 * cos(radians(40)), 2)), 5) AS dist, round(sin(az) * cos(el), 9) AS e, round(cos(az) * cos(el), 9) AS n, round(sin(el), 9) AS u,
 floor(l * 16 / 256)::BIGINT * 1024 + floor(a * 32 / 256)::BIGINT * 32 + floor(b * 32 / 256)::BIGINT AS bin, round(l * 100 / 255, 9) AS cie_l, round(sqrt(pow(a - 128, 2) + pow(b - 128, 2)), 9) AS chroma,
 round(lat + cos(radians(yaw)) * 140 / 111132, 9) AS end_lat, round(lon + sin(radians(yaw)) * 140 / (111320 * cos(radians(lat))), 9) AS end_lon, round((id % 900 + 1) / 1500.0 * 30, 9) AS metres, 'q' || id AS tag, '(' || id || ')' AS asc_ FROM r""")
def q58_plane_and_colour(spark, sf_dir):
    k, c = F.col("c_custkey"), F.col
    x = _t(spark, sf_dir, "customer").select(k.alias("id"), (39 + k % 100 / 50.0).alias("lat"), (72 + k % 77 / 40.0).alias("lon"), (k * 13 % 360).cast("double").alias("yaw"), (-(k % 80)).cast("double").alias("pitch"), (k * 17 % 256).cast("double").alias("l"), (k * 5 % 256).cast("double").alias("a"), (k * 29 % 256).cast("double").alias("b"))
    lit = F.lit
    x = x.withColumn("ray", scalars.ray(c("yaw"), c("pitch"), lit(100.0), lit(700.0), lit(1920.0), lit(1080.0), lit(1500.0))).withColumn("end", scalars.whisker_end(c("lat"), c("lon"), c("yaw"))).withColumn("cie", scalars.cie(c("l"), c("a"), c("b")))
    return x.select(
        "id", F.round(scalars.plane_distance(c("lat"), c("lon"), lit(40.0), lit(73.0), lit(40.0)), 5).alias("dist"), *[F.round(f"ray.{d}", 9).alias(d) for d in "enu"], scalars.colour_bin(c("l"), c("a"), c("b")).alias("bin"),
        F.round("cie.L", 9).alias("cie_l"), F.round("cie.C", 9).alias("chroma"), F.round("end.lat", 9).alias("end_lat"), F.round("end.lon", 9).alias("end_lon"), F.round(scalars.object_metres(c("id") % 900 + 1, lit(1500.0)), 9).alias("metres"),
        text.strip_namespace(F.concat(lit("{http://x/y}q"), c("id"))).alias("tag"), scalars.ascii_text(F.encode(F.concat(lit(" ("), c("id"), lit(")\0\0")), "US-ASCII")).alias("asc_"),
    )


@query("""
WITH x AS (SELECT o_orderkey AS i, o_custkey % 7 AS grp, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS dist FROM orders)
SELECT row_number() OVER (ORDER BY dist NULLS LAST, i) AS rank, row_number() OVER (PARTITION BY grp ORDER BY dist NULLS LAST, i) AS rank_in_group, dist, i, grp FROM x""")
def q59_annotated(spark, sf_dir):
    x = _t(spark, sf_dir, "orders").select(F.lit("one").alias("file"), F.col("o_orderkey").alias("i"), (F.col("o_custkey") % 7).alias("grp"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_totalprice")).alias("dist"))
    return annotate.annotated(x, ["dist"], "file", "grp", [F.col("dist").asc_nulls_last(), F.col("i")]).drop("file")


@query("""
WITH m AS (SELECT conv_id % 9 AS topic, conv_id * 100 + turn AS id, role FROM conversations), k AS (SELECT topic, max(id) AS last_id FROM m WHERE id % 3 = 0 AND topic <> 4 GROUP BY 1)
SELECT topic, count(*) AS n, max(id) AS last_id FROM m LEFT JOIN k USING (topic) WHERE role <> 'system' AND (k.last_id IS NULL OR id > k.last_id) GROUP BY 1""")
def q60_new_messages(spark, sf_dir):
    m = _t(spark, sf_dir, "conversations").select((F.col("conv_id") % 9).alias("topic"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("role") == "system", "joined").alias("action"))
    new = increments.messages_after(m, increments.marks_of(m.where("id % 3 = 0 and topic <> 4")))
    return new.groupBy("topic").agg(F.count("*").alias("n")).join(increments.marks_of(new), "topic")


@query("""
WITH m AS (SELECT o_orderkey AS k, o_custkey % 40 AS size FROM orders), g AS (SELECT l_orderkey AS k, max(l_linenumber * 7 % 40) AS got FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1)
SELECT k, size, CASE WHEN got IS NULL THEN 'absent' WHEN got = size THEN 'ok' ELSE 'partial' END AS status FROM m LEFT JOIN g USING (k)""")
def q61_fetch_outcomes(spark, sf_dir):
    m = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 40).alias("size"))
    got = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 7 % 40).cast("long").alias("size"))
    return ingest.outcomes(m, got, ["k"])


@query("""
WITH c AS (SELECT p_partkey AS id, p_size AS s, (p_partkey % 17 - 8) / 4.0 AS shear, (p_partkey % 5 - 2) / 2000.0 AS px FROM part),
m AS (SELECT id, 0.2 + s / 12.0 AS m0, shear AS m1, 3.0 AS m2, 0.1 AS m3, 0.3 + s / 15.0 AS m4, 5.0 AS m5, px AS m6, 0.0 AS m7, 1.0 AS m8 FROM c),
q AS (SELECT *, m2 / m8 AS x0, m5 / m8 AS y0, (m0 * 640 + m2) / (m6 * 640 + m8) AS x1, (m3 * 640 + m5) / (m6 * 640 + m8) AS y1, (m0 * 640 + m1 * 360 + m2) / (m6 * 640 + m7 * 360 + m8) AS x2, (m3 * 640 + m4 * 360 + m5) / (m6 * 640 + m7 * 360 + m8) AS y2, (m1 * 360 + m2) / (m7 * 360 + m8) AS x3, (m4 * 360 + m5) / (m7 * 360 + m8) AS y3 FROM m),
t AS (SELECT *, (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1) AS a, (x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2) AS b, (x3 - x2) * (y0 - y3) - (y3 - y2) * (x0 - x3) AS c, (x0 - x3) * (y1 - y0) - (y0 - y3) * (x1 - x0) AS d FROM q)
SELECT id, m0 * m4 - m1 * m3 > 0 AND sqrt(abs(m0 * m4 - m1 * m3)) > 0.25 AND sqrt(abs(m0 * m4 - m1 * m3)) < 4 AND (least(a, b, c, d) >= 0 OR greatest(a, b, c, d) <= 0) AS sane FROM t""")
def q62_sane_homographies(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    m = F.array(0.2 + s / 12.0, (k % 17 - 8) / 4.0, F.lit(3.0), F.lit(0.1), 0.3 + s / 15.0, F.lit(5.0), (k % 5 - 2) / 2000.0, F.lit(0.0), F.lit(1.0))
    return _t(spark, sf_dir, "part").select(k.alias("id"), scalars.sane_homography(m, F.lit(640.0), F.lit(360.0)).alias("sane"))


@query("""
WITH p AS (SELECT p_partkey AS id, p_partkey % 7 * 3.0 AS x0, p_partkey % 7 * 3.0 + p_size / 4.0 AS x1, p_partkey % 5 * 2.0 AS y0, p_partkey % 5 * 2.0 + p_size % 9 AS y1 FROM part),
a AS (SELECT id, x0 + (i + 0.5) * 2.5 AS x, x1, y0, y1 FROM p, LATERAL (SELECT unnest(range(0, floor((x1 - x0) / 2.5)::BIGINT + 1)) AS i)),
b AS (SELECT id, x, x1, y0 + (j + 0.5) * 2.5 AS y, y1 FROM a, LATERAL (SELECT unnest(range(0, floor((y1 - y0) / 2.5)::BIGINT + 1)) AS j))
SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM b WHERE x < x1 AND y < y1""")
def q63_grid_cells(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, y0 = (k % 7 * 3).cast("double"), (k % 5 * 2).cast("double")
    p = _t(spark, sf_dir, "part").select(k.alias("id"), F.explode(spatial.grid_cells(x0, x0 + s / 4.0, y0, y0 + s % 9, 2.5)).alias("c"))
    return p.select("id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query("""
WITH c AS (SELECT s_suppkey AS task, s_suppkey % 4 AS m, s_acctbal FROM supplier),
f AS (SELECT task, unnest([0.0, 30.0, -30.0]) AS lift, m, s_acctbal FROM c),
h AS (SELECT task, lift, CASE WHEN m = 0 OR (m = 1 AND lift > 0) THEN NULL ELSE 100 + lift * (task % 9) / 10 END AS x, 50 + abs(lift) / 10 AS y FROM f),
d AS (SELECT h.*, b.x AS bx, b.y AS by_ FROM h JOIN h b ON b.task = h.task AND b.lift = 0),
m AS (SELECT task, max(CASE WHEN bx IS NULL THEN NULL WHEN x IS NULL THEN 1e300 ELSE sqrt(pow(x - bx, 2) + pow(y - by_, 2)) END) AS drift FROM d GROUP BY 1)
SELECT task, round(CASE WHEN drift < 1e300 THEN drift END, 6) AS drift, CASE WHEN drift IS NULL THEN 'no_hit' WHEN drift <= 30 THEN 'ok' ELSE 'poloho' END AS verdict FROM m""")
def q64_verdicts(spark, sf_dir):
    k, lift = F.col("s_suppkey"), F.col("lift")
    c = _t(spark, sf_dir, "supplier").select(k.alias("task"), F.explode(F.array(*map(F.lit, (0.0, 30.0, -30.0)))).alias("lift"))
    m = F.col("task") % 4
    x = F.when((m == 0) | ((m == 1) & (lift > 0)), None).otherwise(100 + lift * (F.col("task") % 9) / 10)
    casts = c.withColumn("hit_x", x).withColumn("hit_y", F.when(x.isNotNull(), 50 + F.abs(lift) / 10)).withColumn("dist", F.when(x.isNotNull(), F.lit(1.0)))
    out = raster.verdicts(casts, "task")
    return out.select("task", F.round(F.when(F.col("drift") < 1e300, F.col("drift")), 6).alias("drift"), "verdict")


@query("""
WITH h AS (SELECT user_id AS video, event_id, value AS dist, CASE WHEN event_id % 7 > 0 THEN event_id % 3000 END AS f FROM events)
SELECT event_id, round(CASE WHEN f <> 0 THEN dist / f END * 100, 8) AS gsd_cm, round(CASE WHEN f <> 0 THEN dist / f END * 800, 8) AS obj8px_cm, CASE WHEN dist IS NULL THEN 'above_horizon' WHEN f IS NULL THEN 'no_focal' ELSE 'ok' END AS status FROM h""")
def q65_scales(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("value").alias("dist_m"), F.when(F.col("event_id") % 7 > 0, F.col("event_id") % 3000).alias("f_px"))
    return coverage.classify(e).select("event_id", *[F.round(c, 8).alias(c) for c in ("gsd_cm", "obj8px_cm")], "status")


@query("""
WITH x AS (SELECT l_orderkey AS id, l_linenumber AS k, floor(l_quantity * 5) AS "L", floor(l_discount * 1000) - 50 AS a, floor(l_tax * 1000) - 40 AS b FROM lineitem)
SELECT count(*) FILTER (sqrt(a * a + b * b) >= 8 AND b < 0) AS blue, count(*) FILTER ("L" >= 78) AS light, count(*) FILTER ("L" < 35 AND a > 0) AS dark FROM x""")
def q66_colour_rules(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem").select(F.floor(F.col("l_quantity") * 5).alias("L"), (F.floor(F.col("l_discount") * 1000) - 50).alias("a"), (F.floor(F.col("l_tax") * 1000) - 40).alias("b"))
    return x.agg(*[F.count_if(rules.rule_column(r)).alias(name) for name, r in (("blue", "C>=8&b<0"), ("light", "L>=78"), ("dark", "L<35&a>0"))])


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type, CASE WHEN event_type = 'click' THEN value END AS a, CASE WHEN event_id % 3 = 0 THEN event_type END AS b FROM events),
s AS (SELECT user_id, us, value_ FROM (SELECT user_id, us, abs(a - lag(a) OVER (PARTITION BY user_id ORDER BY us)) AS value_ FROM (SELECT user_id, us, event_id % 40 AS a FROM e)))
SELECT user_id, arg_min(a, us) FILTER (a IS NOT NULL) AS first_a, arg_min(b, us) FILTER (b IS NOT NULL) AS first_b, min(us) AS low, max(us) AS high, any_value(st.n) AS still FROM e JOIN (SELECT user_id, count(*) FILTER (value_ < 6 AND prev IS NOT NULL) AS n FROM (SELECT *, lag(value_) OVER (PARTITION BY user_id ORDER BY us) AS prev FROM s) GROUP BY 1) st USING (user_id) GROUP BY 1""")
def q67_headers_and_spans(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "us", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("a"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("b"))
    first = frames.header(e, "user_id", "us", ["a", "b"]).select("user_id", F.col("a").alias("first_a"), F.col("b").alias("first_b"))
    w = Window.partitionBy("user_id").orderBy("us")
    moves = e.withColumn("d", F.abs(F.col("event_id") % 40 - F.lag(F.col("event_id") % 40).over(w)))
    still = frames.still(moves, "user_id", "us", "d", 6).groupBy("user_id").agg(F.count_if("still").alias("still"))
    return first.join(frames.span(e, "user_id", "us"), "user_id").join(still, "user_id")
