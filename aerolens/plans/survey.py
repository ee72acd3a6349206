"""One query for each group of operators, over whole tables, with the same in DuckDB SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import annotate, catalog, coverage, detect, ingest, probe, raster, spatial, timeseries, tracking
from ..session import shared_dir
from ..sources import telemetry_packets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with us, microseconds since 1970."""
    return _t(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@query("""
WITH e AS (SELECT user_id AS video, CASE event_type WHEN 'error' THEN 'no_focal' WHEN 'signup' THEN 'above_horizon' ELSE 'ok' END AS status, value AS gsd FROM events),
k AS (SELECT *, CASE WHEN status = 'ok' THEN gsd END AS known FROM e)
SELECT video, count(*) AS n, round(avg(CASE WHEN status = 'no_focal' THEN 1.0 ELSE 0 END), 6) AS no_focal, round(avg(CASE WHEN status = 'above_horizon' THEN 1.0 ELSE 0 END), 6) AS sky,
 round(median(known), 6) AS gsd_med, round(quantile_cont(known, 0.9), 6) AS gsd_p90, round(median(known) * 8, 6) AS obj8_med,
 CASE WHEN count(known) > 0 THEN round(count(*) FILTER (known <= 12.5) / count(*), 6) END AS shows_100,
 CASE WHEN count(known) > 0 THEN round(count(*) FILTER (known <= 7.5) / count(*), 6) END AS shows_60,
 CASE WHEN count(known) > 0 THEN round(count(*) FILTER (known <= 2.125) / count(*), 6) END AS shows_17 FROM k GROUP BY video""")
def q01_coverage_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "error", "no_focal").when(F.col("event_type") == "signup", "above_horizon").otherwise("ok")
    out = coverage.summarize(e.select(F.col("user_id").alias("video"), state.alias("status"), F.col("value").alias("gsd_cm")))
    return out.select("video", "n", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


@query("""
WITH p AS (SELECT l_linenumber AS frame, (floor(l_quantity / 4)::BIGINT * 32 + round(l_discount * 100)::BIGINT) * 32 + round(l_tax * 100)::BIGINT AS bin FROM lineitem),
h AS (SELECT frame, bin, count(*) AS n FROM p GROUP BY ALL),
d AS (SELECT *, n / sum(n) OVER (PARTITION BY frame) AS density FROM h)
SELECT frame, bin, n, round(density, 9) AS density, round(-log10(density + 1e-9), 6) AS rarity FROM d WHERE density < 0.0008""")
def q02_rarity_histogram(spark, sf_dir):
    bin_ = (F.floor(F.col("l_quantity") / 4) * 32 + F.round(F.col("l_discount") * 100).cast("long")) * 32 + F.round(F.col("l_tax") * 100).cast("long")
    h = detect.histogram(_t(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("frame"), bin_.alias("bin")), "frame", "bin")
    return h.where("density < 0.0008").select("frame", "bin", "n", F.round("density", 9).alias("density"), F.round("rarity", 6).alias("rarity"))


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rank FROM lineitem) WHERE rank <= 3""")
def q03_topk_per_frame(spark, sf_dir):
    order = [F.col("l_extendedprice").desc(), *map(F.col, ("l_linenumber", "l_partkey", "l_suppkey"))]
    return detect.top_k(_t(spark, sf_dir, "lineitem"), ["l_orderkey"], order, 3).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "rank")


@query("""SELECT l_orderkey AS comp, round(sum(l_extendedprice), 2) AS score, min(l_linenumber) AS x0, max(l_linenumber) AS x1, min(l_quantity) AS y0, max(l_quantity) AS y1, count(*) AS area FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 3 AND 6""")
def q04_component_score(spark, sf_dir):
    g = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("comp"))
    return g.agg(F.round(F.sum("l_extendedprice"), 2).alias("score"), F.min("l_linenumber").alias("x0"), F.max("l_linenumber").alias("x1"), F.min("l_quantity").alias("y0"), F.max("l_quantity").alias("y1"), F.count("*").alias("area")).where("area between 3 and 6")


@query("""
WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'error'),
b AS (SELECT event_id AS near_id, user_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
j AS (SELECT a.event_id, b.near_id, abs(a.us - b.us) AS dt, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.us - b.us), b.us, b.near_id) AS r FROM a LEFT JOIN b USING (user_id))
SELECT event_id, near_id, dt FROM j WHERE r = 1""")
def q05_asof_nearest(spark, sf_dir):
    e = _events(spark, sf_dir)
    a = e.where("event_type = 'error'").select("event_id", "user_id", "us")
    b = e.where("event_type = 'view'").select(F.col("event_id").alias("near_id"), "user_id", "us")
    out = timeseries.asof_nearest(a, b, ["user_id"], "us", ["near_id"])
    return out.select("event_id", F.col("near.near_id").alias("near_id"), F.abs(F.col("us") - F.col("near.t")).alias("dt"))


@query("""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, value FROM events),
g AS (SELECT user_id, i, lo + i * 21600000000 AS us FROM (SELECT user_id, min(us) AS lo, max(us) AS hi FROM e GROUP BY 1), LATERAL (SELECT unnest(range(0, (hi - lo) // 21600000000 + 1)) AS i)),
p AS (SELECT g.*, e.us AS u0, e.value AS v0 FROM g ASOF JOIN e ON g.user_id = e.user_id AND g.us >= e.us),
q AS (SELECT p.*, e.us AS u1, e.value AS v1 FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.us <= e.us)
SELECT user_id, i, round(CASE WHEN u1 IS NULL OR u1 = u0 THEN v0 ELSE v0 + (v1 - v0) * ((us - u0) / (u1 - u0)) END, 6) AS value FROM q""")
def q06_interp_linear(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", "us", "value")
    ends = e.groupBy("user_id").agg(F.min("us").alias("lo"), F.max("us").alias("hi"))
    grid = ends.select("user_id", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(hi - lo) div 21600000000"))).alias("i")).select("user_id", "i", (F.col("lo") + F.col("i") * 21_600_000_000).alias("us"))
    return timeseries.interpolate(grid, e, ["user_id"], "us", ["value"]).select("user_id", "i", F.round("value", 6).alias("value"))


@query("""
WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS us, (event_id * 37 % 360 - 180)::DOUBLE AS yaw FROM events),
d AS (SELECT *, yaw - lag(yaw) OVER w AS d, first_value(yaw) OVER w AS y0 FROM a WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, d - floor((d + 180) / 360) * 360 AS s FROM d)
SELECT event_id, y0 + sum(coalesce(CASE WHEN s = -180 AND d > 0 THEN 180 ELSE s END, 0)) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS unwrapped FROM s""")
def q07_unwrap(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us", (F.col("event_id") * 37 % 360 - 180).cast("double").alias("yaw"))
    return timeseries.unwrap_degrees(e, ["user_id"], "us", "yaw").select("event_id", "unwrapped")


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, value FROM events)
SELECT a.event_id, CASE WHEN count(b.value) >= 3 THEN round(median(b.value), 6) END AS median FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND abs(a.us - b.us) <= 86400000000 GROUP BY 1""")
def q08_range_median(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", "user_id", "us", "value")
    out = timeseries.range_median(e.select("event_id", "user_id", "us"), e.select("user_id", "us", "value"), ["user_id"], "us", "value", 86_400_000_000)
    return out.select("event_id", F.round("median", 6).alias("median"))


@query("""SELECT event_id, row_number() OVER w AS number, coalesce(lead(epoch_us(ts)) OVER w, epoch_us(ts) + 33333) - epoch_us(ts) AS duration_us FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts))""")
def q09_lead_duration(spark, sf_dir):
    e = _events(spark, sf_dir)
    number = annotate.group_rank(["user_id"], [F.col("us")])
    return e.select("event_id", number.alias("number"), (timeseries.lead_time(["user_id"], "us", 33_333) - F.col("us")).alias("duration_us"))


@query("""SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders""")
def q10_group_rank(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", annotate.group_rank(["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]).alias("rank"))


@query("""
WITH e AS (SELECT vec_id, label, embedding[1]::DOUBLE * 100 AS L, embedding[2]::DOUBLE * 100 AS a, embedding[3]::DOUBLE * 100 AS b FROM embeddings),
s AS (SELECT label AS name, avg(L) AS sl, avg(a) AS sa, avg(b) AS sb FROM e GROUP BY 1),
d AS (SELECT vec_id, name, sqrt(pow(sqrt(pow(a - sa, 2) + pow(b - sb, 2)) / 8, 2) + pow(abs(L - sl) / 28, 2)) AS dist FROM e, s),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, name) AS r FROM d)
SELECT vec_id, name AS nearest, round(dist, 6) AS dist FROM r WHERE r = 1""")
def q11_nearest_signature(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 100
    e = _t(spark, sf_dir, "embeddings").select("vec_id", "label", at(0).alias("L"), at(1).alias("a"), at(2).alias("b"))
    s = e.groupBy(F.col("label").alias("name")).agg(*[F.avg(c).alias(c) for c in "Lab"])
    return annotate.nearest_signature(e, s.withColumn("ord", F.col("name")), "vec_id", "name", "ord").select("vec_id", "nearest", F.round("dist", 6).alias("dist"))


@query("""
WITH x AS (SELECT p_brand, l_extendedprice AS v FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT p_brand, median(v) AS med FROM x GROUP BY 1)
SELECT p_brand, count(*) AS n, round(any_value(med), 4) AS med, round(median(abs(v - med)), 4) AS mad FROM x JOIN m USING (p_brand) GROUP BY 1""")
def q12_mad(spark, sf_dir):
    x = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", F.col("l_extendedprice").alias("v"))
    return annotate.median_and_mad(x, "p_brand", "v").select("p_brand", "n", F.round("med", 4).alias("med"), F.round("mad", 4).alias("mad"))


_POINTS = "SELECT c_custkey AS id, (c_custkey * 7919 % 1000)::DOUBLE AS x, (c_custkey * 104729 % 997)::DOUBLE AS y, CASE WHEN c_nationkey > 0 THEN c_nationkey * 10.0 END AS obj8 FROM customer"


def _points(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(k.alias("id"), (k * 7919 % 1000).cast("double").alias("x"), (k * 104729 % 997).cast("double").alias("y"), F.when(F.col("c_nationkey") > 0, F.col("c_nationkey") * F.lit(10.0)).alias("obj8"))


@query(f"""
WITH h AS ({_POINTS}), c AS (SELECT i * 100 + j AS cell, i * 20.0 + 10 AS x, j * 20.0 + 10 AS y FROM range(60) a(i), range(60) b(j)),
d AS (SELECT cell, obj8, sqrt(pow(c.x - h.x, 2) + pow(c.y - h.y, 2)) AS d FROM c, h)
SELECT cell, max((d <= 15)::INT) AS looked, max((d <= 15 AND coalesce(obj8, 1e9) <= 100)::INT) AS seen, min(CASE WHEN d <= 15 THEN obj8 END) AS best_obj8, round(min(d), 6) AS min_dist FROM d GROUP BY 1""")
def q13_cells_within_radius(spark, sf_dir):
    i, j = F.expr("id div 60"), F.col("id") % 60
    cells = spark.range(3600).select((i * 100 + j).alias("cell"), (i * F.lit(20.0) + 10).alias("x"), (j * F.lit(20.0) + 10).alias("y"))
    out = spatial.cover_cells(cells, _points(spark, sf_dir), "cell", 15.0)
    return out.select("cell", "looked", "seen", "best_obj8", F.round("min_dist", 6).alias("min_dist"))


_RING = [(100.5, 80.5), (880.5, 140.5), (700.5, 520.5), (940.5, 900.5), (300.5, 760.5), (420.5, 430.5)]
_EDGES = ", ".join(f"({x1}, {y1}, {x2}, {y2})" for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1], strict=True))


@query(f"""
WITH h AS ({_POINTS}), e(x1, y1, x2, y2) AS (VALUES {_EDGES})
SELECT id, (sum(((y1 > y) <> (y2 > y) AND x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)::INT) % 2 = 1) AS inside FROM h, e GROUP BY id""")
def q14_point_in_polygon(spark, sf_dir):
    return _points(spark, sf_dir).select("id", spatial.in_polygon(F.col("x"), F.col("y"), _RING).alias("inside"))


@query(f"""
WITH h AS ({_POINTS}), e(x1, y1, x2, y2) AS (VALUES {_EDGES}),
t AS (SELECT *, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM h, e)
SELECT id, round(min(sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))), 6) AS dist FROM t GROUP BY id""")
def q15_point_to_polyline(spark, sf_dir):
    return _points(spark, sf_dir).select("id", F.round(spatial.to_line(F.col("x"), F.col("y"), [*_RING, _RING[0]]), 6).alias("dist"))


_HEIGHT = "300 + 2.0 * {x} + 1.5 * {y} - 0.01 * {x} * {y}"


def _grid(spark: SparkSession, side: int = 201) -> DataFrame:
    g = spark.range(side * side).select(F.expr(f"int(id div {side})").alias("iy"), F.expr(f"int(id % {side})").alias("ix"))
    return g.withColumn("z", F.expr(_HEIGHT.format(x="ix", y="iy")).cast("double"))


@query(f"""
WITH p AS (SELECT o_orderkey, o_orderkey % 2203 / 10.0 AS x, o_custkey % 2001 / 10.0 AS y FROM orders)
SELECT o_orderkey, CASE WHEN floor(x) + 1 <= 200 AND floor(y) + 1 <= 200 THEN round({_HEIGHT.format(x="x", y="y")}, 6) END AS z FROM p""")
def q16_bilinear(spark, sf_dir):
    p = _t(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 2203 / 10).alias("x"), (F.col("o_custkey") % 2001 / 10).alias("y"))
    return raster.bilinear_join(p, _grid(spark), "o_orderkey").select("o_orderkey", F.round("z", 6).alias("z"))


_RAYS = """SELECT s_suppkey AS id, (s_suppkey * 31 % 150 + 20)::DOUBLE AS x, (s_suppkey * 17 % 150 + 20)::DOUBLE AS y, 560.0 + s_suppkey % 90 AS alt,
 sin(radians(s_suppkey * 37 % 360)) * cos(radians(-5.0 - s_suppkey % 50)) AS e, cos(radians(s_suppkey * 37 % 360)) * cos(radians(-5.0 - s_suppkey % 50)) AS n, sin(radians(-5.0 - s_suppkey % 50)) AS u FROM supplier"""


@query(f"""
WITH r AS ({_RAYS}), s AS (SELECT id, d, x + e * d / 10 AS px, y + n * d / 10 AS py, alt + u * d AS h FROM r, (SELECT unnest(range(5, 6001, 5)) AS d)),
g AS (SELECT id, d, CASE WHEN px >= 0 AND py >= 0 AND px <= 200 AND py <= 200 THEN h - ({_HEIGHT.format(x="px", y="py")}) END AS gap FROM s),
f AS (SELECT id, min(d) FILTER (gap > 0) AS up, min(d) FILTER (gap IS NULL) AS out FROM g GROUP BY 1)
SELECT s_suppkey AS id, k.step::DOUBLE AS step FROM supplier LEFT JOIN (SELECT g.id, min(d) AS step FROM g JOIN f USING (id) WHERE gap <= 0 AND d > up AND (out IS NULL OR d < out) GROUP BY 1) k ON k.id = s_suppkey""")
def q17_raycast(spark, sf_dir):
    s, el = F.col("s_suppkey"), F.radians(F.lit(-5.0) - F.col("s_suppkey") % 50)
    az = F.radians(s * 37 % 360)
    rays = _t(spark, sf_dir, "supplier").select(s.alias("id"), (s * 31 % 150 + 20).cast("double").alias("x"), (s * 17 % 150 + 20).cast("double").alias("y"), (F.lit(560.0) + s % 90).alias("alt"), (F.sin(az) * F.cos(el)).alias("e"), (F.cos(az) * F.cos(el)).alias("n"), F.sin(el).alias("u"))
    return raster.cast(rays, _grid(spark), "id", cell=10.0).select("id", "step")


@query("""
WITH RECURSIVE g AS (SELECT iy, ix, ((iy - 17) * (iy - 17) + 2 * (ix - 23) * (ix - 23))::DOUBLE + 3 * avg(q) AS z FROM (SELECT l_orderkey % 40 AS iy, l_partkey % 40 AS ix, l_quantity AS q FROM lineitem) GROUP BY iy, ix),
n AS (SELECT a.iy * 1048576 + a.ix AS id, b.iy * 1048576 + b.ix AS nx, row_number() OVER (PARTITION BY a.iy, a.ix ORDER BY b.z, b.iy, b.ix) AS r FROM g a JOIN g b ON abs(a.iy - b.iy) <= 1 AND abs(a.ix - b.ix) <= 1 AND b.z < a.z),
s AS (SELECT id, nx FROM n WHERE r = 1),
w AS (SELECT iy * 1048576 + ix AS start, 0 AS k, iy * 1048576 + ix AS place FROM g UNION ALL SELECT w.start, w.k + 1, s.nx FROM w JOIN s ON s.id = w.place WHERE w.k < 400)
SELECT start, max(k) AS steps, max_by(place, k) AS stop FROM w GROUP BY 1""")
def q18_descent(spark, sf_dir):
    """The ways down from all places of a terrain: a bowl, roughened by the mean quantity of the order lines that fall on each place."""
    g = _t(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 40).alias("iy"), (F.col("l_partkey") % 40).alias("ix")).agg(F.avg("l_quantity").alias("q"))
    g = g.select("iy", "ix", (F.expr("(iy - 17) * (iy - 17) + 2 * (ix - 23) * (ix - 23)").cast("double") + 3 * F.col("q")).alias("z"))
    s = raster.successors(g)
    return raster.descend(s.select("id"), s)


@query("""
WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(url, '[0-9]{3,}')) AS token FROM pages), p AS (SELECT DISTINCT url FROM pages)
SELECT token, count(*) AS n FROM t JOIN p ON contains(url, token) GROUP BY 1""")
def q19_regex_tokens(spark, sf_dir):
    p = _t(spark, sf_dir, "pages").select("url").distinct()
    tokens = p.select(F.explode(F.regexp_extract_all("url", F.lit("[0-9]{3,}"), F.lit(0))).alias("token"))
    return catalog.token_join(tokens, p, "token", "url").groupBy("token").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace(replace(translate(lower(concat(CASE turn % 3 WHEN 0 THEN 'Щука, Ёжик и Объявление ' WHEN 1 THEN 'Юля Цой ' ELSE '' END, text)), 'абвгдеёзийклмнопрстуфыэъь', 'abvgdeeziiklmnoprstufye'), 'ж', 'zh'), 'х', 'kh'), 'ц', 'ts'), 'ч', 'ch'), 'ш', 'sh'), 'щ', 'shch'), 'ю', 'yu'), 'я', 'ya') AS t, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS s FROM conversations)
SELECT conv_id, turn, coalesce(nullif(trim(regexp_replace(t, '[^a-z0-9]+', '-', 'g'), '-'), ''), 'topic') AS slug, CASE WHEN length(s) > 160 THEN s[:157] || '...' ELSE s END AS snippet FROM x""")
def q20_slugify_text(spark, sf_dir):
    title = F.concat(F.when(F.col("turn") % 3 == 0, "Щука, Ёжик и Объявление ").when(F.col("turn") % 3 == 1, "Юля Цой ").otherwise(""), F.coalesce("text", F.lit("")))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.slug(title).alias("slug"), text.snippet(F.col("text")).alias("snippet"))


@query("""SELECT md5(coalesce(text, '')) AS md5, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def q21_md5_dedup(spark, sf_dir):
    return catalog.first_of_content(_t(spark, sf_dir, "documents"), "text", ["doc_id"], ["doc_id"])


@query("""
WITH m AS (SELECT o_orderkey AS k, o_custkey % 7 + 1 AS s FROM orders), l AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS s FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS s FROM lineitem)
SELECT CASE WHEN l.k IS NOT NULL THEN 'done' WHEN r.k IS NOT NULL THEN 'fetch' ELSE 'absent' END AS status, count(*) AS n FROM m LEFT JOIN l ON m.k = l.k AND m.s = l.s LEFT JOIN r ON m.k = r.k AND m.s = r.s GROUP BY 1""")
def q22_manifest_anti(spark, sf_dir):
    m = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 7 + 1).alias("s"))
    r = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("s"), "l_returnflag")
    return ingest.ledger_totals(ingest.to_fetch(m, r.where("l_returnflag = 'R'"), r, ["k", "s"]))


@query("""
WITH v(o_orderstatus, o_orderpriority, verdict) AS (VALUES ('O', '1-URGENT', 'watch'), ('O', '2-HIGH', 'watch'), ('F', '1-URGENT', 'closed'), ('P', '5-LOW', 'later'))
SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 400000 THEN 'large' END, verdict) AS verdict FROM orders LEFT JOIN v USING (o_orderstatus, o_orderpriority)""")
def q23_verdict_lookup(spark, sf_dir):
    rows = spark.createDataFrame([("O", "1-URGENT", "watch"), ("O", "2-HIGH", "watch"), ("F", "1-URGENT", "closed"), ("P", "5-LOW", "later")], ["o_orderstatus", "o_orderpriority", "verdict"])
    o = _t(spark, sf_dir, "orders").withColumn("own", F.when(F.col("o_totalprice") > 400_000, "large"))
    return catalog.lookup(o, rows, ["o_orderstatus", "o_orderpriority"], "verdict", "own").select("o_orderkey", "verdict")


@query("""
WITH x AS (SELECT p_brand, p_type, p_size::VARCHAR AS p_size, coalesce(p_type IN ('ECONOMY', 'STANDARD') AND p_retailprice >= 950 AND p_size <= 30, false) AS p FROM part)
SELECT facet, value, count(*) FILTER (p) AS visible, count(*) AS total FROM (SELECT 'p_brand' AS facet, p_brand AS value, p FROM x UNION ALL SELECT 'p_type', p_type, p FROM x UNION ALL SELECT 'p_size', p_size, p FROM x) GROUP BY ALL""")
def q24_facets(spark, sf_dir):
    passes = catalog.facet_filter({"p_type": ["ECONOMY", "STANDARD"]}, {"p_retailprice": (950, None), "p_size": (None, 30)})
    return catalog.facet_counts(_t(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], passes)


@query("""
WITH t AS (SELECT lang, source, quality, toxic FROM labels JOIN documents USING (doc_id)), c AS (SELECT * FROM (SELECT DISTINCT lang FROM documents), (SELECT DISTINCT source FROM documents)),
g AS (SELECT lang, source, count(*) AS n, avg(quality) AS recall FROM t WHERE toxic = 0 GROUP BY ALL)
SELECT lang, source, coalesce(n, 0) AS n, round(recall, 6) AS recall FROM c LEFT JOIN g USING (lang, source)""")
def q25_recall_grid(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    cells = d.select("lang").distinct().crossJoin(d.select("source").distinct())
    out = probe.recall(_t(spark, sf_dir, "labels").join(d, "doc_id"), cells, ["lang", "source"], F.col("quality") > 0, F.col("toxic") == 0)
    return out.select("lang", "source", "n", F.round("recall", 6).alias("recall"))


@query("""SELECT l_linenumber, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N", count(*) FILTER (l_returnflag = 'R') AS "R" FROM lineitem GROUP BY 1""")
def q26_pivot_report(spark, sf_dir):
    return probe.report(_t(spark, sf_dir, "lineitem"), "l_linenumber", "l_returnflag", ["A", "N", "R"], F.count(F.lit(1))).fillna(0)


@query("""
SELECT 'all' AS part, count(*) AS n FROM (SELECT c_custkey FROM customer UNION ALL SELECT o_custkey FROM orders)
UNION ALL SELECT 'both', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)
UNION ALL SELECT 'idle', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)""")
def q27_set_ops(spark, sf_dir):
    c, o = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    parts = (("all", c.unionAll(o)), ("both", c.intersect(o)), ("idle", catalog.missing(c, o, ["k"]).distinct()))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in parts]
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("""
WITH x AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'v' WHEN 'system' THEN 'x' END AS tag, turn % 4 AS num FROM conversations)
SELECT conv_id, turn, CASE tag WHEN 'v' THEN 9 WHEN 'x' THEN -1 ELSE coalesce(num, 0) END AS conf FROM x""")
def q28_conf_rank(spark, sf_dir):
    tag = F.when(F.col("role") == "user", "v").when(F.col("role") == "system", "x")
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", scalars.confidence_rank(F.col("turn") % 4, tag).cast("long").alias("conf"))


@query("""SELECT event_id, epoch_us(ts) AS us FROM events WHERE event_id % 3 = 0 AND epoch_us(ts) BETWEEN 1704412800000000 AND 1705622400000000""")
def q29_time_filter(spark, sf_dir):
    return _events(spark, sf_dir).where("event_id % 3 = 0 and us between 1704412800000000 and 1705622400000000").select("event_id", "us")


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""")
def q30_json_field(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query()
def q31_tracks(spark, sf_dir):
    e = _events(spark, sf_dir)
    blob = F.struct(F.floor(F.col("value")).cast("int").alias("x"), (F.col("event_id") % 40).cast("int").alias("y"), (F.col("event_id") % 4 + 3).cast("int").alias("w"), F.lit(5).alias("h"), F.col("value").alias("score"))
    samples = e.groupBy(F.col("user_id").cast("string").alias("video"), F.floor(F.col("us") / 3_600_000_000).cast("double").alias("t")).agg(F.collect_list(blob).alias("blobs"))
    return tracking.build_tracks(samples.select("video", "t", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), "blobs"))


@query("""
WITH g AS (SELECT event_id, user_id, epoch_us(ts) AS us, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) > 21600000000)::INT, 1) AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, max(us) - min(us) AS length_us FROM s GROUP BY ALL""")
def q32_session_ttl(spark, sf_dir):
    s = timeseries.sessions(_events(spark, sf_dir), ["user_id"], "us", 21_600_000_000)
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), (F.max("us") - F.min("us")).alias("length_us"))


@query("""SELECT event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1""")
def q33_incremental(spark, sf_dir):
    from ..streaming.increments import ingest as run

    path = f"{shared_dir(spark)}/increments-{uuid.uuid4().hex}"
    schema = _t(spark, sf_dir, "events").schema
    for _ in range(2):  # the second run finds nothing new
        run(spark, sf_dir, schema, f"{path}/table", f"{path}/marks", "events.parquet")
    return spark.read.schema(schema).parquet(f"{path}/table").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount AS lat, round(l_tax, 6) AS lon, l_orderkey / 1000 AS alt_m, round(-l_quantity / 10, 6) AS gb_pitch FROM lineitem""")
def q34_proto_decode(spark, sf_dir):
    @F.pandas_udf("binary")
    def packet(a: pd.Series, lat: pd.Series, lon: pd.Series, q: pd.Series) -> pd.Series:
        tree = lambda r: {3: {3: {4: {1: {2: r[1], 3: r[2]}, 2: int(r[0])}}, 4: {3: {1: -int(r[3])}}}}
        return pd.Series([telemetry_packets.encode(tree(r)) for r in zip(a, lat, lon, q, strict=True)])

    li = _t(spark, sf_dir, "lineitem").withColumn("packet", packet("l_orderkey", F.radians("l_discount"), F.radians("l_tax"), "l_quantity"))
    d = telemetry_packets.decoded(li)
    fix = {c: x for c, x in zip(telemetry_packets.FIELDS, telemetry_packets.fix(F.col("fields")), strict=True)}
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(fix["lat"], 6).alias("lat"), F.round(fix["lon"], 6).alias("lon"), fix["alt_m"].alias("alt_m"), F.round(fix["gb_pitch"], 6).alias("gb_pitch"))


@query("""
WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM orders)
SELECT o_orderkey, i // 36 AS sheet, i % 36 // 6 AS row, i % 6 AS col FROM r""")
def q35_montage_page(spark, sf_dir):
    i = annotate.group_rank(["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")]) - 1
    o = _t(spark, sf_dir, "orders").withColumn("i", i.cast("long")).withColumn("p", scalars.sheet_place(F.col("i")))
    return o.select("o_orderkey", "p.sheet", "p.row", "p.col")


@query("""
WITH x AS (SELECT event_id, value, event_id * 7 % 1000 - 400.0 AS a, epoch_us(ts) // 1000000 AS s FROM events)
SELECT event_id, round(a - floor((a + 180) / 360) * 360, 6) AS half, round(a - floor(a / 360) * 360, 6) AS full, round(111320.0 * cos(radians(event_id % 80)), 6) AS lon_m,
 printf('%02dm%02ds', (s % 6000) // 60, (s % 6000) % 60) AS timecode, strftime(make_timestamp(2026, 1, 1, 0, 0, 0.0) + to_seconds(s % 86400), '%Y%m%d%H%M%S') AS stamp FROM x""")
def q36_scalars(spark, sf_dir):
    a, s = F.col("event_id") * 7 % 1000 - 400.0, F.floor(F.col("us") / 1_000_000) % 6000
    day = F.floor(F.col("us") / 1_000_000) % 86400
    stamp = F.date_format(F.expr("timestamp_ntz'2026-01-01 00:00:00'") + F.make_dt_interval(secs=day.cast("decimal(18,6)")), "yyyyMMddHHmmss")
    return _events(spark, sf_dir).select("event_id", F.round(scalars.turn_half(a), 6).alias("half"), F.round(scalars.turn_full(a), 6).alias("full"), F.round(scalars.lon_metres(F.col("event_id") % 80), 6).alias("lon_m"), scalars.timecode(s).alias("timecode"), stamp.alias("stamp"))


@query("""
SELECT user_id, number, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS start
FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS number, epoch_us(ts) // 1000 % 86400000 AS ms FROM events)""")
def q37_subtitle_times(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("ms", F.floor(F.col("us") / 1000) % 86_400_000)
    return e.select("user_id", annotate.group_rank(["user_id"], [F.col("us")]).alias("number"), scalars.srt_time(F.col("ms") / 1000).alias("start"))


@query("""SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="(/[^"#?<>]*)"', 1))) AS asset FROM pages""")
def q38_page_links(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"#?<>]*)"'), F.lit(1)))).alias("asset"))


@query("""
WITH x AS (SELECT source, lang, doc_id FROM documents)
SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM x GROUP BY 1""")
def q39_last_wins(spark, sf_dir):
    return ingest.last_wins(_t(spark, sf_dir, "documents").select("source", "doc_id", "lang"), "source", "doc_id")


_TURNS = """e AS (SELECT user_id, epoch_us(ts) / 3.6e9 AS t, (event_id * 37 % 11)::DOUBLE AS yaw, (event_id % 3)::DOUBLE AS pitch FROM events),
g AS (SELECT user_id, i, lo + i * 0.5 AS t FROM (SELECT user_id, min(t) AS lo, max(t) AS hi FROM e GROUP BY 1), LATERAL (SELECT unnest(range(0, floor((hi - lo) / 0.5)::BIGINT + 1)) AS i)),
p AS (SELECT g.*, e.t AS t0, e.yaw AS y0, e.pitch AS p0 FROM g ASOF JOIN e ON g.user_id = e.user_id AND g.t >= e.t),
n AS (SELECT p.*, e.t AS t1, e.yaw AS y1, e.pitch AS p1 FROM p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.t <= e.t),
v AS (SELECT user_id, i, t, CASE WHEN t1 IS NULL OR t1 = t0 THEN y0 ELSE y0 + (y1 - y0) * ((t - t0) / (t1 - t0)) END AS yaw, CASE WHEN t1 IS NULL OR t1 = t0 THEN p0 ELSE p0 + (p1 - p0) * ((t - t0) / (t1 - t0)) END AS pitch FROM n),
d AS (SELECT user_id, i, t, abs(lead(yaw) OVER w - yaw) AS dy, abs(lead(pitch) OVER w - pitch) AS dp FROM v WINDOW w AS (PARTITION BY user_id ORDER BY i)),
m AS MATERIALIZED (SELECT user_id, i, t FROM d WHERE sqrt(dy * dy + dp * dp) BETWEEN 0.4 AND 8 AND greatest(dy, dp) > 2 * least(dy, dp)),
after AS MATERIALIZED (SELECT a.user_id, a.i, b.i AS nx FROM m a ASOF LEFT JOIN m b ON a.user_id = b.user_id AND a.i + 4 <= b.i)"""


@query(f"""
WITH RECURSIVE {_TURNS}, c AS (SELECT user_id, min(i) AS i FROM m GROUP BY 1 UNION ALL SELECT c.user_id, a.nx FROM c JOIN after a ON a.user_id = c.user_id AND a.i = c.i WHERE a.nx IS NOT NULL)
SELECT user_id, round(m.t, 6) AS t0, round(m.t + 0.5, 6) AS t1 FROM c JOIN m USING (user_id, i)""")
def q40_pan_pairs(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", (F.col("us") / 3.6e9).alias("t"), (F.col("event_id") * 37 % 11).cast("double").alias("yaw"), (F.col("event_id") % 3).cast("double").alias("pitch"))
    return timeseries.pan_pairs(e, "user_id").select("user_id", F.round("t0", 6).alias("t0"), F.round("t1", 6).alias("t1"))
