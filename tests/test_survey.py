"""Survey operators against NumPy, plain Python and DuckDB."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.functions import rules, scalars, text
from aerolens.operators import annotate, catalog, coverage, detect, probe, pyramid, raster, spatial, timeseries, tracking
from aerolens.plans import details, journeys, many, survey  # noqa: F401
from aerolens.sources import sinks, tables, telemetry_packets

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [k for k in survey.SQL if k not in ("q18_descent", "q13_cells_within_radius")])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = survey.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = c.execute(survey.SQL[name])
    at = [[x[0] for x in r.description].index(x) for x in cols]
    want = sorted((tuple(_norm(row[i]) for i in at) for row in r.fetchall()), key=repr)
    assert sorted((tuple(_norm(row[x]) for x in cols) for row in df.collect()), key=repr) == want


def test_interpolation_and_unwrap_equal_numpy(spark):
    rng = np.random.default_rng(1)
    t = np.sort(rng.uniform(0, 100, 60))
    yaw = (np.cumsum(rng.normal(0, 60, 60)) + 180) % 360 - 180
    df = spark.createDataFrame([("a", float(x), float(y)) for x, y in zip(t, yaw)], "video string, t double, yaw double")
    got = [r["unwrapped"] for r in timeseries.unwrap_degrees(df, ["video"], "t", "yaw").orderBy("t").collect()]
    assert np.allclose(got, np.unwrap(yaw, period=360))
    at = [-5.0, float(t[3]), *map(float, rng.uniform(0, 100, 20)), 200.0]
    grid = spark.createDataFrame([("a", x) for x in at], "video string, t double")
    got = {r["t"]: r["yaw"] for r in timeseries.interpolate(grid, df, ["video"], "t", ["yaw"]).collect()}
    assert np.allclose([got[x] for x in at], np.interp(at, t, yaw))


def test_nearest_tie_goes_to_the_earlier_row(spark):
    left = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, 10), ("a", 3.0, 30)], "k string, t double, v int")
    got = {r["k"]: r["near"] for r in timeseries.asof_nearest(left, right, ["k"], "t", ["v"]).collect()}
    assert got["a"]["v"] == 10 and got["b"] is None


def test_range_median_needs_three_estimates(spark):
    s = spark.createDataFrame([("a", 0.0), ("a", 100.0)], "k string, t double")
    e = spark.createDataFrame([("a", -20.0, 1.0), ("a", 5.0, 2.0), ("a", 20.0, 9.0), ("a", 20.1, 99.0), ("a", 99.0, 1.0)], "k string, t double, f double")
    assert {r["t"]: r["median"] for r in timeseries.range_median(s, e, ["k"], "t", "f", 20.0).collect()} == {0.0: 2.0, 100.0: None}


def test_radius_join_forms_no_product(spark):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 50, (80, 2)), rng.uniform(0, 50, (90, 2))
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id int, x double, y double")
    right = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "id int, x double, y double")
    out = spatial.radius_join(left, right, 4.0)
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    assert {(r["id"], r["r_id"]) for r in out.collect()} == set(zip(*map(np.ndarray.tolist, np.nonzero(d <= 4))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    near = {r["id"]: r["min_dist"] for r in spatial.nearest_distance(left, right, "id", 1.0).collect()}
    assert np.allclose([near[i] for i in range(80)], d.min(1))


def test_polygon_forms_agree(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    p = spark.createDataFrame([(x + 0.25, y + 0.25) for x in range(-1, 5) for y in range(-1, 5)], "x double, y double")
    column = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ring])
    rows = p.select(spatial.in_polygon(F.col("x"), F.col("y"), ring).alias("a"), spatial.in_polygon_column(F.col("x"), F.col("y"), column).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and {r["a"] for r in rows} == {True, False}


def test_ray_casts_agree_and_sky_has_no_hit(spark):
    grid = spark.range(41 * 41).select(F.expr("int(id div 41)").alias("iy"), F.expr("int(id % 41)").alias("ix"), (F.expr("id % 41") * 2.0).cast("double").alias("z"))
    e, n, u = math.cos(math.radians(-20)), 0.0, math.sin(math.radians(-20))
    rays = spark.createDataFrame([(1, 5.0, 20.0, 100.0, e, n, u), (2, 5.0, 20.0, 100.0, e, n, -u), (3, 5.0, 20.0, -50.0, e, n, u)], "id int, x double, y double, alt double, e double, n double, u double")
    kernel = {r["id"]: r for r in raster.cast_rays(rays, raster.Terrain.of(grid), "id", cell=10.0).collect()}
    forks = (0.0, 30.0, -30.0)
    both = [sorted(map(tuple, raster.cast_rays(rays, raster.Terrain.of(grid), "id", cell=10.0, forks=forks).collect()), key=str), sorted(map(tuple, pyramid.cast_pyramid(rays, grid, "id", cell=10.0, forks=forks, block=8).collect()), key=str)]
    assert len(both[0]) == 9 and all(a[:3] == b[:3] and all(x == y or math.isclose(x, y, abs_tol=1e-5) for x, y in zip(a[3:], b[3:])) for a, b in zip(*both))
    lifted = {r["lift"]: r["dist"] for r in raster.cast_rays(rays, raster.Terrain.of(grid), "id", cell=10.0, forks=forks).where("id = 1").collect()}
    assert all(abs(lifted[k] - (100 - 10 - k) / (math.sin(math.radians(20)) + 0.2 * e)) < 1e-3 for k in forks)
    assert raster.Terrain.of(grid.limit(0)) is None and raster.cast(rays, grid.limit(0), "id").where("dist is not null").count() == 0
    joined = {r["id"]: r["step"] for r in pyramid.cast_pyramid(rays, grid, "id", cell=10.0).collect()}
    want = (100 - 10) / (math.sin(math.radians(20)) + 0.2 * e)
    assert abs(kernel[1]["dist"] - want) < 1e-3 and kernel[2]["dist"] is None and kernel[3]["dist"] is None
    assert {k: r["step"] for k, r in kernel.items()} == joined


def test_verdicts_of_forks(spark):
    c = spark.createDataFrame([("a", 0.0, 1.0, 1.0, 5.0), ("a", 30.0, 11.0, 1.0, 6.0), ("b", 0.0, 1.0, 1.0, 5.0), ("b", 30.0, None, None, None), ("c", 0.0, None, None, None)], "k string, lift double, hit_x double, hit_y double, dist double")
    got = {r["k"]: (r["drift"], r["verdict"]) for r in raster.verdicts(c, "k").collect()}
    assert got == {"a": (10.0, "ok"), "b": (math.inf, "poloho"), "c": (None, "no_hit")}


def test_level_lines_are_chained(spark):
    y, x = np.mgrid[:41, :41]
    ring, = raster.contours(np.hypot(x - 20.0, y - 20.0), 10.5)
    assert (ring[0] == ring[-1]).all() and len(ring) > 60 and np.abs(np.hypot(*(ring - 20).T) - 10.5).max() < 0.05
    assert np.hypot(*np.diff(ring, axis=0).T).max() < 1.5
    lines = raster.contours(x * 1.0, 7.25)
    assert len(lines) == 1 and sorted(lines[0][:, 1]) == list(range(41)) and set(lines[0][:, 0]) == {7.25}
    assert raster.contours(x * 1.0, 99.0) == []
    tiles = spark.createDataFrame([(t, i, j, float(j + 10 * t)) for t in (0, 1) for i in range(4) for j in range(5, 9)], "tile int, iy int, ix int, z double")
    got = {(r["tile"], r["line"], r["i"], r["x"], r["y"]) for r in raster.contour_lines(tiles, [6.5, 17.5], "tile").collect()}
    assert {(t, x) for t, _, _, x, _ in got} == {(0, 6.5), (1, 7.5)} and len(got) == 8
    way = raster.descents(spark.createDataFrame([(1, 5, 30)], "id int, x int, y int"), raster.Terrain(((x - 30.0) ** 2 + (y - 30.0) ** 2)[:, :] * 1.0), "id", cell=10.0).orderBy("i").collect()
    assert (way[0]["x"], way[0]["y"]) == (5.0, 30.0) and len(way) > 5 and way[5]["x"] > 8


def test_descent_goes_down():
    y, x = np.mgrid[:60, :60]
    way = raster.Terrain(((x - 30.0) ** 2 + (y - 30.0) ** 2) * 1.0).descend(np.array([5.0, 90.0]), np.array([50.0, 10.0]), cell=10.0)
    assert way[0].tolist().count(1) == 1  # a start beyond the terrain stays where it is
    way = [(a, b) for k, a, b in zip(*way) if k == 0]
    r = [math.hypot(a - 30, b - 30) for a, b in way]
    assert len(way) > 5 and r[-1] < 1.5 and all(b < a for a, b in zip(r, r[1:]) if a > 1.5)  # at the bottom it steps to and fro
    assert [x.tolist() for x in raster.contours(np.array([[0.0, 0.0], [10.0, 10.0]]), 5.0)] == [[[0.0, 0.5], [1.0, 0.5]]]


def test_blobs_find_a_rare_patch_and_drop_a_speck(spark):
    rows = [("f", y, x, 60, 128, 128) for y in range(160) for x in range(160)]
    px = {(y, x): i for i, (_, y, x, *_r) in enumerate(rows)}
    for y in range(20, 23):
        for x in range(30, 33):
            rows[px[y, x]] = ("f", y, x, 200, 180, 90)
    rows[px[70, 70]] = ("f", 70, 70, 10, 10, 10)
    df = spark.createDataFrame(rows, "frame string, y int, x int, L int, a int, b int")
    got = detect.blobs(df, density=1e-3).collect()
    assert [(r["x"], r["y"], r["w"], r["h"], r["area"]) for r in got] == [(30, 20, 3, 3, 9)]


def test_labels_are_eight_connected():
    m = np.zeros((6, 6), bool)
    m[0, 0] = m[1, 1] = m[4, 4] = True
    assert detect.label(m).max() == 2 and detect.label(m)[0, 0] == detect.label(m)[1, 1]
    a = np.random.default_rng(0).random((32, 32))
    assert detect.shift(a, np.roll(a, (3, -5), (0, 1))) == (-5.0, 3.0)


def test_track_rules():
    k = tracking.Tracker()
    k.feed(0.0, 0, 0, [(0, 0, 2, 2, 5.0), (59, 0, 2, 2, 4.0), (200, 0, 2, 2, 3.0)])
    assert len(k.open) == 2  # the second blob continued the track that this sample began
    assert k.open[0]["score"] == 5.0 and k.at[0].tolist() == [60.0, 1.0]
    k = tracking.Tracker()
    k.feed(0.0, 0, 0, [(0, 0, 3, 2, 1.0), (61, 0, 2, 2, 0.5)])
    assert k.at.tolist() == [[1.0, 1.0], [62.0, 1.0]]  # half an odd width is rounded down
    k = tracking.Tracker()
    k.feed(0.0, 0, 0, [(0, 0, 3, 2, 1.0), (60, 0, 2, 2, 0.5)])
    assert len(k.open) == 2
    k = tracking.Tracker()
    k.feed(0.0, 0, 0, [(0, 0, 0, 0, 1.0)])
    assert k.feed(1.0, 0, 0, [(60, 0, 0, 0, 1.0)]) == [] and len(k.open) == 2  # exactly 60 is too far
    k = tracking.Tracker()
    k.feed(0.0, 0, 0, [(0, 0, 0, 0, 1.0)])
    assert [len(k.feed(float(t), 0, 0, [])) for t in (1, 2, 3, 4)] == [0, 0, 0, 1]


def _plain_tracks(samples, reach=60.0, misses=3, top=25):
    """Tracks of one video as sets of values, by exhaustive search over all open tracks."""
    live, closed = [], []
    for t, blobs in sorted(samples.items()):
        for x, y, w, h, score in sorted(blobs, key=lambda b: (-b[4], b[1], b[0]))[:top]:
            c = (x + w // 2, y + h // 2)
            near = [(math.dist(c, k["c"]), i) for i, k in enumerate(live) if math.dist(c, k["c"]) < reach]
            if not near:
                live.append({"c": c, "seen": [t], "best": (score, t, (x, y, w, h))})
                continue
            k = live[min(near)[1]]
            k["c"] = c
            k["seen"].append(t)
            if score > k["best"][0]:
                k["best"] = (score, t, (x, y, w, h))
        late = [k for k in live if sum(u > k["seen"][-1] for u in samples if u <= t) > misses]
        closed += late
        live = [k for k in live if k not in late]
    return closed + live


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_tracks_query_equals_a_plain_search(spark):
    import pandas as pd

    e = pd.read_parquet(f"{SF}/events.parquet")
    hour = e.ts.astype("datetime64[us]").astype("int64") // 3_600_000_000
    want = set()
    for user, own in e.assign(hour=hour).groupby("user_id"):
        samples = {float(t): [(int(r.value // 1), r.event_id % 40, 3 + r.event_id % 4, 5, r.value) for r in g.itertuples()] for t, g in own.groupby("hour")}
        want |= {(str(user), k["best"][1], k["seen"][0], k["seen"][-1], *k["best"][2], k["best"][0]) for k in _plain_tracks(samples)}
    got = survey.QUERIES["q31_tracks"](spark, SF).collect()
    assert {(r["video"], r["t_best"], r["t0"], r["t1"], r["x"], r["y"], r["w"], r["h"], r["score"]) for r in got} == want and len(got) == len(want) > 100
    for video in {r["video"] for r in got}:
        own = sorted((r for r in got if r["video"] == video), key=lambda r: r["track"])
        assert [r["track"] for r in own] == list(range(len(own))) and all(a["score"] >= b["score"] for a, b in zip(own, own[1:]))


def test_streamed_tracks_equal_batch(spark, tmp_path):
    from aerolens.streaming.tracks import stream_tracks

    kind = "video string, t double, dx double, dy double, blobs array<struct<x:int,y:int,w:int,h:int,score:double>>"
    rows = [("v", float(t), 0.0, 0.0, [(t, 0, 2, 2, float(t % 3))] if t < 4 else [(500, 0, 2, 2, 1.0)] if t == 5 else []) for t in range(12)]
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_tracks(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["t0"], r["t1"], r["score"]) for r in spark.sql("select * from closed").collect()}
    want = {(r["t0"], r["t1"], r["score"]) for r in tracking.build_tracks(spark.createDataFrame(rows, kind)).collect()}
    assert got == want and len(want) == 2


def test_summary_conserves_rows(spark):
    df = spark.createDataFrame([("v", 100.0, 2000.0), ("v", None, 2000.0), ("v", 50.0, None), ("w", None, None)], "video string, dist_m double, f_px double")
    got = {r["video"]: r for r in coverage.summarize(coverage.classify(df)).collect()}
    assert got["v"]["n"] == 3 and got["v"]["gsd_med"] == 5.0 and abs(got["v"]["shows_100"] - 1 / 3) < 1e-9
    assert got["w"]["no_focal"] == 1.0 and got["w"]["sky"] == 0 and got["w"]["shows_100"] is None  # without a focal length nothing is cast


def _packet(**more):
    tree = {3: {1: {2: 5}, 3: {3: {1: -15, 2: 20, 3: -900}, 4: {1: {2: math.radians(45.5), 3: math.radians(-7.25)}, 2: 1_234_500}, 5: {1: 99_900}}, 4: {3: {1: -301, 3: 450}}}}
    return telemetry_packets.encode(tree | more)


def test_packet_fields(spark):
    data = _packet()
    d = telemetry_packets.decoded(spark.createDataFrame([(data,), (data[: len(data) - 6],), (b"",)], "packet binary"))
    full, cut, none = d.select(*telemetry_packets.fix(F.col("fields"))).collect()
    assert abs(full["lat"] - 45.5) < 1e-9 and abs(full["lon"] + 7.25) < 1e-9 and full["alt_m"] == 1234.5 and full["alt_rel_m"] == 99.9
    assert (full["ac_yaw"], full["ac_roll"], full["gb_pitch"], full["gb_yaw"]) == (-90.0, -1.5, -30.1, 45.0)
    assert none["lat"] is None and full["lat"] is not None and cut is not None


def test_packet_blob_stays_bytes_and_a_cut_keeps_what_came_before():
    blob = b"\xff\xfe\xfd\x00\x07"
    got = telemetry_packets.decode(telemetry_packets.encode({1: 7, 2: blob, 3: 2.5}))
    assert got["1"][0] == 7 and got["2"][3] == blob and got["3"][1] == 2.5
    assert telemetry_packets.decode(telemetry_packets.encode({1: 7, 2: 9}) + b"\x18\x80")["2"][0] == 9


def test_frames_slice_the_stream(spark):
    df = spark.createDataFrame([("v", 1.0, 2, 0, b"abcdef"), ("v", 2.0, 3, 1, b"abcdef"), ("v", 3.0, 1, 2, b"abcdef")], "video string, pts double, size int, ord long, stream binary")
    got = telemetry_packets.frames(df, F.col("stream")).orderBy("pts").collect()
    assert [bytes(r["packet"]) for r in got] == [b"ab", b"cde", b"f"]


def test_signatures_by_class(spark):
    df = spark.createDataFrame([("предмет", 20.0), ("контроль", 3.0), ("ловушка", 1.0)], "kind string, C double")
    own, traps = annotate.usable(df)
    assert own.count() == 1 and traps.count() == 1 and annotate.usable(df, neutral=True)[0].count() == 2
    assert [r["C"] for r in annotate.resorted(df.withColumn("o", F.col("C")).withColumn("d", F.when(F.col("C") > 2, F.col("C"))), "d", "o").collect()] == [3.0, 20.0, 1.0]
    assert [r["C"] for r in annotate.top(df, [F.desc("C")], 2).collect()] == [20.0, 3.0]


def test_lookups_tell_what_they_lack(spark):
    points = spark.createDataFrame([("tg", "open"), ("ai", "open"), ("ai", "open")], "src string, status string")
    rows = spark.createDataFrame([("tg", "open", "call")], "src string, status string, verdict string")
    assert [tuple(r) for r in catalog.unmatched(points, rows, ["src", "status"]).collect()] == [("ai", "open")]
    rows = [("/r/scans/A", 3, 125.9, "300,200,21,11"), ("/r/scans/A", 4, 5.0, "10,2,8,8"), ("/r/scans/B", 3, 125.9, "0,0,2,2"), ("/r/scans/A", 12, 600.0, "1,1,1,1")]
    cand = spark.createDataFrame(rows, "folder string, track int, t_best double, bbox string")
    crops = spark.createDataFrame([(f"/r/scans/A/crops/{x}.jpg",) for x in ("t0003_02m05s", "t0004_00m05s", "t0012_10m01s")] + [("/r/scans/B/t0003_02m05s.jpg",)], "path string")
    got = {(r["folder"][-1], r["track"]): (r["crop"], tuple(r["corner"])) for r in annotate.with_crop(cand, crops).collect()}
    assert got == {("A", 3): ("/r/scans/A/crops/t0003_02m05s.jpg", (182, 77)), ("A", 4): ("/r/scans/A/crops/t0004_00m05s.jpg", (0, 0)), ("B", 3): (None, (0, 0)), ("A", 12): (None, (0, 0))}
    assert catalog.token_join(spark.createDataFrame([], "t string"), crops, "t", "path").count() == 0
    assert probe.grid(spark, ["s", "o"], 3).count() == 2 * 11 * 4 * 3


def test_text_tables_come_back(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.5, 0.0, 2.0, "1,2,3,4", 9.5, None, None, None), (1, 2.5, 1.0, 3.0, "5,6,7,8", 8.5, 45.0, 7.0, 100.0)], "track int, t_best double, t0 double, t1 double, bbox string, score double, lat double, lon double, alt double")
    sinks.write_tsv(df.coalesce(1), str(tmp_path / "tracks"))
    kind, got = tables.candidates(spark, str(tmp_path / "tracks"))
    assert kind == "tracks" and sorted(map(tuple, got.drop("ord").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert [r["track"] for r in got.orderBy("ord").collect()] == [0, 1]
    for n in (1, 2):
        sinks.write_tsv(spark.createDataFrame([("f", n, "1,2,3,4", 12, "1,2,3", 0.5)], "frame string, blob int, bbox string, area int, rgb string, score double").coalesce(1), str(tmp_path / "detections"), "append", header=False)
    kind, got = tables.candidates(spark, str(tmp_path / "detections"))
    assert kind == "detections" and {r["blob"] for r in got.collect()} == {1, 2}


def test_increments_run_on_a_schedule(spark, tmp_path):
    from aerolens.streaming import increments

    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(src)
    q = increments.ingest(spark, src, spark.read.parquet(src).schema, target, str(tmp_path / "c"), every="1 second")
    try:
        q.processAllAvailable()
        spark.range(3, 5).write.mode("append").parquet(src)
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [0, 1, 2, 3, 4]
    late = spark.createDataFrame([("2026-01-01 00:10:00", "a"), ("2026-01-01 00:20:00", "a"), ("2026-01-01 01:10:00", "b")], "ts string, k string").select(F.col("ts").cast("timestamp").alias("ts"), "k")
    assert sorted((r["k"], r["n"]) for r in increments.windowed_counts(late, "ts", "k").collect()) == [("a", 2), ("b", 1)]


def test_lattices_spans_and_series(spark):
    from aerolens.operators import frames

    df = spark.createDataFrame([("v", 1.0, None), ("v", 4.0, 2.0)], "k string, t double, alt double")
    assert tuple(frames.span(df, "k", "alt").first()) == ("v", 2.0, 2.0) and tuple(frames.span(df, "k", "t").first()) == ("v", 1.0, 4.0)
    assert [(r["i"], r["t"]) for r in timeseries.resample(df, ["k"], "t", 1.25).orderBy("i").collect()] == [(0, 1.0), (1, 2.25), (2, 3.5)]
    assert raster.with_misses(spark.createDataFrame([(1, "p"), (2, None), (3, "q")], "k int, path string"), spark.createDataFrame([(1, 4.0, "ok")], "k int, drift double, verdict string"), "k").orderBy("k").select("verdict").collect() == [("ok",), ("miss",), ("no_hit",)]


def test_finite_numbers_only(spark):
    df = spark.createDataFrame([("1.5",), ("inf",), ("nan",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(scalars.number(F.col("s"))).collect()] == [1.5, None, None, None, None]


def test_nearest_distances_over_all_scales(spark):
    rng = np.random.default_rng(9)
    hits = np.concatenate([rng.uniform(0, 5, (300, 2)), rng.uniform(900, 905, (20, 2)), [[-4000.0, 10.0]]])
    cells = np.concatenate([rng.uniform(-1000, 1000, (60, 2)), hits[:3], rng.uniform(0, 6, (20, 2))])
    table = lambda a: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)], "id int, x double, y double")
    got = {r["id"]: r["min_dist"] for r in spatial.nearest_distance(table(cells), table(hits), "id", 0.5).collect()}
    assert np.allclose([got[i] for i in range(len(cells))], np.hypot(*(cells[:, None] - hits[None]).transpose(2, 0, 1)).min(1))
    assert {r["min_dist"] for r in spatial.nearest_distance(table(cells), table(hits[:0]), "id", 0.5).collect()} == {math.inf}


def test_rules(spark):
    df = spark.createDataFrame([(80.0, 3.0, -9.0), (20.0, 0.0, 0.0)], "L double, a double, b double")
    assert [r[0] for r in df.select(rules.rule_column("C>=8&b<0")).collect()] == [True, False]
    for bad in ("Z>1", "C~3", "", "C>=8&"):
        with pytest.raises(ValueError):
            rules.rule_column(bad)


def test_scans(spark, tmp_path):
    (tmp_path / "a.gps.tsv").write_text("time_s\tlat\tlon\talt_m\textra\n0.0\t1.5\t2.5\t\tx\n1.0\tbad\t2.5\t3\tx\n2.0\t\t\t4\tx\n")
    rows = tables.telemetry(spark, str(tmp_path / "a.gps.tsv")).orderBy("time_s").collect()
    assert [(r["video"], r["time_s"], r["lat"], r["alt_m"]) for r in rows] == [("a", 0.0, 1.5, None), ("a", 2.0, None, 4.0)]
    (tmp_path / "k.kml").write_text('<kml><Document><Placemark><name>one</name><LineString><coordinates>1,2 3,4</coordinates></LineString></Placemark><Placemark><name>dot</name><LineString><coordinates>1,2</coordinates></LineString></Placemark></Document></kml>')
    (tmp_path / "p.kml").write_text('<kml><Placemark><name>ring</name><Polygon><outerBoundaryIs><LinearRing><coordinates>1,2,0 3,4,0 5,6,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark><Placemark><name>ring</name><LineString><coordinates>7,8 9,10</coordinates></LineString></Placemark></kml>')
    assert [[tuple(p) for p in r["line"]] for r in tables.kml_lines(spark, str(tmp_path / "p.kml")).collect()] == [[(8.0, 7.0), (10.0, 9.0)]]
    (tmp_path / "t.gpx").write_text('<gpx xmlns="http://www.topografix.com/GPX/1/1"><wpt lat="9" lon="8"><name>camp</name></wpt><trk><trkseg><trkpt lat="1.5" lon="2"/><trkpt lat="1.25" lon="2"/></trkseg></trk></gpx>')
    assert [(r["lat"], r["lon"]) for r in tables.gpx_points(spark, str(tmp_path / "t.gpx")).orderBy("ord").collect()] == [(1.5, 2.0), (1.25, 2.0)]
    assert [(r["name"], r["lat"]) for r in tables.gpx_points(spark, str(tmp_path / "t.gpx"), "wpt").collect()] == [("camp", 9.0)]
    (tmp_path / "ring.json").write_text("[[1.0, 2.0], [3, 4]]")
    assert tables.polygon(spark, str(tmp_path / "ring.json")).first()["ring"] == [[1.0, 2.0], [3.0, 4.0]]
    assert [(r["time_s"], r["lat"]) for r in tables.positions(spark, str(tmp_path / "a.gps.tsv")).collect()] == [(0.0, 1.5)] and tables.positions(spark, str(tmp_path / "no.gps.tsv")).count() == 0
    (tmp_path / "DJI_1.coverage.tsv").write_text("t\tf_px\tdist_m\tgsd_cm\tobj8px_cm\tstatus\n0.5\t2000\t100\t5\t40\tok\n1.5\t\t100\t\t41\tno_focal\n")
    assert [(r["video"], r["t"], r["obj8px_cm"]) for r in tables.scales(tables.coverage(spark, str(tmp_path / "DJI_1.coverage.tsv"))).orderBy("t").collect()] == [("DJI_1", 0.5, 40.0), ("DJI_1", 1.5, None)]
    (tmp_path / "s.tsv").write_text("# about\n# it\nname\tL\nred\t50.1\n")
    assert [tuple(r) for r in tables.signatures(spark, str(tmp_path / "s.tsv")).collect()] == [("red", "50.1")]
    days = spark.createDataFrame([("DJI_20260811101010_0001_Z.MP4",), ("DJI_20260813101010_0001_Z.MP4",)], "name string")
    assert tables.on_days(days, ["20260811", "20260812"]).count() == 1
    assert [r[0].rsplit("/", 1)[1] for r in tables.files(spark, str(tmp_path), "*.kml").orderBy("path").select("path").collect()] == ["k.kml", "p.kml"]
    lines = tables.kml_lines(spark, str(tmp_path / "k.kml")).collect()
    assert [(r["name"], [tuple(p) for p in r["line"]]) for r in lines] == [("one", [(2.0, 1.0), (4.0, 3.0)])]
    (tmp_path / "m.tsv").write_text("a/b.mp4\tid1\t10\n\tid2\t5\n")
    assert [r["path"] for r in tables.manifest(spark, str(tmp_path / "m.tsv")).collect()] == ["a/b.mp4"]
    (tmp_path / "t.tsv").write_text("track\tt_best\tt0\tt1\tbbox\tscore\tlat\tlon\talt\n0\t1\t0\t2\t1,2,3,4\t9.5\t\t\t\n")
    kind, t = tables.candidates(spark, str(tmp_path / "t.tsv"))
    assert kind == "tracks" and t.select(scalars.box(F.col("bbox"))["cx"]).first()[0] == 2 and t.first()["lat"] is None


def test_text_sinks(spark):
    df = spark.createDataFrame([("v", 0.0333333, 45.12345678, None, 10.0), ("v", 1.0, 45.0, 7.0, 11.0)], "video string, time_s double, lat double, lon double, alt_m double")
    assert tuple(df.select(*sinks.telemetry_text(["time_s", "lat", "lon", "alt_m"])).first()) == ("0.03", "45.1234568", "", "10.0")
    block = sinks.subtitles(df.withColumn("video", F.lit("DJI_20260811101010_0001_Z.MP4"))).orderBy("number").first()["block"]
    assert block == '1\n00:00:00,033 --> 00:00:01,000\n<font size="28">SrtCnt : 1, DiffTime: 967ms\n2026-08-11 10:10:10.033\n[latitude: 45.12345678] [longitude: ] [altitude: 10.0] </font>\n'
    assert "\n2026-01-01 00:00:01.000\n" in sinks.subtitles(df).orderBy(F.desc("number")).first()["block"]
    lines = [r["line"] for r in sinks.with_preamble(df.select("video", "alt_m"), "# one\n# two\n", ["video", "alt_m"]).collect()]
    assert lines == ["# one\n# two", "video\talt_m", "v\t10.0", "v\t11.0"]
    assert [r["json"] for r in sinks.map_json(df.select("video", "alt_m")).collect()] == ['{"video":"v","alt_m":10.0}', '{"video":"v","alt_m":11.0}']


def test_slug_snippet_and_names(spark):
    df = spark.createDataFrame([("  Съёмка: Щука & Юля!  ", "x" * 200)], "a string, b string")
    assert spark.range(1).select(text.slug(F.lit("!?")).alias("a"), text.slug(F.lit("Чат"), F.lit("chat-1")).alias("b"), text.display_name(*[F.lit(None)] * 5).alias("c"), text.display_name(F.lit("A"), F.lit(""), *[F.lit("t")] * 3).alias("d")).first() == ("topic", "chat-1", "?", "A")
    label = F.lit("scan-183534 and DJI_20260811101010_0001_Z.JPG, C0049; DJI_20260812222324 DJI_20260811101010_0001_Z")
    assert spark.range(1).select(text.clip_tokens(label)).first()[0] == ["DJI_20260811101010_0001_Z.JPG", "DJI_20260811101010_0001_Z", "C0049", "183534", "222324"]
    assert spark.range(1).select(text.asset_paths(F.lit('<img src="/analysis/a/b-1.jpg"> "docs/x.PNG" data/y.gif'))).first()[0] == ["analysis/a/b-1.jpg", "docs/x.PNG"]
    r = df.select(text.slug(F.col("a")).alias("s"), text.snippet(F.col("b")).alias("t"), text.display_name(F.lit(None), F.lit(None), F.lit(None), F.lit("u"), F.lit(3)).alias("n")).first()
    assert r["s"] == "semka-shchuka-yulya" and len(r["t"]) == 160 and r["t"].endswith("...") and r["n"] == "u"


def test_facets_and_recall(spark):
    df = spark.createDataFrame([("open", 3, None), ("open", None, "v"), ("closed", 9, None), ("open", None, None), ("open", 1, "x")], "status string, conf_num int, conf_tag string")
    ok = catalog.facet_filter({"status": ["open"]}, least_conf=2)
    far = spark.createDataFrame([(None,), (5.0,), (50.0,)], "d double")
    assert [r[0] for r in far.select(catalog.facet_filter({}, {"d": (None, 10.0)})).collect()] == [True, True, False]
    kinds = df.withColumn("kind", F.lit("item")).withColumn("ord", F.monotonically_increasing_id())
    assert [(r["conf_num"], r["conf_tag"]) for r in catalog.by_kind(kinds, ["rope", "item"]).collect()] == [(None, "v"), (9, None), (3, None), (None, None), (1, "x")]
    assert [r[0] for r in df.select(ok).collect()] == [True, True, False, False, False]
    t = spark.createDataFrame([("s", 3, 0, 0), ("s", 3, -1, 0), ("s", 3, 0, 1)], "bg string, size int, rank int, dirty int")
    cells = spark.createDataFrame([("s", 3), ("s", 4)], "bg string, size int")
    got = {r["size"]: (r["n"], r["recall"]) for r in probe.recall(t, cells, ["bg", "size"], F.col("rank").between(0, 24), F.col("dirty") == 0).collect()}
    assert got == {3: (2, 0.5), 4: (0, None)}
