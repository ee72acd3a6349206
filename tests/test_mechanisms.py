"""Order statistics, nearest objects, ring covers and terrain pyramids against brute force."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators import annotate, cover, detect, levels, nearest, orderstats, pyramid, raster, regions, spatial
from aerolens.plans import details, survey  # noqa: F401
from aerolens.sources import telemetry_packets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [100_000, 40])
def test_quantiles_equal_sorted_values(spark, most):
    rng = np.random.default_rng(0)
    keys = rng.choice(["a", "b", "c"], 3000, p=[0.8, 0.15, 0.05])
    values = np.where(rng.random(3000) < 0.3, 1.0, np.exp(rng.normal(size=3000) * 8) * rng.choice([-1, 1], 3000))
    rows = [(None if i % 41 == 0 else str(k), None if i % 97 == 0 else float(v)) for i, (k, v) in enumerate(zip(keys, values))] + [("none", None), ("one", 5.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["n"], r["q"]) for r in orderstats.quantiles(df, ["k"], F.col("v"), [0.5, 0.9, 0.0, 1.0], most=most, pieces=8).collect()}
    assert set(got) == {"a", "b", "c", None, "none", "one", "same"}
    for k, (n, q) in got.items():
        own = [v for key, v in rows if key == k and v is not None]
        assert n == len(own) and (q is None if not own else np.allclose(q, np.percentile(own, [50, 90, 0, 100]), rtol=1e-12))
    assert orderstats.quantiles(df.limit(0), ["k"], F.col("v"), [0.5]).count() == 0


def test_quantiles_sort_no_key_whole(spark):
    """However many values a key has, no set of more than `most` distinct ones reaches the sorting window."""
    values = spark.range(5000).select(F.struct(F.lit("k")).alias("k_"), F.lit("").alias("path_"), F.col("id").cast("double").alias("v_"), F.lit(3).alias("c_"))
    wanted = spark.createDataFrame([(0, 7500)], "want_ int, rank_ long").select(F.struct(F.lit("k")).alias("k_"), F.lit("").alias("path_"), "want_", "rank_")
    left, hit, _ = orderstats._narrowed(values, wanted, 400, 16)
    assert 0 < left.count() <= 400 and hit.first()["rank_"] < 1200
    low = left.agg(F.min("v_")).first()[0]
    assert low + hit.first()["rank_"] // 3 == 2500


def test_nearest_signature_searched_equals_compared(spark, monkeypatch):
    rng = np.random.default_rng(2)
    lab = lambda n: [tuple(map(float, x)) for x in np.round(rng.normal(size=(n, 3)) * (15, 20, 6) + (50, 0, 0), 1)]
    sigs = [(f"s{i}", i, *x) for i, x in enumerate(lab(1500))] + [("s3 again", -1, *([20.0] * 3)), ("far", 9999, 500.0, 900.0, -900.0)]
    sigs += [("tie", 5000, *sigs[7][2:])]
    items = [(i, *x) for i, x in enumerate(lab(200))] + [(900, *sigs[7][2:]), (901, None, 1.0, 2.0), (902, 450.0, 800.0, -800.0)]
    s = spark.createDataFrame(sigs, "name string, ord int, L double, a double, b double")
    it = spark.createDataFrame(items, "id int, L double, a double, b double")
    found = annotate.nearest_signature(it, s, "id", "name", "ord")
    got = {r["id"]: (r["nearest"], r["dist"]) for r in found.collect()}
    for i, *p in items:
        if p[0] is None:
            assert got[i][0] is None
            continue
        d = min((math.hypot(math.hypot(p[1] - x[3], p[2] - x[4]) / 8, abs(p[0] - x[2]) / 28), x[1], x[0]) for x in sigs)
        assert abs(got[i][1] - d[0]) < 1e-9 and got[i][0] == d[2], (i, got[i], d)
    monkeypatch.setattr(annotate, "MOST_SIGNATURES", 10_000)
    assert {r["id"]: (r["nearest"], r["dist"]) for r in annotate.nearest_signature(it.where("L is not null"), s, "id", "name", "ord").collect()} == {k: v for k, v in got.items() if v[0]}
    assert nearest.nearest(it, "id", [F.col("L")], s.limit(0), [F.col("L")], [F.col("L")], lambda p, o: F.abs(p[0] - o["L"]), ["ord"]).where("dist is null").count() == len(items)


def test_nearest_forms_no_product(spark):
    """Of 20,000 objects an item meets a handful: the comparisons do not grow with the objects."""
    rng = np.random.default_rng(3)
    objects = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1000, (20_000, 2)))], "o int, x double, y double")
    items = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1000, (300, 2)))], "id int, x double, y double")
    met = spark.sparkContext.accumulator(0)
    count = F.udf(lambda d: met.add(1) or d, "double")
    xy = [F.col("x"), F.col("y")]
    got = nearest.nearest(items, "id", xy, objects, xy, xy, lambda p, o: count(F.hypot(p[0] - o["x"], p[1] - o["y"])), ["o"])
    assert got.where("dist < 30").count() == 300 and met.value < 300 * 120


def test_nearest_line(spark):
    rng = np.random.default_rng(5)
    lines = [(k, q, float(x), float(y)) for k in range(30) for q, (x, y) in enumerate(np.cumsum(rng.normal(size=(25, 2)), 0) + rng.normal(size=2) * 15)]
    lines += [(77, 0, 0.0, 0.0), (78, 0, 3.0, 3.0), (78, 1, 3.0, 3.0), (79, 0, None, 1.0), (79, 1, 1.0, 1.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(150, 2)) * 10)] + [(900, None, 1.0), (901, 3.0, 4.0), (902, 1e5, -1e5)]
    got = {r["id"]: (r["dist"], r["line"]) for r in nearest.nearest_line(spark.createDataFrame(points, "id int, x double, y double"), "id", spark.createDataFrame(lines, "line int, seq int, x double, y double")).collect()}
    parts = [(a[0], np.array(a[2:]), np.array(b[2:])) for a, b in zip(lines, lines[1:]) if a[0] == b[0] and None not in a + b]

    def dist(p, a, b):
        u = b - a
        t = min(1, max(0, float((p - a) @ u) / float(u @ u))) if u.any() else 0.0
        return float(np.hypot(*(p - a - t * u)))

    for i, x, y in points:
        want = min((dist(np.array([x, y]), a, b), k) for k, a, b in parts) if x is not None else (None, None)
        assert got[i] == want or (abs(got[i][0] - want[0]) < 1e-9 * max(1, want[0])), (i, got[i], want)


def test_rings_hold_points(spark):
    rng = np.random.default_rng(7)
    rings = []
    for k in range(12):
        n, r = int(rng.integers(3, 60)), float(10 ** rng.uniform(-1, 3))
        a = np.sort(rng.uniform(0, 2 * np.pi, n))
        d = r * rng.uniform(0.3, 1, n)
        cx, cy = rng.normal(size=2) * 100
        rings += [(k, q, float(cx + x), float(cy + y)) for q, (x, y) in enumerate(zip(d * np.cos(a), d * np.sin(a)))]
    rings += [(50, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (64.0, 0.0), (64.0, 64.0), (0.0, 64.0)])]  # edges on those of tiles
    rings += [(51, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)])]  # crosses itself
    rings += [(52, 0, 1.0, 1.0), (53, 0, 1.0, 1.0), (53, 1, 2.0, 2.0), (54, 0, None, 1.0)]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(size=(500, 2)) * 120)]
    points += [(1000 + i, float(x), float(y)) for i, (x, y) in enumerate((x, y) for x in (0, 2, 32, 63.5, 64, 65) for y in (0, 2, 32, 64))] + [(2000, None, 1.0)]
    p, r = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(rings, "ring int, seq int, x double, y double")
    got = {tuple(x) for x in cover.in_rings(p, "id", r).collect()}
    want = set()
    for k in {x[0] for x in rings} - {54}:
        own = [x[2:] for x in rings if x[0] == k]
        inside = p.where("x is not null").where(spatial.in_polygon(F.col("x"), F.col("y"), own))
        want |= {(x["id"], k) for x in inside.select("id").collect()}
    assert got == want and len(want) > 300


def test_only_points_near_an_edge_meet_edges(spark):
    n = 2000
    ring = [(1, i, 1000 * math.cos(2 * math.pi * i / n), 1000 * math.sin(2 * math.pi * i / n)) for i in range(n)]
    tiles, rows = cover.cover(cover.ring_edges(spark.createDataFrame(ring, "ring int, seq int, x double, y double")))
    kinds = {r["inside"]: r["count"] for r in tiles.groupBy("inside").count().collect()}
    assert kinds[True] > 400 and kinds[None] < 200 and rows.count() < 1.2 * n


def _rays(rng, n, side):
    az, el = rng.uniform(0, 2 * np.pi, n), np.radians(rng.uniform(-60, 10, n))
    x, y = rng.uniform(-3, side + 3, (2, n))
    return [(i, float(x[i]), float(y[i]), float(rng.uniform(50, 600)), float(math.sin(az[i]) * math.cos(el[i])), float(math.cos(az[i]) * math.cos(el[i])), float(math.sin(el[i]))) for i in range(n)]


@pytest.mark.parametrize("cell", [10.0, 2.0])
def test_pyramid_casts_equal_the_kernel(spark, cell):
    rng = np.random.default_rng(11)
    y, x = np.mgrid[:150, :170]
    z = 150 + 80 * np.sin(x / 17) * np.cos(y / 11) + rng.normal(size=x.shape) * 6
    gone = {(40, 50), (41, 50), (100, 20)}
    grid = spark.createDataFrame([(int(i), int(j), float(z[i, j])) for i in range(150) for j in range(170) if (i, j) not in gone] + [(90, 169, None)], "iy int, ix int, z double").dropDuplicates(["iy", "ix"])
    rays = _rays(rng, 250, 150) + [(900, 50.0, 50.0, 200.0, 0.0, 0.0, -1.0), (901, 50.0, 50.0, 400.0, 1.0, 0.0, 0.0), (902, 64.0, 64.0, 300.0, 0.0, 0.8, -0.6), (903, 30.0, 30.0, -100.0, 0.6, 0.0, 0.8)]
    df = spark.createDataFrame(rays, "id int, x double, y double, alt double, e double, n double, u double")
    forks = (0.0, 30.0)
    want = {(r["id"], r["lift"]): tuple(r)[2:] for r in raster.cast_rays(df, raster.Terrain.of(grid), "id", cell=cell, forks=forks).collect()}
    got = {(r["id"], r["lift"]): tuple(r)[2:] for r in pyramid.cast_pyramid(df, grid, "id", cell=cell, forks=forks, block=16).collect()}
    assert set(got) == set(want) and len(got) == len(rays) * 2
    assert all(a[0] == b[0] and all(p == q or math.isclose(p, q, abs_tol=1e-6) for p, q in zip(a[1:], b[1:])) for a, b in ((got[k], want[k]) for k in want))
    assert 60 < sum(v[0] is not None for v in want.values()) < len(want)


def test_rays_above_the_ground_meet_few_tiles(spark):
    """A ray over flat ground passes it in a tile or two of the largest level, not in 1,200 steps."""
    grid = spark.range(300 * 300).select(F.expr("int(id div 300)").alias("iy"), F.expr("int(id % 300)").alias("ix"), F.lit(10.0).alias("z"))
    tiles = pyramid.pyramid(grid, 10.0, 16)
    ray = F.struct(F.lit(5.0).alias("x"), F.lit(8.0).alias("y"), F.lit(500.0).alias("alt"), F.lit(1.0).alias("e"), F.lit(0.0).alias("n"), F.lit(0.0).alias("u"), F.lit(0.0).alias("lift"))
    active = spark.range(1).select("id", ray.alias("ray"), F.lit(1).alias("k"), F.lit(False).alias("up"))
    got = pyramid._looked(active, tiles, 10.0, 16, pyramid.top_level(10.0, 16)).first()
    assert got["jump"] * raster.STEP / 10 + 5 > 250


def test_boxes_at_the_edge_keep_their_size(spark):
    pixels = spark.createDataFrame([("f", x, y, float(x), 128.0, 128.0, False) for x in range(12) for y in range(12)], "frame string, x int, y int, L double, a double, b double, rare boolean")
    boxes = spark.createDataFrame([(1, "f", -5, -5, 6, 4), (2, "f", 3, 2, 2, 2), (3, "f", -9, 0, 2, 2), (4, "f", 0, 0, 0, 3)], "box int, frame string, x int, y int, w int, h int")
    got = {r["box"]: r["L"] for r in annotate.box_mean(pixels, boxes, "box", ("L",)).collect()}
    assert got == {1: 2, 2: 3, 3: 0}


def test_a_tag_of_kind_seven_is_part_of_a_message():
    bare = bytes([1 << 3 | 7])
    assert telemetry_packets.is_message(bare) and telemetry_packets.is_message(bare + bytes([2 << 3, 5]))
    assert not any(telemetry_packets.is_message(bytes([1 << 3 | k])) for k in (3, 4, 6)) and not telemetry_packets.is_message(bytes([7]))
    inner = bytes([2 << 3, 5]) + bare + bytes([3 << 3, 6])
    assert telemetry_packets.decode(bytes([4 << 3 | 2, len(inner)]) + inner) == {"4.2": (5, None, None, None)}  # a message, which ends at the unknown kind


def test_regions_over_tiles_equal_the_frame_kernel(spark):
    rng = np.random.default_rng(21)
    rows = []
    for name, share in (("a", 0.08), ("b", 0.3), ("c", 0.5)):
        mask = rng.random((90, 110)) < share
        mask[20:24, 5:100] = mask[20:70, 40:44] = mask[66:70, 5:100] = True  # a region over many tiles
        mask[80:86, 62:66] = True
        rows += [(name, int(y) - 20, int(x) - 30, float(rng.integers(1, 9))) for y, x in zip(*np.nonzero(mask))]
    rows.append(("lone", 5, 5, 1.0))
    rare = spark.createDataFrame(rows, "frame string, y int, x int, rarity double")
    got = {}
    for mode, tile in (("sum", 32), ("max", 16)):
        for r in regions.tiled_blobs(rare, mode, tile).collect():
            got.setdefault((mode, r["frame"]), []).append(tuple(r)[1:])
    seen = 0
    for mode in ("sum", "max"):
        for name in ("a", "b", "c", "lone"):
            p = rare.where(F.col("frame") == name).toPandas()
            want = sorted(tuple(map(float, r)) for r in detect.frame_blobs(p, mode).itertuples(index=False))
            assert sorted(tuple(map(float, r)) for r in got.get((mode, name), [])) == want
            seen += len(want)
    assert seen > 20


def test_labels_of_a_long_winding_region():
    m = np.zeros((401, 401), bool)
    m[::4] = True
    m[::8, -1] = m[1::8, -1] = m[2::8, -1] = m[3::8, -1] = True
    m[4::8, 0] = m[5::8, 0] = m[6::8, 0] = m[7::8, 0] = True
    lab = detect.label(m)
    assert lab.max() == 1 and (lab > 0).sum() == m.sum()


def test_level_lines_are_whole_across_the_grid(spark):
    y, x = np.mgrid[:61, :61]
    z = np.minimum(np.hypot(x - 30.0, y - 30.0), 25.4)
    z[:, :8] = x[:, :8] * 5.0  # open lines at the left
    z += np.random.default_rng(3).normal(size=z.shape) * 1e-6
    rows = [(int(i), int(j), float(z[i, j])) for i in range(61) for j in range(61)]
    rows += [(i, 200 + j, None if (i, j) == (3, 3) else float(j)) for i in range(8) for j in range(8)]  # a gap ends lines
    grid = spark.createDataFrame(rows, "iy int, ix int, z double").repartition(5)
    got = levels.level_lines(grid, [10.5, 17.25, 3.5, 99.0])
    lines = {}
    for r in got.collect():
        lines.setdefault((r["level"], tuple(r["line"])), []).append((r["i"], r["x"], r["y"]))
    for k in lines:
        lines[k].sort()
        assert [i for i, _, _ in lines[k]] == list(range(len(lines[k])))
    left = {lev: [np.array([p[1:] for p in v]) for (lv, _), v in lines.items() if lv == lev and v[0][1] < 100] for lev in (10.5, 17.25, 3.5)}
    ring = max(left[10.5], key=len)
    assert (ring[0] == ring[-1]).all() and np.abs(np.hypot(*(ring - 30).T) - 10.5).max() < 0.05 and len(ring) > 60
    a, b = (ring[:-1] - 30).T, (ring[1:] - 30).T
    turn = (a[0] * b[1] - a[1] * b[0]).sum()
    assert turn < 0  # the ground rises outwards, so it is on the left when going clockwise
    for lev in left:
        want = raster.contours(z, lev)
        assert sorted(len(a) for a in want) == sorted(len(a) for a in left[lev])
        for a in left[lev]:
            assert np.hypot(*np.diff(a, axis=0).T).max() <= 1.5 and any(len(a) == len(b) and np.allclose(sorted(map(tuple, np.round(a, 9))), sorted(map(tuple, np.round(b, 9)))) for b in want)
    gap = [np.array([p[1:] for p in v]) for (lv, _), v in lines.items() if lv == 3.5 and v[0][1] > 100]
    assert sorted(len(g) for g in gap) == [3, 4]
    thin = levels.level_lines(grid.where("ix < 100"), [10.5], thin=2)
    assert max(r["n"] for r in thin.groupBy("line").agg(F.count("*").alias("n")).collect()) == (len(ring) + 1) // 2
    assert levels.level_lines(grid.limit(0), [1.0]).count() == 0


def test_ranks_of_one_file_are_counted_on_over_parts(spark):
    x = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") % 11 > 0, F.col("id") % 4).alias("grp"), F.when(F.col("id") % 5 > 0, F.col("id") * 37 % 101).alias("dist"), F.when(F.col("id") % 10 > 0, "one").alias("file"))
    order = [F.col("dist").asc_nulls_last(), F.col("i")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = annotate.annotated(x, ["dist"], "file", "grp", order)
        assert got.columns == ["rank", "rank_in_group", "dist", "i", "grp", "file"]
        rows = got.collect()
        parts = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in got.inputFiles()}).groupBy("part_").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and max(r["count"] for r in parts) < 1500  # no task holds the file
    want = x.select(annotate.group_rank(["file"], order).alias("rank"), annotate.group_rank(["file", "grp"], order).alias("rank_in_group"), "dist", "i", "grp", "file").collect()
    assert sorted(map(tuple, rows), key=lambda r: r[3]) == sorted(map(tuple, want), key=lambda r: r[3])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_q59_ranks_all_orders(spark):
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    got = survey.QUERIES["q59_annotated"](spark, SF)
    assert sorted(r["rank"] for r in got.collect()) == list(range(1, n + 1))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
