"""Pixels to placed tracks against plain steps over whole frames."""

from collections import Counter

import numpy as np
import pandas as pd

from aerolens.operators import detect, flights, tracking


def test_placed_tracks_equal_plain_steps(spark):
    rng = np.random.default_rng(12)
    pixels, frames = [], []
    for v in "pq":
        spot = rng.integers(150, 600, 2)
        for t in range(6):
            name = f"{v}{t}"
            colour = {(y, x): (60, 128, 128) for y in range(70) for x in range(80)}
            if t != 3:
                y0, x0 = spot + 2 * t
                colour |= {(int(y0 + i), int(x0 + j)): (200, 180, 90) for i in range(4) for j in range(3)}
            for k in range(2):
                y0, x0 = rng.integers(150, 900, 2)
                colour |= {(int(y0 + i), int(x0 + j)): (30 + 60 * k, 60, 200) for i in range(3) for j in range(3)}
            pixels += [(name, y, x, *c) for (y, x), c in colour.items()]
            frames.append((name, v, t / 2, float(t % 2), 0.0))
    telemetry = [("p", 0.2, 40.0, 73.0, 100.0), ("p", 1.9, 40.1, 73.1, None), ("p", 1.0, None, 73.0, 1.0), ("q", 5.0, 41.0, 74.0, 7.0), ("x", 0.0, 1.0, 1.0, 1.0)]
    px = spark.createDataFrame(pixels, "frame string, y int, x int, L int, a int, b int")
    fr = spark.createDataFrame(frames, "frame string, video string, t double, dx double, dy double")
    tele = spark.createDataFrame(telemetry, "video string, t double, lat double, lon double, alt double")

    want = []
    all_ = pd.DataFrame(pixels, columns=["frame", "y", "x", "L", "a", "b"])
    for v in "pq":
        k, done = tracking.Tracker(), []
        for name, _, t, dx, dy in (f for f in frames if f[1] == v):
            p = all_[all_.frame == name].copy()
            p["bin"] = (p.L * 16 // 256 * 32 + p.a * 32 // 256) * 32 + p.b * 32 // 256
            n = Counter(p["bin"])
            p["density"] = p["bin"].map(n) / len(p)
            p["rarity"] = -np.log10(p.density + 1e-9)
            found = detect.frame_blobs(p[p.density < 0.01]).head(2)
            done += k.feed(t, dx, dy, [(int(b.x), int(b.y), int(b.w), int(b.h), b.score) for b in found.itertuples()])
        done += k.open
        done = [d for _, d in sorted(enumerate(done), key=lambda d: (-round(d[1]["score"], 9), d[0]))]
        for i, d in enumerate(done):
            near = min((r for r in telemetry if r[0] == v and r[2] is not None), key=lambda r: (abs(r[1] - d["t_best"]), r[1]))
            want.append((v, i, d["t_best"], d["t0"], d["t1"], *d["box"], round(d["score"], 6), *near[2:]))
    for tile in (None, 32):
        got = flights.placed_tracks(px, fr, tele, top=2, density=0.01, tile=tile).collect()
        assert sorted(map(repr, ((*r[:9], round(r[9], 6), *r[10:]) for r in map(tuple, got)))) == sorted(map(repr, want))
    assert len(want) > 6
