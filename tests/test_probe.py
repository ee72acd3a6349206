"""First matches against plain search, and of many objects in one place among many blobs."""

import time

import numpy as np
import pytest

from aerolens.operators import probe

OBJECTS, BLOBS = "obj int, frame int, x int, y int, size int", "frame int, x int, y int, w int, h int, score double, rank int"


@pytest.mark.parametrize("pairs", [1 << 20, 10])
def test_first_matches_equal_plain_search(spark, monkeypatch, pairs):
    monkeypatch.setattr(probe, "PAIRS", pairs)
    rng = np.random.default_rng(6)
    objects = [(i, int(rng.integers(0, 3)), *map(int, rng.integers(-20, 300, 2)), int(rng.integers(1, 60))) for i in range(300)]
    objects += [(900, *objects[0][1:]), (901, None, 1, 1, 1), (902, 0, None, 1, 1), (903, 9, 5, 5, 5)]
    blobs = [(i % 3, *map(int, rng.integers(-10, 300, 2)), *map(int, rng.integers(1, 90 if i % 50 == 0 else 9, 2)), float(i), i // 3) for i in range(240)]
    blobs += [(0, *blobs[0][1:5], -1.0, 500), (1, None, 1, 1, 1, 1.0, 501)]
    got = {r["obj"]: (r["rank"], r["score"]) for r in probe.first_match(spark.createDataFrame(objects, OBJECTS), spark.createDataFrame(blobs, BLOBS), "obj").collect()}
    assert len(got) == len(objects)
    for key, f, x, y, size in objects:
        want = (-1, None)
        for bf, bx, by, w, h, score, rank in sorted(blobs, key=lambda b: b[6]):
            if f is None or x is None or bx is None or bf != f:
                continue
            if np.hypot(bx + w / 2 - x, by + h / 2 - y) <= 6 + size / 2 or (bx - 2 <= x <= bx + w + 2 and by - 2 <= y <= by + h + 2):
                want = (rank, score)
                break
        assert got[key] == want, key
    assert len({r for r, _ in got.values()}) > 30


def test_matches_among_many_blobs_form_no_pairs(spark):
    """300,000 objects and as many blobs within reach of each other: some ten thousand million pairs, had they to meet one by one."""
    objects = spark.range(300_000).selectExpr("id as obj", "0 as frame", "id % 30 as x", "id div 30 % 30 as y", "40 as size")
    blobs = spark.range(300_000).selectExpr("0 as frame", "id % 50 as x", "id div 50 % 50 as y", "2 as w", "3 as h", "cast(id as double) as score", "id as rank")
    began = time.time()
    out = probe.first_match(objects, blobs, "obj").selectExpr("count(score)", "min(rank)", "max(rank)").first()
    assert out[0] == 300_000 and out[1] == 0 and time.time() - began < 60
