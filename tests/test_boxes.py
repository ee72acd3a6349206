"""Medians and means over boxes against plain numpy, and at a size where pairs of pixels and boxes would not end."""

import time

import numpy as np
import pytest

from aerolens.operators import annotate, boxes

PIXELS = "frame string, x int, y int, L double, a double, b double, rare boolean"
BOXES = "box int, frame string, x int, y int, w int, h int"


def _plain(pixels, box):
    _, f, x, y, w, h = box
    x, y = max(x, 0), max(y, 0)
    own = [p for p in pixels if p[0] == f and p[1] is not None and x <= p[1] < x + w and y <= p[2] < y + h]
    rare = [p for p in own if p[6]]
    used = rare if len(rare) >= 3 else own
    med = [np.median([p[k] for p in used if p[k] is not None]) if any(p[k] is not None for p in used) else None for k in (3, 4, 5)]
    lab = [m if m is None else (m * 100 / 255, m - 128, m - 128)[k] for k, m in enumerate(med)]
    means = [p[3] for p in own if p[3] is not None]
    return [*lab, "нет" if not own else "маска" if len(rare) >= 3 else "bbox", int(np.mean(means)) if means else None]


@pytest.mark.parametrize("counted, dense", [(1 << 20, 1 << 22), (50, 20_000)])
def test_box_colours_over_tiles_equal_plain_medians(spark, monkeypatch, counted, dense):
    monkeypatch.setattr(boxes, "COUNTED", counted)
    monkeypatch.setattr(boxes, "DENSE", dense)
    rng = np.random.default_rng(4)
    pixels = [(str(f), int(x), int(y), None if v % 17 == 0 else float(v), float(a), float(v % 7) / 3, None if a == 5 else bool(a < 30)) for f, x, y, v, a in zip(rng.integers(0, 2, 3000), rng.integers(0, 200, 3000), rng.integers(0, 150, 3000), rng.integers(0, 256, 3000), rng.integers(0, 256, 3000), strict=True)]
    pixels += [(None, 1, 1, 1.0, 1.0, 1.0, True), ("0", None, 1, 1.0, 1.0, 1.0, True)]
    some = [(i, str(i % 2), int(x), int(y), int(w), int(h)) for i, (x, y, w, h) in enumerate(zip(rng.integers(-20, 200, 120), rng.integers(-20, 150, 120), rng.integers(0, 150, 120), rng.integers(0, 90, 120), strict=True))]
    some += [(500, *some[3][1:]), (501, "0", 64, 64, 64, 64), (502, "none", 0, 0, 9, 9), (503, "0", 0, 0, 200, 150), (504, "1", 63, 0, 2, 3)]
    out = annotate.box_colour(spark.createDataFrame(pixels, PIXELS), spark.createDataFrame(some, BOXES), "box", ("L",))
    got = {r[0]: list(r[1:]) for r in out.collect()}
    assert len(got) == len(some)
    for box in some:
        want = _plain(pixels, box)
        assert all(g == w or (w is not None and g == pytest.approx(w, abs=1e-9)) for g, w in zip(got[box[0]], want, strict=True)), (box, got[box[0]], want)


def test_boxes_over_dense_pixels_form_no_pairs(spark):
    """A million pixels under 30,000 boxes: some ten thousand million pairs, had they to meet one by one."""
    d = spark.range(1_000_000).selectExpr("'f' as frame", "cast(id % 60 as int) as x", "cast(id div 60 % 60 as int) as y", "cast(id % 200 as double) as L", "128D as a", "128D as b", "id % 3 = 0 as rare")
    b = spark.range(30_000).selectExpr("id as box", "'f' as frame", "cast(id % 10 as int) as x", "cast(id div 10 % 10 as int) as y", "cast(35 + id % 13 as int) as w", "cast(35 + id % 11 as int) as h")
    began = time.time()
    out = annotate.box_colour(d, b, "box", ("L",)).selectExpr("count(L)", "count(mean_L)").first()
    assert tuple(out) == (30_000, 30_000)
    assert time.time() - began < 60
