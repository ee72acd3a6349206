"""Points in rings of many long edges, where pairs of points and edges would not end."""

import time

import numpy as np
import pytest

from aerolens.operators import cover


@pytest.mark.parametrize("places", [100_000, 40])
def test_rings_of_long_edges_form_no_pairs(spark, monkeypatch, places):
    """A hundred thousand points, a few hundred places each of which lies in reach of some thousand edges of 6,000."""
    monkeypatch.setattr(cover, "PLACES", places)
    rng = np.random.default_rng(12)
    corners = rng.integers(0, 400, (2, 6000, 2)).astype(float)
    rings = [(k, i, *map(float, p)) for k in range(2) for i, p in enumerate(corners[k])]
    points = spark.range(100_000).selectExpr("id", "(id * 7 % 21) * 20 + 0.25D as x", "(id * 13 % 23) * 18 + 0.75D as y")
    began = time.time()
    got = cover.in_rings(points, "id", spark.createDataFrame(rings, "ring int, seq int, x double, y double")).groupBy("ring").agg({"id": "sum", "ring": "count"}).collect()
    assert time.time() - began < 60
    p = np.arange(100_000)
    x, y = (p * 7 % 21) * 20 + 0.25, (p * 13 % 23) * 18 + 0.75
    want = {}
    for k in range(2):
        a, b = corners[k], np.roll(corners[k], -1, 0)
        inside = {}
        for u, v in set(zip(x, y, strict=True)):
            passes = (a[:, 1] > v) != (b[:, 1] > v)
            at = (v - a[passes, 1]) * ((b[passes, 0] - a[passes, 0]) / (b[passes, 1] - a[passes, 1])) + a[passes, 0]
            inside[u, v] = np.count_nonzero(u < at) % 2 == 1
        held = np.array([inside[q] for q in zip(x, y, strict=True)])
        want[k] = (int(p[held].sum()), int(held.sum()))
    assert {r["ring"]: (r["sum(id)"], r["count(ring)"]) for r in got} == want
