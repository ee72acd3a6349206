"""What the search for nearest objects compares and writes, and its cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators import nearest


def _table(spark, rows, prefix):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"{prefix} int, " + ", ".join(f"{prefix}_{k} double" for k in range(len(rows[0]))))


def _kept(monkeypatch):
    rows = {}

    def counted(df, label, of=nearest.written):
        out = of(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(nearest, "written", counted)
    return rows


def test_long_lines_over_each_other_are_compared_with_few_points(spark, monkeypatch):
    """Each point lies in the boxes of most of 4,000 lines."""
    rng = np.random.default_rng(8)
    lines = np.concatenate([rng.uniform(0, 80, (4000, 2)), rng.uniform(120, 200, (4000, 2))], 1)
    points = rng.uniform(0, 200, (300, 2))
    met, rows = spark.sparkContext.accumulator(0), _kept(monkeypatch)
    count = F.udf(lambda d: met.add(1) or d, "double")
    o = _table(spark, lines, "o").selectExpr("o", "o_0 as x1", "o_1 as y1", "o_2 as x2", "o_3 as y2")
    xy = [F.col("i_0"), F.col("i_1")]
    got = nearest.nearest(_table(spark, points, "i"), "i", xy, o, [F.col("x1"), F.col("y1")], [F.col("x2"), F.col("y2")], lambda p, o: count(nearest.to_segment(p, o)), ["o"])
    got = {r["i"]: (r["dist"], r["object"]["o"]) for r in got.collect()}
    assert met.value < 3 * len(points) and sum(n for k, n in rows.items() if k != "objects") < 8 * len(points)
    a, u = lines[:, :2], lines[:, 2:] - lines[:, :2]
    for i, p in enumerate(points):
        t = np.clip(((p - a) * u).sum(1) / (u * u).sum(1), 0, 1)
        d = np.hypot(*(p - a - t[:, None] * u).T)
        assert got[i] == (pytest.approx(d.min(), abs=1e-9), int(d.argmin()))


@pytest.mark.parametrize("leaf, items, pairs", [(30_000, 20_000, 1 << 21), (50, 20, 300)])
def test_what_is_written_does_not_grow_with_what_is_considered(spark, monkeypatch, leaf, items, pairs):
    """Places around a shell, all about as far from the items in its middle, some far off and some twice."""
    rng = np.random.default_rng(9)
    shell = rng.normal(size=(3000, 3))
    shell = shell / np.linalg.norm(shell, axis=1)[:, None] * (20, 30, 40) + (5, 0, -7)
    objects = np.concatenate([shell, shell[:50], [(9e4, 0, 0), (9e4, 1, 1)], rng.normal(size=(500, 3))])
    places = np.concatenate([rng.normal(size=(150, 3)) * 3, rng.normal(size=(50, 3)) * 50, [(8e4, 7, 7), tuple(shell[3])]])
    for name, value in (("LEAF", leaf), ("ITEMS", items), ("PAIRS", pairs)):
        monkeypatch.setattr(nearest, name, value)
    rows = _kept(monkeypatch)
    at, to = ([F.col(f"{c}_{k}") for k in range(3)] for c in "io")
    far = lambda p, o: F.sqrt(sum(((p[k] - o[f"o_{k}"]) / s) * ((p[k] - o[f"o_{k}"]) / s) for k, s in enumerate((1.0, 2.0, 4.0))))
    got = nearest.nearest(_table(spark, places, "i"), "i", at, _table(spark, objects, "o"), to, to, far, ["o"], [1.0, 2.0, 4.0])
    got = {r["i"]: (r["dist"], r["object"]["o"]) for r in got.collect()}
    for i, p in enumerate(places):
        d = np.linalg.norm((p - objects) / (1, 2, 4), axis=1)
        assert got[i] == (pytest.approx(d.min(), abs=1e-9), int(d.argmin()))
    if leaf > 1000:
        assert sum(n for k, n in rows.items() if k != "objects") < 5 * len(places)
