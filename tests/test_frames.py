"""Frame indexes and the helpers around them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators import frames, probe


def test_sampling_and_ranges(spark):
    df = spark.range(60).select(F.col("id").alias("n"), F.lit(29.97).alias("native"))
    got = [r["n"] for r in frames.sample_frames(df, "n", "native", 2.0).orderBy("n").collect()]
    assert got == [0, 15, 30, 45]
    half = spark.range(8).select(F.col("id").alias("n"), F.lit(25.0).alias("native"))
    assert [r["n"] for r in frames.sample_frames(half, "n", "native", 10.0).orderBy("n").collect()] == [0, 2, 4, 6]  # two and a half rounds to even
    u = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 3.0), ("v", 2, 1.0)], "k string, n int, t double")
    assert [r["n"] for r in frames.until(u, "k", "t", 2.0).collect()] == [0]
    t = spark.createDataFrame([(0.0,), (1.0,), (2.0,)], "t double")
    assert [r[0] for r in t.select(frames.in_range(F.col("t"), 1.0, 0.0)).collect()] == [False, True, True]
    assert [r[0] for r in t.select(frames.in_range(F.col("t"), 0.0, 1.0)).collect()] == [True, True, False]


def test_segments_break_at_the_third_failure(spark):
    flags = [True, False, False, True, False, False, False, False, True, True]
    df = spark.createDataFrame([("v", i, f) for i, f in enumerate(flags)], "k string, t int, ok boolean")
    assert [(r["t"], r["segment"]) for r in frames.segments(df, "k", "t", "ok").orderBy("t").collect()] == [(0, 1), (3, 1), (6, 2), (8, 2), (9, 2)]
    flags = [False, True, *[False] * 7, True, None, True]
    df = spark.createDataFrame([("v", i, f, i != 11) for i, f in enumerate(flags)], "k string, t int, ok boolean, moved boolean")
    # The third and the sixth failure begin a segment each; the one of the third holds a single frame and is none.
    assert [(r["t"], r["segment"]) for r in frames.segments(df, "k", "t", "ok", "moved").orderBy("t").collect()] == [(0, 1), (1, 1), (7, 2), (9, 2)]
    d = spark.createDataFrame([("v", 0, 0.0), ("v", 1, 0.1), ("v", 2, 9.0)], "k string, t int, d double")
    assert [r["still"] for r in frames.still(d, "k", "t", "d", 1.0).orderBy("t").collect()] == [False, True, False]


def test_header_takes_the_first_value_that_is_there(spark):
    df = spark.createDataFrame([("v", 2, "b", None), ("v", 1, None, 5), ("v", 3, "c", 6), ("w", 1, None, None)], "k string, pts int, model string, width int")
    got = {r["k"]: (r["model"], r["width"]) for r in frames.header(df, "k", "pts", ["model", "width"]).collect()}
    assert got == {"v": ("b", 5), "w": (None, None)}


def test_label_places(spark):
    df = spark.createDataFrame([(list(range(100)), 12, False), (list(range(10)), 12, False), (list(range(100)), 12, True), (list(range(100)), 15, True)], "line array<int>, zoom int, minor boolean")
    got = [r[0] for r in df.select(frames.label_places(F.col("line"), F.col("zoom"), F.col("minor"))).collect()]
    assert got == [[16, 50, 83], [5], [], [16, 50, 83]]


def test_size_range(spark):
    df = spark.createDataFrame([("s", 4, 10.0, 0.0), ("s", 4, 20.0, 0.5), ("s", 8, 10.0, 1.0), ("s", 12, 10.0, 0.5), ("s", 16, 20.0, None)], "bg string, size int, contrast double, recall double")
    assert {tuple(r) for r in probe.size_range(df, ["bg", "contrast"]).collect()} == {("s", 10.0, 8, 12), ("s", 20.0, 4, 4)}
    clean = spark.createDataFrame([("a",), ("a",), ("b",)], "frame string")
    assert tuple(probe.clean_counts(clean).first()) == (1.5, 1, 2)
    p = spark.createDataFrame([("s", 210.0), ("s", 205.0), ("d", 100.0), ("d", 120.0), ("m", 205.0), ("m", 100.0)], "k string, L double")
    assert {r["k"]: r["class"] for r in probe.patch_class(p, "k").collect()} == {"s": "snow", "d": "scree", "m": None}


def test_equalized_plane_is_wider_and_keeps_order():
    plane = np.tile(np.linspace(100, 140, 64).astype(np.uint8), (64, 1))
    out = frames.equalize(plane, limit=40.0, tiles=1)
    assert np.ptp(out) > np.ptp(plane) and (np.diff(out[0].astype(int)) >= 0).all()
    assert frames.equalize(plane).shape == plane.shape


def test_retries():
    waits, calls = [], []

    def run():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert frames.with_retry(run, sleep=waits.append) == "done" and waits == [20, 40]
    with pytest.raises(OSError, match="Quota"):
        frames.with_retry(lambda: (_ for _ in ()).throw(OSError("Quota exceeded")), sleep=lambda _: pytest.fail("no use in waiting"))
    with pytest.raises(OSError):
        frames.with_retry(lambda: (_ for _ in ()).throw(OSError()), (1,), waits.append)
