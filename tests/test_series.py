"""Regular times between the rows of a series, and values with gaps of their own, against the joins they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolens.operators import timeseries


def _rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_resampled_equals_resample_and_interpolate_and_shuffles_rows_only(spark):
    rng = np.random.default_rng(3)
    rows = [(k, float(t), float(t * k), float(v)) for k in range(5) for t, v in zip(np.cumsum(rng.choice([0.1, 0.3, 0.5, 2.0, 7.7], 40)), rng.normal(size=40), strict=True)]
    rows += [(7, 1.0, 2.0, 3.0), (8, 0.0, 1.0, 1.0), (8, 1.5, 2.0, 4.0), (9, None, 1.0, 1.0), (9, 4.0, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, t double, a double, b double")
    whole = df.dropna()
    want = timeseries.interpolate(timeseries.resample(whole, ["k"], "t", 0.5), whole, ["k"], "t", ["a", "b"])
    got = timeseries.resampled(df, ["k"], "t", 0.5, ["a", "b"]).select(*want.columns)
    plan = got._jdf.queryExecution().executedPlan().toString()  # not run yet, so it is there once
    for g, w in zip(_rows(got), _rows(want), strict=True):
        assert g == pytest.approx(w, abs=1e-12)
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_interpolate_each_keeps_gaps_apart_in_one_shuffle(spark):
    rng = np.random.default_rng(5)
    gap = lambda x: None if rng.random() < 0.3 else float(x)
    right = spark.createDataFrame([(k, float(t), gap(t), gap(-t)) for k in range(3) for t in np.cumsum(rng.uniform(0.1, 2, 30))], "k int, t double, a double, b double")
    left = spark.createDataFrame([(k, i, float(t)) for k in range(4) for i, t in enumerate(rng.uniform(-1, 40, 25))], "k int, i int, t double")
    want = left
    for c in "ab":
        want = timeseries.interpolate(want, right.select("k", "t", c), ["k"], "t", [c])
    got = timeseries.interpolate_each(left, right, ["k"], "t", ["a", "b"])
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert _rows(got) == _rows(want)
    assert got.where(F.col("a").isNotNull()).count() == 75
