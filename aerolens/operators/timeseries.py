"""As-of joins, interpolation, unwrapping, range medians, resampling and sessions over keyed time series.

Each is one shuffle on the key and one sorted pass, so a series of n rows costs n log n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import orderstats


def _both(left: DataFrame, right: DataFrame, keys: list[str], t: str, payload: list[str]) -> tuple[DataFrame, object, object]:
    """left and right in one series; prev_ and next_ are the rows of right at or before and at or after."""
    row = F.struct(F.col(t).alias("t"), *payload)
    none = F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType)
    a = left.select(*keys, F.col(t).alias("t_"), F.lit(1).alias("left_"), F.struct(*left.columns).alias("row_"), none.alias("r_"))
    b = right.where(F.col(t).isNotNull()).select(*keys, F.col(t).alias("t_"), F.lit(0).alias("left_"), F.lit(None).cast(a.schema["row_"].dataType).alias("row_"), row.alias("r_"))
    both = a.unionByName(b)
    w = Window.partitionBy(*keys)
    prev = F.last("r_", True).over(w.orderBy("t_", "left_").rowsBetween(Window.unboundedPreceding, 0))
    # Read backwards: a frame that runs to the end of the key would be gone through anew for every row.
    nxt = F.last("r_", True).over(w.orderBy(F.col("t_").desc(), "left_").rowsBetween(Window.unboundedPreceding, 0))
    return both, prev, nxt


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, payload: list[str]) -> DataFrame:
    """left with near: the row of right (t and payload) nearest in time, the earlier of two; null if the key has none."""
    both, prev, nxt = _both(left, right, keys, t, payload)
    x = both.withColumn("prev_", prev).withColumn("next_", nxt).where("left_ = 1")
    before = F.col("prev_").isNotNull() & (F.col("next_").isNull() | (F.col("t_") - F.col("prev_.t") <= F.col("next_.t") - F.col("t_")))
    return x.select("row_.*", F.when(before, F.col("prev_")).otherwise(F.col("next_")).alias("near"))


def interpolate(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """left with each value of right at its time, on the line between its neighbours; constant beyond the ends.

    Rows of right that lack one of the values are left out; ask for values one by one where their gaps differ.
    """
    good = right.where(" and ".join(f"{v} is not null" for v in values))
    both, prev, nxt = _both(left, good, keys, t, values)
    x = both.withColumn("prev_", prev).withColumn("next_", nxt).where("left_ = 1")
    share = (F.col("t_") - F.col("prev_.t")) / (F.col("next_.t") - F.col("prev_.t"))
    line = lambda v: F.col(f"prev_.{v}") + (F.col(f"next_.{v}") - F.col(f"prev_.{v}")) * share
    at = lambda v: F.when(F.col("prev_").isNull(), F.col(f"next_.{v}")).when(F.col("next_").isNull() | (F.col("next_.t") == F.col("prev_.t")), F.col(f"prev_.{v}")).otherwise(line(v))
    return x.select("row_.*", *[at(v).alias(v) for v in values])


def interpolate_each(left: DataFrame, right: DataFrame, keys: list[str], t: str, values: list[str]) -> DataFrame:
    """interpolate() of each of values by the rows of right that have it, in one pass."""
    rows = [F.when(F.col(v).isNotNull(), F.struct(F.col(t).alias("t"), F.col(v).alias("v"))).alias(f"{v}_r_") for v in values]
    b = right.where(F.col(t).isNotNull()).select(*keys, F.col(t).alias("t_"), F.lit(0).alias("left_"), *rows)
    a = left.select(*keys, F.col(t).alias("t_"), F.lit(1).alias("left_"), *[F.lit(None).cast(b.schema[f"{v}_r_"].dataType).alias(f"{v}_r_") for v in values], F.struct(*left.columns).alias("row_"))
    both = a.unionByName(b.withColumn("row_", F.lit(None).cast(a.schema["row_"].dataType)))
    w = Window.partitionBy(*keys)
    near = lambda v, order: F.last(f"{v}_r_", True).over(w.orderBy(order, "left_").rowsBetween(Window.unboundedPreceding, 0))
    x = both.select("left_", "row_", "t_", *[near(v, F.col("t_")).alias(f"{v}_p_") for v in values], *[near(v, F.col("t_").desc()).alias(f"{v}_n_") for v in values]).where("left_ = 1")

    def at(v: str) -> Column:
        p, n = F.col(f"{v}_p_"), F.col(f"{v}_n_")
        line = p["v"] + (n["v"] - p["v"]) * ((F.col("t_") - p["t"]) / (n["t"] - p["t"]))
        return F.when(p.isNull(), n["v"]).when(n.isNull() | (n["t"] == p["t"]), p["v"]).otherwise(line).alias(v)

    return x.select("row_.*", *map(at, values))


def unwrap_degrees(df: DataFrame, keys: list[str], t: str, angle: str, out: str = "unwrapped") -> DataFrame:
    """Add the angle without jumps: each step is taken the short way round, a half turn in its own direction."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = F.col(angle) - F.lag(angle).over(w)
    step = d - F.floor((d + 180) / 360) * 360
    step = F.when((step == -180) & (d > 0), 180.0).otherwise(step)
    x = df.withColumn("step_", F.coalesce(step, F.lit(0.0)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(out, F.first(angle).over(upto) + F.sum("step_").over(upto)).drop("step_")


def range_median(samples: DataFrame, estimates: DataFrame, keys: list[str], t: str, value: str, reach: float, least: int = 3, out: str = "median") -> DataFrame:
    """samples with the median of the estimates within `reach` on both sides; null below `least` of them.

    Times are cut into steps of `reach`, so each sample meets the estimates of three steps by equality.
    """
    bucket = F.floor(F.col(t) / reach)
    near = estimates.where(F.col(t).isNotNull() & F.col(value).isNotNull()).select(*keys, F.col(t).alias("te_"), F.col(value).alias("v_"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b_"))
    own = samples.withColumn("id_", F.monotonically_increasing_id()).withColumn("b_", bucket)
    hit = own.join(near, [*keys, "b_"], "left")
    inside = F.when(F.abs(F.col(t) - F.col("te_")) <= reach, F.col("v_"))
    keep = [c for c in samples.columns if c not in keys and c != t]
    g = hit.groupBy("id_", *keys, t).agg(*[F.first(c).alias(c) for c in keep], F.median(inside).alias("m_"), F.count(inside).alias("n_"))
    return g.select(*samples.columns, F.when(F.col("n_") >= least, F.col("m_")).alias(out))


def resample(df: DataFrame, keys: list[str], t: str, step: float) -> DataFrame:
    """Regular times from each key's first to its last: keys, i, t."""
    ends = df.groupBy(*keys).agg(F.min(t).alias("lo_"), F.max(t).alias("hi_"))
    n = F.floor((F.col("hi_") - F.col("lo_")) / step)
    return ends.select(*keys, "lo_", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("i")).select(*keys, "i", (F.col("lo_") + F.col("i") * step).alias(t))


def resampled(df: DataFrame, keys: list[str], t: str, step: float, values: list[str]) -> DataFrame:
    """What resample() and interpolate() give together, keys, i, t and values without gaps, but only the rows of df are shuffled: regular times come up between them."""
    w = Window.partitionBy(*keys)
    row = lambda c: F.lead(c).over(w.orderBy(t)).alias(f"{c}_")
    own = df.where(" and ".join(f"{c} is not null" for c in (t, *values)))
    own = own.select(*keys, t, *values, row(t), *map(row, values), F.min(t).over(w).alias("lo_"), F.max(t).over(w).alias("hi_"))
    last, place = F.col(f"{t}_").isNull(), lambda c: F.floor((F.col(c) - F.col("lo_")) / step)
    # One more on both sides for rounding; which row a time belongs to is told by the time itself.
    first, end = F.greatest(place(t) - 1, F.lit(0)), F.least(F.coalesce(place(f"{t}_") + 1, place("hi_")), place("hi_"))
    own = own.withColumn("i", F.explode(F.filter(F.sequence(first, F.greatest(first, end)), lambda i: i <= end)))
    at = F.col("lo_") + F.col("i") * step
    own = own.withColumn("at_", at).where((F.col("at_") >= F.col(t)) & (last | (F.col("at_") < F.col(f"{t}_"))))
    share = (F.col("at_") - F.col(t)) / (F.col(f"{t}_") - F.col(t))
    line = lambda v: F.when(last | (F.col("at_") == F.col(t)), F.col(v)).otherwise(F.col(v) + (F.col(f"{v}_") - F.col(v)) * share).alias(v)
    return own.select(*keys, "i", F.col("at_").alias(t), *map(line, values))


def lead_time(keys: list[str], t: str, default: float = 1 / 30) -> Column:
    """The next time of the key, or `default` later for the last."""
    return F.coalesce(F.lead(t).over(Window.partitionBy(*keys).orderBy(t)), F.col(t) + default)


def sessions(df: DataFrame, keys: list[str], t: str, gap: float, out: str = "session") -> DataFrame:
    """Number the runs of rows that are at most `gap` apart, from 1."""
    w = Window.partitionBy(*keys).orderBy(t)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("new_", new).withColumn(out, F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")


def step_pairs(tracks: DataFrame, spans: DataFrame, key: str, dt: float = 0.25) -> DataFrame:
    """(key, i, a, b, dyaw, dpitch, pitch) for each fixed step of spans (key, t0, t1): turns between a and b = a + dt, pitch half way.

    tracks: (key, t, yaw, pitch), yaw unwrapped.
    """
    n = F.floor((F.col("t1") - F.col("t0")) / dt)
    steps = spans.where("t1 >= t0").select(key, "t0", F.explode(F.sequence(F.lit(0).cast("long"), 2 * n)).alias("k")).select(key, "k", (F.col("t0") + F.col("k") * (dt / 2)).alias("t"))
    w = Window.partitionBy(key).orderBy("k")
    at = interpolate(steps, tracks.select(key, "t", "yaw", "pitch"), [key], "t", ["yaw", "pitch"])
    ahead = lambda c, m: F.lead(c, m).over(w)
    x = at.select(key, "k", F.col("t").alias("a"), ahead("t", 2).alias("b"), (ahead("yaw", 2) - F.col("yaw")).alias("dyaw"), (ahead("pitch", 2) - F.col("pitch")).alias("dpitch"), ahead("pitch", 1).alias("mid_"))
    return x.where("k % 2 = 0 and b is not null").select(key, (F.col("k") / 2).cast("long").alias("i"), "a", "b", "dyaw", "dpitch", F.col("mid_").alias("pitch"))


def until_failure(df: DataFrame, key: str, order: str, readable: Column) -> DataFrame:
    """Rows of each key before its first one that can't be read."""
    first = F.min(F.when(~F.coalesce(readable, F.lit(False)), F.col(order))).over(Window.partitionBy(key))
    return df.withColumn("stop_", first).where(F.col("stop_").isNull() | (F.col(order) < F.col("stop_"))).drop("stop_")


def focal_quartiles(estimates: DataFrame, key: str, f: str = "f") -> DataFrame:
    """(key, n, med, q25, q75) of the focal lengths above 0."""
    q = orderstats.quantiles(estimates.where(F.col(f) > 0), [key], F.col(f), [0.5, 0.25, 0.75])
    return q.select(key, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(("med", "q25", "q75"))])


def pan_pairs(df: DataFrame, key: str, dt: float = 0.5, every: float = 2.0, least: float = 0.4, most: float = 8.0) -> DataFrame:
    """(key, t0, t1) where the camera (t, yaw, pitch, yaw unwrapped) turns between `least` and `most` degrees about one axis.

    Pairs start `every` seconds apart at least, on a grid of `dt`, as early as they can. All offsets are measured at
    once. Marks that far behind the mark before them start a chain of their own, which no earlier choice reaches,
    so only the marks of one chain are gone through in order.
    """
    series = df.select(key, "t", "yaw", "pitch").dropna(subset=["t", "yaw", "pitch"])
    at = resampled(series, [key], "t", dt, ["yaw", "pitch"])
    w = Window.partitionBy(key).orderBy("i")
    turn = [F.abs(F.lead(c).over(w) - F.col(c)) for c in ("yaw", "pitch")]
    size, one_axis = F.hypot("dy_", "dp_"), F.greatest("dy_", "dp_") > 2 * F.least("dy_", "dp_")
    marks = at.select(key, "i", "t", turn[0].alias("dy_"), turn[1].alias("dp_")).where(size.between(least, most) & one_axis)
    apart = round(every / dt)
    chains = sessions(marks.select(key, "i", "t"), [key], "i", apart - 1).groupBy(key, "session").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("m_"))
    none = F.slice("m_", 1, 0)
    free = lambda acc, x: (F.size(acc) == 0) | (x["i"] - F.try_element_at(acc, F.lit(-1))["i"] >= apart)
    chosen = F.aggregate("m_", none, lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    return chains.select(key, F.explode(chosen).alias("m_")).select(key, F.col("m_.t").alias("t0"), (F.col("m_.t") + dt).alias("t1"))
