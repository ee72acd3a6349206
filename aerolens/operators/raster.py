"""Terrain grids: bilinear heights, ray casting and descent.

A grid is a table (iy, ix, z). Kernels take it as one array, which is broadcast only below MOST_BYTES; the
relational forms have no such limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEP, MOST, HALVINGS = 5.0, 6000.0, 20
MOST_BYTES = 256_000_000


def bilinear_join(points: DataFrame, grid: DataFrame, key: str, x: str = "x", y: str = "y", out: str = "z") -> DataFrame:
    """points with the height at (x, y) in grid units; null outside the grid. One shuffle: four corners, summed by weight."""
    p = points.withColumn("fx_", F.floor(x)).withColumn("fy_", F.floor(y))
    corner = F.explode(F.array(*[F.struct((F.col("fy_") + b).cast("int").alias("iy"), (F.col("fx_") + a).cast("int").alias("ix"), (F.abs(F.lit(1 - a) - (F.col(x) - F.col("fx_"))) * F.abs(F.lit(1 - b) - (F.col(y) - F.col("fy_")))).alias("w")) for a in (0, 1) for b in (0, 1)]))
    c = p.where(f"{x} >= 0 and {y} >= 0").select(key, corner.alias("c_")).select(key, "c_.*")
    got = c.join(grid, ["iy", "ix"]).groupBy(key).agg(F.sum(F.col("w") * F.col("z")).alias(out), F.count("*").alias("n_")).where("n_ = 4").drop("n_")
    return points.join(got, key, "left")


class Terrain:
    """A grid as an array, with heights in between."""

    def __init__(self, z: np.ndarray):
        self.z = z

    @classmethod
    def of(cls, grid: DataFrame) -> Terrain | None:
        """None if the grid is empty or takes more than MOST_BYTES as one array."""
        s = grid.agg(F.max("iy"), F.max("ix")).first()
        if s[0] is None or 8 * (s[0] + 1) * (s[1] + 1) > MOST_BYTES:
            return None
        z = np.full((s[0] + 1, s[1] + 1), np.nan)
        p = grid.select("iy", "ix", "z").toPandas()  # bounded by the check above
        z[p.iy, p.ix] = p.z
        return cls(z)

    def height(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        h, w = self.z.shape
        ok = (x >= 0) & (y >= 0) & (x < w - 1) & (y < h - 1)
        ix, iy = np.clip(np.where(ok, x, 0).astype(int), 0, max(0, w - 2)), np.clip(np.where(ok, y, 0).astype(int), 0, max(0, h - 2))
        fx, fy = x - ix, y - iy
        z = self.z
        out = z[iy, ix] * (1 - fx) * (1 - fy) + z[iy, ix + 1] * fx * (1 - fy) + z[iy + 1, ix] * (1 - fx) * fy + z[iy + 1, ix + 1] * fx * fy
        return np.where(ok, out, np.nan)

    def march(self, x, y, alt, e, n, u, first, last, above, cell: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(above, out, step, dist) of rays after their steps from the numbers first to last; all rays take a step together.

        above: whether a ray has been above the ground, before and after; out: whether it left the heights. A step that ends at or
        below the ground after one above it is halved HALVINGS times for the distance; step and dist are NaN without one.
        """
        above, out = above.copy(), np.zeros(len(x), bool)
        step, dist = np.full(len(x), np.nan), np.full(len(x), np.nan)
        gap = lambda d, k: alt[k] + u[k] * d - self.height(x[k] + e[k] * d / cell, y[k] + n[k] * d / cell)
        k, at = np.arange(len(x)), first.copy()
        while len(k := k[at[k] <= last[k]]):
            g = gap(at[k] * STEP, k)
            hit = (g <= 0) & above[k]
            step[k[hit]] = at[k[hit]] * STEP
            out[k[np.isnan(g)]] = True
            above[k[g > 0]] = True
            k = k[~hit & ~np.isnan(g)]
            at[k] += 1
        k = np.flatnonzero(~np.isnan(step))
        lo, hi = step[k] - STEP, step[k].copy()
        for _ in range(HALVINGS):
            mid = (lo + hi) / 2
            up = gap(mid, k) > 0
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
        dist[k] = hi
        return above, out, step, dist

    def cast(self, x, y, alt, e, n, u, cell: float = 1.0, lift: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(last step above, distance of the hit) of rays; NaN if a ray leaves the grid or ends first.

        A ray that starts below the ground is skipped until it is above.
        """
        m = len(x)
        return self.march(x, y, alt - lift, e, n, u, np.ones(m, int), np.full(m, int(MOST / STEP)), np.zeros(m, bool), cell)[2:]

    def descend(self, x: np.ndarray, y: np.ndarray, cell: float = 1.0, stride: float = 12.0, probe: float = 15.0, most: int = 400, least_deg: float = 4.0, frame: tuple[float, float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, x, y) of the ways down, step by step: all starts go one stride along the steepest slope together.

        A way ends where the slope is below least_deg, where a height is missing, where it would leave the frame (x0, y0, x1, y1), or after `most` strides.
        """
        reach, on, ways = probe / cell, np.arange(len(x)), [(np.arange(len(x)), x.astype(float), y.astype(float))]
        at = np.stack([x, y]).astype(float)
        for _ in range(most):
            px, py = at[:, on]
            rise = np.stack([self.height(px + reach, py) - self.height(px - reach, py), self.height(px, py + reach) - self.height(px, py - reach)]) / (2 * probe)
            slope = np.hypot(*rise)
            steep = np.degrees(np.arctan(slope)) >= least_deg
            on, to = on[steep], at[:, on[steep]] - rise[:, steep] / slope[steep] * stride / cell
            there = ~np.isnan(self.height(*to))
            if frame is not None:
                there &= (to[0] > frame[0]) & (to[1] > frame[1]) & (to[0] < frame[2]) & (to[1] < frame[3])
            on, to = on[there], to[:, there]
            if not len(on):
                break
            at[:, on] = to
            ways.append((on, *to))
        return tuple(np.concatenate(c) for c in zip(*ways, strict=True))


def cast_rays(rays: DataFrame, terrain: Terrain, key: str, cell: float = 1.0, forks: tuple = (0.0,)) -> DataFrame:
    """(key, lift, step, dist, hit_x, hit_y) of rays (key, x, y, alt, e, n, u) for each lift of the terrain."""
    shared = rays.sparkSession.sparkContext.broadcast(terrain)  # at most MOST_BYTES
    kind = dict(rays.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            cols = [p[c].to_numpy(float) for c in ("x", "y", "alt", "e", "n", "u")]
            for lift in forks:
                step, dist = shared.value.cast(*cols, cell=cell, lift=lift)
                yield pd.DataFrame({key: p[key], "lift": lift, "step": step, "dist": dist, "hit_x": cols[0] + cols[3] * dist / cell, "hit_y": cols[1] + cols[4] * dist / cell})

    out = rays.select(key, "x", "y", "alt", "e", "n", "u").mapInPandas(run, f"{key} {kind}, lift double, step double, dist double, hit_x double, hit_y double")
    return out.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) if c in ("step", "dist", "hit_x", "hit_y") else c for c in out.columns])


def cast(rays: DataFrame, grid: DataFrame, key: str, cell: float = 1.0, forks: tuple = (0.0,)) -> DataFrame:
    """cast_rays over a grid that fits one array, else pyramid.cast_pyramid, which gives the same columns."""
    from .pyramid import cast_pyramid

    terrain = Terrain.of(grid)
    return cast_pyramid(rays, grid, key, cell, forks) if terrain is None else cast_rays(rays, terrain, key, cell, forks)


def descents(starts: DataFrame, terrain: Terrain, key: str, **how: object) -> DataFrame:
    """(key, i, x, y): the way down from each start (key, x, y). The starts of a batch go down together."""
    shared = starts.sparkSession.sparkContext.broadcast(terrain)  # at most MOST_BYTES
    kind = dict(starts.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            start, x, y = shared.value.descend(p["x"].to_numpy(float), p["y"].to_numpy(float), **how)
            way = pd.DataFrame({key: p[key].to_numpy()[start], "x": x, "y": y})
            way.insert(1, "i", pd.Series(start).groupby(start).cumcount().to_numpy())
            yield way

    return starts.select(key, F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(run, f"{key} {kind}, i long, x double, y double")


def verdicts(casts: DataFrame, key: str, flat_m: float = 30.0) -> DataFrame:
    """(key, drift, verdict) over the forks of each ray: the hit's largest move, infinite if a fork misses."""
    base = F.max(F.when(F.col("lift") == 0, F.struct("hit_x", "hit_y")))
    g = casts.groupBy(key).agg(base.alias("b_"), F.collect_list(F.struct("hit_x", "hit_y", "dist")).alias("f_"))
    move = F.transform("f_", lambda h: F.when(h["dist"].isNull(), float("inf")).otherwise(F.hypot(h["hit_x"] - F.col("b_.hit_x"), h["hit_y"] - F.col("b_.hit_y"))))
    drift = F.when(F.col("b_.hit_x").isNotNull(), F.array_max(move))
    return g.select(key, drift.alias("drift"), F.when(drift.isNull(), "no_hit").when(drift <= flat_m, "ok").otherwise("poloho").alias("verdict"))


def with_misses(tasks: DataFrame, verdict_rows: DataFrame, key: str) -> DataFrame:
    """tasks with drift and verdict; 'miss' for those without a sidecar, whose path is null."""
    out = tasks.join(verdict_rows, key, "left")
    return out.withColumn("verdict", F.when(F.col("path").isNull(), "miss").otherwise(F.coalesce("verdict", F.lit("no_hit"))))


def successors(grid: DataFrame) -> DataFrame:
    """(id, next, z): the lowest of a cell's eight neighbours if it is lower, ties by place. id is iy * 2^20 + ix."""
    cell = lambda iy, ix: iy.cast("long") * 2**20 + ix
    own = grid.select(cell(F.col("iy"), F.col("ix")).alias("id"), "z", "iy", "ix")
    around = F.explode(F.array(*[F.struct((F.col("iy") + b).alias("iy"), (F.col("ix") + a).alias("ix")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    n = own.select("id", F.col("z").alias("z0"), around.alias("n_")).select("id", "z0", "n_.iy", "n_.ix").join(grid, ["iy", "ix"]).where("z < z0")
    low = n.groupBy("id").agg(F.min(F.struct("z", cell(F.col("iy"), F.col("ix")).alias("id"))).alias("m_"))
    return own.select("id", "z").join(low, "id", "left").select("id", F.col("m_.id").alias("next"), "z")


def descend(starts: DataFrame, steps: DataFrame, most: int = 400) -> DataFrame:
    """(start, steps, stop) of the discrete way down from each start, by a recursive query."""
    spark = starts.sparkSession
    starts.createOrReplaceTempView("aerolens_starts")
    steps.createOrReplaceTempView("aerolens_steps")
    return spark.sql(
        f"""WITH RECURSIVE way(start, n, at) MAX RECURSION LEVEL {most + 2} AS (
              SELECT id, 0, id FROM aerolens_starts
              UNION ALL SELECT w.start, w.n + 1, s.next FROM way w JOIN aerolens_steps s ON s.id = w.at WHERE s.next IS NOT NULL AND w.n < {most})
            SELECT start, max(n) AS steps, max_by(at, n) AS stop FROM way GROUP BY start"""
    )


def contours(z: np.ndarray, level: float) -> list[np.ndarray]:
    """Level lines as arrays of (x, y): crossings of the edges of all cells at once, chained from cell to cell.

    An edge is crossed if one end is below the level and the other is not; a cell with four crossings pairs them in turn
    around it. A closed line ends where it began.
    """
    h, w = z.shape
    up = z >= level
    ends, place = [], []
    for axis in (1, 0):  # edges along x, then along y, named by the number of their first corner
        a, b = (z[:, :-1], z[:, 1:]) if axis else (z[:-1], z[1:])
        iy, ix = np.nonzero((up[:, :-1] != up[:, 1:]) if axis else (up[:-1] != up[1:]))
        share = (level - a[iy, ix]) / (b[iy, ix] - a[iy, ix])
        ends.append(2 * (iy * w + ix) + (axis == 0))
        place.append(np.stack([ix + share * (axis == 1), iy + share * (axis == 0)], 1))
    name, place = np.concatenate(ends), np.concatenate(place)
    order = np.argsort(name)
    name, place = name[order], place[order]
    iy, ix = (x.ravel() for x in np.mgrid[: h - 1, : w - 1])
    ring = np.stack([2 * (iy * w + ix), 2 * (iy * w + ix + 1) + 1, 2 * ((iy + 1) * w + ix), 2 * (iy * w + ix) + 1], 1)
    at = np.minimum(np.searchsorted(name, ring), max(0, len(name) - 1))
    crossed = name[at] == ring if len(name) else np.zeros(ring.shape, bool)
    pairs = at[crossed].reshape(-1, 2)  # two or four a cell, in the order around it
    near: list[list[int]] = [[] for _ in name]
    for a, b in pairs.tolist():
        near[a].append(b)
        near[b].append(a)
    lines, seen = [], np.zeros(len(name), bool)
    for start in [*np.flatnonzero([len(x) == 1 for x in near]).tolist(), *range(len(name))]:
        if seen[start] or not near[start]:
            continue
        line, k = [start], start
        seen[start] = True
        while (step := next((x for x in near[k] if not seen[x]), None)) is not None:
            seen[step] = True
            line.append(step)
            k = step
        if len(line) > 2 and start in near[k]:
            line.append(start)
        lines.append(place[line])
    return lines


def contour_lines(tiles: DataFrame, levels: list[float], key: str) -> DataFrame:
    """(key, level, line, i, x, y) of tiles (key, iy, ix, z); a tile is one group, and lines end at its edges."""
    kind = dict(tiles.dtypes)[key]

    def run(k: tuple, p: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = p.iy.min(), p.ix.min()
        z = np.full((p.iy.max() - y0 + 1, p.ix.max() - x0 + 1), np.nan)
        z[p.iy - y0, p.ix - x0] = p.z
        rows = [(k[0], v, n, i, x + x0, y + y0) for v in levels for n, line in enumerate(contours(z, v)) for i, (x, y) in enumerate(line)]
        return pd.DataFrame(rows, columns=[key, "level", "line", "i", "x", "y"])

    return tiles.select(key, "iy", "ix", "z").groupBy(key).applyInPandas(run, f"{key} {kind}, level double, line long, i long, x double, y double")
