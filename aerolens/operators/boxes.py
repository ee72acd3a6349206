"""Medians and means of the pixels in many boxes, by summed counts.

Pixels and boxes meet on tiles, as before a join, but never one by one: a tile's pixels are counted by place and value, as they come,
and the counts summed along both axes, so that a box reads its own from the four corners, however many pixels it holds and however many boxes
lie over it. Boxes of one place and size are one. What a box over several tiles reads in each is put together in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from ..session import drop_written, written

#: Pixels of a side of a tile, rows that are counted together, and numbers of a dense block of counts.
TILE, COUNTED, DENSE = 64, 1 << 20, 1 << 22
#: Rare pixels from which on they alone decide.
LEAST_RARE = 3
_ENDS = ["x0", "y0", "x1", "y1"]


def _middle(g: np.ndarray, v: np.ndarray, n: np.ndarray, groups: int) -> np.ndarray:
    """The median of each group of values v that occur n times, in order of group and value; not a number for a group without any."""
    out = np.full(groups, np.nan)
    upto = np.concatenate([[0], np.cumsum(n)])
    start, end = (np.searchsorted(g, np.arange(groups), side) for side in ("left", "right"))
    some = np.flatnonzero(end > start)
    base, total = upto[start[some]], upto[end[some]] - upto[start[some]]
    low, high = (v[np.searchsorted(upto, base + rank, "right") - 1] for rank in ((total - 1) // 2, total // 2))
    out[some] = 0.5 * low + 0.5 * high
    return out


class _Counts:
    """Occurrences of values by place, from rows as they come."""

    def __init__(self) -> None:
        self.new: list = []
        self.held: list = []
        self.rows = 0

    def add(self, at: np.ndarray, v: np.ndarray) -> None:
        self.new.append((at, v, np.ones(len(at), np.int64)))
        self.rows += len(at)
        if self.rows > COUNTED:
            self.flush()

    def flush(self) -> None:
        if self.new:
            at, v, n = (np.concatenate(x) for x in zip(*self.new, strict=True))
            values, code = np.unique(v, return_inverse=True)
            if 2 * TILE * TILE * len(values) <= DENSE:
                count = np.bincount(at * len(values) + code, n, 2 * TILE * TILE * len(values))
                found = np.flatnonzero(count)
                count = count[found]
            else:
                found, back = np.unique(at * len(values) + code, return_inverse=True)
                count = np.bincount(back, n)
            self.held.append((found // len(values), values[found % len(values)], count.astype(np.int64)))
        self.new, self.rows = [], 0
        if sum(len(x[0]) for x in self.held[1:]) > COUNTED:
            self.new, self.held = self.held, []
            self.flush()

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.flush()
        at, v, n = (np.concatenate(x) for x in zip(*self.held, strict=True)) if self.held else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        return at, v, n


def _summed(at: np.ndarray, weight: np.ndarray, code: np.ndarray, width: int, planes: int = 2) -> np.ndarray:
    """(planes, TILE + 1, TILE + 1, width): sums over all places above and to the left. at: twice the place, and one more for a rare pixel."""
    side = TILE + 1
    place = at // 2
    where = (((at % 2) * (planes - 1) * side + place // TILE + 1) * side + place % TILE + 1) * width + code
    out = np.bincount(where, weight, planes * side * side * width).reshape(planes, side, side, width)
    return np.cumsum(np.cumsum(out, 1, out=out), 2, out=out)


def _read(sums: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(boxes, planes, width) of boxes by their ends within the tile."""
    x0, y0, x1, y1 = ends.T
    return (sums[:, y1, x1] - sums[:, y0, x1] - sums[:, y1, x0] + sums[:, y0, x0]).swapaxes(0, 1)


def _lists(box: np.ndarray, rows: np.ndarray, boxes: int) -> pa.Array:
    """rows (n, k), in order of box, as one flat list a box."""
    offsets = np.searchsorted(box, np.arange(boxes + 1)) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rows.ravel(), pa.float64()))


def _rows(frame: pa.Scalar, ends: np.ndarray, whole: np.ndarray, n: np.ndarray, m: np.ndarray, q: np.ndarray, sums: np.ndarray, parts: pa.Array) -> pa.RecordBatch:
    fixed = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), pa.float64()))
    columns = [pa.array([frame.as_py()] * len(ends), frame.type), *[pa.array(ends[:, k], pa.int64()) for k in range(4)], pa.array(whole, pa.bool_()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), fixed(q), fixed(sums), parts]
    return pa.RecordBatch.from_arrays(columns, ["frame", *_ENDS, "whole", "n", "m", "q", "sums", "parts"])


def _by_tile(medians: int, means: int):
    """What each box reads in a tile: all of it, if it lies within, else the counts that are still to be put together."""

    def read(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, boxes = [_Counts() for _ in range(medians)], []
        places = 2 * TILE * TILE
        number, added = np.zeros(places), np.zeros((means, 2, places))
        for b in batches:
            at = b.column(3)
            mine = at.is_null()
            if mine.true_count:
                boxes.append(np.stack([b.column(4 + k).filter(mine).to_numpy() for k in range(4)], 1).astype(np.int64))
                b = b.filter(at.is_valid())
            if not b.num_rows:
                continue
            at = b.column(3).to_numpy().astype(np.int64)
            number += np.bincount(at, minlength=places)
            for k in range(medians + means):
                v = b.column(4 + k).to_numpy(zero_copy_only=False)
                known = ~np.isnan(v)
                if k < medians:
                    counts[k].add(at[known], v[known])
                else:
                    added[k - medians] += [np.bincount(at[known], v[known], places), np.bincount(at[known], minlength=places)]
        if not boxes or not number.any():
            return
        boxes = np.concatenate(boxes)
        corner = np.array([key[1].as_py(), key[2].as_py()] * 2) * TILE
        ends = np.clip(boxes - corner, 0, TILE)
        whole = (boxes == ends + corner).all(1)
        every, none = np.arange(places), np.zeros(places, np.int64)
        n, m = _read(_summed(every, number, none, 1), ends)[:, :, 0].T
        n = n + m
        sums = [_read(_summed(every, x, none, 1, 1), ends)[:, 0, 0] for pair in added for x in pair]
        q, rest = np.full((len(boxes), medians), np.nan), []
        for k, c in enumerate(counts):
            at, v, times = c.all()
            values, code = np.unique(v, return_inverse=True)
            found, wide = [], max(1, DENSE // (2 * (TILE + 1) ** 2))
            for a in range(0, len(values), wide):
                own = (code >= a) & (code < a + wide)
                width = min(wide, len(values) - a)
                table = _summed(at[own], times[own], code[own] - a, width)
                step = max(1, DENSE // (2 * width))
                for s in range(0, len(boxes), step):
                    got, inside, few = _read(table, ends[s : s + step]), whole[s : s + step], m[s : s + step, None] < LEAST_RARE
                    chosen = np.where(few, got.sum(1), got[:, 1]) * inside[:, None]
                    box, value = np.nonzero(chosen)
                    found.append((box + s, values[value + a], chosen[box, value]))
                    box, plane, value = np.nonzero(got * ~inside[:, None, None])
                    rest.append(np.stack([box + s, np.full(len(box), k), plane, values[value + a], got[box, plane, value]], 1))
            if found:
                box, v, times = (np.concatenate(x) for x in zip(*found, strict=True))
                if len(values) > wide:
                    order = np.lexsort((v, box))
                    box, v, times = box[order], v[order], times[order]
                q[:, k] = _middle(box, v, times.astype(np.int64), len(boxes))
        rest = np.concatenate([*rest, np.zeros((0, 5))])
        rest = rest[np.argsort(rest[:, 0], kind="stable")]
        out = _rows(key[0], boxes, whole, n, m, q, np.stack([*sums, n], 1)[:, :-1], _lists(rest[:, 0], rest[:, 1:], len(boxes)))
        for s in range(0, out.num_rows, 1000):
            yield out.slice(s, 1000)

    return read


def _put_together(medians: int, means: int):
    """The boxes over several tiles whose corner lies in one."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        ends, box = np.unique(np.stack([column(c) for c in _ENDS], 1), axis=0, return_inverse=True)
        box = box.ravel()
        add = lambda x: np.bincount(box, x, len(ends))
        n, m = add(column("n")), add(column("m"))
        flat = table.column("sums").combine_chunks().flatten().to_numpy().reshape(len(box), 2 * means)
        sums = np.stack([*[add(x) for x in flat.T], n], 1)[:, :-1]
        lists = table.column("parts").combine_chunks()
        own = np.repeat(box, lists.value_lengths().to_numpy() // 4)
        k, plane, v, times = lists.flatten().to_numpy().reshape(-1, 4).T
        q = np.full((len(ends), medians), np.nan)
        for i in range(medians):
            some = np.flatnonzero((k == i) & ((m[own] < LEAST_RARE) | (plane == 1)))
            some = some[np.lexsort((v[some], own[some]))]
            q[:, i] = _middle(own[some], v[some], times[some].astype(np.int64), len(ends))
        return pa.Table.from_batches([_rows(key[0], ends, np.ones(len(ends), bool), n, m, q, sums, _lists(np.zeros(0), np.zeros((0, 4)), len(ends)))])

    return merge


def box_values(pixels: DataFrame, boxes: DataFrame, key: str, medians: tuple[str, ...] = (), means: tuple[str, ...] = (), rare: str | None = None) -> DataFrame:
    """(key, n, m, q, means) of each box (frame, x, y, w, h): its pixels (frame, x, y, ...), how many are rare, the medians of
    columns over the rare ones, or over all if there are fewer than LEAST_RARE, and the means over all; null without a value.

    A negative corner moves to 0; the box keeps its width and height. Exact for values that doubles hold; quick for those of eight-bit planes.
    """
    corner = lambda c: F.greatest(F.col(c), F.lit(0))
    end = lambda c, size: F.when((F.col("w") > 0) & (F.col("h") > 0), F.ceil(corner(c) + F.col(size)).cast("long"))
    asked = boxes.select(key, "frame", F.ceil(corner("x")).cast("long").alias("x0"), F.ceil(corner("y")).cast("long").alias("y0"), end("x", "w").alias("x1"), end("y", "h").alias("y1"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / TILE), F.floor((F.col(b) - 1) / TILE)))
    some = asked.where("frame is not null and x1 > x0 and y1 > y0").select("frame", *_ENDS).distinct()
    some = some.withColumn("i_", span("x0", "x1")).withColumn("j_", span("y0", "y1"))
    # A row is a pixel, or a box with its ends in place of values. (A list that is mostly null would be slow on its way to Python.)
    nothing, values = F.lit(None).cast("double"), [F.col(c).cast("double") for c in (*medians, *means)]
    width = max(len(_ENDS), len(values))
    named = lambda cs: [c.cast("double").alias(f"v{k}") for k, c in enumerate([*cs, *[nothing] * (width - len(cs))])]
    some = some.select("frame", "i_", "j_", F.lit(None).cast("int").alias("at"), *named([F.col(c) for c in _ENDS]))
    tile, inside = (lambda c: F.floor(F.col(c) / TILE)), (lambda c: F.pmod(F.floor(F.col(c)), F.lit(TILE)))
    place = (inside("y") * TILE + inside("x")) * 2 + (F.coalesce(F.col(rare), F.lit(False)).cast("int") if rare else 0)
    own = pixels.where("frame is not null and x is not null and y is not null")
    own = own.select("frame", tile("x").alias("i_"), tile("y").alias("j_"), place.cast("int").alias("at"), *named(values))
    both = own.unionByName(some)
    doubles = ArrayType(DoubleType())
    kinds = [*[(c, LongType()) for c in _ENDS], ("whole", BooleanType()), ("n", LongType()), ("m", LongType()), ("q", doubles), ("sums", doubles), ("parts", doubles)]
    schema = StructType([StructField("frame", both.schema["frame"].dataType), *[StructField(c, kind) for c, kind in kinds]])
    parts = written(both.groupBy("frame", "i_", "j_").applyInArrow(_by_tile(len(medians), len(means)), schema), "box-parts")
    home = [F.floor(F.col(c) / TILE) for c in ("x0", "y0")]
    merged = parts.where("not whole").groupBy("frame", *[h.alias(c) for h, c in zip(home, ("i_", "j_"), strict=True)]).applyInArrow(_put_together(len(medians), len(means)), schema)
    known = lambda c: F.when(~F.isnan(c), c)
    q = F.struct(*[known(F.col("q")[k]).alias(c) for k, c in enumerate(medians)]) if medians else F.lit(None)
    mean = F.struct(*[F.try_divide(F.col("sums")[2 * k], F.col("sums")[2 * k + 1]).alias(c) for k, c in enumerate(means)]) if means else F.lit(None)
    got = parts.where("whole").unionByName(merged).where("n > 0").select("frame", *_ENDS, "n", "m", q.alias("q"), mean.alias("means"))
    out = written(asked.join(got, ["frame", *_ENDS], "left").select(key, "n", "m", "q", "means"), "box-values")
    drop_written(parts)
    return out
