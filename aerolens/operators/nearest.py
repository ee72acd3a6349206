"""The nearest of many objects by hierarchies of boxes.

An object is a place, or straight from one place to another. Long ones are cut, and the pieces filed in cells, each half as wide as the one above,
until a cell holds few enough for one task to search. An item is first sent to the cell whose pieces begin nearest, and then, with the
distance that it found, to those few others that begin no farther. Within a cell a tree of tight boxes is searched from the top: of the boxes that an item
still considers, those that begin beyond the nearest far end of any are dropped. What is written and shuffled grows with
items and pieces, not with what an item considers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..session import drop_written, written

#: Pieces of a cell and items that a task searches for at a time, about; levels of cells at most.
LEAF, ITEMS, LEVELS = 30_000, 20_000, 20
#: Boxes of a node of a tree, and pairs of items and boxes that are looked at together, about.
NODE, PAIRS = 8, 1 << 21
#: Relative and absolute (in units of the largest coordinate) room for rounding: what is so near is compared by the given distance.
HAIR, DUST = 1e-9, 1e-12


def _spread(bits: np.ndarray, dims: int) -> np.ndarray:
    table = sum(((np.arange(256) >> k) & 1) << (k * dims) for k in range(8)).astype(np.int64)
    return table[bits & 255] | table[bits >> 8] << (8 * dims)


class Tree:
    """Boxes lo to hi, (n, dims) each, under boxes of NODE of them in the order of a Z curve, and so on up to one."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray) -> None:
        dims = lo.shape[1]
        middle = (lo + hi) / 2
        least = middle.min(0)
        place = ((middle - least) / ((middle.max(0) - least).max() or 1.0) * 65535).astype(np.int64)
        code = _spread(place[:, 0], dims)
        for d in range(1, dims):
            code |= _spread(place[:, d], dims) << d
        self.order = np.argsort(code, kind="stable")
        self.levels = [(lo[self.order], hi[self.order])]
        while len(self.levels[-1][0]) > NODE:
            a, b = self.levels[-1]
            at = np.arange(0, len(a), NODE)
            self.levels.append((np.minimum.reduceat(a, at), np.maximum.reduceat(b, at)))
        self.axes = [tuple([np.ascontiguousarray(c) for c in x.T] for x in level) for level in self.levels]
        self.dust = DUST * max(np.abs(lo).max(), np.abs(hi).max())

    def search(self, p: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, box, near) of the boxes that may hold the nearest thing to each of p or one at the bound, in order of item; items come in parts."""
        todo = [(s, min(s + 512, len(p))) for s in range(0, len(p), 512)][::-1]
        while todo:
            start, end = todo.pop()
            most, top = bound[start:end].copy(), len(self.levels[-1][0])
            own = [np.ascontiguousarray(c) for c in p[start:end].T]
            item, box = np.repeat(np.arange(end - start), top), np.tile(np.arange(top), end - start)
            for level in range(len(self.levels) - 1, -1, -1):
                near, far = np.zeros(len(item)), np.zeros(len(item))
                for c, lo, hi in zip(own, *self.axes[level], strict=True):
                    at = c[item]
                    below, above = lo[box] - at, at - hi[box]
                    far += np.minimum(below, above) ** 2  # both are negative within, so the lesser one is the farther end
                    outside = np.maximum(below, above)
                    near += np.maximum(outside, 0, out=outside) ** 2
                near, far = np.sqrt(near, out=near), np.sqrt(far, out=far)
                first = np.flatnonzero(np.diff(item, prepend=-1))
                if len(first):
                    most[item[first]] = np.minimum(most[item[first]], np.minimum.reduceat(far, first))
                keep = near <= (most * (1 + HAIR) + self.dust)[item]
                item, box, near = item[keep], box[keep], near[keep]
                if not level:
                    yield item + start, self.order[box], near
                elif len(item) * NODE > PAIRS and end - start > 1:
                    todo += [((start + end) // 2, end), (start, (start + end) // 2)]
                    break
                else:
                    item, box = np.repeat(item, NODE), (box[:, None] * NODE + np.arange(NODE)).ravel()
                    there = box < len(self.levels[level - 1][0])
                    item, box = item[there], box[there]


def _cut(a: np.ndarray, b: np.ndarray, t0: np.ndarray, t1: np.ndarray, side: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(object, t0, t1): each object's part from share t0 to t1 in equal pieces that are no longer than side on any axis."""
    n = np.maximum(np.ceil(np.abs(b - a).max(1) * (t1 - t0) / side), 1).astype(np.int64)
    own = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    step = ((t1 - t0) / n)[own]
    return own, t0[own] + k * step, np.where(k + 1 == n[own], t1[own], t0[own] + (k + 1) * step)


def _ends(a: np.ndarray, b: np.ndarray, t0: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of pieces."""
    x, y = a + (b - a) * t0[:, None], a + (b - a) * t1[:, None]
    return np.minimum(x, y), np.maximum(x, y)


def _filed(a: np.ndarray, b: np.ndarray, least: np.ndarray, extent: float, full: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, cell, object, t0, t1) of the pieces of a level's cells that are not too full; full: the cells of each level that are, from the root on."""
    own, t0, t1 = np.arange(len(a)), np.zeros(len(a)), np.ones(len(a))
    for level in range(len(full) + 1):
        side = extent / 2**level
        cut, t0, t1 = _cut(a[own], b[own], t0, t1, side)
        own = own[cut]
        middle = a[own] + (b[own] - a[own]) * ((t0 + t1) / 2)[:, None]
        place = np.clip((middle - least) / side, 0, 2**level - 1).astype(np.int64)
        cell = np.zeros(len(own), np.int64)
        for d in range(place.shape[1]):
            cell = (cell << level) | place[:, d]
        split = np.isin(cell, full[level]) if level < len(full) else np.zeros(len(cell), bool)
        yield level, cell[~split], own[~split], t0[~split], t1[~split]
        own, t0, t1 = own[split], t0[split], t1[split]


def _columns(b: pa.RecordBatch | pa.Table, name: str, dims: int) -> np.ndarray:
    return np.stack([b.column(f"{name}{d}").to_numpy() for d in range(dims)], 1)


def _counted(least: np.ndarray, extent: float, full: list[np.ndarray], dims: int):
    """A batch's pieces of the last level by cell: how many, and their box."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _columns(batch, "a", dims), _columns(batch, "b", dims)
            *_, (_, cell, own, t0, t1) = _filed(a, b, least, extent, full)
            order = np.argsort(cell, kind="stable")
            lo, hi = _ends(a[own[order]], b[own[order]], t0[order], t1[order])
            at = np.flatnonzero(np.diff(cell[order], prepend=-1))
            if len(at):
                columns = [cell[order][at], np.diff(at, append=len(order)), *np.minimum.reduceat(lo, at).T, *np.maximum.reduceat(hi, at).T]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["cell", "n", *[f"{e}{d}" for e in ("lo", "hi") for d in range(dims)]])

    return count


def _pieces(least: np.ndarray, extent: float, full: list[np.ndarray], leaves: list[np.ndarray], dims: int):
    """Pieces with the number of their leaf; leaves: the cells of each level that are, in order, and levels one after the other."""
    before = np.cumsum([0, *map(len, leaves)])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, ident = _columns(batch, "a", dims), _columns(batch, "b", dims), batch.column("id").to_numpy()
            for level, cell, own, t0, t1 in _filed(a, b, least, extent, full):
                leaf = before[level] + np.searchsorted(leaves[level], cell)
                for s in range(0, len(own), 50_000):
                    k = slice(s, s + 50_000)
                    columns = [leaf[k], ident[own[k]], *a[own[k]].T, *b[own[k]].T, t0[k], t1[k]]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["leaf", "id", *[f"{e}{d}" for e in "ab" for d in range(dims)], "t0", "t1"])

    return file


def _sent(tree: Tree, dims: int, again: bool):
    """Items with the leaf that begins nearest, or, again, with all others that begin within the distance found."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = _columns(b, "p", dims)
            bound = b.column("bound").to_numpy() if again else np.full(len(p), np.inf)
            for item, leaf, near in tree.search(p, bound):
                if again:
                    other = leaf != b.column("leaf").to_numpy()[item]
                    item, leaf = item[other], leaf[other]
                else:
                    order = np.lexsort((leaf, near, item))
                    order = order[np.flatnonzero(np.diff(item[order], prepend=-1))]
                    item, leaf = item[order], leaf[order]
                rows = b.take(pa.array(item))
                yield pa.RecordBatch.from_arrays([rows.column("item"), *[rows.column(f"p{d}") for d in range(dims)], pa.array(bound[item]), pa.array(leaf)], ["item", *[f"p{d}" for d in range(dims)], "bound", "leaf"])

    return send


def _searched(dims: int):
    """The objects of a cell that are nearest to each of its items, within a hair, if they are no farther than its bound."""

    def search(items: pa.Table, pieces: pa.Table) -> pa.Table:
        found, p = [], _columns(items, "p", dims)
        if len(p) and pieces.num_rows:
            a, b, bound = _columns(pieces, "a", dims), _columns(pieces, "b", dims), items.column("bound").to_numpy()
            t0, t1 = pieces.column("t0").to_numpy(), pieces.column("t1").to_numpy()
            lo, hi = _ends(a, b, t0, t1)
            # The more items, the finer are pieces worth to be cut.
            side = (hi.max(0) - lo.min(0)).max() / min(max(len(p) ** 0.5, 4), 64)
            own, t0, t1 = _cut(a, b, t0, t1, side or 1.0)
            tree = Tree(*_ends(a[own], b[own], t0, t1))
            for item, box, _ in tree.search(p, bound):
                o = own[box]
                along, away = zip(*[((f - e)[o], c[item] - e[o]) for c, e, f in zip(p.T, a.T, b.T, strict=True)], strict=True)
                length = sum(x * x for x in along)
                t = np.clip(sum(x * y for x, y in zip(along, away, strict=True)) / np.where(length > 0, length, 1), 0, 1)
                d = np.sqrt(sum((y - x * t) ** 2 for x, y in zip(along, away, strict=True)))
                first = np.flatnonzero(np.diff(item, prepend=-1))
                least = bound.copy()
                if len(first):
                    least[item[first]] = np.minimum(least[item[first]], np.minimum.reduceat(d, first))
                keep = d <= least[item] * (1 + HAIR) + tree.dust
                found.append((item[keep], o[keep], d[keep]))
        item, o, d = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        rows = items.take(pa.array(item))
        columns = [rows.column("item"), *[rows.column(f"p{k}") for k in range(dims)], pa.array(d), rows.column("leaf"), pieces.column("id").take(pa.array(o))]
        return pa.table(columns, names=["item", *[f"p{k}" for k in range(dims)], "d", "leaf", "id"])

    return search


def nearest(items: DataFrame, key: str, at: list[Column], objects: DataFrame, start: list[Column], end: list[Column], distance: Callable[[Column, Column], Column], order: list[str], scale: list[float] | None = None) -> DataFrame:
    """(key, dist, object) for each row of items: the least distance, and of equally near objects the first by order, as a struct of its columns.

    at: the item's place on each of up to three axes; start and end: those of an object, which is straight between them; scale: what is one unit of distance on each
    axis; distance(p, o): the same distance, from the item at array p to object o, by which what is nearest within rounding is compared in the end. Rows with a null or non-finite place
    have a null result, as all have if there is no object. Keys of items are unique.
    """
    dims, scale, spark = len(at), scale or [1.0] * len(at), items.sparkSession
    fine = lambda cs: ~F.exists(F.array(*cs), lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True)))
    numbers = lambda cs, name: [(c.cast("double") / s).alias(f"{name}{d}") for d, (c, s) in enumerate(zip(cs, scale, strict=True))]
    places = [f"{e}{d}" for e in "ab" for d in range(dims)]
    own = objects.select(*numbers(start, "a"), *numbers(end, "b"), F.struct(*order, *[c for c in objects.columns if c not in order]).alias("o")).where(fine(places))
    own = own.groupBy(*places, F.struct(*[F.col("o")[c] for c in objects.columns if c not in order]).alias("rest")).agg(F.min("o").alias("o"))
    own = written(own.select(F.monotonically_increasing_id().alias("id"), *places, "o"), "objects")
    asked = items.select(F.col(key).alias("item"), *numbers(at, "p"), F.array(*[c.cast("double") for c in at]).alias("p")).where(fine([f"p{d}" for d in range(dims)]))
    both = [[f"a{d}", f"b{d}"] for d in range(dims)]
    ends = own.agg(F.count("*"), *[F.min(F.least(*c)) for c in both], *[F.max(F.greatest(*c)) for c in both]).first()
    nothing = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in objects.schema.fields])
    if not ends[0]:
        drop_written(own)
        return items.select(key, F.lit(None).cast("double").alias("dist"), F.when(F.lit(False), nothing).alias("object"))
    least, extent = np.array(ends[1 : 1 + dims]), max(ends[1 + dims + d] - ends[1 + d] for d in range(dims)) * (1 + 1e-9) or 1.0
    # Cells that are too full are split, level by level; what comes to the driver is a row a cell, which holds LEAF pieces, about.
    sides = ", ".join(f"{e}{d} double" for e in ("lo", "hi") for d in range(dims))
    full: list[np.ndarray] = []
    leaves, boxes = [], []
    while True:
        some = own.select(*places).mapInArrow(_counted(least, extent, list(full), dims), f"cell long, n long, {sides}")
        cells = some.groupBy("cell").agg(F.sum("n").alias("n"), *[f(f"{e}{d}").alias(f"{e}{d}") for e, f in (("lo", F.min), ("hi", F.max)) for d in range(dims)]).toPandas().sort_values("cell")
        split = (cells["n"] > LEAF) & (len(full) < LEVELS)
        leaves.append(cells["cell"][~split].to_numpy())
        boxes.append(cells[~split].iloc[:, 2:].to_numpy())
        if not split.any():
            break
        full.append(cells["cell"][split].to_numpy())
    boxes = np.concatenate(boxes)
    tree = Tree(boxes[:, :dims], boxes[:, dims:])
    kind = lambda df, more: StructType([df.schema["item"], *[df.schema[f"p{d}"] for d in range(dims)], *more])
    double, long = StructField("d", DoubleType()), LongType()
    to = kind(asked, [StructField("bound", DoubleType()), StructField("leaf", long)])
    met = kind(asked, [double, StructField("leaf", long), StructField("id", long)])
    pieces = own.drop("o").mapInArrow(_pieces(least, extent, full, leaves, dims), StructType([StructField("leaf", long), StructField("id", long), *[StructField(c, DoubleType()) for c in (*places, "t0", "t1")]]))

    def found(sent: DataFrame, label: str) -> DataFrame:
        """What items meet in their leaves; a leaf with many items is searched by several tasks."""
        sent = written(sent, label)
        made.append(sent)
        parts = sent.groupBy("leaf").agg(F.ceil(F.count("*") / ITEMS).alias("parts"))
        parts = F.broadcast(spark.createDataFrame([tuple(r) for r in parts.collect()], "leaf long, parts long"))
        mine = sent.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64("item"), "parts")).drop("parts")
        own_pieces = pieces.join(parts, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        return mine.groupBy("leaf", "part").cogroup(own_pieces.groupBy("leaf", "part")).applyInArrow(_searched(dims), met)

    made = [own]
    flat = asked.drop("p")
    first = written(found(flat.mapInArrow(_sent(tree, dims, False), to), "sent"), "met")
    made.append(first)
    bounds = first.groupBy("item", *[f"p{d}" for d in range(dims)]).agg(F.min("d").alias("bound"), F.min("leaf").alias("leaf"))
    second = found(bounds.mapInArrow(_sent(tree, dims, True), to), "sent-again")
    near = first.select("item", "id").unionByName(second.select("item", "id")).distinct().join(own.select("id", "o"), "id").join(asked.select("item", "p"), "item")
    best = F.min(F.struct(distance(F.col("p"), F.col("o")).alias("dist"), "o"))
    got = written(near.groupBy("item").agg(best.alias("b")), "nearest")
    drop_written(*made)
    found_ = got.select(F.col("item").alias(key), F.col("b.dist").alias("dist"), F.struct(*[F.col("b.o")[c].alias(c) for c in objects.columns]).alias("object"))
    return items.select(key).join(found_, key, "left")


def to_segment(p: Column, o: Column) -> Column:
    """Distance from the place p to the segment (x1, y1) to (x2, y2)."""
    dx, dy = o["x2"] - o["x1"], o["y2"] - o["y1"]
    t = F.coalesce(F.try_divide((p[0] - o["x1"]) * dx + (p[1] - o["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(p[0] - (o["x1"] + t * dx), p[1] - (o["y1"] + t * dy))


def segments(lines: DataFrame, line: str = "line", seq: str = "seq", x: str = "x", y: str = "y") -> DataFrame:
    """(line, seq, x1, y1, x2, y2): each point of a line with the next one. The last point of a line has none, so a single point is no line."""
    ahead = lambda c: F.lead(c).over(Window.partitionBy(line).orderBy(seq))
    out = lines.select(F.col(line).alias("line"), F.col(seq).alias("seq"), F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"), ahead(x).cast("double").alias("x2"), ahead(y).cast("double").alias("y2"))
    return out.where("x2 is not null and y2 is not null and x1 is not null and y1 is not null")


def nearest_line(points: DataFrame, key: str, lines: DataFrame, x: str = "x", y: str = "y", line: str = "line", seq: str = "seq") -> DataFrame:
    """(key, dist, line) for each point: the least distance to any of the lines, and the first by name of the nearest ones.

    lines: (line, seq, x, y), the points of a line in order of seq.
    """
    own = segments(lines, line, seq)
    ends = [[F.col(f"x{k}"), F.col(f"y{k}")] for k in (1, 2)]
    got = nearest(points, key, [F.col(x), F.col(y)], own, *ends, to_segment, ["line", "seq"])
    return got.select(key, "dist", F.col("object.line").alias("line"))
