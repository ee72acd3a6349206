"""Terrain grids from GeoTIFF files as a data source: a partition for each strip or tile, (iy, ix, z, lat, lon) as rows.

The head of a file tells where its strips lie, how they are packed and where the grid lies on the map; a task reads the bytes of
its own strip only. Comparisons of iy, ix, lat or lon with a number leave out strips before anything is read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, iy int, ix int, z double, lat double, lon double"
#: Fixed values of the format: sizes of its types, the tags that are read, and the compressions that can be undone.
_SIZES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
_TAGS = {256: "width", 257: "height", 258: "bits", 259: "packing", 273: "offsets", 277: "samples", 278: "rows", 279: "counts", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_counts", 339: "kind", 33550: "scale", 33922: "tie", 42113: "missing"}
PLAIN, DEFLATE = 1, (8, 32946)
_ALWAYS = {"bits": (1,), "packing": (1,), "samples": (1,), "predictor": (1,), "kind": (1,)}


@dataclass(frozen=True)
class Head:
    """What the head of a file says: order of bytes, type of a height, size of grid and blocks, and the map place and steps."""

    order: str
    dtype: str
    packing: int
    predictor: int
    shape: tuple[int, int]
    block: tuple[int, int]
    blocks: tuple[tuple[int, int], ...]
    tiled: bool
    place: tuple[float, float, float, float]
    missing: float | None


@dataclass
class Block(InputPartition):
    """A strip or tile: its first row and column, and the bytes that hold it."""

    path: str
    head: Head
    y: int
    x: int
    offset: int
    size: int


def _tags(f) -> tuple[str, dict[str, tuple]]:
    """(order of bytes, values by name) of the first directory; classic files and those with long offsets."""
    first = f.read(16)
    order = {b"II": "<", b"MM": ">"}.get(first[:2])
    version = struct.unpack(order + "H", first[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    wide = version == 43
    at, number, entry, inline = (struct.unpack(order + "Q", first[8:16])[0], "Q", 20, 8) if wide else (struct.unpack(order + "I", first[4:8])[0], "H", 12, 4)
    f.seek(at)
    n = struct.unpack(order + number, f.read(struct.calcsize(number)))[0]
    rows, out = f.read(n * entry), dict(_ALWAYS)
    for row in (rows[i : i + entry] for i in range(0, len(rows), entry)):
        tag, kind, count = struct.unpack(order + ("HHQ" if wide else "HHI"), row[: entry - inline])
        if tag not in _TAGS or kind not in _SIZES:
            continue
        size, code = _SIZES[kind]
        raw = row[entry - inline :]
        if size * count > inline:
            f.seek(struct.unpack(order + ("Q" if wide else "I"), raw)[0])
            raw = f.read(size * count)
        out[_TAGS[tag]] = (raw[:count],) if code == "s" else struct.unpack(f"{order}{count}{code}", raw[: size * count])
    return order, out


def head(path: str) -> Head:
    with open(path, "rb") as f:
        order, t = _tags(f)
    letter = {1: "u", 2: "i", 3: "f"}.get(t["kind"][0])
    if t["samples"][0] != 1 or letter is None or t["packing"][0] not in (PLAIN, *DEFLATE):
        raise ValueError(f"{path}: one plane of numbers, plain or deflated, is read; not packing {t['packing'][0]}, {t['samples'][0]} planes")
    tiled = "tile_offsets" in t
    shape = t["height"][0], t["width"][0]
    block = (t["tile_height"][0], t["tile_width"][0]) if tiled else (min(t.get("rows", shape)[0], shape[0]), shape[1])
    blocks = tuple(zip(*((t["tile_offsets"], t["tile_counts"]) if tiled else (t["offsets"], t["counts"])), strict=True))
    i, j, _, lon, lat, _ = t["tie"][:6]
    dlon, dlat = t["scale"][:2]
    missing = float(t["missing"][0].split(b"\0")[0]) if "missing" in t else None
    return Head(order, f"{letter}{t['bits'][0] // 8}", t["packing"][0], t["predictor"][0], shape, block, blocks, tiled, (lat + j * dlat, lon - i * dlon, dlat, dlon), missing)


def heights(data: bytes, h: Head, rows: int) -> np.ndarray:
    """The rows of a block as doubles: unpacked, and summed up along the row if only differences are kept."""
    raw = zlib.decompress(data) if h.packing in DEFLATE else data
    width, kind = h.block[1], np.dtype(h.order + h.dtype)
    if h.predictor == 3:  # bytes of a row by significance, as differences
        planes = np.frombuffer(raw, np.uint8)[: rows * width * kind.itemsize].reshape(rows, -1)
        planes = np.add.accumulate(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(">" + h.dtype).reshape(rows, width).astype(float)
    z = np.frombuffer(raw, kind)[: rows * width].reshape(rows, width)
    if h.predictor == 2:
        z = np.add.accumulate(z, axis=1, dtype=kind.newbyteorder("="))
    return z.astype(float)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file:").replace("//", "/")
        self.bounds: dict[str, list[float]] = {c: [-np.inf, np.inf] for c in ("iy", "ix", "lat", "lon")}

    def pushFilters(self, filters: list[Filter]):
        """Comparisons narrow the box; Spark still applies all of them to the rows."""
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name in self.bounds and isinstance(getattr(f, "value", None), (int, float)):
                low, high = self.bounds[name]
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    low = max(low, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    high = min(high, f.value)
                self.bounds[name] = [low, high]
            yield f

    def partitions(self) -> list[Block]:
        files = [os.path.join(self.path, x) for x in sorted(os.listdir(self.path)) if x.lower().endswith((".tif", ".tiff"))] if os.path.isdir(self.path) else [self.path]
        out = []
        for path in files:
            h = head(path)
            across = -(-h.shape[1] // h.block[1])
            for k, (offset, size) in enumerate(h.blocks):
                b = Block(path, h, k // across * h.block[0], k % across * h.block[1], offset, size)
                if self._wanted(b):
                    out.append(b)
        return out or [Block("", None, 0, 0, 0, 0)]

    def _wanted(self, b: Block) -> bool:
        lat, lon, dlat, dlon = b.head.place
        y1, x1 = min(b.y + b.head.block[0], b.head.shape[0]) - 1, min(b.x + b.head.block[1], b.head.shape[1]) - 1
        spans = {"iy": (b.y, y1), "ix": (b.x, x1), "lat": (lat - y1 * dlat, lat - b.y * dlat), "lon": (lon + b.x * dlon, lon + x1 * dlon)}
        return all(spans[c][0] <= high and spans[c][1] >= low for c, (low, high) in self.bounds.items())

    def read(self, b: Block) -> Iterator[pa.RecordBatch]:
        if not b.path:
            return
        h = b.head
        with open(b.path, "rb") as f:
            f.seek(b.offset)
            data = f.read(b.size)
        rows = h.block[0] if h.tiled else min(h.block[0], h.shape[0] - b.y)
        z = heights(data, h, rows)[: h.shape[0] - b.y, : h.shape[1] - b.x]
        iy, ix = (a.ravel() for a in np.mgrid[b.y : b.y + z.shape[0], b.x : b.x + z.shape[1]])
        lat, lon, dlat, dlon = h.place
        gone = np.isnan(z.ravel()) if h.missing is None else np.isnan(z.ravel()) | (z.ravel() == h.missing)
        cols = [pa.array([b.path]).take(pa.array(np.zeros(len(iy), np.int32))), pa.array(iy.astype(np.int32)), pa.array(ix.astype(np.int32)), pa.array(z.ravel(), mask=gone), pa.array(lat - iy * dlat), pa.array(lon + ix * dlon)]
        yield pa.RecordBatch.from_arrays(cols, names=["path", "iy", "ix", "z", "lat", "lon"])


class TerrainTiff(DataSource):
    """spark.dataSource.register(TerrainTiff); spark.read.format("terrain_tiff").load(path): a file or a folder that all executors see.

    z is null where the file says that a height is missing. The place (lat, lon) is that of the grid point (iy, ix), northern rows first.
    """

    @classmethod
    def name(cls) -> str:
        return "terrain_tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
