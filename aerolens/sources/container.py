"""Packets of a video container as a data source: the index gives (stream, ord, pts, offset, size), and a task reads only the bytes of its own packets.

A container is a tree of boxes. The tables of a track's sample box tell the chunks' offsets, the samples of each
chunk, their sizes and durations; nothing else of the file is read, however large it is.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, stream int, handler string, ord long, pts double, offset long, size long, packet binary"
#: Packets of a partition at most, and bytes.
PACKETS, BYTES = 20_000, 64_000_000
#: Boxes that hold boxes, kinds of tracks that are neither picture nor sound, and what a telemetry track's handler name has in it.
_INNER = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl"])
_SHOWN, _TELEMETRY = frozenset([b"vide", b"soun"]), ("dji", "meta")


@dataclass
class Track:
    kind: bytes = b""
    handler: str = ""
    scale: int = 1
    tables: dict[bytes, bytes] = field(default_factory=dict)


def _boxes(f, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, end) of the boxes between two places; a box that is cut short ends there."""
    while start + 8 <= end:
        f.seek(start)
        size, name = struct.unpack(">I4s", f.read(8))
        body = start + 8
        if size == 1:
            size, body = struct.unpack(">Q", f.read(8))[0], start + 16
        stop = end if size == 0 else min(end, start + size)
        if stop < body:
            return
        yield name, body, stop
        start = stop


def tracks(path: str) -> list[Track]:
    """The tracks of a container in file order, with their tables."""
    out: list[Track] = []

    def walk(f, start: int, end: int) -> None:
        for name, at, stop in _boxes(f, start, end):
            if name == b"trak":
                out.append(Track())
            if name in _INNER:
                walk(f, at, stop)
            elif out and name in (b"hdlr", b"mdhd", b"stsz", b"stco", b"co64", b"stsc", b"stts"):
                f.seek(at)
                body = f.read(stop - at)
                if name == b"hdlr" and not out[-1].kind:
                    out[-1].kind, text = body[8:12], body[24:]
                    if text[:1] and text[0] == len(text) - 1:  # counted, not ended by a zero
                        text = text[1:]
                    out[-1].handler = text.split(b"\0")[0].decode("utf-8", "replace")
                elif name == b"mdhd":
                    out[-1].scale = struct.unpack(">I", body[20:24] if body[0] == 1 else body[12:16])[0] or 1
                else:
                    out[-1].tables.setdefault(name, body)

    with open(path, "rb") as f:
        walk(f, 0, os.fstat(f.fileno()).st_size)
    return out


def telemetry_stream(found: list[Track]) -> int | None:
    """The place of the first data track whose handler's name tells telemetry, else of the first data track; null without one."""
    data = [i for i, t in enumerate(found) if t.kind not in _SHOWN]
    named = [i for i in data if any(x in found[i].handler.lower() for x in _TELEMETRY)]
    return (named or data or [None])[0]


def index(t: Track) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pts, offset, size) of a track's packets, from its tables at once."""
    table = lambda name, width, skip=4: np.frombuffer(t.tables.get(name, b"\0" * 16)[skip + 4 :], f">u{width}").astype(np.int64)
    sizes = t.tables.get(b"stsz", b"\0" * 12)
    one, n = struct.unpack(">II", sizes[4:12])
    size = np.full(n, one, np.int64) if one else np.frombuffer(sizes[12 : 12 + 4 * n], ">u4").astype(np.int64)
    chunks = table(b"co64", 8) if b"co64" in t.tables else table(b"stco", 4)
    runs = table(b"stsc", 4).reshape(-1, 3) if b"stsc" in t.tables else np.zeros((0, 3), np.int64)
    first = np.append(runs[:, 0] - 1, len(chunks))
    per = np.repeat(runs[:, 1], np.maximum(0, np.diff(first)))[: len(chunks)]
    chunk = np.repeat(np.arange(len(per)), per)[: len(size)]
    size = size[: len(chunk)]
    upto = np.cumsum(size) - size
    starts = np.flatnonzero(np.append(True, np.diff(chunk) > 0)) if len(chunk) else np.zeros(0, int)
    within = upto - np.repeat(upto[starts], np.diff(np.append(starts, len(chunk))))
    steps = table(b"stts", 4).reshape(-1, 2) if b"stts" in t.tables else np.zeros((0, 2), np.int64)
    gaps = np.repeat(steps[:, 1], steps[:, 0])[: len(size)]
    gaps = np.append(gaps, np.zeros(len(size) - len(gaps), np.int64))
    return (np.cumsum(gaps) - gaps) / t.scale, chunks[chunk] + within, size


@dataclass
class Packets(InputPartition):
    path: str
    stream: int
    handler: str
    first: int
    pts: bytes
    offset: bytes
    size: bytes


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stream = options["path"].removeprefix("file:").replace("//", "/"), options.get("stream", "telemetry")

    def partitions(self) -> list[Packets]:
        files = [os.path.join(self.path, x) for x in sorted(os.listdir(self.path)) if x.lower().endswith((".mp4", ".mov"))] if os.path.isdir(self.path) else [self.path]
        out = []
        for path in files:
            found = tracks(path)
            chosen = range(len(found)) if self.stream == "all" else [telemetry_stream(found)] if self.stream == "telemetry" else [int(self.stream)]
            for i in (k for k in chosen if k is not None):
                pts, offset, size = index(found[i])
                cut = np.cumsum(size) // BYTES + np.arange(len(size)) // PACKETS
                for lo, hi in zip(edges := np.flatnonzero(np.append(True, np.diff(cut) > 0)) if len(size) else [], [*edges[1:], len(size)], strict=True):
                    out.append(Packets(path, i, found[i].handler, int(lo), pts[lo:hi].tobytes(), offset[lo:hi].tobytes(), size[lo:hi].tobytes()))
        return out or [Packets("", 0, "", 0, b"", b"", b"")]

    def read(self, p: Packets) -> Iterator[pa.RecordBatch]:
        pts, offset, size = np.frombuffer(p.pts, float), np.frombuffer(p.offset, np.int64), np.frombuffer(p.size, np.int64)
        if not p.path:
            return
        with open(p.path, "rb") as f:
            for lo in range(0, len(size), 1000):
                own, packets = slice(lo, lo + 1000), []
                for at, n in zip(offset[own].tolist(), size[own].tolist(), strict=True):
                    f.seek(at)
                    packets.append(f.read(n))
                m = len(packets)
                yield pa.RecordBatch.from_arrays([pa.array([p.path] * m), pa.array([p.stream] * m, pa.int32()), pa.array([p.handler] * m), pa.array(np.arange(lo, lo + m) + p.first), pa.array(pts[own]), pa.array(offset[own]), pa.array(size[own]), pa.array(packets, pa.binary())], names=SCHEMA.replace(",", "").split()[::2])


class ContainerPackets(DataSource):
    """spark.dataSource.register(ContainerPackets); spark.read.format("container_packets").load(path): packets of the telemetry track of each file.

    Option stream: telemetry, all, or a number. The path is a file or folder that all executors see; a file without such a track gives no rows, and a packet that the file
    ends in is as long as what is there.
    """

    @classmethod
    def name(cls) -> str:
        return "container_packets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
