"""Telemetry packets of unknown schema: framing and wire-format decoding into {field path: value}."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Levels of nesting that are entered.
DEPTH = 8
VALUE = "struct<i: bigint, d: double, f: float, b: binary>"
#: Paths of the fields that are read, and the unit each is in.
FIELDS = {
    "lat": ("3.3.4.1.2", "rad"), "lon": ("3.3.4.1.3", "rad"), "alt_m": ("3.3.4.2", "milli"), "alt_rel_m": ("3.3.5.1", "milli"),
    "ac_yaw": ("3.3.3.3", "deci"), "ac_pitch": ("3.3.3.2", "deci"), "ac_roll": ("3.3.3.1", "deci"), "gb_yaw": ("3.4.3.3", "deci"), "gb_pitch": ("3.4.3.1", "deci"),
}


class Cut(Exception):
    """The packet ends inside a number."""


def frames(df: DataFrame, stream: Column, key: str = "video") -> DataFrame:
    """One packet a row: bytes of the key's stream at the sum of the sizes before it, in order of pts and ord."""
    before = F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy("pts", "ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("packet", F.substring(stream, (before + 1).cast("int"), F.col("size").cast("int")))


class Reader:
    """A cursor over the wire format: each item is (field, kind, value)."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def varint(self) -> int:
        value = 0
        for k, byte in enumerate(self.data[self.at : self.at + 10]):
            value |= (byte & 127) << 7 * k
            if byte < 128:
                self.at += k + 1
                return value & (2**64 - 1)
        raise Cut

    def items(self, strict: bool = False) -> Iterator[tuple[int, int, object]]:
        """strict: Cut unless every field is whole and numbered and none is of the kinds 3, 4 and 6. Else a short fixed field is left out, and a
        short number or an unknown kind ends the packet."""
        size = len(self.data)
        while self.at < size:
            tag = self.varint()
            field, kind = tag >> 3, tag & 7
            if strict and (not field or kind in (3, 4, 6)):
                raise Cut
            if kind == 0:
                yield field, 0, self.varint()
                continue
            if kind not in (1, 2, 5):
                if not strict:
                    return
                yield field, kind, None  # a tag of kind 7 stands alone
                continue
            n = self.varint() if kind == 2 else {1: 8, 5: 4}[kind]
            raw = self.data[self.at : self.at + n]
            self.at += n
            if strict and self.at > size:
                raise Cut
            if kind == 2 or len(raw) == n:
                yield field, kind, raw


def is_message(data: bytes) -> bool:
    """Whether the bytes are a whole message of one field or more."""
    try:
        return sum(1 for _ in Reader(data).items(strict=True)) > 0
    except Cut:
        return False


def decode(data: bytes) -> dict[str, tuple]:
    """{path: (int, double, float, bytes)}, one of which is set; of a repeated field, the first."""
    out: dict[str, tuple] = {}

    def walk(raw: bytes, path: str, depth: int) -> None:
        try:
            for field, kind, value in Reader(raw).items():
                p = f"{path}{field}"
                if kind == 0:
                    out.setdefault(p, (value - 2**64 if value >> 63 else value, None, None, None))
                elif kind == 1:
                    out.setdefault(p, (None, struct.unpack("<d", value)[0], None, None))
                elif kind == 5:
                    out.setdefault(p, (None, None, struct.unpack("<f", value)[0], None))
                elif depth < DEPTH and len(value) > 1 and is_message(value):
                    walk(value, p + ".", depth + 1)
                else:
                    out.setdefault(p, (None, None, None, value))
        except Cut:
            pass  # what came before the cut counts

    walk(data, "", 0)
    return out


def _varints(buf: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, place after it, whether it is whole) of the numbers at many places at once; ten bytes at most."""
    value, done = np.zeros(len(at), np.uint64), np.zeros(len(at), bool)
    at = at.copy()
    for k in range(10):
        on = ~done & (at < end)
        if not on.any():
            break
        byte = buf[np.where(on, at, 0)].astype(np.uint64)
        value[on] |= (byte[on] & np.uint64(127)) << np.uint64(7 * k)
        at[on] += 1
        done |= on & (byte < 128)
    return value, at, done


def _fields(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(fields, whether each is a message) of many stretches of bytes: all stretches advance by one field a step.

    fields has, for each one found, the stretch that it is of, its number, kind, value, and where its bytes begin and end. What a walk would not reach, after a
    number that is cut or an unknown kind, is not among them; a short fixed field is left out.
    """
    at, live = start.copy(), np.flatnonzero(start < end)
    walks, seen, good = np.ones(len(start), bool), np.zeros(len(start), int), np.ones(len(start), bool)
    out: list[tuple] = []
    while len(live):
        stop = end[live]
        tag, pos, whole = _varints(buf, at[live], stop)
        number, kind = (tag >> np.uint64(3)).astype(np.int64), (tag & np.uint64(7)).astype(int)
        good[live[~whole | (number == 0) | np.isin(kind, (3, 4, 6))]] = False
        walks[live[~whole | ~np.isin(kind, (0, 1, 2, 5))]] = False
        value, after, read = _varints(buf, pos, np.where(whole & np.isin(kind, (0, 2)), stop, pos))
        cut = whole & np.isin(kind, (0, 2)) & ~read
        good[live[cut]] = walks[live[cut]] = False
        size = np.where(kind == 2, np.minimum(value, np.uint64(2**62)).astype(np.int64), np.where(kind == 1, 8, np.where(kind == 5, 4, 0)))
        first = np.where(np.isin(kind, (0, 2)), after, pos)
        nxt = first + size
        good[live[whole & (nxt > stop)]] = False
        found = whole & ~cut & walks[live] & ((kind == 0) | (kind == 2) | (nxt <= stop))
        out.append(tuple(x[found] for x in (live, number, kind, value, first, np.minimum(nxt, stop), at[live])))
        seen[live[whole]] += 1
        at[live] = np.minimum(nxt, stop)
        live = live[(good[live] | walks[live]) & (at[live] < stop)]
    names = ("of", "number", "kind", "value", "first", "end", "at")
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 7
    return dict(zip(names, cols, strict=True)), good & (seen > 0)


def decode_batch(packets: pa.Array) -> pa.Array:
    """decode() of many packets at once: for each, a list of (k, v), of a repeated path the first. Null counts as empty."""
    data = pa.array(packets, pa.binary()) if not isinstance(packets, pa.Array) else packets.cast(pa.binary())
    data = pc.fill_null(data, b"")
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    buf = np.frombuffer(data.buffers()[2] or b"\0", np.uint8) if data.buffers()[2] is not None and data.buffers()[2].size else np.zeros(1, np.uint8)
    start, end, packet, path = offsets[:-1], offsets[1:], np.arange(len(data)), np.zeros(len(data), np.int64)
    paths: list[str] = [""]
    kept: list[tuple] = []
    for depth in range(DEPTH + 1):
        f, _ = _fields(buf, start, end)
        if not len(f["of"]):
            break
        pairs, which = np.unique(np.stack([path[f["of"]], f["number"]], 1), axis=0, return_inverse=True)
        base = len(paths)
        paths += [f"{paths[p]}.{n}" if paths[p] else str(n) for p, n in pairs.tolist()]
        own, mine = base + which.ravel(), packet[f["of"]]
        inner = np.zeros(len(own), bool)
        maybe = np.flatnonzero((f["kind"] == 2) & (f["end"] - f["first"] > 1)) if depth < DEPTH else np.zeros(0, int)
        if len(maybe):
            inner[maybe] = _fields(buf, f["first"][maybe], f["end"][maybe])[1]
        kept.append(tuple(x[~inner] for x in (mine, own, f["at"], f["kind"], f["value"], f["first"], f["end"])))
        start, end, packet, path = f["first"][inner], f["end"][inner], mine[inner], own[inner]
    mine, own, at, kind, value, first, stop = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else [np.zeros(0, np.int64)] * 7
    order = np.lexsort((at, mine))
    mine, own, kind, value, first, stop = (x[order] for x in (mine, own, kind, value, first, stop))
    if len(mine):
        names: dict[str, int] = {}
        same = np.array([names.setdefault(p, len(names)) for p in paths])[own]
        once = np.sort(np.unique(mine * len(names) + same, return_index=True)[1])
        mine, own, kind, value, first, stop = (x[once] for x in (mine, own, kind, value, first, stop))
    fixed = lambda k, width, t: buf[np.where(kind == k, first, 0)[:, None] + np.arange(width)].copy().view(t)[:, 0] if len(buf) >= width and len(kind) else np.zeros(len(kind), t)
    raw = [buf[a:b].tobytes() if k == 2 else None for k, a, b in zip(kind.tolist(), first.tolist(), stop.tolist(), strict=True)]
    v = pa.StructArray.from_arrays([pa.array(value.astype(np.uint64).view(np.int64), mask=kind != 0), pa.array(fixed(1, 8, "<f8"), mask=kind != 1), pa.array(fixed(5, 4, "<f4"), mask=kind != 5), pa.array(raw, pa.binary())], names=["i", "d", "f", "b"])
    rows = pa.StructArray.from_arrays([pa.array(np.array(paths, object)[own] if len(own) else [], pa.string()), v], names=["k", "v"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(mine, np.arange(len(data) + 1)), pa.int32()), rows)


def decoded(df: DataFrame, packet: str = "packet", out: str = "fields") -> DataFrame:
    """df with the decoded fields of each packet as a map; the packets of an Arrow batch are decoded together, a field of each at a time."""

    @F.arrow_udf(f"array<struct<k: string, v: {VALUE}>>")
    def run(packets: pa.Array) -> pa.Array:
        return decode_batch(packets)

    return df.withColumn(out, F.map_from_entries(run(F.col(packet))))


def fix(fields: Column) -> list[Column]:
    """Telemetry columns of a map of decoded fields, in degrees and metres."""

    def one(path: str, unit: str) -> Column:
        v = F.try_element_at(fields, F.lit(path))
        x = F.coalesce(v["d"], v["f"].cast("double"), v["i"].cast("double"))
        return {"rad": F.degrees(x), "milli": x / 1000, "deci": x / 10}[unit]

    return [one(p, u).alias(n) for n, (p, u) in FIELDS.items()]


def encode_varint(n: int) -> bytes:
    n &= 2**64 - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(tree: dict) -> bytes:
    """A message of {field: int, float, bytes or a tree}; the counterpart of decode, for tests and round trips."""
    out = b""
    for field, v in tree.items():
        kind = 0 if isinstance(v, int) else 1 if isinstance(v, float) else 2
        raw = encode(v) if isinstance(v, dict) else v
        body = encode_varint(raw) if kind == 0 else struct.pack("<d", raw) if kind == 1 else encode_varint(len(raw)) + raw
        out += encode_varint(field << 3 | kind) + body
    return out
