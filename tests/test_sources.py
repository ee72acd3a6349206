"""Data sources and the delivering sink: files written by hand come back as rows, restarts repeat nothing, failures leave nothing."""

import json
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aerolens.sources import container, exchange, telemetry_packets, terrain_tiff


def _tiff(path, z, rows=7, deflate=False, predictor=1, big=False, tile=None, order="<", missing=None, tie=(0, 0, 0, 73.0, 40.0, 0), scale=(0.001, 0.0005, 0)):
    h, w = z.shape
    if tile:
        pad = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), z.dtype)
        pad[:h, :w] = z
        parts = [pad[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
    else:
        parts = [z[y : y + rows] for y in range(0, h, rows)]

    def pack(p):
        if predictor == 2:
            p = np.concatenate([p[:, :1], np.diff(p, axis=1)], 1)
        data = p.astype(p.dtype.newbyteorder(order)).tobytes()
        if predictor == 3:
            by = np.frombuffer(p.astype(">f4").tobytes(), np.uint8).reshape(*p.shape, 4).transpose(0, 2, 1).reshape(p.shape[0], -1)
            data = np.concatenate([by[:, :1], np.diff(by, axis=1)], 1).astype(np.uint8).tobytes()
        return zlib.compress(data) if deflate else data

    packed = [pack(p) for p in parts]
    body, offsets = b"", []
    for x in packed:
        offsets.append(16 + len(body))
        body += x
    kind = {"f": 3, "i": 2, "u": 1}[z.dtype.kind]
    counts = [len(x) for x in packed]
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [z.dtype.itemsize * 8]), (259, "H", [8 if deflate else 1])]
    tags += [(322, "H", [tile]), (323, "H", [tile]), (324, "I", offsets), (325, "I", counts)] if tile else [(273, "I", offsets), (278, "I", [rows]), (279, "I", counts)]
    tags += [(317, "H", [predictor]), (339, "H", [kind]), (33550, "d", scale), (33922, "d", tie)] + ([(42113, "s", [missing.encode() + b"\0"])] if missing else [])
    code = {"H": 3, "I": 4, "d": 12, "s": 2}
    more, entries, at = b"", b"", 16 + len(body)
    for tag, c, values in sorted(tags):
        raw = values[0] if c == "s" else struct.pack(f"{order}{len(values)}{c}", *values)
        n, room = (len(raw) if c == "s" else len(values)), 8 if big else 4
        if len(raw) > room:
            where = at + len(more)
            more += raw
            raw = struct.pack(order + ("Q" if big else "I"), where)
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, code[c], n) + raw.ljust(room, b"\0")
    first = at + len(more)
    start = b"II" if order == "<" else b"MM"
    begin = start + (struct.pack(order + "HHHQ", 43, 8, 0, first) if big else struct.pack(order + "HI", 42, first))
    path.write_bytes(begin.ljust(16, b"\0") + body + more + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * 8)


@pytest.mark.parametrize("how", [{}, {"deflate": True, "predictor": 2, "kind": "<i2"}, {"deflate": True, "predictor": 3}, {"tile": 16, "deflate": True}, {"big": True, "order": ">", "kind": "<i4"}])
def test_terrain_comes_back(spark, tmp_path, how):
    how = dict(how)
    z = np.random.default_rng(1).integers(-50, 5000, (40, 37)).astype(how.pop("kind", "<f4"))
    z[3, 4] = -9999
    _tiff(tmp_path / "dem.tif", z, missing="-9999", **how)
    spark.dataSource.register(terrain_tiff.TerrainTiff)
    got = spark.read.format("terrain_tiff").load(str(tmp_path)).toPandas().sort_values(["iy", "ix"])
    assert len(got) == z.size and np.isnan(got.z.iloc[3 * 37 + 4])
    assert (got.z.fillna(-9999).to_numpy().reshape(z.shape) == z).all()
    assert np.allclose(got.lat, 40 - got.iy * 0.0005) and np.allclose(got.lon, 73 + got.ix * 0.001)


def test_terrain_reads_only_strips_that_are_asked_for(tmp_path):
    z = np.arange(400.0).reshape(40, 10).astype("<f4")
    _tiff(tmp_path / "dem.tif", z, rows=5)
    reader = terrain_tiff.TerrainTiff({"path": str(tmp_path / "dem.tif")}).reader(None)
    kept = list(reader.pushFilters([terrain_tiff.GreaterThanOrEqual(("lat",), 40 - 17 * 0.0005), terrain_tiff.LessThan(("lat",), 40 - 11 * 0.0005)]))
    assert len(kept) == 2 and [b.y for b in reader.partitions()] == [10, 15]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 100
    (tmp_path / "bad.tif").write_bytes(b"no picture at all")
    with pytest.raises(ValueError, match="not a TIFF"):
        terrain_tiff.head(str(tmp_path / "bad.tif"))


def _box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), name) + body


def _container(path, streams, wide=False):
    """streams: (kind, handler name, packets, seconds of each); packets of all streams lie in turn, two to a chunk."""
    data, places = b"", [[] for _ in streams]
    for k in range(0, max(len(s[2]) for s in streams), 2):
        for i, s in enumerate(streams):
            if s[2][k : k + 2]:
                places[i].append(len(data))
                data += b"".join(s[2][k : k + 2])
    shift = 8 + 16
    traks = []
    for (kind, handler, packets, step), at in zip(streams, places):
        offsets = struct.pack(f">I{len(at)}{'Q' if wide else 'I'}", len(at), *(shift + 8 + a for a in at))
        per = [(1, 2)] + ([(len(at), 1)] if len(packets) % 2 and len(at) > 1 else []) if len(packets) > 1 else [(1, 1)]
        stbl = _box(b"stbl", _box(b"stts", struct.pack(">IIII", 0, 1, len(packets), int(step * 1000))), _box(b"stsc", struct.pack(f">II{3 * len(per)}I", 0, len(per), *(v for f, n in per for v in (f, n, 1)))),
                    _box(b"stsz", struct.pack(f">III{len(packets)}I", 0, 0, len(packets), *map(len, packets))), _box(b"co64" if wide else b"stco", b"\0" * 4 + offsets))
        traks.append(_box(b"trak", _box(b"mdia", _box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 1000, 0)), _box(b"hdlr", b"\0" * 8 + kind + b"\0" * 12 + handler.encode() + b"\0"), _box(b"minf", stbl))))
    path.write_bytes(_box(b"ftyp", b"isom" + b"\0" * 12) + _box(b"mdat", data) + _box(b"moov", *traks))


@pytest.mark.parametrize("wide", [False, True])
def test_packets_come_from_their_byte_ranges(spark, tmp_path, wide):
    packet = lambda n: telemetry_packets.encode({3: {3: {5: {1: 1000 * n}}, 4: {3: {1: -10 * n, 3: n}}}})
    streams = [(b"vide", "VideoHandler", [b"v" * (50 + k) for k in range(9)], 0.04), (b"meta", "other data", [b"zz"], 1.0), (b"meta", "DJI meta", [packet(k) for k in range(7)], 0.1)]
    (tmp_path / "in").mkdir()
    _container(tmp_path / "in" / "a.MP4", streams, wide)
    _container(tmp_path / "in" / "b.mp4", streams[:2], wide)
    _container(tmp_path / "in" / "c.mp4", streams[:1], wide)
    spark.dataSource.register(container.ContainerPackets)
    got = spark.read.format("container_packets").load(str(tmp_path / "in"))
    rows = sorted((r["path"][-5], r["stream"], r["ord"], round(r["pts"], 6), bytes(r["packet"])) for r in got.collect())
    assert rows == [("a", 2, k, round(0.1 * k, 6), packet(k)) for k in range(7)] + [("b", 1, 0, 0.0, b"zz")]
    fields = telemetry_packets.decoded(got.where("stream = 2")).select("ord", *telemetry_packets.fix(F.col("fields")))
    assert [(r["gb_yaw"], r["gb_pitch"], r["alt_rel_m"]) for r in fields.orderBy("ord").collect()] == [(k / 10, -float(k), float(k)) for k in range(7)]
    every = spark.read.format("container_packets").option("stream", "all").load(str(tmp_path / "in" / "a.MP4"))
    assert {(r["stream"], r["n"], r["b"]) for r in every.groupBy("stream").agg(F.count("*").alias("n"), F.sum(F.length("packet")).alias("b")).collect()} == {(i, len(s[2]), sum(map(len, s[2]))) for i, s in enumerate(streams)}


def test_listing_needs_all_pages(spark, tmp_path):
    for n, items in enumerate([[{"path": "/a/x.MP4", "size": 5, "type": "file"}, {"path": "/a", "type": "dir"}], [{"path": "/y.JPG", "size": 7, "type": "file"}]]):
        (tmp_path / f"page-{n}.json").write_text(json.dumps({"total": 3, "items": items}))
    spark.dataSource.register(exchange.PagedListing)
    got = spark.read.format("paged_listing").load(str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [("/a/x.MP4", "x.MP4", 5, 0), ("/y.JPG", "y.JPG", 7, 1)]
    (tmp_path / "page-1.json").rename(tmp_path / "page-2.json")
    with pytest.raises(Exception, match="missing"):
        spark.read.format("paged_listing").load(str(tmp_path)).count()


def test_topics_go_on_where_each_stopped(spark, tmp_path):
    pages, out, check = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "check")

    def put(topic, *ids):
        (pages / topic).mkdir(parents=True, exist_ok=True)
        (pages / topic / f"{ids[0]}-{ids[-1]}.json").write_text(json.dumps([{"id": i, "text": f"{topic}{i}", "action": "pin" if i % 5 == 0 else None} for i in ids]))

    def run():
        spark.dataSource.register(exchange.TopicMessages)
        stream = spark.readStream.format("topic_messages").option("pages", "1").load(str(pages))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["topic"], r["id"], r["text"]) for r in spark.read.parquet(out).collect())

    put("north", 1, 2, 3)
    put("south", 10, 11)
    run()
    put("north", 4, 6)
    put("north", 9)
    put("west", 2)
    for _ in range(3):  # one page of a topic a run
        got = run()
    assert got == [("north", i, f"north{i}") for i in (1, 2, 3, 4, 6, 9)] + [("south", i, f"south{i}") for i in (10, 11)] + [("west", 2, "west2")]
    assert run() == got


def test_files_arrive_whole_or_not_at_all(spark, tmp_path):
    spark.dataSource.register(exchange.Delivery)
    rows = [("d/a.bin", 4, b"aaaa"), ("d/b.bin", 5, b"bb"), ("c.bin", 3, None), ("there.bin", 2, b"xx")]
    (tmp_path / "there.bin").write_bytes(b"tt")
    df = spark.createDataFrame([(p, n, bytearray(c) if c is not None else None) for p, n, c in rows], exchange.FILES).repartition(2)
    df.write.format("delivery").mode("append").save(str(tmp_path))
    assert (tmp_path / "d" / "a.bin").read_bytes() == b"aaaa" and not (tmp_path / "d" / "b.bin").exists() and (tmp_path / "there.bin").read_bytes() == b"tt"
    (ledger,) = (tmp_path / "_ledger").glob("*.tsv")
    assert sorted(ledger.read_text().splitlines()) == ["c.bin\t3\tabsent", "d/a.bin\t4\tdone", "d/b.bin\t5\twrong size", "there.bin\t2\tthere"]
    bad = spark.createDataFrame([("e/ok.bin", 1, bytearray(b"o")), ("../out.bin", 1, bytearray(b"o"))], exchange.FILES).coalesce(1)
    with pytest.raises(Exception, match="outside"):
        bad.write.format("delivery").mode("append").save(str(tmp_path))
    assert not (tmp_path / "e" / "ok.bin").exists() and not list(tmp_path.rglob("*.part")) and len(list((tmp_path / "_ledger").iterdir())) == 1


def test_batches_of_packets_equal_one_by_one(spark):
    rng = random.Random(1)
    leaf = lambda: rng.choice([rng.randint(-5, 300), rng.random(), bytes(rng.randrange(256) for _ in range(rng.randint(0, 9))), 2**63 + 5])
    tree = lambda d: {rng.randint(1, 20): tree(d - 1) if d and rng.random() < 0.5 else leaf() for _ in range(rng.randint(1, 5))}
    packets = []
    for k in range(1500):
        b = bytearray(telemetry_packets.encode(tree(4)))
        if k % 5 == 0:
            b = b[: rng.randint(0, len(b))]
        elif k % 5 == 1:
            b[rng.randrange(len(b))] = rng.randrange(256)
        elif k % 5 == 2:
            b = b + b
        packets.append(bytes(b))
    deep = {1: 5}
    for _ in range(12):
        deep = {1: deep}
    packets += [b"", None, telemetry_packets.encode(deep)]
    plain = lambda d: {k: tuple(map(repr, v)) for k, v in d.items()}
    for own in (packets, packets[700:703], [None], []):
        got = telemetry_packets.decode_batch(pa.array(own, pa.binary())).to_pylist()
        assert [plain({x["k"]: tuple(x["v"][c] for c in "idfb") for x in g}) for g in got] == [plain(telemetry_packets.decode(p or b"")) for p in own]
    part = pa.array(packets, pa.binary()).slice(100, 50)
    assert len(telemetry_packets.decode_batch(part)) == 50 and {x["k"] for x in telemetry_packets.decode_batch(part)[0].as_py()} == set(telemetry_packets.decode(packets[100]))
