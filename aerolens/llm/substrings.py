"""Exact removal of repeated substrings by bucket-pointer refinement.

A window of 100 bytes goes if the same bytes start earlier. Each window is filed under the q-gram in it with the
least hash, so equal windows meet in one bucket whatever stands around them, and neighbouring windows
under one q-gram travel as one stretch of bytes.

1. Chunks of documents send the hashes of these q-grams, packed, to buckets; those that occur once in all
   texts are dropped. Most text ends here, without having been shuffled. What a chunk knows of its documents
   goes straight to where its q-grams come back, under a number below 0 that is no bucket.
2. Stretches under q-grams that occur again go to buckets. Equal stretches of a task go once; places of the
   others pass by, again under numbers below 0.
3. In a bucket, equal stretches of several tasks are one. Positions are sorted by their first bytes into initial
   buckets, which are refined by the bucket numbers at later offsets; refined numbers are reused in the next round,
   so that 8 bytes grow to 24, 72 and 100 without comparing text again. Each final bucket keeps its earliest window.
4. What the other windows cover is cut from the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .jaccard import _schema
from .shingles import _table, mix, powers

WINDOW = 100
#: Bytes of the q-gram that a window is filed under.
GRAM = 20
CHUNK_DOCS = 256
CHUNK_BYTES = 1_000_000
#: Bytes of text for each bucket of q-grams, and of stretches.
GRAM_BUCKET_BYTES = 48_000_000
STRETCH_BUCKET_BYTES = 1_500_000
LOW_BITS = 40
#: Digests of stretches that a task remembers; then it forgets them all, and equal stretches travel again.
MOST_SEEN = 200_000
_U = np.uint64
_PLACE = 24
_SEGMENT = (1 << 20) - 200

_KEY = "nul int, id long, h long"
GRAMS = "bucket long, chunk long, low binary, high binary, times binary, place binary, nuls binary, ids binary, hs binary"
AGAIN = f"{_KEY}, grams binary"
STRETCHES = "bucket long, bytes binary, lengths binary, starts binary, place binary, nuls binary, ids binary, hs binary, done_place binary, done_from binary, done_to binary"
SPANS = f"{_KEY}, low binary, high binary"
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def filed(data: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of each stretch of windows of data that are filed under one q-gram.

    Of equal least hashes in a window the first one counts, so places never go back.
    """
    a = np.frombuffer(data, np.uint8)
    n = len(a) - window + 1
    if n <= 0:
        e = np.zeros(0, np.int64)
        return e.astype(_U), e, e
    parts = []
    width = window - gram + 1
    for lo in range(0, n, _SEGMENT):
        b = a[lo : min(len(a), lo + _SEGMENT + window - 1)]
        up, down = powers(len(b) + 1)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(_table[b] * up[: len(b)], dtype=_U)])
        k = len(b) - gram + 1
        h = mix((total[gram:] - total[:k]) * down[:k])
        m = h >> _U(_PLACE) << _U(_PLACE) | np.arange(k, dtype=_U)
        have = 1
        while 2 * have <= width:
            m = np.minimum(m[: len(m) - have], m[have:])
            have *= 2
        if have < width:
            m = np.minimum(m[: len(m) - (width - have)], m[width - have :])
        place = (m & _U((1 << _PLACE) - 1)).astype(np.int64)
        head = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        parts.append((h[place[head]], head + lo, np.append(head[1:], len(place)) - 1 + lo))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _keys(h: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of q-grams, whose first bits are their bucket. The least hash of a window is small, so that without a
    scramble the first of 32 buckets would hold three quarters of all."""
    return mix(h) >> _U(64 - bits - LOW_BITS)


def _chunks(b: pa.RecordBatch):
    """(nul, id, h, text) of runs of rows within the limits of a chunk, in order of place within each run."""
    rows, size = [], 0
    for i in range(b.num_rows):
        text = b.column(3)[i].as_py() or b""
        if rows and (len(rows) == CHUNK_DOCS or size + len(text) > CHUNK_BYTES):
            yield rows
            rows, size = [], 0
        rows.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_py(), text, *(c[i].as_py() for c in b.columns[4:])))
        size += len(text)
    if rows:
        yield rows


def _info(rows: list[tuple]) -> dict:
    return {"nuls": bytes(r[0] for r in rows), "ids": np.array([r[1] for r in rows], "<i8").tobytes(), "hs": np.array([r[2] for r in rows], "<i8").tobytes()}


def _grams(bits: int, window: int, gram: int):
    schema = _schema(GRAMS)

    def run(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            for rows in _chunks(b):
                hashes = [filed(r[3], window, gram)[0] for r in rows]
                flat = _keys(np.concatenate(hashes), bits)
                place = np.repeat(np.arange(len(rows), dtype=np.uint8), list(map(len, hashes)))
                order = np.argsort(flat, kind="stable")
                flat, place = flat[order], place[order]
                head = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
                key, ends = flat[head], np.append(head, len(flat))
                times = np.diff(ends).astype("<u4")
                bucket = (key >> _U(LOW_BITS)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                there = np.flatnonzero(np.diff(cut)).tolist()
                low, high, info = key.astype(np.uint32), (key >> _U(32)).astype(np.uint8), _info(rows)
                part = lambda x: [b"", *(x[cut[k] : cut[k + 1]].tobytes() for k in there)]  # noqa: E731, B023
                cols = {"bucket": [-1 - chunk, *there], "chunk": [chunk] * (len(there) + 1), "low": part(low), "high": part(high), "times": part(times), "place": [b"", *(place[ends[cut[k]] : ends[cut[k + 1]]].tobytes() for k in there)]}
                yield pa.RecordBatch.from_pydict(cols | {c: [v] + [None] * len(there) for c, v in info.items()}, schema=schema)
                chunk += 1

    return run


def _again():
    """Of a bucket, what occurs more than once, in the same form; a chunk's documents pass by."""
    schema = _schema(GRAMS)

    def run(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() < 0:
            return t
        lows, places = t["low"].to_pylist(), t["place"].to_pylist()
        count = np.array([len(x) // 4 for x in lows])
        key = np.frombuffer(b"".join(lows), "<u4").astype(_U) | np.frombuffer(b"".join(t["high"].to_pylist()), np.uint8).astype(_U) << _U(32)
        times = np.frombuffer(b"".join(t["times"].to_pylist()), "<u4")
        place = np.frombuffer(b"".join(places), np.uint8)
        _, inverse = np.unique(key, return_inverse=True)
        keep = np.bincount(inverse, times)[inverse] >= 2 if len(key) else np.zeros(0, bool)
        row, wide = np.repeat(np.arange(len(count)), count), np.repeat(keep, times)
        cut = np.searchsorted(row[keep], np.arange(len(count) + 1))
        pcut = np.searchsorted(np.repeat(row, times)[wide], np.arange(len(count) + 1))
        key, times, place = key[keep], times[keep], place[wide]
        low, high = key.astype(np.uint32), (key >> _U(32)).astype(np.uint8)
        info = {c: t[c].to_pylist() for c in ("nuls", "ids", "hs")}
        bucket, chunk = t["bucket"].to_pylist(), t["chunk"].to_pylist()
        rows = np.flatnonzero(np.diff(cut)).tolist()
        part = lambda x: [x[cut[i] : cut[i + 1]].tobytes() for i in rows]
        cols = {"bucket": [bucket[i] for i in rows], "chunk": [chunk[i] for i in rows], "low": part(low), "high": part(high), "times": part(times), "place": [place[pcut[i] : pcut[i + 1]].tobytes() for i in rows]}
        return pa.Table.from_pydict(cols | {c: [v[i] for i in rows] for c, v in info.items()}, schema=schema)

    return run


def _by_document():
    schema = _schema(AGAIN)

    def run(t: pa.Table) -> pa.Table:
        ids = t["ids"].to_pylist()
        at = next(i for i, x in enumerate(ids) if x is not None)
        lows = t["low"].to_pylist()
        bucket = np.repeat(np.maximum(t["bucket"].to_numpy(), 0).astype(_U), [len(x) // 4 for x in lows])
        key = np.frombuffer(b"".join(lows), "<u4").astype(_U) | np.frombuffer(b"".join(t["high"].to_pylist()), np.uint8).astype(_U) << _U(32) | bucket << _U(LOW_BITS)
        key = np.repeat(key, np.frombuffer(b"".join(t["times"].to_pylist()), "<u4"))
        place = np.frombuffer(b"".join(t["place"].to_pylist()), np.uint8)
        order = np.lexsort((key, place))
        key, cut = key[order], np.searchsorted(place[order], np.arange(257))
        nuls, own, hs = t["nuls"][at].as_py(), np.frombuffer(ids[at], "<i8"), np.frombuffer(t["hs"][at].as_py(), "<i8")
        rows = [i for i in range(len(own)) if cut[i] < cut[i + 1]]
        return pa.Table.from_pydict({"nul": [nuls[i] for i in rows], "id": own[rows], "h": hs[rows], "grams": [np.unique(key[cut[i] : cut[i + 1]]).tobytes() for i in rows]}, schema=schema)

    return run


def _stretches(bits: int, buckets: int, window: int, gram: int):
    schema = _schema(STRETCHES)

    def run(batches):
        from pyspark import TaskContext

        passing = -1 - (TaskContext.get().partitionId() << 32)
        seen: set[bytes] = set()  # digests of this task's stretches; rows come in order of place
        before = None  # place of the row before: what a repeated row repeats of itself is no repeat, and spans hold for all rows of a document
        for b in batches:
            for rows in _chunks(b):
                packs: dict[int, list] = {}
                done: list[tuple[int, int, int]] = []
                for i, (*place, text, grams) in enumerate(rows):
                    if place == before:
                        continue
                    before = place
                    h, first, last = filed(text, window, gram)
                    own = np.frombuffer(grams, "<u8")
                    key = _keys(h, bits)
                    at = np.minimum(np.searchsorted(own, key), len(own) - 1)
                    hit = np.flatnonzero(own[at] == key)
                    to = (mix(h[hit]) % _U(buckets)).tolist()
                    for lo, hi, bucket in zip(first[hit].tolist(), last[hit].tolist(), to, strict=True):
                        x = text[lo : hi + window]
                        digest = hashlib.blake2b(x, digest_size=16).digest()
                        if digest in seen:
                            done.append((i, lo, hi + window))
                        else:
                            seen.add(digest)
                            packs.setdefault(bucket, []).append((x, i, lo))
                if len(seen) > MOST_SEEN:
                    seen.clear()
                cols: dict[str, list] = {c: [] for c in schema.names}
                for bucket, own, gone in [*((k, x, []) for k, x in packs.items()), *([(passing, [], done)] if done else [])]:
                    used = sorted({x[1] for x in own} | {x[0] for x in gone})
                    number = {i: k for k, i in enumerate(used)}
                    cols["bucket"].append(bucket)
                    cols["bytes"].append(b"".join(x[0] for x in own))
                    cols["lengths"].append(np.array([len(x[0]) for x in own], "<u4").tobytes())
                    cols["starts"].append(np.array([x[2] for x in own], "<u8").tobytes())
                    cols["place"].append(bytes(number[x[1]] for x in own))
                    for c, v in _info([rows[i] for i in used]).items():
                        cols[c].append(v)
                    cols["done_place"].append(bytes(number[x[0]] for x in gone))
                    cols["done_from"].append(np.array([x[1] for x in gone], "<u8").tobytes())
                    cols["done_to"].append(np.array([x[2] for x in gone], "<u8").tobytes())
                passing -= 1
                yield pa.RecordBatch.from_pydict(cols, schema=schema)

    return run


def _numbered(key: np.ndarray) -> np.ndarray:
    """Place of each key among the distinct keys."""
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate([[False], k[1:] != k[:-1]])
    del k
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(new, dtype=np.int32)
    return out


def refine(data: np.ndarray, window: int = WINDOW, at: np.ndarray | None = None) -> np.ndarray:
    """Bucket numbers of all positions of data with `window` bytes after them, or of those at `at`: equal exactly if the windows are.

    Initial buckets are by 8 bytes; each round sorts a position's bucket with the buckets at one or two later
    offsets: two if three numbers fit one key, so that 8 bytes grow to 24, 72 and 100.
    """
    n, have = len(data) - 7, 8
    if len(data) < window or window < 8:
        return np.zeros(0, np.int32)
    word = np.zeros(n, _U)
    for k in range(8):
        word |= data[k : k + n].astype(_U) << _U(8 * (7 - k))
    bucket = _numbered(word)
    del word
    while have < window:
        later, bits = ((have, 2 * have), 21) if 3 * have <= window and len(bucket) < 1 << 21 else ((min(have, window - have),), 32)
        m = len(bucket) - later[-1]
        have += later[-1]
        wanted = slice(None) if at is None or have < window else at
        key = bucket[:m][wanted].astype(_U)
        for k in later:
            key <<= _U(bits)
            key |= bucket[k : k + m][wanted].astype(_U)
        bucket = _numbered(key)
        del key
    return bucket[at] if at is not None and window == 8 else bucket


def _spans(window: int):
    schema = _schema(SPANS)

    def run(t: pa.Table) -> pa.Table:
        n_docs = [len(x) for x in t["nuls"].to_pylist()]
        base = np.concatenate([[0], np.cumsum(n_docs)])
        nul = np.frombuffer(b"".join(t["nuls"].to_pylist()), np.uint8)
        ids, hs = (np.frombuffer(b"".join(t[c].to_pylist()), "<i8") for c in ("ids", "hs"))
        order = np.lexsort((hs, ids, nul))
        same = np.zeros(len(order), bool)
        for x in (nul, ids, hs):
            s = x[order]
            same[1:] |= s[1:] != s[:-1]
        rank = np.zeros(len(order), np.int64)
        rank[order] = np.cumsum(same)  # rows of one document in several chunks are one
        places = t["place"].to_pylist()
        doc = rank[np.frombuffer(b"".join(places), np.uint8) + np.repeat(base[:-1], list(map(len, places)))]
        length = np.frombuffer(b"".join(t["lengths"].to_pylist()), "<u4").astype(np.int64)
        start = np.frombuffer(b"".join(t["starts"].to_pylist()), "<u8").astype(np.int64)
        raw = b"".join(t["bytes"].to_pylist())
        first = np.cumsum(length) - length
        by = np.lexsort((start, doc))  # windows in the order of their places
        first, length, start, doc = first[by], length[by], start[by], doc[by]
        known: dict[bytes, int] = {}  # equal stretches of several tasks: the earliest stands for all
        lead = np.array([known.setdefault(raw[x : x + n], k) for k, (x, n) in enumerate(zip(first.tolist(), length.tolist(), strict=True))], np.int64)
        again = (doc != doc[lead]) | (start != start[lead])
        og, fg, tg = doc[again], start[again], start[again] + length[again]
        own = lead == np.arange(len(lead))
        length, start, doc = length[own], start[own], doc[own]
        data = np.frombuffer(b"".join(known), np.uint8)
        del raw, known
        first = np.cumsum(length) - length
        wins = length - window + 1
        step = np.arange(wins.sum()) - np.repeat(np.cumsum(wins) - wins, wins)
        bucket = refine(data, window, np.repeat(first, wins) + step) if len(step) else step
        o, w = np.repeat(doc, wins), np.repeat(start, wins) + step
        del step
        lead = np.zeros(int(bucket.max(initial=0)) + 1, np.int64)
        lead[bucket[::-1]] = np.arange(len(o))[::-1]  # the first window of each bucket is written last
        lead = lead[bucket]
        gone = (o != o[lead]) | (w != w[lead])
        o, w = o[gone], w[gone]
        done = t["done_place"].to_pylist()
        od = rank[np.frombuffer(b"".join(done), np.uint8) + np.repeat(base[:-1], list(map(len, done)))]
        fd, td = (np.frombuffer(b"".join(t[c].to_pylist()), "<u8").astype(np.int64) for c in ("done_from", "done_to"))
        new = np.concatenate([[True], (o[1:] != o[:-1]) | (w[1:] > w[:-1] + 1)]) if len(o) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        end = w[np.append(head[1:], len(w)) - 1] + window if len(o) else w
        o, lo, hi = np.concatenate([o[head], od, og]), np.concatenate([w[head], fd, fg]), np.concatenate([end, td, tg])
        by = np.argsort(o, kind="stable")
        o, lo, hi = o[by], lo[by].astype("<u8"), hi[by].astype("<u8")
        docs, cut = np.unique(o, return_index=True)
        cut = np.append(cut, len(o))
        any_ = np.zeros(len(order), np.int64)
        any_[rank] = np.arange(len(order))
        k = any_[docs]
        return pa.Table.from_pydict({"nul": nul[k].astype(np.int32), "id": ids[k], "h": hs[k], "low": [lo[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)], "high": [hi[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)]}, schema=schema)

    return run


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [lo, hi)."""
    if not len(lo):
        return lo, hi
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    head = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return lo[head], hi[np.append(head[1:], len(hi)) - 1]


def cut_spans(text: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed)."""
    lo, hi = merged(lo, hi)
    out, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out), int((hi - lo).sum()), len(lo)


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows are docs as (nul, id, h, text as bytes), spans the byte ranges of their documents to remove,
    packed, in one row or more a document."""
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(0, min(24, (size // GRAM_BUCKET_BYTES).bit_length()))
    buckets = max(1, size // STRETCH_BUCKET_BYTES)
    rows = docs.select(F.col("doc_id").isNull().cast("int").alias("nul"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    grams = rows.mapInArrow(_grams(bits, window, gram), GRAMS)
    again = grams.groupBy("bucket").applyInArrow(_again(), GRAMS).groupBy("chunk").applyInArrow(_by_document(), AGAIN)
    again = again.groupBy("nul", "id", "h").agg(F.first("grams").alias("grams"))  # a repeated row has the same ones
    packs = rows.join(again, ["nul", "id", "h"]).select("nul", "id", "h", "text", "grams").sortWithinPartitions("nul", "id", "h").mapInArrow(_stretches(bits, buckets, window, gram), STRETCHES)
    return rows, packs.groupBy("bucket").applyInArrow(_spans(window), SPANS)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of (doc_id, text).

    Documents are ordered by doc_id, null last, then by a hash of the text. Rows of equal id and text are one
    document, of which no row is earlier than another. A null text is empty; texts shorter than a window stay.
    """
    rows, spans = repeated_spans(docs, window, gram)
    spans = spans.groupBy("nul", "id", "h").agg(F.collect_list("low").alias("low"), F.collect_list("high").alias("high"))  # a document's own
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for nul, i, text, low, high in zip(*(c for c in b.columns), strict=True):
                text = text.as_py() or b""
                lo, hi = (np.frombuffer(b"".join(x.as_py() or []), "<u8").astype(np.int64) for x in (low, high))
                left, gone, n = cut_spans(text, lo, hi)
                out.append((None if nul.as_py() else i.as_py(), len(text), gone, n, hashlib.sha256(left).hexdigest()))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return rows.join(spans, ["nul", "id", "h"], "left").select("nul", "id", "text", "low", "high").mapInArrow(run, OUT)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op7_suffix_array_dedup": op7_suffix_array_dedup}
#: The same over all windows, in hexadecimal digits, for the SQL check.
SQL: dict[str, str] = {
    "op7_suffix_array_dedup": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b0 AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99, 500)) AS off FROM t), b1 AS (SELECT doc_id, off, substr(h, 2 * off + 1, 1198) AS part FROM b0),
b2 AS (SELECT doc_id, off, part, unnest(range(0, length(part) // 2 - 99)) AS i FROM b1), w AS (SELECT doc_id, off + i AS k, md5(substr(part, 2 * i + 1, 200)) AS m FROM b2),
a AS (SELECT doc_id, k, row_number() OVER (PARTITION BY m ORDER BY doc_id, k) AS nth FROM w),
g AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER x + 100 THEN 0 ELSE 1 END AS new FROM a WHERE nth > 1 WINDOW x AS (PARTITION BY doc_id ORDER BY k)),
i AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM g),
s AS (SELECT doc_id, run, min(k) AS lo, max(k) + 100 AS hi FROM i GROUP BY ALL),
b AS (SELECT doc_id, lo, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since, hi FROM s),
p AS (SELECT doc_id, count(*) AS n_spans, sum(hi - lo) AS gone, max(hi) AS last, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS left_ FROM b JOIN t USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM t LEFT JOIN p USING (doc_id)"""
}
