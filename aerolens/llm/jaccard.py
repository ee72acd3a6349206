"""Exact Jaccard join on word shingles: rare-first prefixes with length, positional and suffix filters.

1. Texts are hashed in blocks of chunks, and postings (shingle, place of the document in its chunk) go to the
   shingle's bucket, packed as bytes, a row for each block and bucket. Texts themselves are never shuffled.
2. A bucket counts in how many documents each shingle is, and sends those that are shared, with their
   frequency, back to the blocks. What a block knows of its documents goes there directly.
3. A block puts each document's shared shingles in rare-first order; those of one document only come
   before all others. If they fill the prefix, the document links with nothing and is done.
4. Documents of equal sets are one class. Classes whose prefixes share shingles and whose sizes are near enough, directly or
   through others, form a cluster; a cluster is cut into blocks, and each pair of blocks is one group, so that
   each pair of classes is met in one group only. There, pairs that meet on a prefix shingle pass
   the filters and are verified once, on the shared shingles, which hold all that two documents have
   in common. A group returns sums of links and a spanning forest, not pairs.

A cluster's blocks are bounded, so a large group of near copies is spread over many tasks.

A shingle is told by 48 to 58 bits of its hash and of a 64-bit one in a document's own set. Among N different shingles about
N^2 / 2^(b + 1) pairs are taken for one by chance (b bits): one in 500 tables of a million, seven pairs in a table of two billion
(b = 58). One such pair counts a shingle too many for the documents that hold its two.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, table, written
from .components import components
from .shingles import shingle_sets

WORDS = 5
#: Least similarity, as a fraction.
NUM, DEN = 75, 100
#: Documents and bytes of a chunk, and chunks of a block. A document's place in its chunk is one byte.
CHUNK_DOCS = 256
CHUNK_BYTES = 1_500_000
CHUNKS = 16
#: Postings of a bucket, about, and bytes of text that give one posting.
BUCKET_POSTINGS = 1_000_000
POSTING_BYTES = 6
#: Bits of a shingle's identity: those of its bucket and at most so many more; the upper six bits of a key tell its frequency.
LOW_BITS, KEY_BITS = 48, 58
#: Classes of a block of a cluster.
BLOCK = 400
SEGMENTS = 16

_U = np.uint64
POSTS = "bucket long, block long, low binary, high binary, place binary, counts binary, doc_ids binary, nulls binary, sizes binary, sigs binary, reps binary, docs binary"
SHARED = POSTS + ", df binary"
SETS = "doc_id long, n long, sig binary, keys binary"
LINKS = "cid long, links long, root long"
_INFO = ("doc_ids", "nulls", "sizes", "sigs", "reps", "docs")
_NEAR = "key long, low long, high long, a long, b long"


def least_prefix(n: int, num: int = NUM, den: int = DEN) -> int:
    """Shingles that a prefix of a set of n needs."""
    return n - (num * n + den - 1) // den + 1


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(p.split()[0], kinds[p.split()[1]]) for p in ddl.split(", ")])


def chunks(batch: pa.RecordBatch):
    """(ids, texts) of runs of rows within the limits of a chunk."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        t = t.as_py() or b""
        if ids and (len(ids) == CHUNK_DOCS or size + len(t) > CHUNK_BYTES):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(t)
        size += len(t)
    if ids:
        yield ids, texts


def _low_bits(bits: int) -> int:
    return min(LOW_BITS, KEY_BITS - bits)


def _postings(bits: int, words: int):
    schema = _schema(POSTS)

    def pack(block: int, own: list[tuple]) -> pa.RecordBatch:
        """Rows of one block: its documents under a bucket of their own below 0, and its postings under theirs."""
        low = _low_bits(bits)
        ids = [i for x in own for i in x[0]]
        flat, place = np.concatenate([x[2] for x in own]), np.concatenate([x[3] for x in own])
        sub = np.repeat(np.arange(len(own)), [len(x[2]) for x in own])
        bucket = (flat >> _U(low)).astype(np.uint16 if bits <= 16 else np.int64)
        order = np.argsort(bucket, kind="stable")  # so within a bucket by chunk, then by shingle
        flat, place, sub, bucket = flat[order], place[order], sub[order], bucket[order]
        there, first = np.unique(bucket, return_index=True)
        cut = np.append(first, len(flat))
        counts = np.bincount(np.repeat(np.arange(len(there)), np.diff(cut)) * CHUNKS + sub, minlength=len(there) * CHUNKS).astype("<u4").reshape(-1, CHUNKS)
        part = lambda a: [a[x:y].tobytes() for x, y in zip(cut, cut[1:], strict=False)]
        info = {
            "doc_ids": np.array([i or 0 for i in ids], "<i8").tobytes(), "nulls": bytes(i is None for i in ids), "sizes": np.concatenate([x[4] for x in own]).astype("<i8").tobytes(),
            "sigs": b"".join(s for x in own for s in x[1]), "reps": b"".join(x[5] for x in own), "docs": np.array([len(x[0]) for x in own], "<u4").tobytes(),
        }
        cols = {"bucket": [-1 - block, *there.astype(np.int64).tolist()], "block": [block] * (len(there) + 1), "low": [b"", *part(flat.astype(np.uint32))], "high": [b"", *part((flat >> _U(32) & _U(2 ** max(0, low - 32) - 1)).astype(np.uint16))]}
        cols |= {"place": [b"", *part(place)], "counts": [bytes(4 * CHUNKS), *(c.tobytes() for c in counts)]} | {c: [v] + [None] * len(there) for c, v in info.items()}
        return pa.RecordBatch.from_pydict(cols, schema=schema)

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        own: list[tuple] = []
        seen: set[bytes] = set()  # sets that a document of this block stands for
        for b in batches:
            for ids, texts in chunks(b):
                sets = shingle_sets(texts, words)
                sigs = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                reps = bytearray(len(ids))
                for i, sig in enumerate(sigs):
                    if ids[i] is not None and sig not in seen:
                        seen.add(sig)
                        reps[i] = 1
                at = [i for i in range(len(ids)) if reps[i]]
                flat = np.concatenate([sets[i] for i in at] or [np.zeros(0, _U)]) >> _U(64 - bits - _low_bits(bits))
                place = np.repeat(np.array(at, np.uint8), [len(sets[i]) for i in at])
                order = np.argsort(flat, kind="stable")
                own.append((ids, sigs, flat[order], place[order], np.array([len(s) for s in sets]), bytes(reps)))
                if len(own) == CHUNKS:
                    yield pack(block, own)
                    block, own, seen = block + 1, [], set()
        if own:
            yield pack(block, own)

    return run


def _identities(t: pa.Table) -> np.ndarray:
    """Shingles' bits below those of their buckets."""
    low, high = (np.frombuffer(b"".join(t[c].to_pylist()), k) for c, k in (("low", "<u4"), ("high", "<u2")))
    return low.astype(_U) | high.astype(_U) << _U(32)


def _counts(t: pa.Table) -> np.ndarray:
    """Postings of each row and chunk, row by row."""
    return np.frombuffer(b"".join(t["counts"].to_pylist()), "<u4").astype(np.int64)


def _shared():
    schema = _schema(SHARED)

    def run(t: pa.Table) -> pa.Table:
        if t["bucket"][0].as_py() < 0:
            return t.append_column("df", pa.array([b""] * len(t), pa.binary())).cast(schema)
        key = _identities(t)
        place = np.frombuffer(b"".join(t["place"].to_pylist()), np.uint8)
        chunk = np.repeat(np.arange(len(t) * CHUNKS), _counts(t))
        order = np.argsort(key, kind="stable")
        k = key[order]
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        run_ = np.diff(np.append(head, len(k)))
        df = np.empty(len(k), "<u4")
        df[order] = np.repeat(run_, run_)
        keep = df >= 2
        key, place, df = key[keep], place[keep], df[keep]
        counts = np.bincount(chunk[keep], minlength=len(t) * CHUNKS).astype("<u4").reshape(-1, CHUNKS)
        cut = np.concatenate([[0], np.cumsum(counts.sum(1, dtype=np.int64))])
        rows = np.flatnonzero(np.diff(cut)).tolist()
        part = lambda a: [a[cut[i] : cut[i + 1]].tobytes() for i in rows]
        cols = {"bucket": t["bucket"].to_numpy()[rows], "block": t["block"].to_numpy()[rows], "low": part(key.astype(np.uint32)), "high": part((key >> _U(32)).astype(np.uint16)), "place": part(place), "counts": [counts[i].tobytes() for i in rows]}
        return pa.Table.from_pydict(cols | {c: [None] * len(rows) for c in _INFO} | {"df": part(df)}, schema=schema)

    return run


def _assembled(bits: int, num: int, den: int):
    schema, low_bits = _schema(SETS), _low_bits(bits)

    def run(t: pa.Table) -> pa.Table:
        at = next(i for i, s in enumerate(t["sizes"]) if s.is_valid)
        info = {c: t[c][at].as_py() for c in _INFO}
        docs, counts = np.frombuffer(info["docs"], "<u4").astype(np.int64), _counts(t)
        chunk = np.repeat(np.tile(np.arange(CHUNKS), len(t)), counts)
        bucket = np.repeat(np.maximum(t["bucket"].to_numpy(), 0), counts.reshape(-1, CHUNKS).sum(1)).astype(_U)
        ident = _identities(t) | bucket << _U(low_bits)
        place = np.frombuffer(b"".join(t["place"].to_pylist()), np.uint8) + (np.cumsum(docs) - docs)[chunk]
        df = np.frombuffer(b"".join(t["df"].to_pylist()), "<u4")
        octave = np.frexp(df.astype(np.float64))[1].astype(_U)  # rare first: by powers of two of the frequency, then by shingle
        key = octave << _U(KEY_BITS) | ident
        order = np.lexsort((key, place))
        key, cut = key[order], np.searchsorted(place[order], np.arange(docs.sum() + 1))
        ids, nulls, n, reps = np.frombuffer(info["doc_ids"], "<i8"), info["nulls"], np.frombuffer(info["sizes"], "<i8").tolist(), info["reps"]
        keys: list[bytes | None] = []
        for i, size in enumerate(n):
            lone = size - int(cut[i + 1] - cut[i])
            keys.append(key[cut[i] : cut[i + 1]].tobytes() if reps[i] and size and lone < least_prefix(size, num, den) else None)
        sigs = [info["sigs"][16 * i : 16 * i + 16] for i in range(len(n))]
        return pa.Table.from_pydict({"doc_id": [None if z else int(i) for i, z in zip(ids, nulls, strict=True)], "n": n, "sig": sigs, "keys": keys}, schema=schema)

    return run


def _prefix_rows(num: int, den: int):
    """(key, low, high, a, b) of prefix shingles: classes of a batch that share one and whose sizes follow on each other within
    num / den are linked at once by rows (a, b) without a key, and the first, a, stands for all from size low to size high."""
    schema = _schema(_NEAR)

    def run(batches):
        for b in batches:
            cid, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            keys = []
            for size, raw in zip(n.tolist(), b.column(2).to_pylist(), strict=True):
                k = np.frombuffer(raw, "<u8")
                keys.append(k[: least_prefix(size, num, den) - (size - len(k))])
            at = np.repeat(np.arange(len(cid)), list(map(len, keys)))
            key = np.concatenate(keys or [np.zeros(0, _U)])
            order = np.lexsort((cid[at], n[at], key))
            key, at = key[order], at[order]
            own, size = cid[at], n[at]
            head = np.concatenate([[True], (key[1:] != key[:-1]) | (num * size[1:] > den * size[:-1])])[: len(key)]
            lead = np.flatnonzero(head)
            last = np.append(lead[1:], len(key))[: len(lead)] - 1
            pairs = np.unique(np.stack([own[lead][np.cumsum(head) - 1][~head], own[~head]]), axis=1)
            rows = {"key": key[lead].astype(np.int64), "low": size[lead], "high": size[last], "a": own[lead], "b": own[lead]}
            yield pa.RecordBatch.from_pydict(rows, schema=schema)
            none = [None] * pairs.shape[1]
            yield pa.RecordBatch.from_pydict({"key": none, "low": none, "high": none, "a": pairs[0], "b": pairs[1]}, schema=schema)

    return run


def join_block(cid: np.ndarray, mult: np.ndarray, n: np.ndarray, keys: list[np.ndarray], side: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group: for each class the documents that it links with, and the place of its root in a spanning forest.

    side: 0 or 1 if only pairs of different sides are asked for, else all 0.
    """
    m = len(cid)
    cross = bool(side.any())
    order = np.lexsort((cid, n))
    cid, mult, n, side, keys = cid[order], mult[order], n[order], side[order], [keys[i] for i in order]
    size = np.array([len(k) for k in keys])
    lone = n - size
    owner = np.repeat(np.arange(m), size)
    flat = np.concatenate(keys) if m else np.zeros(0, _U)
    place = np.concatenate([np.arange(s) for s in size]) if m else np.zeros(0, np.int64)
    by = np.argsort(flat, kind="stable")
    flat_s, owner_s, place_s = flat[by], owner[by], place[by]
    prefix = n - (num * n + den - 1) // den + 1 - lone
    in_prefix = place_s < prefix[owner_s]
    pre_key, pre_owner, pre_place = flat_s[in_prefix], owner_s[in_prefix], place_s[in_prefix]
    # How many shingles of each class lie in each segment of the order: sets differ at least by the differences of these.
    pivots = flat_s[np.linspace(0, len(flat_s) - 1, SEGMENTS + 1).astype(int)[1:-1]] if len(flat_s) else flat_s
    seg = np.zeros((m, SEGMENTS + 1), np.int64)
    np.add.at(seg, (owner, np.searchsorted(pivots, flat, side="right")), 1)
    seg[:, SEGMENTS] = lone
    links, parent = np.zeros(m, np.int64), np.arange(m)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for y in range(m):
        k = keys[y][: max(0, int(prefix[y]))]
        lo, hi = np.searchsorted(pre_key, k, "left"), np.searchsorted(pre_key, k, "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        x = pre_owner[at]
        ok = (x < y) & (den * n[x] >= num * n[y])  # length
        if cross:
            ok &= side[x] != side[y]
        at, x, j = at[ok], x[ok], np.repeat(np.arange(len(k)), count)[ok]
        if not len(x):
            continue
        x, first = np.unique(x, return_index=True)  # the first shingle in common
        at, j = at[first], j[first]
        need = -(-num * (n[x] + n[y]) // (num + den))
        ok = 1 + np.minimum(n[x] - lone[x] - pre_place[at], n[y] - lone[y] - j) - 1 >= need  # positional
        x, need = x[ok], need[ok]
        ok = np.abs(seg[x] - seg[y]).sum(1) <= n[x] + n[y] - 2 * need  # suffix
        x, need = x[ok], need[ok]
        if not len(x):
            continue
        lo, hi = np.searchsorted(flat_s, keys[y], "left"), np.searchsorted(flat_s, keys[y], "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        both = np.bincount(owner_s[at], minlength=m)[x]
        x = x[den * both >= num * (n[x] + n[y] - both)]
        if len(x):
            links[y] += mult[x].sum()
            links[x] += mult[y]
            for i in {root(int(i)) for i in x} | {root(y)}:
                a, b = root(i), root(y)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(m)], np.int64)
    out_links, out_root = np.zeros(m, np.int64), np.zeros(m, np.int64)
    out_links[order], out_root[order] = links, order[roots] if m else roots
    return out_links, out_root


def _linked(num: int, den: int):
    schema = _schema(LINKS)

    def run(t: pa.Table) -> pa.Table:
        cid, mult, n, side = (t[c].to_numpy() for c in ("cid", "mult", "n", "side"))
        keys = [np.frombuffer(x, "<u8") for x in t["keys"].to_pylist()]
        links, root = join_block(cid, mult, n, keys, side, num, den)
        on = links > 0
        return pa.Table.from_arrays([pa.array(cid[on]), pa.array(links[on]), pa.array(cid[root[on]])], schema=schema)

    return run


def jaccard_components(docs: DataFrame, num: int = NUM, den: int = DEN, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for each row of docs, of which doc_id and text are read.

    Rows link if their shingle sets' intersection is at least num / den of their union. n_links counts the other
    rows that a row links with directly. Rows without a word link with nothing. Repeated rows and equal texts
    are of one class and link with each other. A row whose id is null joins its class, but a class of such rows only
    is compared with no other. An empty table gives no rows.
    """
    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(KEY_BITS - 32, max(0, (size // POSTING_BYTES // BUCKET_POSTINGS).bit_length()))
    posts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(_postings(bits, words), POSTS)
    shared = posts.groupBy("bucket").applyInArrow(_shared(), SHARED)
    sets = written(shared.groupBy("block").applyInArrow(_assembled(bits, num, den), SETS), "sets")

    classes = sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("cid"), F.count("*").alias("mult"))
    open_ = sets.where("keys is not null").groupBy("sig").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    reps = written(open_.join(classes, "sig").select("cid", "n", "keys", "mult"), "classes")

    rows = written(reps.select("cid", "n", "keys").mapInArrow(_prefix_rows(num, den), _NEAR), "prefixes")
    by_size = Window.partitionBy("key").orderBy("low", "a")
    before = F.max("high").over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    follows = rows.where("key is not null").select(F.lag("a").over(by_size).alias("a"), F.col("a").alias("b"), (F.col("low") * num <= before * den).alias("near_"))
    met = follows.where("near_").select("a", "b").unionByName(rows.where("key is null").select("a", "b"))
    clusters = components(met.where("a <> b").distinct())
    drop_written(rows)

    member = reps.join(clusters, reps["cid"] == clusters["id"]).select("cid", "n", "keys", "mult", F.col("component").alias("cluster"))
    blocks = clusters.groupBy(F.col("component").alias("cluster")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("rows"))
    groups = max(1, -(-clusters.count() // BLOCK))
    placed = member.join(blocks, "cluster").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    # Small clusters share groups; a large one has a group for each pair of its blocks.
    small = placed.where("blocks = 1").select((-1 - F.pmod(F.xxhash64("cluster"), F.lit(groups))).alias("g"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"), "cid", "n", "keys", "mult")
    large = placed.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(F.col("cluster").alias("g"), F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "cid", "n", "keys", "mult")
    found = written(small.unionByName(large).groupBy("g", "lo", "hi").applyInArrow(_linked(num, den), LINKS), "links")

    labels = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    full = classes.join(links, "cid", "left").join(labels, F.col("cid") == F.col("id"), "left").select("sig", "mult", F.coalesce("component", "cid").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    some = sets.where("n > 0").select("doc_id", "n", "sig").join(full, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("mult") - 1 + F.col("links")).alias("n_links"))
    none = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def _own_ids(docs: DataFrame) -> DataFrame | None:
    """(real_id_, text_hash_, own_id_) of the documents whose id is null or is that of different texts too, or None if there are none.

    Own ids lie above all others; ids near the end of a long leave no room for them.
    """
    keys = docs.select(F.col("doc_id").cast("long").alias("real_id_"), F.xxhash64("text").alias("text_hash_"))
    reused = keys.where("real_id_ is not null").groupBy("real_id_").agg(F.min("text_hash_").alias("lo_"), F.max("text_hash_").alias("hi_")).where("lo_ <> hi_").select("real_id_")
    odd = keys.where("real_id_ is null").unionByName(keys.join(reused, "real_id_", "left_semi")).distinct()
    top = keys.agg(F.max("real_id_")).first()[0]
    odd = written(odd.withColumn("own_id_", F.monotonically_increasing_id() + F.lit(max(0, (top or 0) + 1))), "own_ids")
    return None if odd.isEmpty() else odd


def keep_one(docs: DataFrame, num: int = NUM, den: int = DEN, words: int = WORDS, nameless: bool = False) -> DataFrame:
    """One row of docs, all columns, for each component: one with the least id. Rows without a word all stay.

    A row's document is its id and text: repeated rows are one, and rows that share an id but neither text nor
    links are of different components and stay. Rows with a null id come after all others: one stays if its component has
    no other rows and nameless is set; else rows with a null id go.
    """
    odd = _own_ids(docs if nameless else docs.where("doc_id is not null"))
    if odd is None:
        kept = jaccard_components(docs, num, den, words).where("doc_id = component_id").select("doc_id").distinct()
        return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    named = docs.withColumn("row_hash_", F.xxhash64("text")).join(odd, F.col("doc_id").eqNullSafe(F.col("real_id_")) & (F.col("row_hash_") == F.col("text_hash_")), "left").drop("real_id_", "row_hash_", "text_hash_")
    named = named.withColumn("own_id_", F.coalesce("own_id_", F.col("doc_id").cast("long")))
    found = jaccard_components(named.select(F.col("own_id_").alias("doc_id"), "text"), num, den, words).where("component_id is not null").select(F.col("doc_id").alias("own_id_"), "component_id").where("own_id_ is not null")
    found = found.join(odd.select("own_id_", "real_id_", F.lit(True).alias("odd_")), "own_id_", "left").withColumn("real_id_", F.when(F.col("odd_"), F.col("real_id_")).otherwise(F.col("own_id_")))
    least = F.min(F.struct(F.col("real_id_").isNull().alias("null_"), "real_id_", "own_id_"))
    kept = found.groupBy("component_id").agg(least["own_id_"].alias("own_id_")).select("own_id_")
    return named.join(kept, "own_id_", "left_semi").dropDuplicates(["own_id_"]).select(*docs.columns)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op6_ngram_jaccard_join": op6_ngram_jaccard_join}
#: The same over all pairs that share a shingle, for the SQL check.
SQL: dict[str, str] = {
    "op6_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY 1), d AS (SELECT x, count(*) AS links FROM e GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, coalesce(links, 0) AS n_links
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = doc_id LEFT JOIN d ON d.x = doc_id"""
}
