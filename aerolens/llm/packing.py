"""Best-fit packing of documents into sequences of a fixed number of tokens.

Lengths are integers of at most the capacity, so an instance is a histogram of at most that many
counts, however many documents there are. Martello-Toth dominance fixes sets that provably dominate
all others with the same largest item, the rest is packed best fit, largest first, and the result is
a short list of placements by length and rank. Ranks are counted in salted buckets, so one length
that a third of all documents have is spread over many tasks.
"""

from __future__ import annotations

import bisect
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table, written
from .tokens import encoder, vocabulary

CAPACITY = 1024
END_ID = 2
#: Rows that share a length and are ranked in one task, about.
RANK_ROWS = 2000

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be short of the capacity."""
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document's ids with the end id; null texts are empty."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        enc = encoder(vocab)
        for b in batches:
            out = []
            for doc_id, own in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)), strict=True):
                ids = own.tobytes() + end
                for i, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id, i, s, n, zlib.crc32(memoryview(ids)[4 * s : 4 * (s + n)])))
            yield _batch(out)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _batch(rows: list[tuple]):
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=PIECES.names)


@dataclass
class Placement:
    """Items of `length` with rank lo <= rank < hi go `each` to a sequence, from sequence `first`, at `offset`."""

    length: int
    lo: int
    hi: int
    each: int
    first: int
    offset: int


class _Packer:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.c = capacity
        self.left = {s: n for s, n in counts.items() if n}
        self.next_rank = dict.fromkeys(self.left, 0)
        self.sizes = sorted(self.left)
        self.placed: list[Placement] = []
        self.bins = 0

    def take(self, size: int, n: int, each: int, first: int, offset: int) -> None:
        lo = self.next_rank[size]
        self.placed.append(Placement(size, lo, lo + n, each, first, offset))
        self.next_rank[size] = lo + n
        self.left[size] -= n
        if not self.left[size]:
            self.sizes.remove(size)

    def fix(self, items: list[int], times: int) -> None:
        """Close `times` sequences that hold these items."""
        at = 0
        for s in items:
            self.take(s, times, 1, self.bins, at)
            at += s
        self.bins += times

    def largest_fit(self, room: int, without: int | None = None) -> int | None:
        """The largest length that fits, with one item of `without` already in use."""
        i = bisect.bisect_right(self.sizes, room) - 1
        if i >= 0 and self.sizes[i] == without and self.left[without] == 1:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def two_most(self, room: int, j: int) -> int:
        """The largest sum of two or more further items that fits beside j; 0 if none does.

        Any sum that two lengths reach, or whose smallest two fit with a third, is over-counted at most:
        an item may count twice. That can only hide a dominance, never claim a false one.
        """
        best = 0
        small = self.sizes[: bisect.bisect_right(self.sizes, room)]
        if not small or 2 * small[0] > room:
            return 0
        if 3 * small[0] <= room:
            return room
        hi = len(small) - 1
        for a in small:
            while hi >= 0 and a + small[hi] > room:
                hi -= 1
            if hi < 0:
                break
            best = max(best, a + small[hi])
        return best

    def reduce(self) -> None:
        """Martello-Toth: fix {j} if nothing fits beside it, and {j, k} if k, the largest that fits,
        fills the rest or outweighs all sets of more items that fit."""
        changed = True
        while changed:
            changed = False
            for j in sorted(self.sizes, reverse=True):
                while self.left.get(j):
                    room = self.c - j
                    k = self.largest_fit(room, j)
                    if k is None:
                        self.fix([j], 1 if self.sizes[0] <= room else self.left[j])
                    elif k == room or self.two_most(room, j) <= k:
                        self.fix([j, k], self.left[j] // 2 if j == k else min(self.left[j], self.left[k]))
                    else:
                        break
                    changed = True

    def best_fit(self) -> None:
        """The rest, largest first, each item into the fullest sequence that has room."""
        rooms: list[int] = []
        groups: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in groups:
                    bisect.insort(rooms, room)
                groups.setdefault(room, []).append((first, n))

        while self.sizes:
            s = self.sizes[-1]
            n = self.left[s]
            i = bisect.bisect_left(rooms, s)
            if i < len(rooms):
                room = rooms[i]
                first, have = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                room, first, have = self.c, self.bins, -(-n // (self.c // s))
                self.bins += have
            each = room // s
            whole = min(have, n // each)
            if whole:
                self.take(s, whole * each, each, first, self.c - room)
                put(room - each * s, first, whole)
            else:
                self.take(s, n, n, first, self.c - room)
                put(room - n * s, first, 1)
                whole = 1
            put(room, first + whole, have - whole)


def placements(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int]:
    """Where the items of a histogram go, and how many sequences that takes.

    Ties are by rank; an empty histogram takes none.
    """
    p = _Packer(counts, capacity)
    p.reduce()
    p.best_fit()
    return p.placed, p.bins


def salts_of(counts: dict[int, int], capacity: int) -> list[int]:
    """Parts in which the pieces of each length are ranked: of RANK_ROWS pieces, or, if that is more, as many parts as each has pieces."""
    return [max(1, math.ceil(counts.get(s, 0) / max(RANK_ROWS, counts.get(s, 0) ** 0.5))) for s in range(capacity + 1)]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces that have `length`. Pieces must be cheap to read twice.

    Repeated rows are packed each by itself; an empty table stays empty.
    """
    spark = pieces.sparkSession
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    placed, _ = placements(counts, capacity)
    salts = salts_of(counts, capacity)
    keyed = pieces.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.array(*map(F.lit, salts))[F.col("length").cast("int")]))
    before = Window.partitionBy("length").orderBy("salt_").rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("length", "salt_").agg(F.count("*").alias("n_")).select("length", "salt_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    within = Window.partitionBy("length", "salt_").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.join(base, ["length", "salt_"]).withColumn("rank_", F.col("base_") + F.row_number().over(within) - 1)
    rows = [(p.length, p.lo, p.hi, p.each, p.first, p.offset) for p in placed]
    plan = spark.createDataFrame(pd.DataFrame(rows, columns=["length", "lo_", "hi_", "each_", "first_", "off_"]).astype("int64"), "length long, lo_ long, hi_ long, each_ long, first_ long, off_ long")
    # The placements follow from the capacity, not from the number of documents: safe to broadcast.
    at = F.col("rank_") - F.col("lo_")
    return (
        ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("rank_") >= F.col("lo_")) & (F.col("rank_") < F.col("hi_")))
        .drop(plan["length"])
        .withColumn("sequence_id", F.expr("first_ + (rank_ - lo_) div each_"))
        .withColumn("offset", F.col("off_") + (at % F.col("each_")) * F.col("length"))
        .drop("salt_", "base_", "rank_", "lo_", "hi_", "each_", "first_", "off_")
    )


def pack_documents(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with the sequence and place of each. Other columns of docs are not read."""
    return pack(written(token_pieces(docs, vocab or vocabulary("byte_bpe_50k.json"), capacity, end_id), "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
SQL: dict[str, str] = {}
