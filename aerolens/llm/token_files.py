"""Token ids in the Arrow file format: fixed-size-list batches of equal-length sequences and masks.

Documents are dealt by ranges of doc_id, so that each task writes one file of a contiguous run of the
global id stream. A file holds record batches of one block of sequences each; both columns are
fixed-size lists, so sequence i of a block is a slice of one buffer, and a memory-mapped file is read
without copying. The last sequence of a file is padded, and its mask tells so. The places of the
documents are a second Arrow file beside it. Files are written under a name of the attempt and then
renamed, so that a repeated or speculative task leaves one whole file.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import new_path, table, written
from .tokens import encoder, vocabulary

SEQUENCE = 2048
#: Sequences of a record batch.
BLOCK = 256
END_ID = 1
#: Bytes of text that one file takes, about.
FILE_BYTES = 24_000_000

FILES = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())])
ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class SequenceWriter:
    """Writes ids as blocks of `length` ids and masks; holds one block at most."""

    def __init__(self, fs, path: str, kind: str, length: int = SEQUENCE, block: int = BLOCK):
        self.length, self.block, self.kind = length, block, np.dtype(kind)
        item = pa.uint16() if self.kind.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([pa.field("ids", pa.list_(pa.field("item", item, False), length), False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), length), False)])
        self.sink = fs.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = self.total = 0

    def write(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n += len(ids)
        self.total += len(ids)
        if self.n >= self.length * self.block:
            flat = np.concatenate(self.held)
            full = self.length * self.block
            while len(flat) >= full:
                self._batch(flat[:full], full)
                flat = flat[full:]
            self.held, self.n = [flat], len(flat)

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.zeros(len(flat), bool)
        mask[:real] = True
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((flat, mask), self.schema, strict=True)]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._batch(np.concatenate([flat, np.zeros(-len(flat) % self.length, self.kind)]), len(flat))
        self.out.close()
        self.sink.close()


class SequenceFile:
    """Random access to the sequences of one file; local files are memory-mapped, so slices copy nothing."""

    def __init__(self, path: str):
        fs, at = _fs(path)
        self.source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.last: tuple[int, pa.RecordBatch] | None = None
        self.block = self.file.get_batch(0).num_rows if self.file.num_record_batches else BLOCK

    def _get(self, i: int) -> pa.RecordBatch:
        if self.last is None or self.last[0] != i:
            self.last = i, self.file.get_batch(i)
        return self.last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i."""
        b, k = self._get(i // self.block), i % self.block
        s = slice(k * self.length, (k + 1) * self.length)
        return b.column(0).values.to_numpy()[s], b.column(1).values.to_numpy(zero_copy_only=False)[s]

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids of the stream from place `start`; a view unless they span blocks."""
        size, out = self.block * self.length, []
        while n > 0:
            flat = self._get(start // size).column(0).values.to_numpy()
            got = flat[start % size : start % size + n]
            out.append(got)
            start, n = start + len(got), n - len(got)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, self.file.schema.field("ids").type.value_type.to_pandas_dtype())


def write_tokens(docs: DataFrame, vocab: str, folder: str, kind: str = "uint16", length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents, in order of doc_id (null first, ties by text), under folder.

    Returns a written table with a row for each file: part, name, n_docs, n_tokens; the files' order is that of part. Null texts
    are empty, so each document has its end id at least; an empty table gives no file. A `kind` that does not hold every id is an error.
    """
    spark = docs.sparkSession
    end = np.array([end_id], "<u4")

    def run(batches):
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), f"part-{TaskContext.get().partitionId():06d}"
        enc, fs, out, n_docs = None, None, None, 0
        rows: list[tuple[int, int, int]] = []
        own = uuid.uuid4().hex
        for b in batches:
            if out is None and b.num_rows:
                enc = encoder(vocab)
                fs, at = _fs(folder)
                fs.create_dir(at)
                out = SequenceWriter(fs, f"{at}/_{name}-{own}", kind, length)
                if max(enc.tok.get_vocab_size(), end_id + 1) > 1 << 8 * out.kind.itemsize:
                    raise ValueError(f"{kind} does not hold every id")
            for doc_id, of in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1)) if b.num_rows else [], strict=True):
                ids = np.concatenate([of, end])
                rows.append((doc_id, out.total, len(ids)))
                out.write(ids)
                n_docs += 1
        if out is None:
            return
        out.close()
        places = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "start": pa.array([r[1] for r in rows], pa.int64()), "n_tokens": pa.array([r[2] for r in rows], pa.int64())})
        with fs.open_output_stream(f"{at}/_{name}-{own}.docs") as sink, pa.ipc.new_file(sink, places.schema) as w:
            w.write_table(places)
        for end_ in (".docs", ""):
            fs.move(f"{at}/_{name}-{own}{end_}", f"{at}/{name}.arrow{end_}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()), pa.array([out.total], pa.int64())], names=FILES.names)

    size = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-size // FILE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")) if size > 4 * FILE_BYTES else 1)
    dealt = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(dealt.mapInArrow(run, FILES), "files")


def read_tokens(folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start in the whole stream, n_tokens and CRC-32 of the ids of each document, from the files, a task each."""
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a file
    listed = files.select("name", F.coalesce(before, F.lit(0)).alias("base")).repartition(max(1, files.count()))

    def run(batches):
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = SequenceFile(f"{folder}/{name}.arrow")
                fs, at = _fs(folder)
                with fs.open_input_file(f"{at}/{name}.arrow.docs") as source:
                    places = pa.ipc.open_file(source).read_all()
                start, n = places["start"].to_numpy(), places["n_tokens"].to_numpy()
                crc = [zlib.crc32(np.ascontiguousarray(f.ids(s, k), "<u4")) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([places["doc_id"].combine_chunks(), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], names=ROWS.names)

    return listed.mapInArrow(run, ROWS)


def op8_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    files = write_tokens(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), folder)
    return read_tokens(folder, files)


QUERIES = {"op8_token_binary_output": op8_token_binary_output}
SQL: dict[str, str] = {}
