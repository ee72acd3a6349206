"""Language identification by compression with a zstandard raw-content dictionary for each language.

A text is reduced to lower-case letters and single spaces and cut into pieces. For each language, each piece is
compressed behind a short opening in that language, with the dictionary in reach, and the smallest sum names the
language: sizes and their differences both grow with the text, so the margin doesn't hang on its length. The
opening makes short texts compressible at all. A narrow margin is a rejection.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import table

#: The sample that a dictionary is made of: so many labelled documents of each language, whole. Their passages of so
#: many characters, in the order of a hash, fill the dictionary.
SAMPLE_DOCS = 200
PASSAGE_CHARS = 1024
DICTIONARY_BYTES = 262_144
#: Bytes of the sample that are the opening.
OPENING_BYTES = 500
#: Bytes of a piece at most. In a longer one the text's own words soon serve as well as the dictionary's.
PIECE_BYTES = 4096
LEVEL = 9
#: A smallest size that is less than this share below the second is too close to call.
MARGIN = 0.005
FOLDS = 5
UNKNOWN = "und"
#: Bytes of size difference that make a language e times less likely, for the score.
SCORE_BYTES = 4.0
_OTHER = re.compile(r"[\W\d_]+")

OUT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def letters(text: str) -> bytes:
    """Lower-case letters with a space for each run of other characters; empty if there is no letter."""
    out = _OTHER.sub(" ", text.lower()).strip()
    return out.encode("utf-8", "replace") if any(map(str.isalpha, out)) else b""


def pieces(data: bytes) -> list[bytes]:
    """Data in as few pieces of about equal length as PIECE_BYTES allows."""
    size = max(1, -(-len(data) // max(1, -(-len(data) // PIECE_BYTES))))
    return [data[i : i + size] for i in range(0, len(data), size)]


def fit(docs: DataFrame, fold: int = 0, folds: int = FOLDS) -> list[tuple[str, bytes]]:
    """Languages, the most common first, with their sample, from labelled documents outside the fold.

    The documents are the SAMPLE_DOCS of each language with the smallest hashes; of their passages, those with the smallest
    hashes are taken, as many as a dictionary and an opening hold. How common a language is counts all documents. The
    size of the result depends on the number of languages only.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != fold))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    w = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "lang"), "doc_id")
    chosen = known.select("lang", "doc_id", F.row_number().over(w).alias("rank_")).where(F.col("rank_") <= SAMPLE_DOCS).select("lang", "doc_id").distinct()
    sample = known.select("lang", "doc_id", "text").join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")  # at most SAMPLE_DOCS ids a language
    passages = sample.select("lang", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PASSAGE_CHARS}}}"), F.lit(0))).alias("at_", "text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "at_"), "doc_id", "at_", "text")
    most = 2 * (DICTIONARY_BYTES + OPENING_BYTES) // PASSAGE_CHARS  # not all of a passage may be letters
    rows = passages.withColumn("rank_", F.row_number().over(order)).where(F.col("rank_") <= most).select("lang", "rank_", "text").collect()
    out = []
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        own = sorted((r["rank_"], r["text"]) for r in rows if r["lang"] == lang)
        out.append((lang, b" ".join(letters(text) for _, text in own)[: DICTIONARY_BYTES + OPENING_BYTES]))
    return out


class Classifier:
    def __init__(self, model: list[tuple[str, bytes]]):
        import zstandard as z

        self.langs: list[tuple] = []
        for lang, sample in model:
            opening, data = sample[:OPENING_BYTES] + b" ", sample[OPENING_BYTES:]
            p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE_BYTES, dict_size=len(data), write_content_size=False)
            d = z.ZstdCompressionDict(data or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=p)
            c = z.ZstdCompressor(compression_params=p, dict_data=d)
            self.langs.append((lang, c, opening, len(c.compress(opening))))

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected). Equal sizes go to the more common language.

        No text, no letter or no model: unknown, 0, 0, rejected.
        """
        data = letters(text or "")
        if not data or not self.langs:
            return UNKNOWN, 0.0, 0.0, True
        cut = pieces(data)
        sizes = [(float(sum(len(c.compress(opening + x)) - n for x in cut)), i) for i, (_, c, opening, n) in enumerate(self.langs)]
        sizes.sort()
        best = sizes[0][0]
        margin = (sizes[1][0] - best) / max(1.0, sizes[1][0]) if len(sizes) > 1 else 1.0
        score = 1 / sum(math.exp(-min(700.0, (s - best) / SCORE_BYTES)) for s, _ in sizes)
        return self.langs[sizes[0][1]][0], score, margin, margin < MARGIN


def identify(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected for each row of docs, of whose columns only doc_id and text are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()

    def run(batches):
        import pyarrow as pa

        c = Classifier(shared.value)
        for b in batches:
            got = [c.predict(t.as_py()) for t in b.column(1)]
            cols = list(zip(*got, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], names=OUT.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, OUT)


def keep_identified(docs: DataFrame, model: list[tuple[str, bytes]]) -> DataFrame:
    """The rows of docs, all columns, whose language is told without doubt."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        c = Classifier(shared.value)
        for b in batches:
            yield b.filter(pa.array([not c.predict(t.as_py())[3] for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


QUERIES = {"op5_language_id": op5_language_id}
SQL: dict[str, str] = {}
