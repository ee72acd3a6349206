"""Document fingerprints by consistent weighted sampling.

Terms are five-word shingles weighted by their count. For each sample, a term draws two gamma variables
and a uniform one from its hash, and the term with the least value represents the document; two documents
agree in a sample with a probability equal to the generalised Jaccard similarity of their weights. All of
it is DataFrame operations: texts are dealt once, by ranges of doc_id, and the window that finds the next
document, the aggregate over terms and the comparison all stay in that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, SPACE_CHARS, ascii_lower, table, written

SAMPLES = 32
WORDS = 5
#: Terms whose lower bound is above this many times the mean least value can't be the least, but for one sample in e^20. They are
#: ranked by that bound behind all others, so each sample has a least term whatever the bound.
REACH = 20.0
BEHIND = 1e9
#: Documents of a range that are sorted together, about, and the most ranges. Ranges' ends are broadcast: 16 bytes each.
RANGE_ROWS = 256
MOST_RANGES = 200_000
#: A range is too full with so many times the rows of an even one, and is parted so many times at most.
FULL, LEVELS = 4, 4
COARSE = 64


def with_terms(df: DataFrame, text: str, words: int = WORDS) -> DataFrame:
    """Replace the column text by terms_: sorted shingle hashes."""
    t = F.btrim(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE_CHARS))
    df = df.withColumn("words_", F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE))).drop(text)
    df = df.withColumn("hashes_", F.transform("words_", lambda x: F.xxhash64(x))).drop("words_")
    n = F.size("hashes_")
    many = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(F.col("hashes_"), i + j) for j in range(words)]))
    few = F.array(F.xxhash64("hashes_"))
    return df.withColumn("terms_", F.sort_array(F.when(n >= words, many).when(n > 0, few).otherwise(F.array().cast("array<bigint>")))).drop("hashes_")


def exploded(df: DataFrame) -> DataFrame:
    """A row for each distinct term_ of terms_, with its weight_ and the total_ weight; a row of nulls if there is none."""
    keep = [c for c in df.columns if c != "terms_"]
    rows = df.select(*keep, "terms_", F.posexplode_outer("terms_").alias("pos_", "term_"))
    at = lambda i: F.get("terms_", i)
    pos, term = F.col("pos_"), F.col("term_")
    last = F.coalesce(at(pos + 1) != term, F.lit(True))
    long_run = pos + 2 - F.array_position("terms_", term)
    weight = (
        F.when(pos.isNull(), F.lit(None))
        .when((pos == 0) | (at(pos - 1) != term), 1)
        .when(pos < 64, long_run)
        .when(at(pos - 63) != term, 65 - F.array_position(F.slice("terms_", pos - 62, 64), term))
        .otherwise(long_run)
    )
    return rows.where(last).select(*keep, term, weight.cast("double").alias("weight_"), F.size("terms_").cast("double").alias("total_"))


def sample(k: int, term: Column, weight: Column, total: Column) -> Column:
    """ln a of sample k, or BEHIND and more for a term that can't be the least of its document; null for no term."""
    a, b = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    unit = lambda x: (x.cast("double") + 1) / float(2**32)
    high, low = (lambda x: unit(F.shiftrightunsigned(x, 32))), (lambda x: unit(x.bitwiseAND(F.lit(2**32 - 1))))
    uc, ur = high(a) * low(a), high(b) * low(b)
    r = F.greatest(-F.log(ur), F.lit(1e-300))
    beta = F.shiftrightunsigned(F.xxhash64(term, F.lit(-1 - k)), 11).cast("double") / float(2**53)
    t = F.floor(F.log(weight) / r + beta)
    bound = (1 - uc) * ur * total / weight
    return F.when(bound < REACH, F.log(-F.log(uc)) - r * (t - beta) - r).otherwise(BEHIND + bound)


def sampled(rows: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and fp_, an array of one integer for each sample, from exploded rows. Empty texts all get the same."""
    least = [F.min(sample(k, F.col("term_"), F.col("weight_"), F.col("total_"))).alias(f"m{k}_") for k in range(samples)]
    return rows.groupBy(*keys).agg(*least).select(*keys, F.array(*[F.hash(f"m{k}_") for k in range(samples)]).alias("fp_"))


def fingerprint_text(fp: Column) -> Column:
    """Hexadecimal, eight digits a sample."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(2**32 - 1))), 8, "0")), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples in which two fingerprints agree."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / float(samples)


def fingerprints(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """doc_id and fp_ of every row of (doc_id, text). Documents with equal texts have equal fingerprints, null counts as empty."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), "doc_id", "text")
    return sampled(exploded(with_terms(rows, "text", words)), ["row_", "doc_id"], samples).drop("row_")


def _ranges(docs: DataFrame, range_rows: int = RANGE_ROWS) -> tuple[Column, int, int]:
    """A range number for each doc_id, rising with it, how many there are, and of how many rows: equal counts coarsely, equal widths within."""
    steps = [i / COARSE for i in range(1, COARSE)]
    s = docs.select(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.percentile_approx("doc_id", steps, 10_000).alias("q")).first()
    if s["lo"] is None:
        return F.lit(0), 1, s["n"]
    ends = sorted({*s["q"], s["hi"]})
    each = max(1, min(MOST_RANGES, s["n"] // range_rows) // len(ends))
    lows = [s["lo"] - 1, *ends[:-1]]

    def pick(i: int, j: int) -> Column:
        if j - i == 1:
            part = F.floor((F.col("doc_id").cast("double") - float(lows[i]) - 1) * each / max(1.0, float(ends[i]) - float(lows[i])))
            return F.lit(i * each) + F.least(F.greatest(part, F.lit(0)), F.lit(each - 1))
        m = (i + j) // 2
        return F.when(F.col("doc_id") <= ends[m - 1], pick(i, m)).otherwise(pick(m, j))

    return F.when(F.col("doc_id").isNull(), 0).otherwise(pick(0, len(ends))).cast("int"), len(ends) * each, s["n"]


def ranged(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs with range_, a number that rises with doc_id and that about range_rows rows share, whatever gaps the ids have.

    Ranges of quantiles and equal widths are counted first; those that gaps made too full are parted at their own
    quantiles, and once more where that wasn't enough. Rows of one id always share a range.
    """
    number, ranges, n = _ranges(docs, range_rows)
    out, even = docs.withColumn("range_", number.cast("long")), max(range_rows, n / ranges)
    for _ in range(LEVELS):
        cuts = F.percentile_approx("doc_id", F.array(*[F.lit(i / COARSE) for i in range(1, COARSE)]), F.lit(20 * COARSE))
        some = out.select("doc_id", "range_").groupBy("range_").agg(F.count("*").alias("n_"), F.min("doc_id").alias("low_"), F.max("doc_id").alias("top_"), cuts.alias("cuts_"))
        each = F.greatest(F.lit(1), F.floor(COARSE * even / F.col("n_")).cast("int"))  # no more parts than the rows are worth
        full = some.where((F.col("n_") > FULL * even) & (F.col("low_") < F.col("top_"))).select(F.col("range_").alias("r_"), F.filter("cuts_", lambda c, i: (c < F.col("top_")) & ((i + 1) % each == 0)).alias("cuts_"))
        full = written(full, "ranges")
        if full.isEmpty():
            break
        # At most MOST_RANGES / FULL rows, of less than COARSE ids, and together no more ids than twice the ranges: safe to broadcast.
        part = F.when(F.col("r_").isNull() | F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter("cuts_", lambda c: c < F.col("doc_id"))))
        out = out.join(F.broadcast(full), F.col("range_") == F.col("r_"), "left").withColumn("range_", F.col("range_") * COARSE + part).drop("r_", "cuts_")
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """Each row of (doc_id, text) with next_, the text of the next row in descending doc_id, the first after the last.

    Ties go by the texts' hashes and null ids come last. range_ and row_ name a row, and rows are clustered by
    range_. The highest row of the range below stands in each range as a guest, after its own rows.
    """
    rows = ranged(docs.select("doc_id", "text"))
    ends = rows.groupBy("range_").agg(F.max("doc_id").alias("end_"))
    order, all_ = Window.orderBy("range_"), Window.partitionBy()
    guests = ends.select(F.when(F.row_number().over(order) == 1, F.max("end_").over(all_)).otherwise(F.lag("end_").over(order)).alias("guest_"), F.col("range_").alias("to_"))
    # At most MOST_RANGES rows of 16 bytes, and as many again for each time that full ranges were parted: safe to broadcast.
    extra = docs.select("doc_id", "text").join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("guest_"))).select("doc_id", "text", F.col("to_").alias("range_"), F.lit(1).alias("is_guest_"))
    both = rows.select("doc_id", "text", "range_", F.lit(0).alias("is_guest_")).unionByName(extra).withColumn("hash_", F.xxhash64("text"))
    w = Window.partitionBy("range_").orderBy("is_guest_", F.col("doc_id").desc_nulls_last(), "hash_")
    return both.withColumn("next_", F.lead("text").over(w)).withColumn("row_", F.row_number().over(w))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp_, edited_fp_, near_edited, near_next of every row of (doc_id, text).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the
    next text. A single row is its own next; an empty table gives no rows; a null text is empty.
    """
    text, nxt = F.coalesce("text", F.lit("")), F.coalesce("next_", F.lit(""))
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), n - half), F.substring(nxt, F.lit(1), half))
    rows = with_next(docs).select("range_", "row_", "is_guest_", "doc_id", n.cast("long").alias("n_chars"), text.alias("text_"), edited.alias("edited_"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited_", 256))
    variant = F.when(F.col("is_guest_") == 0, F.array(F.struct(F.lit(0).alias("which_"), F.col("text_").alias("t_")), F.struct(F.lit(1).alias("which_"), F.col("edited_").alias("t_")))).otherwise(F.array(F.struct(F.lit(0).alias("which_"), F.col("text_").alias("t_"))))
    keys = ["range_", "row_", "is_guest_", "doc_id", "n_chars", "edited_sha256"]
    both = rows.select(*keys, F.explode(variant).alias("v_")).select(*keys, "v_.which_", "v_.t_")
    fp = sampled(exploded(with_terms(both, "t_", words)), [*keys, "which_"], samples)
    w = Window.partitionBy("range_").orderBy("row_", "which_")
    out = fp.withColumn("edited_fp_", F.lead("fp_", 1).over(w)).withColumn("next_fp_", F.lead("fp_", 2).over(w)).where("which_ = 0 and is_guest_ = 0")
    return out.select("doc_id", "n_chars", "edited_sha256", "fp_", "edited_fp_", likeness(F.col("fp_"), F.col("edited_fp_"), samples).alias("near_edited"), likeness(F.col("fp_"), F.col("next_fp_"), samples).alias("near_next"))


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprint_text(F.col("fp_")).alias("fingerprint"), fingerprint_text(F.col("edited_fp_")).alias("edited_fingerprint"), "near_edited", "near_next")


QUERIES = {"op1_document_fingerprints": op1_document_fingerprints}
SQL: dict[str, str] = {}
