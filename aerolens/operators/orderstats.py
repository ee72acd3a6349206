"""Exact quantiles by key without all values of a key in one task.

Equal values of a key are counted first, by key and value, so the shuffle is even however many rows a key has. Ranks
are then looked for among weighted distinct values: those of a key are cut at splitters from a sketch, the pieces are counted
exactly, and only the pieces that hold a wanted rank are cut again, until each has few enough values to be sorted in one go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import drop_written, written

#: Distinct values that are sorted together at most, and pieces that a larger set is cut into.
SORTED, PIECES = 100_000, 64
_SET = ["k_", "path_"]


def _narrowed(values: DataFrame, wanted: DataFrame, most: int, pieces: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cut each set of more than `most` values: (the values of the pieces that hold a wanted rank, the ranks within them, all pieces).

    values: (k_, path_, v_, c_), one row a distinct value of a set (k_, path_); wanted: (k_, path_, want_, rank_).
    """
    big = values.groupBy(*_SET).count().where(F.col("count") > most).select(*_SET)
    at = F.percentile_approx("v_", F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), F.lit(50 * pieces))
    cuts = values.join(big, _SET, "left_semi").groupBy(*_SET).agg(at.alias("cuts_"), F.max("v_").alias("top_"))
    # The greatest value is no splitter, so a cut always parts a set of two values or more.
    cuts = cuts.select(*_SET, F.filter("cuts_", lambda s: s < F.col("top_")).alias("cuts_"))
    number = F.size(F.filter("cuts_", lambda s: s < F.col("v_"))).cast("string")
    cut = values.join(cuts, _SET, "left").withColumn("to_", F.when(F.col("cuts_").isNull(), F.col("path_")).otherwise(F.concat_ws(".", "path_", number)))
    cut = written(cut.select(*_SET, "to_", "v_", "c_"), "cut")
    parts = cut.groupBy(*_SET, "to_").agg(F.sum("c_").alias("n_"), F.min("v_").alias("low_"))
    upto = Window.partitionBy(*_SET).orderBy("low_").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("before_", F.sum("n_").over(upto) - F.col("n_"))
    hit = wanted.join(parts, _SET).where("rank_ >= before_ and rank_ < before_ + n_")
    hit = written(hit.select("k_", F.col("to_").alias("path_"), "want_", (F.col("rank_") - F.col("before_")).alias("rank_")), "wanted")
    left = cut.select("k_", F.col("to_").alias("path_"), "v_", "c_").join(hit.select(*_SET).distinct(), _SET, "left_semi")
    return written(left, "left"), hit, cut


def quantiles(df: DataFrame, keys: list[str], value: Column, shares: list[float], most: int = SORTED, pieces: int = PIECES) -> DataFrame:
    """(keys, n, q) of each key: the number of values that are not null, and the interpolated quantiles in order of shares.

    Exact, as if all values of a key were sorted. A null key is a key; a key without a value has n 0 and q null; no rows, no
    keys. No set of more than `most` distinct values is ever sorted in one task.
    """
    counted = written(df.select(F.struct(*keys).alias("k_"), value.cast("double").alias("v_")).groupBy("k_", "v_").agg(F.count("*").alias("c_")), "values")
    there = F.col("v_").isNotNull()
    totals = counted.groupBy("k_").agg(F.coalesce(F.sum(F.when(there, F.col("c_"))), F.lit(0)).alias("n"), F.count("v_").alias("size_"))
    at = lambda s: (F.col("n") - 1) * F.lit(float(s))
    ends = [F.struct(F.lit(2 * i + end).alias("want_"), (F.ceil if end else F.floor)(at(s)).alias("rank_")) for i, s in enumerate(shares) for end in (0, 1)]
    wanted = totals.where("n > 0").select("k_", F.lit("").alias("path_"), F.explode(F.array(*ends)).alias("e_")).select(*_SET, "e_.want_", "e_.rank_")
    left, made = counted.where(there).select("k_", F.lit("").alias("path_"), "v_", "c_"), [counted]
    largest = totals.agg(F.max("size_")).first()[0] or 0
    while largest > most:
        left, wanted, cut = _narrowed(left, wanted, most, pieces)
        made += [left, wanted, cut]
        largest = left.groupBy(*_SET).count().agg(F.max("count")).first()[0] or 0
    upto = Window.partitionBy(*_SET).orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    ranks = wanted.groupBy(*_SET).agg(F.collect_list(F.struct("want_", "rank_")).alias("w_"))  # two a share at most
    met = left.withColumn("upto_", F.sum("c_").over(upto)).join(ranks, _SET)
    inside = lambda w: (w["rank_"] < F.col("upto_")) & (w["rank_"] >= F.col("upto_") - F.col("c_"))
    found = met.select("k_", "v_", F.explode(F.filter("w_", inside)).alias("w_")).groupBy("k_").agg(F.map_from_entries(F.collect_list(F.struct("w_.want_", "v_"))).alias("m_"))

    def between(i: int, s: float) -> Column:
        low, high = F.col("m_")[2 * i], F.col("m_")[2 * i + 1]
        return low + (high - low) * (at(s) - F.floor(at(s)))

    q = F.when(F.col("n") > 0, F.array(*[between(i, s) for i, s in enumerate(shares)]))
    out = written(totals.join(found, "k_", "left").select("k_.*", F.col("n").cast("long").alias("n"), q.alias("q")), "quantiles")
    drop_written(*made)
    return out
