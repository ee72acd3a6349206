"""Mixing sources to target weights: complete epochs first, then an Efraimidis-Spirakis sample for the rest.

All of it is DataFrame operations. Each document draws an exponential key scaled by its quality weight;
within a source the smallest keys are taken until their words reach the budget. Where the budget ends is found by
cutting: a source's keys are parted at splitters from a sketch, the parts' words are added up, and only the part that holds the
budget's end is parted again, until it is small enough to be sorted. A source may so hold any share of all documents, and weights may be
as uneven as they like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_written, table, word_count, written

SHARE = 1.5
MOST_EPOCHS = 2.0
WEIGHTS = (3, 1, 2)
#: Rows of a source that are sorted together at most, but for equal keys, and parts that more are cut into.
SORTED_ROWS, PARTS = 10_000, 200


def uniform(*cols: Column, seed: int = 0) -> Column:
    """In (0, 1], a function of the columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 1) / float(2**53)


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST_EPOCHS, weights: tuple = WEIGHTS) -> DataFrame:
    """Targets of sources (source, key_, source_size): shares by weight of `share` of all words, each at most `most` of its own.

    Weights repeat in order of the sources' code points, null last. A source is at its limit if the
    level at which it gets there asks for no more than the whole budget; the others share the rest by
    weight, which is where sharing the excess again and again ends. One row a source, so few rows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(order) - 1) % len(weights) + 1
    all_ = Window.partitionBy()
    w = sizes.withColumn("w_", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), rank)).withColumn("cap_", F.col("source_size") * most)
    w = w.withColumn("level_", F.col("cap_") / F.col("w_")).withColumn("total_", F.sum("source_size").over(all_) * share)
    upto = Window.orderBy("level_").rangeBetween(Window.unboundedPreceding, 0)
    asked = F.sum("cap_").over(upto) + F.col("level_") * (F.sum("w_").over(all_) - F.sum("w_").over(upto))
    w = w.withColumn("full_", asked <= F.col("total_"))
    rest = F.col("total_") - F.sum(F.when(F.col("full_"), F.col("cap_")).otherwise(0.0)).over(all_)
    free = F.sum(F.when(F.col("full_"), 0.0).otherwise(F.col("w_"))).over(all_)
    return w.withColumn("target", F.when(F.col("full_"), F.col("cap_")).otherwise(F.least(F.col("cap_"), rest * F.col("w_") / free))).select("source", "key_", "source_size", "target")


def budget_ends(rows: DataFrame, plan: DataFrame, most: int = SORTED_ROWS, parts: int = PARTS) -> DataFrame:
    """(key_, stop_, last_): the first row of each source that its budget no longer takes, or, if it takes all of them, the last one.

    rows: (key_, draw_, doc_id, hash_, size), in order of draw_, doc_id, hash_ within a source; plan: (key_, rest_), the words to take, less than
    the source has. A row is taken if at least half of it is within the budget. Sources of which nothing is taken have no row.
    """
    own = F.struct("draw_", "doc_id", "hash_")
    open_ = rows.join(plan.where("rest_ > 0").select("key_", "rest_"), "key_").select("key_", "draw_", "doc_id", "hash_", "size", "rest_", F.lit(0).cast("long").alias("before_"))
    n = rows.groupBy("key_").count().agg(F.max("count")).first()[0] or 0
    made, at = [], [F.lit(i / parts) for i in range(1, parts)]
    while n > most:
        cuts = open_.groupBy("key_").agg(F.percentile_approx("draw_", F.array(*at), F.lit(20 * parts)).alias("cuts_"))
        dealt = open_.join(cuts, "key_").withColumn("part_", F.size(F.filter("cuts_", lambda c: c < F.col("draw_"))))
        sums = dealt.groupBy("key_", "part_").agg(F.sum("size").alias("sum_"), F.min("draw_").alias("low_"), F.max("draw_").alias("high_"), F.first("rest_").alias("rest_"), F.first("before_").alias("start_"))
        upto = F.col("start_") + F.sum("sum_").over(Window.partitionBy("key_").orderBy("part_").rowsBetween(Window.unboundedPreceding, 0))
        end = sums.withColumn("upto_", upto).where((F.col("upto_") - F.col("sum_") < F.col("rest_")) & (F.col("rest_") <= F.col("upto_")))
        end = end.select("key_", "low_", "high_", (F.col("upto_") - F.col("sum_")).alias("before_"))
        inner = open_.drop("before_").join(end, "key_").where("draw_ between low_ and high_").drop("low_", "high_")
        open_ = written(inner.select("key_", "draw_", "doc_id", "hash_", "size", "rest_", "before_"), "open")
        made.append(open_)
        less = open_.groupBy("key_").count().agg(F.max("count")).first()[0] or 0
        if less == n:  # equal keys, of repeated rows
            break
        n = less
    upto = F.col("before_") + F.sum("size").over(Window.partitionBy("key_").orderBy("draw_", "doc_id", "hash_").rowsBetween(Window.unboundedPreceding, 0))
    taken = open_.withColumn("taken_", upto - F.col("size") / 2 <= F.col("rest_"))
    out = written(taken.groupBy("key_").agg(F.min(F.when(~F.col("taken_"), own)).alias("stop_"), F.max(own).alias("last_")), "ends")
    for df in made:
        drop_written(df)
    return out


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: int = 0, share: float = SHARE, most: float = MOST_EPOCHS, weights: tuple = WEIGHTS, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, row_: for each row of docs, the words that the mix takes.

    quality: (doc_id, weight > 0); documents without one weigh 1. A null text has size 0 and nothing
    is taken of it; null sources are one source, which comes last. Repeated rows are documents of their own that are taken
    alike: equal keys, which only equal documents have, are taken together or not at all. `taken` is size times a whole
    number of epochs. The last document of a fractional selection is taken if that
    brings the source nearer to its target. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("hash_"))
    if quality is not None:
        q = quality.groupBy("doc_id").agg(F.max("weight").alias("weight_"))
        rows = rows.join(q, "doc_id", "left")
    else:
        rows = rows.withColumn("weight_", F.lit(1.0))
    weight = F.greatest(F.coalesce(F.col("weight_"), F.lit(1.0)), F.lit(1e-6))
    rows = rows.withColumn("draw_", -F.log(uniform("doc_id", "hash_", seed=seed)) / weight)
    rows = rows.withColumn("key_", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    rows = written(rows.select("doc_id", "source", "key_", "size", "draw_", "hash_"), "mix")

    sizes = rows.groupBy("key_").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    plan = source_targets(sizes, share, most, weights).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("epochs_", epochs).withColumn("rest_", F.col("target") - F.col("epochs_") * F.col("source_size"))
    plan = written(plan, "plan")
    ends = budget_ends(rows, plan, sorted_rows)
    own = F.struct("draw_", "doc_id", "hash_")
    picked = F.coalesce(own < F.col("stop_"), own <= F.col("last_"), F.lit(False)).cast("int")
    out = rows.join(plan, "key_").join(ends, "key_", "left")
    return out.withColumn("taken", (F.col("size") * (F.col("epochs_") + picked)).cast("long")).select("doc_id", "source", "size", "source_size", "target", "taken", F.col("hash_").alias("row_"))


def mix_documents(docs: DataFrame, quality: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """docs, all columns, each row as often as the mix takes it. Rows of equal id and text are taken alike."""
    taken = mix(docs, quality, seed).where("taken > 0").groupBy("doc_id", "row_").agg(F.max((F.col("taken") / F.col("size")).cast("int")).alias("times_"))
    taken = taken.select(F.col("doc_id").alias("id_"), "row_", "times_")
    rows = docs.select(F.struct(*docs.columns).alias("d_"), F.xxhash64("text").alias("hash_"))  # names of docs can't clash
    picked = rows.join(taken, F.col("d_.doc_id").eqNullSafe(F.col("id_")) & (F.col("hash_") == F.col("row_")))
    return picked.select("d_", F.explode(F.sequence(F.lit(1), F.col("times_"))).alias("copy_")).select("d_.*")


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights from labels: 2 for good, 0.5 for poor."""
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") > 0, 2.0).otherwise(0.5).alias("weight"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op9_mix_sources": op9_mix_sources}
SQL: dict[str, str] = {}
