"""Manifests against what is there, and ledgers of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_fetch(manifest: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of manifest with its status: done (it is here), fetch (it is there), absent."""
    here = local.select(*keys).distinct().withColumn("here_", F.lit(True))
    there = remote.select(*keys).distinct().withColumn("there_", F.lit(True))
    out = manifest.join(here, keys, "left").join(there, keys, "left")
    return out.withColumn("status", F.when(F.col("here_"), "done").when(F.col("there_"), "fetch").otherwise("absent")).drop("here_", "there_")


def outcomes(manifest: DataFrame, fetched: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """manifest with status: ok if what was fetched has the size asked for, partial if it has another, absent if there is nothing.
    Only ok files are to be renamed from their partial names; the others are fetched again."""
    got = fetched.groupBy(*keys).agg(F.max(size).alias("got_"))
    status = F.when(F.col("got_").isNull(), "absent").when(F.col("got_") == F.col(size), "ok").otherwise("partial")
    return manifest.join(got, keys, "left").withColumn("status", status).drop("got_")


def ledger_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("status").agg(F.count("*").alias("n"))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key, the last by order; combined before the shuffle."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("m_")).select(key, "m_.*")
