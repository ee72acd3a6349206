"""Text formats of results."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import srt_time, stamp_in_name
from ..operators.annotate import group_rank
from ..operators.timeseries import lead_time

#: Decimals of the telemetry columns.
DECIMALS = {"time_s": 2, "lat": 7, "lon": 7}


def telemetry_text(columns: list[str]) -> list[Column]:
    """Columns as text: seven decimals for places, two for times, else one; empty for null."""
    return [F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{DECIMALS.get(c, 1)}f", F.col(c))).alias(c) for c in columns]


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite", partition: str | None = None, header: bool = True) -> None:
    w = df.write.mode(mode).option("sep", "\t").option("header", header).option("emptyValue", "").option("nullValue", "")
    (w.partitionBy(partition) if partition else w).csv(path)


def subtitles(df: DataFrame, key: str = "video", t: str = "time_s") -> DataFrame:
    """(key, number, block): one subtitle a row of telemetry, shown until the next, with its count, its duration and the wall clock.

    lat, lon and alt_m stand as they come; pass them as text for fixed decimals.
    """
    end = lead_time([key], t)
    x = df.withColumn("end_", end).withColumn("number", group_rank([key], [F.col(t)]))
    ms = F.greatest(F.lit(1), F.round((F.col("end_") - F.col(t)) * 1000).cast("long"))
    there = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(F.lit('<font size="28">SrtCnt : '), F.col("number"), F.lit(", DiffTime: "), ms, F.lit("ms"))
    clock = F.date_format(stamp_in_name(F.col(key), F.col(t)), "yyyy-MM-dd HH:mm:ss.SSS")
    place = F.concat(F.lit("[latitude: "), there("lat"), F.lit("] [longitude: "), there("lon"), F.lit("] [altitude: "), there("alt_m"), F.lit("] </font>\n"))
    block = F.concat_ws("\n", F.col("number").cast("string"), F.concat_ws(" --> ", srt_time(F.col(t)), srt_time(F.col("end_"))), head, clock, place)
    return x.select(key, "number", block.alias("block"))


def with_preamble(df: DataFrame, preamble: str, columns: list[str]) -> DataFrame:
    """(key_, line): a table as lines of text under a preamble of comments and a header, to be written in the order of key_."""
    spark = df.sparkSession
    head = spark.createDataFrame([(-2, preamble.rstrip("\n")), (-1, "\t".join(columns))], "key_ long, line string")
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return head.unionByName(df.select(F.monotonically_increasing_id().alias("key_"), F.concat_ws("\t", *cells).alias("line"))).orderBy("key_")


def map_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, for a map."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def map_document(groups: dict[str, DataFrame], **constants: object) -> DataFrame:
    """One row with one JSON document of a map: constants as they are, and for each group its rows, in order of their columns, as a list.

    It is what a browser loads, so it has the size of a page; groups are what is drawn, not what was computed from.
    """
    spark = next(iter(groups.values())).sparkSession
    doc = spark.range(1).select(*[F.parse_json(F.lit(json.dumps(v, ensure_ascii=False))).alias(k) for k, v in constants.items()], F.lit(None).alias("none_"))
    for name, df in groups.items():
        rows = df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
        doc = doc.crossJoin(F.broadcast(rows))  # one row
    return doc.select(F.to_json(F.struct(*constants, *groups), {"ignoreNullFields": "false"}).alias("json"))


def message_lines(messages: DataFrame) -> DataFrame:
    """(topic, id, line): messages as the text of an export, a head, the text if there is one, and an empty line. Service messages are left out.

    messages: (topic, id, ts, sender, text, media, action), ts a timestamp; media is the path of what came along.
    """
    note = F.when(F.col("media").isNotNull(), F.concat(F.lit(" [медиа: "), F.col("media"), F.lit("]"))).otherwise("")
    head = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] #"), F.col("id"), F.lit(" "), F.coalesce("sender", F.lit("")), F.lit(":"), note)
    said = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    lines = F.concat(F.array(head), F.when(said != "", F.array(said)).otherwise(F.array().cast("array<string>")), F.array(F.lit("")))
    return messages.where("action is null").select("topic", "id", F.array_join(lines, "\n").alias("line"))
