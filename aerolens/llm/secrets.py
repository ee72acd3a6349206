"""Secret scans with an incremental blob ledger.

Every row is a version of the path doc_id, and every version is addressed by the SHA-256 of its text. The ledger says
which blob has been scanned under which rule version, and with what findings. Pairs that it lacks are found by their
hashes alone, and only their texts, one for each blob, meet a pattern. Findings are then joined back to all versions of all
paths. All of it is DataFrame operations: the text between matches and the matches themselves come from one pattern,
and a running sum of their lengths gives the places in code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

RULE_VERSION = "2"
#: kind, pattern, group that counts, its least length, and what a text that it matches holds in lower case: one of these,
#: if there are any. The first three are the base; later ones add spans.
RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("passw", "secret", "token", "api")),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    ("hex", r"[0-9a-f]{32,}", 0, 32, ()),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, ("-----begin ",)),
    ("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, ("eyj",)),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{20,}", 0, 1, ("xox",)),
)
BASE = 3
MASK = "[SECRET]"
_FOUND = "array<struct<start:bigint,kind:int,end:bigint>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def may_hold(text: Column) -> Column:
    """Whether any rule can match at all. A pattern is tried only where its text is."""
    low = F.lower(text)

    def one(pattern: str, marks: tuple) -> Column:
        there = reduce(Column.__or__, [F.contains(low, F.lit(m)) for m in marks]) if marks else F.lit(True)
        return there & text.rlike(pattern)

    return F.coalesce(reduce(Column.__or__, [one(r[1], r[4]) for r in RULES]), F.lit(False))


def blob_spans(texts: DataFrame) -> DataFrame:
    """(blob, kind, start, end) of all findings in (blob, text): kind is a place in RULES, start and end are code points."""

    def lengths(k: int) -> Column:
        _, p, group, *_ = RULES[k]
        long = lambda a: F.transform(a, lambda x: F.length(x))
        return F.struct(F.lit(k).alias("kind"), F.arrays_zip(long(F.split("text", p, -1)).alias("gap"), long(F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias("len"), long(F.regexp_extract_all("text", F.lit(p), F.lit(group))).alias("value")).alias("parts"))

    # A filter isn't moved below a column that Spark can't recompute, so the patterns stay above the join that chose the texts.
    chosen = texts.withColumn("place_", F.monotonically_increasing_id()).where((F.col("place_") >= 0) & may_hold(F.col("text")))
    kinds = chosen.select("blob", F.explode(F.array(*[lengths(k) for k in range(len(RULES))])).alias("k_")).select("blob", "k_.kind", F.posexplode("k_.parts").alias("pos", "p_"))
    parts = kinds.select("blob", "kind", "pos", "p_.gap", "p_.len", "p_.value").where("len is not null").dropDuplicates(["blob", "kind", "pos"])
    upto = Window.partitionBy("blob", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    least = F.element_at(F.array(*[F.lit(r[3]) for r in RULES]), F.col("kind") + 1)
    return parts.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).where(F.col("value") >= least).select("blob", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(r[0]) for r in RULES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, found) for the blobs of docs that ledger lacks under rule_version.

    found: array of (start, kind, end), sorted; empty if there is none. One row for each blob; a null
    text is the empty blob, and an empty table gives no rows. Texts of known blobs meet no pattern.
    """
    path = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    blobs = docs.select(blob_id(F.col("text")).alias("blob"), path.alias("path_"), F.col("text"))
    unseen = blobs.groupBy("blob").agg(F.min("path_").alias("path_"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    unseen = written(unseen, "unseen")
    texts = blobs.join(unseen, ["blob", "path_"], "left_semi")
    found = blob_spans(texts).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    return unseen.join(found, "blob", "left").select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce("found", F.array().cast(_FOUND)).alias("found"))


class Ledger:
    """The ledger as a Parquet folder of (rule_version, blob, found) that only grows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(self.path) if fs.exists(p) and fs.listStatus(p) else None

    def update(self, docs: DataFrame, rule_version: str = RULE_VERSION) -> None:
        """Scan what is new in docs under rule_version. A repeated call with the same rows scans nothing."""
        scan(docs, self.rows(), rule_version).write.mode("append").partitionBy("rule_version").parquet(self.path)


def findings(docs: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Join the ledger back: doc_id and found for every row of docs, found empty where there is none."""
    known = ledger.where(F.col("rule_version") == rule_version).select("blob", "found")
    return docs.select("doc_id", blob_id(F.col("text")).alias("blob")).join(known, "blob", "left").select("doc_id", "blob", "found")


def redact(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """docs, all columns and rows, with MASK for each run of findings, and n_chars, if there is that column, of a text that changed.

    ledger must know all blobs of docs; without one, it is made here: each distinct text is scanned once, and
    findings are joined back to all rows by the texts' hashes.
    """
    if ledger is None:
        ledger = written(scan(docs.select("doc_id", "text")), "ledger")
    rest = [c for c in docs.columns if c != "text"]
    own = docs.select(F.struct(*rest).alias("d_"), F.col("text"), blob_id(F.col("text")).alias("blob_"))  # names of docs can't clash
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = x["start"] - acc["at"]
        add = F.when(gap >= 0, F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, gap.cast("int")), F.lit(MASK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), add.alias("out"))

    clean = F.aggregate("found_", zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"].cast("int") + 1, F.lit(2**31 - 1))))
    done = own.join(_known(ledger), "blob_", "left").withColumn("new_", F.when(F.size("found_") > 0, clean))
    new = {"text": F.coalesce("new_", "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("new_").cast("long"), F.col("d_.n_chars"))
    return done.select(*[new.get(c, F.col("d_")[c]).alias(c) for c in docs.columns])


def _known(ledger: DataFrame) -> DataFrame:
    """(blob_, found_) of the blobs with findings."""
    rows = ledger.where((F.col("rule_version") == RULE_VERSION) & (F.size("found") > 0))
    return rows.select(F.col("blob").alias("blob_"), F.col("found").alias("found_"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments: about half of the documents, then all of them, of which the ledger knows the first half."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = written(scan(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)), "ledger")
    ledger = ledger.unionByName(written(scan(docs, ledger), "ledger"))
    found = findings(docs, ledger)
    base = F.filter("found", lambda x: x["kind"] < BASE)
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


QUERIES = {"op3_secret_scan": op3_secret_scan}
#: The same from the lengths of gaps and matches of each rule, for the SQL check.
SQL: dict[str, str] = {
    "op3_secret_scan": "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{r[0]}' AS kind, list_transform(string_split_regex(text, p), lambda x: length(x)) AS gap, list_transform(regexp_extract_all(text, p, 0), lambda x: length(x)) AS len, list_transform(regexp_extract_all(text, p, {r[2]}), lambda x: length(x)) AS val, {r[3]} AS least FROM d, (SELECT '{r[1].replace(chr(39), chr(39) * 2)}' AS p)"
        for k, r in enumerate(RULES)
    )
    + f"""), i AS (SELECT *, unnest(range(1, len(len) + 1)) AS i FROM m WHERE len(len) > 0),
s AS (SELECT doc_id, k, kind, (list_sum(gap[1:i]) + coalesce(list_sum(len[1:i - 1]), 0))::BIGINT AS start, (list_sum(gap[1:i]) + list_sum(len[1:i]))::BIGINT AS stop FROM i WHERE val[i] >= least),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) FILTER (k < {BASE}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""
}
