"""Spelling variants as neighbours of one edit, by a trie whose frontier advances one level a round.

Every word walks down a path-compressed trie. A state is (word, position, node, edits); a round joins all
states with the edges that leave their nodes, and an edge lets a state pass if its label is what comes next in the word, or is so
after one replaced or deleted code point, placed where the word leaves its own way (what is inserted from one word is deleted
from the other). States without an edit
are the words themselves, so they also make the next level of edges: words of a node that go on with the
same code point form one edge, as long as what their least and greatest have in common. A state that ends on a word with one edit is a pair of neighbours.

Two words of one edit agree up to the middle of the first or from there on, so words are walked forwards and backwards, and an edit may
come only in a walk's second half: near the root, where nodes have many children, states only follow their own word. Levels
begin below the first three code points, which the half that agrees always has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, drop_written, table, written

LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_LENGTH = 7
LEAST_N = 2
#: One of so many runs loses a code point.
DAMAGED = 31
#: A form is so many times as frequent as the word.
FORM_TIMES = 10
#: Code points of the nodes that the levels start from: no more than half of the shortest word.
ROOT = 3


def damaged_runs(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word) for each run of letters in (doc_id, text), lower case, after the loss of a code point; only words of least code points.

    A null text has no runs; a null doc_id hashes as an empty one.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{least},}}"), F.lit(0))).alias("run"))
    runs = runs.select(ascii_lower(F.col("run")).alias("run"), F.crc32(F.concat_ws(":", "id", ascii_lower(F.col("run")))).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def common_length(a: Column, b: Column) -> Column:
    """Code points that two strings begin with alike."""
    differs = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
    return F.when(a == b, F.length(a)).otherwise(differs)


def edges(states: DataFrame) -> DataFrame:
    """(way, node, first, label, child, word_ends, leaf) of the edges below the nodes of the states without an edit."""
    own = states.where("edits = 0 and rest <> ''").groupBy("way", "node", F.substring("rest", 1, 1).alias("first")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    own = own.withColumn("child", F.substring("low", F.lit(1), common_length(F.col("low"), F.col("high"))))
    label = F.substring("child", F.length("node") + 1, F.length("child"))
    return own.select("way", "node", "first", label.alias("label"), "child", (F.col("low") == F.col("child")).alias("word_ends"), (F.col("low") == F.col("high")).alias("leaf"))


def advanced(states: DataFrame) -> DataFrame:
    """states (way, key, rest, node, edits) one level further down, with word_ends and leaf of the new node; only those that are a result or may become one.

    rest is what the word has left. A state without an edit always passes the edge that its own word made; on any other edge the first
    code point differs, so that is where the edit comes. A pair is walked from one of its words only: code points are deleted, or
    replaced by greater ones.
    """
    may = (F.col("edits") == 0) & (F.length("key") - F.length("rest") >= F.floor(F.length("key") / 2))
    own = states.select("*", F.substring("rest", 1, 1).alias("next"), F.when(may, F.substring("rest", 2, 1)).alias("second"))
    below = edges(states).withColumn("tail", F.substring("label", F.lit(2), F.length("label"))).hint("shuffle_hash")  # one row an edge: even, and never many a partition
    replaced = F.col("second").isNotNull() & (F.col("next") < F.col("first"))
    deleted = F.coalesce(F.col("second") == F.col("first"), F.lit(False)) & (F.col("next") != F.col("first"))
    met = own.join(below, ["way", "node"]).where((F.col("next") == F.col("first")) | replaced | deleted)
    rest, label, n = F.col("rest"), F.col("label"), F.length("label")
    rest_1 = F.substring(rest, F.lit(2), F.length(rest))
    state = lambda start, edits: F.struct(F.substring(rest, start, F.length(rest)).alias("rest"), F.lit(edits).alias("edits"))
    edited = F.array(F.when(replaced & F.startswith(rest_1, F.col("tail")), state(n + 1, 1)), F.when(deleted & F.startswith(rest_1, label), state(n + 2, 1)))
    moves = F.when(F.col("next") != F.col("first"), F.array_compact(edited)).when(F.col("edits") == 0, F.array(state(n + 1, 0))).when(F.startswith(rest, label), F.array(state(n + 1, 1)))
    went = met.select("way", "key", F.col("child").alias("node"), "word_ends", "leaf", F.explode(moves).alias("to"))
    return went.select("way", "key", "to.rest", "node", "to.edits", "word_ends", "leaf").where(_is_pair() | _goes_on())


def _is_pair() -> Column:
    """At the end of a word, an edit and the whole key, or no edit and all of it but the last code point."""
    return F.col("word_ends") & (F.length("rest") == 1 - F.col("edits"))


def _goes_on() -> Column:
    return ~F.col("leaf") & (F.col("rest") != "")


def neighbours(words: DataFrame) -> DataFrame:
    """(word, near) for all ordered pairs of distinct words (of six code points or more) that differ by exactly one edit; repeated words count once."""
    w = words.select("word").distinct()
    keys = w.select(F.lit(0).alias("way"), F.col("word").alias("key")).unionByName(w.select(F.lit(1).alias("way"), F.reverse("word").alias("key")))
    states = written(keys.select("way", "key", F.substring("key", F.lit(ROOT + 1), F.length("key")).alias("rest"), F.substring("key", 1, ROOT).alias("node"), F.lit(0).alias("edits")), "states")
    levels = []
    while not states.isEmpty():
        level = written(advanced(states), "states")
        if not levels:
            drop_written(states)
        levels.append(level)
        states = level.where(_goes_on()).select("way", "key", "rest", "node", "edits")
    turned = lambda c: F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = [level.where(_is_pair()).select(turned("key").alias("word"), turned("node").alias("near")) for level in levels]
    both = F.explode(F.array(F.struct("word", "near"), F.struct(F.col("near").alias("word"), F.col("word").alias("near")))).alias("p")
    found = written(reduce(DataFrame.unionByName, pairs).select(both).select("p.*").distinct(), "pairs") if pairs else w.select("word", F.col("word").alias("near")).limit(0)
    for level in levels:
        drop_written(level)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row of (word, form): where following forms ends. Each round doubles the steps that a row knows."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = written(known.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_written(known)
        known = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return known


def variants(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of (word, n).

    A word's form is its most frequent near word (ties: the least in code-point order) if that is `times` as frequent; else
    form and form_n are null. root is the last of the chain of forms, or the word itself. No words, no rows.
    """
    near = neighbours(words)
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = near.join(other, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    is_form = -F.col("best.less") >= times * F.col("n")
    out = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).cast("long").alias("form_n"))
    out = written(out, "forms")
    return out.join(roots(out.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def frequent_words(docs: DataFrame, least: int = LEAST_LENGTH, least_n: int = LEAST_N) -> DataFrame:
    """(word, n) of the words of least code points that occur least_n times or more in all texts."""
    return damaged_runs(docs, least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = written(frequent_words(table(spark, sf_dir, "documents")), "words")
    return variants(words).select("word", "n", "n_near", "form", "form_n", "root")


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
#: The same from equal strings after one deletion, for the SQL check; CRC-32 bit by bit.
SQL: dict[str, str] = {
    "op12_spelling_variants": rf"""WITH RECURSIVE o AS MATERIALIZED (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{{LEAST_LENGTH},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
g AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM o GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
 lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) AS h FROM g),
r AS (SELECT CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_N}),
i AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w), d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM i),
p AS MATERIALIZED (SELECT a.word, b.word AS near FROM d a JOIN d b USING (i, v) WHERE a.word <> b.word UNION SELECT d.word, w.word FROM d JOIN w ON d.v = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.v = w.word),
b AS (SELECT p.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS near, max(w.n) AS near_n FROM p JOIN w ON w.word = p.near GROUP BY 1),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FORM_TIMES} * w.n THEN near END AS form, CASE WHEN near_n >= {FORM_TIMES} * w.n THEN near_n END AS form_n FROM w LEFT JOIN b USING (word)),
t AS (SELECT word, word AS root FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
l AS (SELECT t.word, t.root FROM t JOIN f ON f.word = t.root WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM f JOIN l USING (word)"""
}
