"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are a structured random product code: a direction joins one codeword of each half of the
(randomly rotated) space. A vector is list-decoded to all directions whose cap holds it: for each word of
the first half, sorted inner products of the second tell at once which words reach the threshold. A vector that
too few caps hold goes to its best directions instead, so that each has a list that its near copies share. Vectors
of one label that share a direction are compared in double precision; a pair counts under the first
direction that it shares, so it is met once. Equal vectors are one class. Full caps are cut into blocks, and each
pair of blocks is one group; a group returns sums of links and a spanning forest, not pairs.
"""

from __future__ import annotations

from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import components
from .jaccard import _schema

LEAST = 0.98
#: Directions that a vector is decoded to, on average, and vectors for each direction.
LIST = 40
VECTORS_PER_DIRECTION = 12
#: Directions of each vector at least, or all there are: its best ones, be they above the threshold or not.
LEAST_LIST = 32
#: Vectors of a block of a full cap, and rows of a group of small caps.
BLOCK = 512
GROUP_ROWS = 4000
SEED = 11

DECODED = "label int, dim int, direction long, cid long, mult long, vector binary, list binary"
LINKS = "cid long, links long, root long"


@lru_cache(maxsize=4)
def code(dim: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotation, words of the first half, words of the second): the same everywhere for the same arguments."""
    rng = np.random.default_rng((SEED, dim, words))
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    halves = []
    for d in (dim // 2, dim - dim // 2):
        w = rng.standard_normal((words, d))
        halves.append(w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300))
    return turn, *halves


def threshold(dim: int, words: int, per_vector: float = LIST) -> float:
    """Height of the caps that hold a random vector per_vector times on average."""
    share = min(1 - 1e-9, per_vector / words**2)
    return NormalDist().inv_cdf(1 - share) / dim**0.5


def best(p: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k directions with the largest sums of a word's product in p and one's in q, or of all if there are less.

    The k best joins are of the k best words of each half.
    """
    a, b = np.argsort(-p, kind="stable")[:k], np.argsort(-q, kind="stable")[:k]
    top = np.argsort(-(p[a][:, None] + q[b]).ravel(), kind="stable")[:k]
    return a[top // len(b)] * len(q) + b[top % len(b)]


def decode(unit: np.ndarray, words: int, per_vector: float = LIST, at_least: int = 0) -> list[np.ndarray]:
    """For each unit vector, the sorted numbers of all directions whose caps hold it, or of its at_least best if these are more."""
    dim = unit.shape[1]
    if dim < 2:
        return [np.zeros(1, np.int64)] * len(unit)
    turn, one, two = code(dim, words)
    v = unit @ turn
    p, q = v[:, : dim // 2] @ one.T, v[:, dim // 2 :] @ two.T
    reach = threshold(dim, words, per_vector) * 2**0.5
    order = np.argsort(-q, axis=1, kind="stable")
    out = []
    for i in range(len(v)):
        down = -q[i, order[i]]
        a = np.flatnonzero(p[i] >= reach + down[0])
        count = np.searchsorted(down, p[i, a] - reach, "right")
        if count.sum() < at_least:
            out.append(np.sort(best(p[i], q[i], at_least)))
            continue
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        out.append(np.sort(np.repeat(a, count) * words + order[i, at]))
    return out


def _decoded(words: int, per_vector: float):
    schema = _schema(DECODED)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                label, cid, mult = (part.column(k).to_pylist() for k in range(3))
                raw = [np.array(x, np.float32) for x in part.column(3).to_pylist()]
                cols: dict[str, list] = {c: [] for c in schema.names}
                for dim in sorted({len(x) for x in raw}):
                    own = [i for i, x in enumerate(raw) if len(x) == dim]
                    v = np.stack([raw[i] for i in own]).astype(np.float64)
                    v /= np.abs(v).max(axis=1, keepdims=True)
                    for i, found in zip(own, decode(v / np.linalg.norm(v, axis=1, keepdims=True), words, per_vector, LEAST_LIST), strict=True):
                        n = len(found)
                        for c, x in zip(schema.names, (label[i], dim, None, cid[i], mult[i], raw[i].tobytes(), found.astype("<u4").tobytes()), strict=True):
                            cols[c].extend(found.tolist() if c == "direction" else [x] * n)
                yield pa.RecordBatch.from_pydict(cols, schema=schema)

    return run


def _counts(words: int, per_vector: float):
    schema = _schema("label int, dim int, direction long, n long")

    def run(batches):
        for b in _decoded(words, per_vector)(batches):
            t = pa.Table.from_batches([b]).group_by(["label", "dim", "direction"]).aggregate([("cid", "count")])
            yield from t.select(["label", "dim", "direction", "cid_count"]).rename_columns(schema.names).cast(schema).to_batches()

    return run


def link_cap(cid: np.ndarray, mult: np.ndarray, vectors: np.ndarray, lists: list[np.ndarray], direction: int, side: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Links that pairs of a cap count under its direction, and for each vector the place of a root in a forest of all its links."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    norm = np.linalg.norm(v, axis=1)
    near = v @ v.T / np.outer(norm, norm) >= least
    np.fill_diagonal(near, False)
    if side.any():
        near &= side[:, None] != side[None, :]
    links, root = np.zeros(len(cid), np.int64), np.arange(len(cid))
    on = np.flatnonzero(near.any(axis=1))
    if not len(on):
        return links, root
    adj = near[np.ix_(on, on)]
    lower = [lists[i][lists[i] < direction] for i in on]
    seen, number = np.unique(np.concatenate(lower), return_inverse=True)
    has = np.zeros((len(on), len(seen)), np.float32)
    has[np.repeat(np.arange(len(on)), list(map(len, lower))), number] = 1
    first = adj & (has @ has.T == 0)
    links[on] = first @ mult[on]
    lab = np.arange(len(on))
    while True:
        new = np.minimum(lab, np.where(adj, lab[None, :], len(on)).min(axis=1))
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    root[on] = on[lab]
    return links, root


def _linked(least: float):
    schema = _schema(LINKS)

    def run(t: pa.Table) -> pa.Table:
        label, dim, direction, cid, mult, side = (t[c].to_numpy() for c in ("label", "dim", "direction", "cid", "mult", "side"))
        raw, lists = t["vector"].to_pylist(), t["list"].to_pylist()
        order = np.lexsort((direction, dim, label))
        head = np.flatnonzero(np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (label, dim, direction)], axis=0)]))
        out = []
        for own in np.split(order, head[1:]):
            if len(own) < 2:
                continue
            v = np.stack([np.frombuffer(raw[i], "<f4") for i in own])
            links, root = link_cap(cid[own], mult[own], v, [np.frombuffer(lists[i], "<u4") for i in own], int(direction[own[0]]), side[own], least)
            at = np.arange(len(own))
            on = (links > 0) | (root != at)
            out.append(np.stack([cid[own][on], links[on], cid[own][root[on]]]))
        got = np.concatenate(out, axis=1) if out else np.zeros((3, 0), np.int64)
        return pa.Table.from_arrays([pa.array(x) for x in got], schema=schema)

    return run


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link at all: it and its label are there, all components finite, one not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(label.isNotNull() & vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, least: float = LEAST, per_vector: float = LIST) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label).

    Rows link if their labels are equal and the cosine is at least `least`; none below it ever does. Null,
    zero and non-finite vectors and null labels link with nothing. Repeated rows and equal vectors link with each other.
    A row with a null id joins its class. Vectors of different length never link. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"), F.col("label").cast("int"))
    rows = rows.withColumn("k1", F.when(usable(F.col("embedding"), F.col("label")), F.xxhash64(F.lit(1), "embedding"))).withColumn("k2", F.xxhash64(F.lit(2), "embedding", "label"))
    classes = rows.where("k1 is not null").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("cid"), F.count("*").alias("mult"), F.first("embedding").alias("embedding"))
    classes = written(classes.where("cid is not null"), "classes")
    n = classes.count()
    words = max(4, int((n / VECTORS_PER_DIRECTION) ** 0.5 + 0.999))
    source = classes.select("label", "cid", "mult", "embedding")

    counts = source.mapInArrow(_counts(words, per_vector), "label int, dim int, direction long, n long").groupBy("label", "dim", "direction").agg(F.sum("n").alias("n"))
    full = written(counts.where(F.col("n") > BLOCK).select("label", "dim", "direction", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "full")
    groups = max(1, int(n * per_vector // GROUP_ROWS))
    decoded = source.mapInArrow(_decoded(words, per_vector), DECODED).join(full, ["label", "dim", "direction"], "left")
    payload = ["label", "dim", "direction", "cid", "mult", "vector", "list"]
    small = decoded.where("blocks is null").select(F.pmod(F.xxhash64("label", "dim", "direction"), F.lit(groups)).alias("g"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("side"), *payload)
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    large = decoded.where("blocks is not null").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select((-1 - F.pmod(F.xxhash64("label", "dim", "direction"), F.lit(2**62))).alias("g"), F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), (F.col("mine") > F.col("other")).cast("int").alias("side"), *payload)
    found = small.unionByName(large).groupBy("g", "lo", "hi").applyInArrow(_linked(least), LINKS)
    found = written(found.groupBy("cid", "root").agg(F.sum("links").alias("links")), "links")

    labels = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    done = classes.select("label", "k1", "k2", "cid", "mult").join(links, "cid", "left").join(labels, F.col("cid") == F.col("id"), "left")
    done = done.select("label", "k1", "k2", "mult", F.coalesce("component", "cid").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
    out = rows.drop("embedding").join(done, ["label", "k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", (F.coalesce(F.col("mult"), F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_near_dedup": op2_embedding_near_dedup}
#: The same over all pairs of a label, for the SQL check.
SQL: dict[str, str] = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS low FROM r GROUP BY 1), d AS (SELECT x, count(*) AS links FROM e GROUP BY 1)
SELECT vec_id, coalesce(links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id <= coalesce(low, vec_id) AS kept FROM v LEFT JOIN c ON c.x = vec_id LEFT JOIN d ON d.x = vec_id"""
}
