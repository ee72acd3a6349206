"""Centroid clustering of integer vectors with scalar lookup tables.

Each round is one pass over the written integer vectors. Within an Arrow batch, each dimension has a table of squared
differences: a row for each integer value that occurs there, a column for each centroid. A distance is a sum of entries
gathered from the tables, so a value that many vectors share is squared once. Tasks return sums and counts by centroid, at
most one row a centroid and batch; Spark adds them up, and only the new centroids come to the driver: k times the number of dimensions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_written, table, written

DIM = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
SEED = 2
#: Integers below this size keep all distances, sums over 64 dimensions, within a long.
LARGEST = 2**27

ASSIGNED = "vec_id long, cluster int, distance long"


def usable(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector is kept: dim components, none null or non-finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) == dim) & ~F.exists(vector, bad), F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double; an error if one is too large for distances in a long."""
    down = lambda x: F.floor(x.cast("double") * scale)
    fits = F.forall(vector, lambda x: F.abs(x.cast("double")) * scale < LARGEST - 1)
    out = F.transform(vector, lambda x: down(x).cast("int"))
    return F.when(fits, out).otherwise(F.raise_error(F.lit(f"a component of {LARGEST // scale} or more: distances would not fit a long")))


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(rows x centroids) squared distances: for each dimension a table of occurring values by centroids, gathered and added."""
    out = np.zeros((len(rows), len(centroids)), np.int64)
    for d in range(rows.shape[1]):
        values, place = np.unique(rows[:, d], return_inverse=True)
        lookup = (values[:, None].astype(np.int64) - centroids[None, :, d]) ** 2
        out += lookup[place]
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(centroids: np.ndarray, schema: pa.Schema):
    dim = centroids.shape[1]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows = _matrix(b.column(0), dim)
            near = distances(rows, centroids).argmin(axis=1)  # the first of equal ones
            order = np.argsort(near, kind="stable")
            held, start, n = np.unique(near[order], return_index=True, return_counts=True)
            total = np.add.reduceat(rows[order].astype(np.int64), start, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(n), *(pa.array(c) for c in total.T)], schema=schema)

    return run


def _assign(centroids: np.ndarray):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])
    dim = centroids.shape[1]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            all_ = distances(_matrix(b.column(1), dim), centroids)
            near = all_.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(all_[np.arange(len(near)), near])], schema=schema)

    return run


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over rows (v array<int>): floor of the mean of each one's vectors; empty ones stay."""
    dim = centroids.shape[1]
    names = [f"s{d}" for d in range(dim)]
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), *((c, pa.int64()) for c in names)])
    parts = rows.select("v").mapInArrow(_sums(centroids, schema), "cluster int, n long, " + ", ".join(f"{c} long" for c in names))
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():  # one row a centroid at most
        out[r["cluster"]] = [r[c] // r["n"] for c in names]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept row of (vec_id, embedding).

    A vector is kept if it has exactly dim components, none null or non-finite; each becomes floor(256 * x). The first
    centroids are the k kept rows with the smallest SHA-256 of `seed:vec_id`; of rows with one id those with smaller
    components come first, and a null id hashes as an empty one. With fewer than k kept rows there are as many centroids as rows, with none no rows.
    Equal distances go to the smaller number. A component of 2^19 or more is an error, as distances would not fit a long.
    """
    ids = F.col("vec_id").cast("long")
    rows = written(vectors.where(usable(F.col("embedding"), dim)).select(ids.alias("vec_id"), integers(F.col("embedding")).alias("v")), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    out = written(rows.select("vec_id", "v").mapInArrow(_assign(centroids), ASSIGNED), "assigned")
    drop_written(rows)
    sums = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a centroid at most
    spark = vectors.sparkSession
    facts = [(c, s, sum(sums.values()), ",".join(map(str, centroids[c].tolist()))) for c, s in sorted(sums.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_ string")
    facts = facts.select("cluster", "cluster_inertia", "inertia", F.sha2("centroid_", 256).alias("centroid_sha256"))
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_centroid_clustering": op13_centroid_clustering}


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM) -> str:
    """The same with one row a vector, dimension and round, for the SQL check."""
    out = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
f AS (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INT AS c, v FROM v QUALIFY c < {k}),
x AS MATERIALIZED (SELECT r, unnest(range(1, {dim + 1})) AS d, unnest(v) AS x FROM v), c0 AS (SELECT c, unnest(range(1, {dim + 1})) AS d, unnest(v) AS y FROM f)"""
    for i in range(rounds + 1):
        out += f""",
s{i} AS (SELECT r, c, sum((x - y) * (x - y))::BIGINT AS s FROM x JOIN c{i} USING (d) GROUP BY 1, 2),
a{i} AS MATERIALIZED (SELECT r, arg_min(c, (s, c)) AS c, min(s) AS s FROM s{i} GROUP BY 1)"""
        if i < rounds:
            out += f""",
m{i} AS (SELECT c, d, sum(x)::BIGINT AS t, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce((t - ((t % n) + n) % n) // n, y) AS y FROM c{i} LEFT JOIN m{i} USING (c, d))"""
    return out + f""",
h AS (SELECT c, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY 1), t AS (SELECT c, sum(s)::BIGINT AS t FROM a{rounds} GROUP BY 1)
SELECT vec_id, c::INT AS cluster, s AS distance, t AS cluster_inertia, (SELECT sum(t)::BIGINT FROM t) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN h USING (c) JOIN t USING (c)"""


SQL: dict[str, str] = {"op13_centroid_clustering": _sql()}
