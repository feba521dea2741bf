"""Exact integer k-means by sort-means.

Vectors are scaled to integers, so distances and means have no rounding and the result
does not depend on how rows are dealt out. Each round is one pass over a stored table of
(vector, cluster of the round before): for every centroid the others are sorted by their
distance from it; a vector starts with its previous centroid and goes through the others
in that order until one is strictly further from the previous centroid than twice the
vector's distance from it. By the triangle inequality none of the rest can be nearer;
at exactly twice the distance one may be equally near, so ties are seen and go to the
smaller number. Tasks return sums for each cluster; only these, clusters x components
numbers, reach the driver.

Kept are vectors of ``DIMENSIONS`` finite components; null or other vectors are left
out. Rows that repeat a vec_id are vectors of their own, and of equal start hashes the
one with the smaller components starts first. A row without vec_id is clustered and
starts none while there are enough others. With fewer rows than clusters each row starts
one; an empty table gives an empty result. Other columns are ignored. A scaled component
beyond 2**27 is an error: squared distances would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import Tables, read, store

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
_LARGEST = 1 << 27
#: Below it all terms of a squared distance are exact in doubles, and matrix products can be used.
_EXACT = 1 << 21


def scaled(embeddings: DataFrame) -> DataFrame:
    """``vec_id, v, cluster``: the kept vectors as integers, all of cluster 0."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == DIMENSIONS) & F.forall("x", finite))
    large = F.exists("x", lambda e: F.abs(e * SCALE) > _LARGEST)
    checked = F.when(large, F.raise_error(F.lit("a scaled component is beyond 2**27"))).otherwise(F.transform("x", lambda e: F.floor(e * SCALE).cast("int")))
    return kept.select("vec_id", checked.alias("v"), F.lit(0).alias("cluster"))


def starts(rows: DataFrame) -> np.ndarray:
    """The CLUSTERS vectors with the smallest hashes of their ids, in that order: a top-k, not a sort of all rows."""
    h = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(h.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(CLUSTERS).collect()
    return np.array([r["v"] for r in first], np.int64).reshape(-1, DIMENSIONS)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of ``x`` and ``c`` (one row, or as many as ``x``), exact."""
    d = x - c
    return (d * d).sum(1)


def nearest(x: np.ndarray, centroids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row and its squared distance; ``before``: the row's previous centroid."""
    between = ((centroids[:, None] - centroids[None]) ** 2).sum(2)
    exact = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < _EXACT
    if exact:
        xf, cf = x.astype(np.float64), centroids.astype(np.float64)
        norm, cnorm = (xf * xf).sum(1), (cf * cf).sum(1)
    own = np.zeros(len(x), np.int64)
    best, at = np.zeros(len(x), np.int64), before.astype(np.int64)
    for a in range(len(centroids)):
        rows = np.flatnonzero(before == a)
        if not len(rows):
            continue
        d = squared(x[rows], centroids[a])
        order = np.lexsort((np.arange(len(centroids)), between[a]))
        order = order[order != a]
        # how many of the others each row has to look at: those up to twice its distance (four times the square)
        looks = np.searchsorted(between[a][order], 4 * d, "right")
        by_looks = np.argsort(-looks, kind="stable")
        rows, d, looks = rows[by_looks], d[by_looks], looks[by_looks]
        own[rows] = d
        low, cluster = d.copy(), np.full(len(rows), a)
        active = np.searchsorted(-looks, -np.arange(1, len(order) + 1), "right")
        part = xf[rows] if exact else x[rows]
        for rank in range(len(order)):
            n, c = active[rank], order[rank]
            if not n:
                break
            now = (norm[rows[:n]] + cnorm[c] - 2.0 * (part[:n] @ cf[c])).astype(np.int64) if exact else squared(part[:n], centroids[c])
            nearer = (now < low[:n]) | ((now == low[:n]) & (c < cluster[:n]))
            low[:n][nearer], cluster[:n][nearer] = now[nearer], c
        best[rows], at[rows] = low, cluster
    return at, best


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, DIMENSIONS)


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, v, cluster, distance``: every vector with its nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, best = nearest(_vectors(batch), centroids, batch.column("cluster").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(at.astype(np.int32)), pa.array(best)], ["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", "cluster").mapInArrow(run, "vec_id long, v array<int>, cluster int, distance long")


def means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the clusters' means; empty clusters keep their centroid."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, DIMENSIONS), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster = batch.column("cluster").to_numpy()
            order = np.argsort(cluster, kind="stable")
            x, ids = _vectors(batch)[order], cluster[order]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            total[ids[first]] += np.add.reduceat(x, first)
            n += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = rows.select("v", "cluster").mapInArrow(run, "cluster long, n long, total array<long>")
    flat = parts.select("cluster", "n", F.posexplode("total").alias("d", "s")).groupBy("cluster", "d")
    out = centroids.copy()
    for r in flat.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r["cluster"], r["d"]] = int(r["s"]) // r["n"]
    return out


def sort_means(embeddings: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    spark = embeddings.sparkSession
    now_at = Tables(spark)
    rows = store(scaled(embeddings), "vectors", now_at)
    centroids = starts(rows)
    for _ in range(ROUNDS):
        next_at = Tables(spark)
        rows = store(assigned(rows, centroids).drop("distance"), "assigned", next_at)
        now_at.drop()
        now_at = next_at
        centroids = means(rows, centroids)
    found = store(assigned(rows, centroids).drop("v"), "clusters")
    now_at.drop()
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = sum(r["cluster_inertia"] for r in sums.collect())  # a row for each cluster
    names = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    per = F.broadcast(sums.join(names, "cluster"))
    return found.join(per, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256")


def op11_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means(read(spark, sf_dir, "embeddings"))


def _rounds_sql() -> str:
    """A round is two common tables: the nearest centroid of each vector, and the floors of the means."""
    out = []
    for i in range(ROUNDS + 1):
        out.append(f"""d{i} AS MATERIALIZED (SELECT v.n, c.cluster, list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{i} c),
a{i} AS MATERIALIZED (SELECT n, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{i} GROUP BY n)""")
        if i < ROUNDS:
            out.append(f"""m{i} AS (SELECT a.cluster, u.d, sum(u.x)::HUGEINT AS s, count(*) AS k FROM a{i} a JOIN u USING (n) GROUP BY ALL),
f{i} AS (SELECT cluster, list(((s - ((s % k) + k) % k) // k)::BIGINT ORDER BY d) AS v FROM m{i} GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(f.v, c.v) AS v FROM c{i} c LEFT JOIN f{i} f USING (cluster))""")
    return ",\n".join(out)


ORACLE_SQL = f"""WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
u AS MATERIALIZED (SELECT n, unnest(range(1, {DIMENSIONS + 1})) AS d, unnest(v) AS x FROM v),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS cluster, v FROM v QUALIFY cluster < {CLUSTERS}),
{_rounds_sql()},
p AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, a.distance, cluster_inertia, (SELECT sum(distance) FROM a{ROUNDS})::BIGINT AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN v USING (n) JOIN p USING (cluster) JOIN c{ROUNDS} c USING (cluster)"""
