"""Vectors in order: similarity of neighbours and windows, coherence, expansion, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx


def unit(v: F.Column) -> F.Column:
    length = F.sqrt(tx.dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / length)


def adjacent(df: DataFrame, group: str, order: str) -> DataFrame:
    """``group, order, next_id, similarity`` of neighbours in a group."""
    w = Window.partitionBy(group).orderBy(order)
    rows = df.select(group, order, "embedding", F.lead(order).over(w).alias("next_id"), F.lead("embedding").over(w).alias("next")).where("next_id is not null")
    return rows.select(group, order, "next_id", tx.cosine(F.col("embedding"), F.col("next")).alias("similarity"))


def coherence(df: DataFrame, group: str) -> DataFrame:
    """Mean cosine of all pairs and mean variance of a coordinate.

    The pairs are not made: the squared length of the sum of unit vectors holds them all.
    """
    u = df.select(group, F.posexplode(F.arrays_zip(unit(F.col("embedding")).alias("x"), F.col("embedding").alias("raw"))).alias("d", "p"))
    per = u.groupBy(group, "d").agg(F.sum("p.x").alias("s"), F.var_pop("p.raw").alias("var"), F.count("*").alias("n"))
    out = per.groupBy(group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"), F.avg("var").alias("variance")).where("n > 1")
    return out.select(group, "n", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("avg_similarity"), "variance")


def window_similarity(df: DataFrame, group: str, order: str, w: int) -> DataFrame:
    """Mean cosine of the w vectors before a place with the w from it on, where both are whole.

    The mean of all w * w cosines is the product of the two windows' mean unit vectors.
    """
    seq = Window.partitionBy(group).orderBy(order)
    rows = df.select(group, F.row_number().over(seq).alias("at"), unit(F.col("embedding")).alias("u"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    flat = rows.select(group, "at", "n", F.posexplode("u").alias("d", "x"))
    coord = Window.partitionBy(group, "d").orderBy("at")
    flat = flat.withColumns({"before": F.avg("x").over(coord.rowsBetween(-w, -1)), "after": F.avg("x").over(coord.rowsBetween(0, w - 1))})
    flat = flat.where((F.col("at") > w) & (F.col("at") <= F.col("n") - w + 1))
    return flat.groupBy(group, F.col("at").cast("long").alias("at")).agg(F.sum(F.col("before") * F.col("after")).alias("similarity"))


def expand_from_middle(df: DataFrame, group: str, order: str, least: float) -> DataFrame:
    """First and last row of the run around a group's middle row whose cosine with it is at least ``least``."""
    seq, whole = Window.partitionBy(group).orderBy(order), Window.partitionBy(group)
    rows = df.select(group, "embedding", F.row_number().over(seq).cast("long").alias("i"), F.count("*").over(whole).alias("n"))
    rows = rows.withColumn("anchor", F.floor(F.col("n") / 2) + 1)
    mid = rows.where("i = anchor").select(group, F.col("embedding").alias("m"))
    ok = tx.cosine(F.col("embedding"), F.col("m")) >= least
    rows = rows.join(mid, group).withColumn("bad", ~ok)
    lo, hi = F.max(F.when(F.col("bad") & (F.col("i") < F.col("anchor")), F.col("i"))), F.min(F.when(F.col("bad") & (F.col("i") > F.col("anchor")), F.col("i")))
    return rows.groupBy(group).agg(F.max("anchor").alias("anchor"), (F.coalesce(lo, F.lit(0)) + 1).alias("first"), (F.coalesce(hi, F.max("n") + 1) - 1).alias("last"))


def nearest(df: DataFrame, queries: DataFrame, top: int, part: int = 8192, block: int = 8192, strip: int = 512) -> DataFrame:
    """``query_id, vec_id, similarity, rank``: the ``top`` rows with the highest cosine for each row of ``queries(vec_id, embedding)``, ties by id.

    An exact search in blocks: every part of the rows meets every block of queries in one
    task, ``strip`` queries at a time, which keeps the best of each query; only these are
    sorted and ranked. Vectors of length 0 are like nothing.
    """
    parts, blocks = max(1, -(-df.count() // part)), max(1, -(-queries.count() // block))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = df.select(deal(parts).alias("p"), every(blocks).alias("b"), F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    asked = queries.select(every(parts).alias("p"), deal(blocks).alias("b"), F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("query"))

    def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
        m = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
        length = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(length > 0, length, np.nan)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            ids, asked_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            own, q = unit_rows(left.column("embedding")).T, unit_rows(right.column("query"))
            for at in range(0, len(q), strip):
                sim = q[at : at + strip] @ own
                sim[np.isnan(sim)] = -np.inf
                k = min(top, sim.shape[1])
                least = np.partition(sim, -k, axis=1)[:, -k]  # the k-th best of each query; those equal to it are compared by id
                i, j = np.nonzero((sim >= least[:, None]) & (sim > -np.inf))
                order = np.lexsort((ids[j], -sim[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                for found, x in zip(out, (asked_ids[at + i[keep]], ids[j[keep]], sim[i[keep], j[keep]])):
                    found.append(x)
        return pa.table([np.concatenate(x) for x in out], ["query_id", "vec_id", "similarity"])

    best = rows.groupBy("p", "b").cogroup(asked.groupBy("p", "b")).applyInArrow(run, "query_id long, vec_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top)


def low_similarities(df: DataFrame, group: str, order: str, below: float, most: int) -> DataFrame:
    """The first ``most`` neighbours of each group whose similarity is below a limit: ``group, order, next_id, similarity, rank``."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return adjacent(df, group, order).where(F.col("similarity") < below).withColumn("rank", rank).where(F.col("rank") <= most)


def _unlike(x: np.ndarray, centres: list[np.ndarray]) -> list[np.ndarray]:
    """Squared distances of rows and centres, an array for each set of centres; the sets share one product."""
    every = np.concatenate(centres)
    d = np.maximum((x * x).sum(1)[:, None] + (every * every).sum(1) - 2.0 * (x @ every.T), 0.0)
    return np.split(d, np.cumsum([len(c) for c in centres])[:-1], axis=1)


def _doubles(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)


def summed(rows: DataFrame, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each set of centres: how many ``rows(embedding)`` are nearest to each centre, their sum, and the squared distances of the whole set; one pass for all sets."""
    sizes = [len(c) for c in centres]
    first, wide = np.cumsum([0, *sizes]), centres[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((first[-1], wide + 2))  # sums, then number and cost
        for batch in batches:
            if batch.num_rows:
                x = _doubles(batch)
                own = np.concatenate([x, np.ones((len(x), 1)), np.zeros((len(x), 1))], axis=1)
                for at, d in zip(first, _unlike(x, centres)):
                    near = d.argmin(1)
                    own[:, -1] = d[np.arange(len(x)), near]
                    one = (near[:, None] == np.arange(d.shape[1])).astype(np.float64)
                    total[at : at + d.shape[1]] += one.T @ own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))], ["centre", "total"])

    parts = rows.select("embedding").mapInArrow(run, "centre long, total array<double>")
    flat = parts.select("centre", F.posexplode("total").alias("d", "x")).groupBy("centre", "d").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros((first[-1], wide + 2))
    out[flat.column("centre").to_numpy(), flat.column("d").to_numpy()] = flat.column("x").to_numpy()
    return [(o[:, -2], o[:, :-2], float(o[:, -1].sum())) for o in np.split(out, first[1:-1])]


def lloyd(rows: DataFrame, starts: list[np.ndarray], rounds: int = 30, still: float = 1e-4) -> list[tuple[np.ndarray, float]]:
    """The centres that each set of ``starts`` comes to and the cost before its last move, as Spark's ``KMeans`` counts it.

    All sets that still move share a pass, so the passes over the vectors are ``rounds`` at most, however many sets there are.
    """
    out, moving = [(c, float("inf")) for c in starts], list(range(len(starts)))
    for _ in range(rounds):
        if not moving:
            break
        left = []
        for i, (n, total, cost) in zip(moving, summed(rows, [out[i][0] for i in moving])):
            before = out[i][0]
            after = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], before)
            out[i] = after, cost
            if ((after - before) ** 2).sum(1).max() > still**2:
                left.append(i)
        moving = left
    return out


def kmeans(rows: DataFrame, sizes: list[int], starts: int = 10) -> dict[int, np.ndarray]:
    """For each k of ``sizes`` the centres from the start with the least cost; ``rows(embedding, features)``. Starts are those of Spark's ``KMeans`` with the seeds from 0."""
    first = [np.array(KMeans(k=k, seed=seed, maxIter=0).fit(rows).clusterCenters()) for k in sizes for seed in range(starts)]
    ends = lloyd(rows, first)
    return {k: min(ends[i * starts : (i + 1) * starts], key=lambda e: e[1])[0] for i, k in enumerate(sizes)}


def predicted(rows: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """``vec_id, embedding`` and a column ``k`` and the number of each set of centres: the nearest of them."""
    names, sets = [f"k{k}" for k in centres], list(centres.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = [pa.array(d.argmin(1).astype(np.int32)) for d in _unlike(_doubles(batch), sets)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *near], [*batch.schema.names, *names])

    rows = rows.select("vec_id", "embedding")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, ", ".join([kinds, *(f"{n} int" for n in names)]))


def _with_features(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "embedding", array_to_vector("embedding").alias("features"))


def cluster_labels(df: DataFrame, k: int) -> DataFrame:
    """``vec_id, cluster`` of k clusters."""
    rows = _with_features(df).persist()
    out = predicted(rows, kmeans(rows, [k])).select("vec_id", F.col(f"k{k}").alias("cluster"))
    rows.unpersist()
    return out


def best_kmeans(df: DataFrame) -> DataFrame:
    """``vec_id, cluster, k, silhouette`` of the k from 2 to 7 with the highest silhouette (squared Euclidean), the last of equals."""
    rows = _with_features(df).persist()
    centres = kmeans(rows, list(range(2, 8)))
    found = predicted(rows, centres)
    judged = found.withColumn("features", array_to_vector("embedding")).persist()
    score, of = max((ClusteringEvaluator(predictionCol=f"k{k}").evaluate(judged), k) for k in centres)
    judged.unpersist()
    rows.unpersist()
    return found.select("vec_id", F.col(f"k{of}").alias("cluster"), F.lit(of).alias("k"), F.lit(float(score)).alias("silhouette"))


def components(df: DataFrame) -> DataFrame:
    """Two principal coordinates of each vector."""
    rows = df.select("vec_id", "label", array_to_vector("embedding").alias("features"))
    placed = PCA(k=2, inputCol="features", outputCol="p").fit(rows).transform(rows).withColumn("p", vector_to_array("p"))
    return placed.select("vec_id", "label", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
