"""Clusters, coordinates and searches against brute force."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from foliate.operators import structure, vectors


def table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").limit(120).persist()
    rows = df.orderBy("vec_id").collect()
    return df, [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64)


def test_each_vector_is_with_its_nearest_centre(spark, sf):
    df, ids, x = table(spark, sf)
    own = {r["vec_id"]: r["cluster"] for r in vectors.cluster_labels(df, 3).collect()}
    label = np.array([own[i] for i in ids])
    centres = np.array([x[label == c].mean(0) for c in range(3)])
    assert (((x[:, None] - centres) ** 2).sum(2).argmin(1) == label).all()


def test_principal_coordinates(spark, sf):
    df, ids, x = table(spark, sf)
    got = {r["vec_id"]: (r["x"], r["y"]) for r in vectors.components(df).collect()}
    p = np.array([got[i] for i in ids])
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    cov = np.cov(p.T)
    assert np.allclose(np.diag(cov), values[:2], rtol=1e-6) and abs(cov[0, 1]) < 1e-6 * values[0]


def test_nearest_in_blocks(spark, sf):
    df, ids, x = table(spark, sf)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    asked = df.where("vec_id % 7 = 0")
    got = {}
    for r in vectors.nearest(df, asked, 5, part=30, block=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q, found in got.items():
        sim = u @ u[ids.index(q)]
        assert found == [ids[i] for i in np.lexsort((ids, -sim))[:5]]
    assert sorted(got) == [i for i in ids if i % 7 == 0]
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[:2] for r in vectors.nearest(zero, zero, 5).collect()] == [(2, 2)]
    assert vectors.nearest(df.limit(0), asked, 5).count() == 0


def test_page_breaks_and_headers(spark):
    import re

    texts = ["a\n\n\nb", "a\n \n\t\n\n b\n\n\n", "\n\n\nx\n\ny", "\n\n", "a\n\n\n", "", "\n\n\n", "CHAPTER IV\nTITLE OF IT ALL\n1. one\nMay, 1890\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["pos"]) for r in structure.page_breaks(docs).collect())
    assert got == [(i, m.start()) for i, t in enumerate(texts) for m in re.finditer(r"\n\s*\n\s*\n", t)]
    heads = {(r["text"], r["kind"]) for r in structure.header_positions(docs).where(F.col("doc_id") == 7).collect()}
    assert heads == {("CHAPTER IV", "title"), ("CHAPTER IV", "chapter"), ("TITLE OF IT ALL", "title"), ("1. one", "header"), ("May, 1890", "date")}


def test_nearest_sorts_only_what_can_be_best(spark):
    # many equal vectors, one of length 0, queries in several strips
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(rng.integers(-2, 3, (9, 4)), 40, 0), rng.integers(-2, 3, (90, 4)), np.zeros((1, 4))]).astype(float)
    x[:-1][~x[:-1].any(1)] = 1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.nearest(rows, rows.where("vec_id % 7 = 0"), 6, part=100, block=30, strip=8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["similarity"], r["vec_id"]
    u = x[:-1] / np.linalg.norm(x[:-1], axis=1, keepdims=True)
    for q in range(0, len(u), 7):
        sim = (u @ u[q]).round(9)
        own = [(round(s, 9), i) for _, (s, i) in sorted(got[q].items())]
        assert [s for s, _ in own] == sorted(sim, reverse=True)[:6] and all(sim[i] == s for s, i in own) and len({i for _, i in own}) == 6
    assert len(x) - 1 not in got


def test_all_starts_share_the_passes(spark, sf):
    df, ids, x = table(spark, sf)
    context = spark.sparkContext

    def jobs(name, run):
        context.setJobGroup(name, name)
        out = run()
        context.setJobGroup("", "")
        return out, len(context.statusTracker().getJobIdsForGroup(name))

    rows = df.select("vec_id", "embedding", array_to_vector("embedding").alias("features")).persist()
    rows.count()
    models, of_models = jobs("models", lambda: [KMeans(k=4, seed=s, maxIter=30).fit(rows) for s in range(10)])
    _, of_starts = jobs("starts", lambda: [KMeans(k=4, seed=s, maxIter=0).fit(rows) for s in range(10)])
    found, of_all = jobs("all", lambda: vectors.cluster_labels(df, 4))
    assert of_all < (of_models + of_starts) / 2
    # the same centres as Spark's from each start, so the same clusters from the best
    least = min(m.summary.trainingCost for m in models)
    own = {r["vec_id"]: r["cluster"] for r in found.collect()}
    best = [{r["vec_id"]: r["prediction"] for r in m.transform(rows).collect()} for m in models if m.summary.trainingCost <= least * (1 + 1e-9)]
    assert own in best
    ends = vectors.lloyd(rows, [np.array(KMeans(k=4, seed=s, maxIter=0).fit(rows).clusterCenters()) for s in range(3)])
    for m, (centres, cost) in zip(models, ends):
        assert np.allclose(np.array(m.clusterCenters()), centres, atol=1e-9) and np.isclose(m.summary.trainingCost, cost, rtol=1e-9)
    rows.unpersist()
