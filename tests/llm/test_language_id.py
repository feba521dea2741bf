import numpy as np
from pyspark.sql import functions as F

from foliate.llm import language_id as g


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in g.new_parameters(3, hidden=4, seed=1).items()}
    x, y = rng.integers(0, 256, (6, 5)), rng.integers(0, 3, 5)
    _, grads = g.loss_and_gradients({k: v.astype(np.float32) for k, v in p.items()}, x, y)
    for k in p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), p[k].shape)
        losses = []
        for e in (1e-2, -1e-2):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += e
            losses.append(g.loss_and_gradients({n: v.astype(np.float32) for n, v in q.items()}, x, y)[0])
        assert abs((losses[0] - losses[1]) / 2e-2 - grads[k][at]) < 0.05 * abs(grads[k][at]) + 1e-4, k


def slow_states(p, d, data):
    """The recurrence spelled out in doubles, one byte at a time."""
    w, u, b = (p[k + d].astype(np.float64) for k in ("wx", "u", "b"))
    n = len(b)
    h, out = np.zeros(n), [None] * len(data)
    for t in reversed(range(len(data))) if d == "b" else range(len(data)):
        x, g = w[data[t]], h @ u
        z, r = (np.clip(0.2 * (x[i : i + n] + g[i : i + n]) + 0.5, 0, 1) for i in (0, n))
        a = x[2 * n :] + r * (g[2 * n :] + b)
        h = z * h + (1 - z) * a / (1 + np.abs(a))
        out[t] = h
    return np.array(out)


def test_pooling_against_the_recurrence_spelled_out():
    p = g.new_parameters(3)
    rng = np.random.default_rng(0)
    texts = [rng.integers(32, 127, n).astype(np.uint8) for n in (0, 1, 127, 128, 129, 150, 1000)]
    raw, offsets = np.concatenate(texts), np.cumsum([0, *map(len, texts)])
    got = g.document_probabilities(p, raw, offsets)
    for t, row in zip(texts, got):
        total = np.zeros(3)
        for i in range(0, len(t), g.SEGMENT):
            lo, hi = max(0, i - g.CONTEXT), min(len(t), i + g.SEGMENT + g.CONTEXT)
            states = np.concatenate([slow_states(p, d, t[lo:hi]) for d in "fb"], 1)
            e = np.exp(states @ p["wo"].astype(np.float64) + p["bo"])
            total += (e / e.sum(1, keepdims=True))[i - lo : i - lo + g.SEGMENT].sum(0)
        assert np.allclose(row, total / max(len(t), 1), atol=1e-4)


def test_a_huge_text_is_read_whole(spark):
    model = g.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 3000 and lang is not null")
    langs = {r["lang"]: r["text"] for r in rows.collect()}
    (a, x), (b, y) = sorted(langs.items())[:2]
    docs = spark.createDataFrame([(1, x * 300 + y * 20), (2, x * 20 + y * (300 * len(x) // len(y)))], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in g.identify(docs, model).collect()} == {1: a, 2: b}


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = g.learn(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "é"), (4, "é")], "doc_id long, text string").withColumn("score", F.lit(1))
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in g.identify(odd, model).collect()]
    assert got[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and got[3] == got[4] and got[3][1] in model[0]
    pred = g.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(g.held_out(F.col("doc_id")))
    right, n = pred.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.97
    assert g.learn(docs.limit(0)) is None and {r[0] for r in g.identify(odd, None).select("lang_pred").collect()} == {"und"}
