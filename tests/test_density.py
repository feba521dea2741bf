"""Density clusters and components against brute force."""

import numpy as np
import pytest

from foliate.operators import density, graphs


def brute(rows, eps, least):
    sound = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    u = np.array([v / np.sqrt((v * v).sum()) for _, v in sound])
    near = u @ u.T >= 1 - eps
    ids, core = [i for i, _ in sound], near.sum(1) >= least
    label = {k: ids[k] for k in np.flatnonzero(core)}
    changed = True
    while changed:
        changed = False
        for k in label:
            low = min(label[j] for j in np.flatnonzero(near[k] & core))
            if low < label[k]:
                label[k], changed = low, True
    out = {i: (i, None, False, 0) for i, _ in rows}
    for k, i in enumerate(ids):
        around = [label[j] for j in np.flatnonzero(near[k] & core)]
        out[i] = (i, label[k] if core[k] else min(around, default=None), bool(core[k]), int(near[k].sum()))
    return sorted(out.values())


def vectors(rng):
    centres = rng.normal(0, 1, (6, 16))
    rows = [rng.normal(0, 1, 16) for _ in range(60)]
    for i, c in enumerate(centres):
        rows += [c + rng.normal(0, 0.2 + 0.1 * i, 16) for _ in range(70)]
    rows += [c * w + centres[(k + 1) % 6] * (1 - w) for k, c in enumerate(centres) for w in np.linspace(0.1, 0.9, 9)]  # bridges
    rows += [rows[3]] * 5 + [rows[4]] * 3 + [rows[100]] * 150
    out = [(7 * i % 1009, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]
    return out + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15)]


@pytest.mark.parametrize("eps, least, block, part", [(0.3, 5, 64, 100), (0.15, 3, 30, 10_000), (0.05, 4, 2048, 8192), (0.9, 200, 100, 50)])
def test_brute_force(spark, monkeypatch, eps, least, block, part):
    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density, "VISITORS", part)
    monkeypatch.setattr(density, "_ROWS", 16)
    rows = vectors(np.random.default_rng(4))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(r) for r in density.density_clusters(df, eps, least).collect()), key=lambda r: r[0])
    assert got == brute(rows, eps, least)


def test_clusters_apart_meet_only_themselves(spark, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", 50)
    rng = np.random.default_rng(0)
    rows = [(100 * c + i, (np.eye(8)[c] + rng.normal(0, 0.01, 8)).tolist()) for c in range(8) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert density.visits(df, 0.01) < 4 * len(rows)  # all pairs of blocks would be 16 x 800 / 2
    assert {r["cluster"] for r in density.density_clusters(df, 0.01, 5).collect()} == set(range(0, 800, 100))
    assert density.density_clusters(df.limit(0), 0.3, 5).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200), (41, 300), (60, 41)]
    got = {r["id"]: r["component"] for r in graphs.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 41: 41, 300: 41, 60: 41}


def test_blocks_grow_and_batches_are_bounded(spark, monkeypatch):
    # 3,000 points are near each other: with blocks of a fixed size the rows sent would grow with the square
    monkeypatch.setattr(density, "BLOCK", 10)
    monkeypatch.setattr(density, "VISITORS", 40)
    monkeypatch.setattr(density, "_SENT", 100)
    rng = np.random.default_rng(1)
    sent = []
    for n in (300, 2400):
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(n, 8)))], "vec_id long, embedding array<double>")
        sent.append(density.visits(rows, 1.0) / n)
    assert sent[1] < 1.5 * sent[0] and density.block_sizes(300) == (10, 40) and density.block_sizes(2400) == (80, 320)
