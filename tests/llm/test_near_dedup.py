import random
import re

import numpy as np

from foliate.llm import near_dedup
from foliate.llm.common import byte_view, components
from foliate.llm.near_dedup import banding, distinct, near_duplicates, shingles, superminhash


def shingle_set(t, k):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t, k)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}é" if i % 3 else f"W{i}" for i in range(300)]
    rows, n = [], 0
    for base in range(12):
        words = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 40, 120, 300]))]
        for _ in range(rng.choice([1, 2, 30])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((n := n + rng.randrange(1, 4), rng.choice([" ", "\t", "\n "]).join(copy)))
    rows += [(n + 1, None), (n + 2, ""), (n + 3, " \n "), (n + 4, "one"), (n + 5, "ONE"), (n + 6, "one two"), (n + 6, "one two")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, component_id string, rep int")
    for k, percent in ((3, 85), (5, 80)):
        got = sorted(map(tuple, near_duplicates(docs, k, percent).collect()))
        assert got == brute(rows, k, percent)
    assert near_duplicates(docs.limit(0), 3, 85).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert sorted(map(tuple, near_duplicates(nulls, 3, 85).collect()), key=str) == [(1, 2, 1, True), (None, 2, None, True)]


def test_signatures_estimate_similarity():
    import pyarrow as pa

    words = [f"w{i}" for i in range(600)]
    a, b = " ".join(words[:500]), " ".join(words[50:550])
    h, rows = shingles(*byte_view(pa.array([a, b])), 1)
    _, h, rows = distinct(h, rows)
    sig = superminhash(h, rows, 2)
    assert abs((sig[0] == sig[1]).mean() - 450 / 550) < 0.12
    assert (sig < 2**31).all() and len(np.unique(sig[0] >> 24)) < 6  # early stopping: few ranks are needed


def test_banding():
    assert banding(0.85) == (25, 5) and banding(0.8) == (32, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, j) for j in range(50, 90)] + [(200, 200), (201, 202)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 50 for i in [*range(50, 90), 100]}, 201: 201, 202: 201}


def test_crowded_buckets_against_brute_force(spark, monkeypatch):
    """Many documents on one template, unlike in the rest, with small groups of copies among them: every path beyond one block."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "PARTS", 2)
    monkeypatch.setattr(near_dedup, "LARGE", 4)
    rng = random.Random(8)
    template = [f"t{i}" for i in range(70)]
    rows = []
    for i in range(150):
        own = [f"o{i}x{j}" for j in range(22)]
        rows.append((len(rows), " ".join(template + own)))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            rows.append((len(rows), " ".join(template[:-1] + [rng.choice("ab")] + own)))
    rows += [(len(rows) + i, " ".join(template)) for i in range(9)]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = [(i, t) for i, (_, t) in zip(ids, rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 3, 85)
    assert sorted(map(tuple, near_duplicates(docs, 3, 85).collect())) == want
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, near_duplicates(docs, 3, 85).collect())) == want


def test_rare_shingles_of_similar_sets_meet(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(x if rng.random() > 0.02 else f"n{i}" for x in base)) for i in range(60)] + [(100, "a b"), (101, "a b c d")]
    found = near_dedup.rare_shingles(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    own = {}
    for r in found:
        own.setdefault(r["doc"], set()).add(r["bucket"])
    sets = {i: shingle_set(t, 3) for i, t in rows}
    for i, a in sets.items():
        assert len(own[i]) == len(a) - -(-len(a) * 85 // 100) + 1
        assert all(own[i] & own[j] for j, b in sets.items() if 100 * len(a & b) >= 85 * len(a | b))
