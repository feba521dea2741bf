"""Max-min chunks and anchored sections against loops."""

import numpy as np
import pytest

from foliate.operators import semantic


def loop(u, most, first, hard, factor):
    out, chunk = [0], [0]
    for i in range(1, len(u)):
        best = max(float(u[i] @ u[j]) for j in chunk)
        pairs = [float(u[a] @ u[b]) for a in chunk for b in chunk if a < b]
        limit = max(hard, factor * min(pairs)) if pairs else first
        joins = len(chunk) < most and best >= limit
        chunk = [*chunk, i] if joins else [i]
        out.append(out[-1] + (not joins))
    return out


@pytest.mark.parametrize("block, most", [(4096, 6), (7, 6), (16, 3)])
def test_max_min(spark, block, most):
    rng = np.random.default_rng(3)
    rows, want = [], []
    for g in range(4):
        centre = np.repeat(rng.normal(0, 1, (12, 8)), rng.integers(1, 14, 12), 0)
        x = centre + rng.normal(0, 0.4, centre.shape)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        rows += [(f"g{g}", 3 * i, x[i].tolist()) for i in range(len(x))]
        want += [(f"g{g}", 3 * i, c) for i, c in enumerate(loop(u, most, 0.4, 0.3, 0.8))]
    df = spark.createDataFrame(rows, "g string, at long, embedding array<double>")
    got = sorted(tuple(r) for r in semantic.max_min_chunks(df, "g", "at", most, 0.4, 0.3, 0.8, block).collect())
    assert got == sorted(want) and max(c for _, _, c in got) > 10
    assert semantic.max_min_chunks(df.limit(0), "g", "at", most, 0.4, 0.3, 0.8).count() == 0


def test_anchored_sections(spark):
    rng = np.random.default_rng(1)
    words = ["Gold Coast is", "the gold coast", "GOLD COAST COLONY", "Malta", "nothing", "", None, "malta and Gold Coast"]
    rows = [(g, 2 * i, words[rng.integers(0, len(words))], (np.eye(3)[i // 6 % 3] + rng.normal(0, 0.5, 3)).tolist()) for g in range(3) for i in range(50)]
    names, want = ["Gold Coast", "Malta", "Nowhere"], []
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        u = np.array([r[3] for r in own])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        for name in names:
            said = [i for i, r in enumerate(own) if name.lower() in (r[2] or "").lower()]
            if not said:
                continue
            heads = [i for i in said if f"THE {name.upper()}" in own[i][2].upper() or f"{name.upper()} COLONY" in own[i][2].upper()]
            a = (heads or said)[0]
            first = last = a
            while first > 0 and (u[a] @ u[first - 1] > 0.6 or first - 1 in said):
                first -= 1
            while last + 1 < len(own) and (u[a] @ u[last + 1] > 0.6 or last + 1 in said):
                last += 1
            want.append((g, name, a + 1, first + 1, last + 1))
    df = spark.createDataFrame(rows, "g int, at long, text string, embedding array<double>")
    found = semantic.anchored_sections(df, spark.createDataFrame([(n,) for n in names], "name string"), "g", "at", 0.6).collect()
    assert sorted(tuple(r)[:5] for r in found) == sorted(want)
    for r in found:
        for s in found:
            if r["g"] == s["g"] and r["first"] <= s["last"] and s["first"] <= r["last"]:
                assert r["section"] == s["section"]
