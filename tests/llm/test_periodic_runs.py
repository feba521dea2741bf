"""Runs of words against a brute force over all starts and periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from foliate.llm import periodic_runs as p


def brute_runs(w):
    """Every stretch with a period, extended as far as it goes; the smallest period of each stretch."""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def brute(rows):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            period = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % period] for i, x in enumerate(w)]
        runs = sorted(brute_runs(w), key=lambda r: (r[0], r[2]))
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{a},{n},{q}\n" for a, n, q in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


def texts(rng):
    def words(n, k):
        return " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(n))

    yield from (None, "", " \t\n ", "one", "a a a a a", "a a a a a a", "ab\x0bab\x0cab ab\rab ab", "é é é é é é é é é é é é", "a b a b a b a", "a b a b a b a b")
    for k in (1, 2, 3, 5, 20):
        for n in (7, 30, 101, 300):
            yield words(n, k)
    for _ in range(60):  # periodic stretches between words, some of them side by side, or periodic in themselves
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(words(rng.randrange(0, 12), 20))
            unit = words(rng.randrange(1, 9), rng.choice([2, 20]))
            parts.append(" ".join([unit] * rng.randrange(1, 9)))
        yield "\n".join(parts)


def test_brute_force(spark, monkeypatch):
    monkeypatch.setattr(p, "_TOGETHER", 50)
    rng = random.Random(7)
    rows = list(enumerate(texts(rng)))
    rows += [(i, "x y z " * 40 + "q") for i in range(1000, 1060)] + [(7, "twice " * 9), (7, "twice " * 9), (None, "no id " * 8)]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id long, text string, runs string, start int")
    got = sorted(map(tuple, p.periodic_runs(docs).drop("runs", "collapsed").collect()), key=str)
    assert got == brute(rows)
    assert p.periodic_runs(docs.limit(0)).count() == 0


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(map(tuple, p.op12_repeated_grams(spark, sf).collect()), key=str)
    want = brute([r for r in rows if len(r[1] or "") < 12_000])
    assert {r for r in got if r[0] in {w[0] for w in want}} == set(want)
    assert len(got) == len(rows) and any(r[1] for r in got)


def test_false_hashes_are_found_out(monkeypatch):
    rng = np.random.default_rng(1)
    numbers = np.concatenate([np.tile(rng.integers(0, 9, 5), 9), rng.integers(0, 3, 400)])
    want = sorted((a, n, q) for a, n, q in brute_runs(numbers.tolist()))
    cut = np.array([0]), np.array([len(numbers)])
    assert sorted(zip(*map(np.ndarray.tolist, p.runs_of(numbers, *cut)))) == want
    monkeypatch.setattr(p.Ranges, "equal", lambda self, a, b, n: np.ones(len(a), bool))
    assert sorted(zip(*map(np.ndarray.tolist, p.runs_of(numbers, *cut)))) == want


@pytest.mark.parametrize("text", ["a " * 1_000_000, "a b c d e f g " * 150_000, " ".join(f"w{i % 997 * (i // 997 % 3)}" for i in range(600_000))])
def test_long_texts(spark, text):
    import time

    start = time.perf_counter()
    row = p.periodic_runs(spark.createDataFrame([(3, text)], "doc_id long, text string")).drop("collapsed", "runs").first()
    assert row["n_runs"] >= 0 and time.perf_counter() - start < 60


def test_overlap():
    assert p.overlap(6, 4) == 5 and p.overlap(4, 2) == 2 and p.overlap(8, 4) == 6
