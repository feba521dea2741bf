"""Repeated passages against a count of all windows; the index against plain search."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from foliate.llm import fm_index as f
from tests.oracle import compare, connect


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, split):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def rows(rng):
    words = lambda n, k=3000: [f"w{rng.randrange(k)}" for _ in range(n)]
    passages = [words(n) for n in (34, 35, 36, 80, 300)]
    line = words(20)  # shorter than a window, in many contexts
    out = []
    for i in range(120):
        parts = [words(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passages), words(rng.randrange(0, 40))]
        if i % 3 == 0:
            parts += [line, words(30)]
        if i % 10 == 0:
            parts += [words(1) * 60, words(9, 2) * 8]  # repeats inside a text
        out.append((i, rng.choice(["\n", " ", " \t"]).join(x for p in parts for x in p)))
    out += [(200 + i, out[5][1]) for i in range(40)] + [(300, None), (301, ""), (302, " \n"), (303, "ü " * 35), (304, "ü\x0b" * 34), (3, out[4][1]), (6, out[6][1]), (None, out[7][1]), (None, "alone " + out[8][1])]
    return out


@pytest.mark.parametrize("bits, shard, crowd", [(1 << 20, 700, 2048), (64, 3000, 2048), (1 << 20, 3000, 5)])
def test_brute_force(spark, monkeypatch, bits, shard, crowd):
    """With a bitmap, with a shuffled join, and with common lines as crowds."""
    monkeypatch.setattr(f, "SHARD", shard)
    monkeypatch.setattr(f, "CROWD", crowd)
    data = rows(random.Random(3))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], "doc_id long, text string, words string, n int")
    got = sorted(map(tuple, f.deduplicate(docs, bits, with_text=False).collect()), key=str)
    assert got == brute(data, f.WINDOW)
    assert f.deduplicate(docs.limit(0), bits).count() == 0


def test_very_long_text(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(400))
    long = " ".join(f"w{rng.randrange(90_000)}" for _ in range(300_000))
    data = [(0, long + " " + passage + " " + "again " * 50_000), (1, passage)]
    got = sorted(map(tuple, f.deduplicate(spark.createDataFrame(data, "doc_id long, text string"), with_text=False).collect()), key=str)
    assert got == brute(data, f.WINDOW)


@pytest.mark.parametrize("seed", range(4))
def test_index_counts_like_plain_search(seed):
    rng = np.random.default_rng(seed)
    window, sizes = 5, rng.integers(5, 40, 60)
    parts = [rng.integers(1, (3, 9, 2, 40)[seed], n) for n in sizes]
    weights = rng.integers(1, 3, len(parts))
    index = f.Index(np.concatenate(parts), sizes, weights, window)
    text = np.concatenate([np.append(p, 0) for p in parts])
    symbols = np.arange(int(text.max()) + 1)
    wavelet = f.Wavelet(text, int(text.max()).bit_length())
    for place in (0, 1, 63, 64, 65, len(text) // 2, len(text)):
        assert (wavelet.rank(symbols, np.full(len(symbols), place)) == [(text[:place] == c).sum() for c in symbols]).all()
    count = Counter()
    for p, n in zip(parts, weights):
        for i in range(len(p) - window + 1):
            count[tuple(p[i : i + window])] += n
    first, last = index.repeated(np.concatenate(parts), sizes)
    for p, a, b in zip(parts, first, last):
        hits = [i for i in range(len(p) - window + 1) if count[tuple(p[i : i + window])] > 1]
        assert (a, b) == ((hits[0], hits[-1]) if hits else (-1, -1))


def test_every_window_is_in_one_segment():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 34, 35, 36, 500, 20)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    row, first, windows, a, b, _, _, h, of = f.cut_segments(raw, np.append(0, np.cumsum([len(t) for t in texts])))
    seen = sorted((r, i) for r, x, n in zip(row, first, windows) for i in range(x, x + n))
    assert seen == [(r, i) for r, t in enumerate(texts) for i in range(len(t.split()) - f.WINDOW + 1)]
    for n, x, y in zip(windows, a, b):
        assert len(raw[x:y].tobytes().split()) == n + f.WINDOW - 1 <= 2 * f.WINDOW - f.GRAM


def test_matches_sql(spark, sf):
    assert compare(spark, connect(sf), f.op13_fm_index, f.ORACLE_SQL, sf) == ""
