import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from foliate.llm import suffix_dedup as s


def brute(rows):
    first = {}
    docs = sorted(set(rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0]))
    gone = {r: set() for r in docs}
    for r in docs:
        b = (r[1] or "").encode()
        for i in range(len(b) - 99):
            if first.setdefault(b[i : i + 100], (r, i)) != (r, i):
                gone[r].update(range(i, i + 100))
    out = []
    for r in rows:
        b, g = (r[1] or "").encode(), gone[r]
        rest = bytes(x for i, x in enumerate(b) if i not in g)
        out.append((r[0], len(b), len(g), sum(i - 1 not in g for i in g), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 15, 0])
def test_against_brute_force(spark, bits):
    rng = random.Random(11)
    words = [rng.choice(["é", ""]) + "".join(rng.choice("abcdeß") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [prose(40) for _ in range(6)] + ["ab" * 90, "z" * 260]
    rows = []
    for i in range(60):
        t = prose(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            part = rng.choice(shared)
            cut = rng.randrange(len(part))
            t += rng.choice(["", " "]) + part[max(0, cut - rng.randrange(60, 200)) : cut + rng.randrange(60, 200)] + prose(rng.randrange(10))
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, rows[3][1]), (103, rows[3][1] + "x"), (5, rows[5][1]), (None, shared[0]), (104, "q" * 99)]
    docs = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, pos int, kept string")
    got = s.deduplicate(docs, bits, with_text=False)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert s.deduplicate(docs.limit(0), bits).count() == 0


def test_entries_cover_every_string_once(monkeypatch):
    monkeypatch.setattr(s, "_PIECE", 700)
    rng = random.Random(4)
    text = ["".join(rng.choice("abc") for _ in range(n)) for n in (0, 50, 99, 100, 101, 650, 5000, 0, 120)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(text))), pa.array(text)], ["id", "text"])
    seen = []
    for part, raw, offsets, base in s.pieces(iter([batch])):
        row, anchor, lo, hi, _, _ = s.entries(raw, offsets)
        ids = part.column("id").to_numpy()[row]
        for i, a, x, y, o in zip(ids, anchor, lo, hi, offsets[row]):
            assert x <= a and y <= a and a + s.GRAM <= x + s.SPAN
            seen += [(i, base + p - o) for p in range(x, y + 1)]
    assert sorted(seen) == [(i, p) for i, t in enumerate(text) for p in range(len(t) - 99)]
    assert len(s.gram_hash(np.zeros(40, np.uint8))) == 9


def test_periodic_texts_are_few_entries(spark):
    rows = [(1, "z" * 3_000_000), (2, "ab" * 900_000), (3, "z" * 5_000), (None, "ab" * 80), (None, "c" + "ab" * 80), (4, "plain" * 3)]
    docs = s.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    assert s.all_entries(docs, None, False).count() < 500 and s.own_spans(docs).count() < 50
    got = {(r["doc_id"], r["n_bytes"]): (r["n_removed"], r["n_spans"]) for r in s.deduplicate(docs, with_text=False).collect()}
    # each string occurs first at the start of the first text that holds it
    assert got[1, 3_000_000] == (2_999_999, 1) and got[2, 1_800_000] == (1_800_000, 1) and got[3, 5_000] == (5_000, 1)
    assert sorted(v for k, v in got.items() if k[0] is None)[1] == (160, 1) and got[4, 15] == (0, 0)
