import hashlib
import random
import re
import struct

import xxhash

from pyspark.sql import functions as F

from foliate.llm import imatch
from foliate.llm.imatch import fingerprints, with_edited


def test_edited_text_and_likeness(spark):
    rng = random.Random(9)
    vocab = [f"w{i}é" for i in range(3000)]
    rows = [(i * 3, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 20, 90, 200])))) for i in range(120)]
    rows += [(1000, None), (1001, ""), (1002, rows[4][1]), (1003, rows[4][1].upper()), (1003, rows[4][1].upper()), (1004, "!!")]
    shuffled = rng.sample(rows, len(rows))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in shuffled], "doc_id long, text string, h string, id int")
    got = with_edited(docs).collect()
    assert len(got) == len(rows)
    order = sorted(set((i, t or "") for i, t in rows))
    follows = {order[k]: order[(k + 1) % len(order)] for k in range(len(order))}
    texts, prints = {i: t or "" for i, t in rows}, {}
    for r in got:
        t = texts[r["doc_id"]]
        half = len(t) // 2
        nxt = follows[r["doc_id"], t][1]
        edited = t[: len(t) - half] + nxt[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        if edited == t:
            assert r["near_edited"] == 1.0 and r["edited_fingerprint"] == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long = [r for r in got if r["n_chars"] > 400]
    assert sum(r["near_edited"] for r in long) > 3 * sum(r["near_next"] for r in long)
    assert prints[rows[4][1]] == prints[rows[4][1].upper()] and prints[""] != prints["!!"]
    assert with_edited(docs.limit(0)).count() == 0


def test_one_document_follows_itself(spark):
    r = with_edited(spark.createDataFrame([(None, "ab cd")], "doc_id long, text string")).first()
    assert r["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()


def test_fingerprints_native(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    out = with_edited(docs)
    assert out.count() == docs.count()
    assert out.agg(F.avg("near_edited") > F.avg("near_next")).first()[0]


def signed64(x):
    return struct.unpack("<q", struct.pack("<Q", x))[0]


def brute_fingerprint(text, lexicon):
    """The lexicon's terms in each randomised subset, as sets; None for a text without any."""
    own = {w for w in re.split(r"[\W_]+", text.lower()) if w in lexicon}
    if not own:
        return None
    out = [set() for _ in range(imatch.SUBSETS)]
    for w in own:
        term = xxhash.xxh64_intdigest(w.encode(), 42)
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", term), 42)
        at = used = 0
        bits = (1 << 64) - 1
        for n, power in imatch.DENSITIES:
            for i in range(used, power):
                bits &= xxhash.xxh64_intdigest(f"lexicon {i}".encode(), seed)
            for k in range(at, at + n):
                if bits >> k & 1:
                    out[k].add(w)
            at, used = at + n, power
    return out


def brute_likeness(a, b, same):
    if a is None and b is None:
        return float(same)
    none = [set()] * imatch.SUBSETS
    pairs = [(x, y) for x, y in zip(a or none, b or none) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else float(a == b)


def test_signatures_and_likeness_against_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(900)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([3, 15, 60]))) for _ in range(150)]
    texts = [t if rng.random() < 0.6 else t + " " + rng.choice(base) for t in base] + ["", "unique words only here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = {}
    for t in texts:
        for w in {w for w in re.split(r"[\W_]+", t.lower()) if w}:
            df[w] = df.get(w, 0) + 1
    n = len(texts)
    lexicon = {w for w, c in df.items() if imatch.LOW * n <= c <= max(imatch.LEAST_HIGH, imatch.HIGH * n)}
    rows = {r["doc_id"]: r for r in with_edited(docs).collect()}
    for i, t in enumerate(texts):
        nxt, half = texts[(i + 1) % n], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        f, e, g = (brute_fingerprint(x, lexicon) for x in (t, edited, nxt))
        assert abs(rows[i]["near_edited"] - brute_likeness(f, e, t == edited)) < 1e-12, i
        assert abs(rows[i]["near_next"] - brute_likeness(f, g, t == nxt)) < 1e-12, i


def test_the_query_has_no_python_in_its_plan(spark, sf):
    plan = with_edited(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_very_long_text(spark):
    text = " ".join(f"t{i % 5000}" for i in range(200_000))
    got = {r["doc_id"]: r for r in with_edited(spark.createDataFrame([(1, text), (2, "t1 t2"), (3, text)], "doc_id long, text string")).collect()}
    assert got[1]["n_chars"] == len(text) and got[1]["fingerprint"] == got[3]["fingerprint"] != got[2]["fingerprint"]


def test_the_shuffled_way_beyond_the_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(2))
    want = sorted(map(str, imatch.with_edited(docs).collect()))
    monkeypatch.setattr(imatch, "BROADCAST_ROWS", -1)
    assert sorted(map(str, imatch.with_edited(docs).collect())) == want and len(want) == docs.count()


def test_rows_without_a_term_share_no_key(spark, monkeypatch, capsys):
    monkeypatch.setattr(imatch, "BROADCAST_ROWS", -1)
    n = 2_000
    split = spark.range(n).select("id", F.lit(1).alias("h"), F.explode(F.array(F.col("id") % 7, F.lit(None).cast("long"))).alias("term"))
    words = spark.createDataFrame([(1,), (2,)], "term long")
    rows = imatch.in_lexicon(split, words)
    got = rows.groupBy("term").count().collect()
    assert {r["term"]: r["count"] for r in got} == {None: n, 1: len(range(1, n, 7)), 2: len(range(2, n, 7))}
    rows.explain()
    assert "coalesce(term" in capsys.readouterr().out
