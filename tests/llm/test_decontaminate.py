import hashlib
import random
import re

from foliate.llm.decontaminate import decontaminate


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, bench):
    windows = {}
    for item, t in bench:
        w = words(t)
        n = min(10, len(w))
        for p in range(len(w) - n + 1) if n and item is not None else []:
            windows.setdefault(tuple(w[p : p + n]), set()).add(item)
    out = []
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(g) for g in windows}:
            for p in range(len(w) - n + 1):
                if found := windows.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    items |= found
        ids = ",".join(sorted(map(str, items)))
        out.append((i, len(w), len(hit), len(items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}é" for i in range(40)] + ["A", "b9"]
    bench = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 9, 10, 11, 30, 60])))) for i in range(25)]
    bench += [(7, bench[0][1]), (90, None), (91, "..."), (None, "a b9 a"), (92, bench[5][1])]
    docs = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 9, 40, 200]))]
        for _ in range(rng.choice([0, 1, 3])):
            b = words(rng.choice(bench)[1])
            lo = rng.randrange(len(b) + 1)
            p = rng.randrange(len(w) + 1)
            w[p:p] = b[lo : lo + rng.choice([5, 9, 10, 14, 99])]
        docs.append((i, rng.choice([" ", "-", ".\n"]).join(x.upper() if rng.random() < 0.1 and x.isascii() else x for x in w)))
    docs += [(200, None), (201, ""), docs[3], docs[4], (None, docs[5][1])]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, pos string")
    b = spark.createDataFrame(bench, "item_id long, text string")
    assert sorted(map(tuple, decontaminate(d, b).collect()), key=str) == brute(docs, bench)
    assert decontaminate(d.limit(0), b).count() == 0
    clean = decontaminate(d, b.limit(0))
    assert clean.where("n_hit > 0 or contaminated").count() == 0 and clean.count() == len(docs)
