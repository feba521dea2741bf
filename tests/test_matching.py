"""Matches, headings and named parts against Python's own regular expressions."""

import random
import re

from pyspark.sql import functions as F

from foliate.operators import matching as m

WORDS = ["FIJI.", "Fiji.", "**Gold Coast.**", "**NATAL.**", "Nowhere.", "HONG KONG.", "Hong Kong.", "\n", "\n", "\n\n", "\n\n---\n\n", " ", "text of it", "A. B.", "U.S. ", "é", "ST. HELENA.", "\t", "x,", "X, Y.", "*", "North\nBorneo."]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def samples():
    rng = random.Random(11)
    return ["".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 30))) for _ in range(700)] + [None, "", "\n", "FIJI.\n", "FIJI.\nFIJI.\n\nFiji.\n"]


def test_matches(spark):
    texts = samples()
    for pattern, groups in ((r"[A-Z]+\.", 0), (r"(?s)([a-z]+).(\n|.)", 2), (r"\n+", 0)):
        got = sorted(tuple(r) for r in m.matches(docs(spark, texts), pattern, groups).collect())
        want = sorted((i, n, x.start(), x.end(), x[0], *x.groups()) for i, t in enumerate(texts) if t for n, x in enumerate(re.finditer(pattern, t)))
        assert got == want


def test_headings(spark):
    texts, want = samples(), []
    caps = re.compile(r"(?m)^(?:\*\*)?([A-Z][A-Z\s\-'&,]+)\.(?:\*\*)?(?=\n{1,2})")
    title = re.compile(r"(?m)^(?:\*\*)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\.(?:\*\*)?(?=\n{1,2})")
    for i, t in enumerate(texts):
        found = [(x.start(1), x, "capitals") for x in caps.finditer(t or "")]
        seen = {x[0] for x in found}
        found += [(x.start(1), x, "title") for x in title.finditer(t or "") if x.start(1) not in seen and x[1].strip().upper() in m.TITLE_NAMES]
        found.sort(key=lambda x: x[0])
        for k, (start, x, kind) in enumerate(found):
            content = x.end() + (2 if t[x.end() :][:2] == "\n\n" else 1)
            want.append((i, x[1].strip(), kind, start, content, found[k + 1][0] if k + 1 < len(found) else len(t)))
    assert sorted(tuple(r) for r in m.headings(docs(spark, texts)).collect()) == sorted(want) and len(want) > 100


def test_named_parts(spark):
    texts, want = samples(), []
    pattern = re.compile(r"([A-Z\s,]+)\.\s+(.*?)(?=\s+[A-Z\s,]+\.\s+|\Z)", re.DOTALL)
    for i, t in enumerate(texts):
        parts, seen = {}, {}
        for x in pattern.finditer((t or "").replace("\n\n---\n\n", "\n\n")):
            name = x[1].strip()
            parts[name] = (x.start(), f"{name}.\n\n{x[2].strip()}")
            seen[name] = seen.get(name, 0) + 1
        want += [(i, n, s, seen[n], b) for n, (s, b) in parts.items()]
    assert sorted(tuple(r) for r in m.named_parts(docs(spark, texts)).collect()) == sorted(want) and len(want) > 100


def test_long_text_and_section(spark):
    text = "HONG KONG.\n\n" + "Some words of it. " * 60_000 + "\n\nFIJI.\n\nend"
    rows = m.headings(docs(spark, [text])).orderBy("start").collect()
    assert [(r["heading"], r["end"]) for r in rows] == [("HONG KONG", text.index("FIJI")), ("FIJI", len(text))]
    assert [r["name"] for r in m.named_parts(docs(spark, [text])).orderBy("start").collect()] == ["HONG KONG", "FIJI"]
    cut = lambda *a: m.section(docs(spark, ["abcdef", None]), *a).orderBy(F.desc("text")).first()["text"]
    assert (cut(), cut(2), cut(2, 4), cut(9, 12)) == ("abcdef", "cdef", "cd", "")


def test_named_parts_search_a_text_once(spark):
    rng = random.Random(3)
    pieces = ["A", "GOLD COAST", "B, C", ".", ". ", ".\n", " ", "\n\n", "\n\n---\n\n", "text", "x.", "É", "\t", "D.\n\n", "𝄞 "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 40))) for _ in range(300)] + [None, "", "A. ", " . ", "A.", "A. b\nC. "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = m.named_parts(docs)
    want = {}
    for i, t in enumerate(texts):
        for x in re.finditer(r"(?s)([A-Z\t-\r ,]+)\.[\t-\r ]+(.*?)(?=[\t-\r ]+[A-Z\t-\r ,]+\.[\t-\r ]+|\Z)", (t or "").replace("\n\n---\n\n", "\n\n")):
            name = x[1].strip("\t\n\v\f\r ")
            seen = want.get((i, name), (0, 0, 0))[1]
            want[i, name] = x.start(), seen + 1, name + ".\n\n" + x[2].strip("\t\n\v\f\r ")
    assert {(r["doc_id"], r["name"]): (r["start"], r["seen"], r["text"]) for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
