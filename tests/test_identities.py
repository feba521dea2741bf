"""Entries, sorted neighbourhoods and persons against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliate.operators import identities as ids
from foliate.operators import ordering


@pytest.mark.parametrize("parts, block, adaptive", [(1, 1000, "true"), (8, 7, "true"), (8, 7, "false"), (5, 3, "true")])
def test_places_and_neighbours(spark, parts, block, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rng = random.Random(parts)
        values = sorted({(rng.choice("ab"), rng.randrange(90)) for _ in range(120)})
        rows = spark.createDataFrame(rng.sample(values, len(values)), "k string, v int")
        placed = ordering.placed(rows, "k", "v", parts=parts)
        assert [(r["k"], r["v"]) for r in placed.orderBy("place").collect()] == values
        assert sorted(r["place"] for r in placed.collect()) == list(range(1, len(values) + 1))
        got = sorted((tuple(r["a"]), tuple(r["b"])) for r in ordering.neighbours(placed, 3, block).collect())
        assert got == sorted((values[i], values[j]) for i in range(len(values)) for j in range(i + 1, min(i + 4, len(values))))
        assert ordering.placed(rows.limit(0), "k", "v").count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


VOLUME = """Preface, not an entry
SMITH, NOT IN A SECTION. text
RECORD OF SERVICES.
CURZON, GEORGE N. Entered the service in 1880.
Posted to Bengal.

O'NEIL-HART, A. B.
 Joined 1881.
lower, case is no heading
DESCRIPTION OF SERVICES
DE LA RUE, JEAN. One line"""


def test_entries(spark):
    volumes = spark.createDataFrame([(3, VOLUME), (4, None), (5, ""), (6, "RECORD OF SERVICES\nno entry")], "doc_id long, text string")
    got = ids.entries(volumes).orderBy("entry_no").collect()
    assert [(r["section_title"], r["name_heading"], r["surname"], r["given"]) for r in got] == [
        ("RECORD OF SERVICES", "CURZON, GEORGE N", "CURZON", "GEORGE N"), ("RECORD OF SERVICES", "O'NEIL-HART, A. B", "O'NEIL-HART", "A B"), ("DESCRIPTION OF SERVICES", "DE LA RUE, JEAN", "DE LA RUE", "JEAN"),
    ]
    assert got[0]["entry_text"] == "Entered the service in 1880.\nPosted to Bengal." and got[2]["entry_text"] == "One line"
    assert VOLUME[got[1]["start"] :].startswith("O'NEIL") and VOLUME[: got[2]["end"]] == VOLUME


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(row[j + 1] + 1, now[-1] + 1, row[j] + (x != y)))
        row = now
    return row[-1]


def brute(rows):
    def code(s):
        letters = re.sub("[^A-Z]", "", s)
        return letters[:1] + re.sub("[AEIOUHWY]", "", letters[1:])[:3]

    names = sorted({(s, g) for _, _, s, g in rows})
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for key in (lambda n: (code(n[0]), n[0], n[1]), lambda n: (code(n[0]), n[1], n[0])):
        order = sorted(names, key=key)
        for i, a in enumerate(order):
            for b in order[i + 1 : i + 1 + ids.WIDTH]:
                like = round(1 - (edits(a[0], b[0]) + edits(a[1], b[1])) / (max(len(a[0]), len(b[0])) + max(len(a[1]), len(b[1]))), 4)
                initial = a[0] == b[0] and min(len(a[1]), len(b[1])) == 1 and a[1][0] == b[1][0]
                if code(a[0]) == code(b[0]) and (like >= ids.LEAST or initial):
                    parent[root(a)] = root(b)
    first = {}
    for v, e, s, g in rows:
        r = root((s, g))
        first[r] = min(first.get(r, (v, e)), (v, e))
    return sorted((v, e, *first[root((s, g))]) for v, e, s, g in rows)


def test_persons(spark):
    rng = random.Random(5)
    surnames = ["SMITH"] * 30 + ["SMYTHE", "SMITHE", "CURZON", "CURSON", "BROWN", "BROWNE", "O'NEIL"]
    given = ["GEORGE", "GEORGES", "G", "J", "JOHN", "JOHAN", "MARY ANN", "MARY", "A"]
    letter = lambda s: "".join(rng.choice("AEKLMNORST") if rng.random() < 0.05 else c for c in s)
    rows = [(i % 7, i, letter(rng.choice(surnames)), letter(rng.choice(given))) for i in range(400)]
    found = spark.createDataFrame(rows, "volume long, entry_no int, surname string, given string")
    got = ids.persons(found, F.col("volume") + 1886, block=11)
    assert sorted((r["volume"], r["entry_no"], r["person_volume"], r["person_entry"]) for r in got.collect()) == brute(rows)
    assert {r["confidence"] for r in got.collect()} <= {1.0} | {r["likeness"] for r in ids.links(found).collect()}
    assert {r["code"]: (r["names"], r["entries"]) for r in ids.blocks(found).collect()}["SMT"][1] > 200
    assert ids.persons(found.limit(0), F.col("volume")).count() == 0


def test_a_part_of_a_name_ends_before_a_letter_of_any_script(spark):
    text = "RECORD OF SERVICES\nSMITH, Gérard joined\nJONES, ANNÉE. left\nBROWN, JOHN Q.\nGREEN, A1"
    rows = ids.entries(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("entry_no").collect()
    assert [(r["name_heading"], r["entry_text"]) for r in rows] == [("SMITH, G", "érard joined"), ("JONES, ANN", "ÉE. left"), ("BROWN, JOHN Q", ""), ("GREEN,", "A1")]
