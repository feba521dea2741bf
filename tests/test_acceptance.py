"""Gates, types, expected names and the parts between boundaries, by hand."""

import random

from foliate.operators import acceptance as ac
from foliate.operators import hierarchy as h


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def volume(*parts):
    return "\n".join(f"{name}.\nSituation and Area\n{'x' * size}" for name, size in parts)


GOOD = volume(*[(n, 6000) for n in ("ONTARIO", "QUEBEC", "NOVA SCOTIA", "MANITOBA", "BERMUDA", "HONG KONG", "JAMAICA", "GIBRALTAR", "MAURITIUS", "BASUTOLAND")])
BAD = volume(("CEYLON", 900), ("CEYLON", 3000), ("SENATE OF CANADA", 2000), ("PRIME MINISTER'S ISLAND", 2000), ("BRAZIL", 2000))


def test_gates_by_hand(spark):
    measured = ac.measures(docs(spark, [GOOD, BAD, "no headings at all", "", None]))
    got = {}
    for r in ac.gates(measured).collect():
        got.setdefault(r["doc_id"], {})[r["gate"]] = (r["value"], r["passed"])
    assert set(got) == {0, 1} and set(got[0]) == set(ac.GATES)
    assert {g for g, (_, ok) in got[0].items() if not ok} == set()
    assert (got[0]["grouped_provinces"], got[0]["expected_percent"], got[0]["types_percent"]) == ((4.0, True), (75.0, True), (100.0, True))
    assert {g for g, (_, ok) in got[1].items() if not ok} == {"grouped_provinces", "offices_as_territories", "same_names", "known_twice", "least_size", "expected_percent"}
    assert got[1]["types_percent"] == (100.0, True) and got[1]["same_names"] == (1.0, False) and got[1]["offices_as_territories"] == (2.0, False)
    rows = {r["doc_id"]: r for r in ac.mended(measured).collect()}
    assert rows[0]["overall"] and not rows[1]["overall"] and rows[1]["duplicates"]
    one = {r["doc_id"]: r for r in measured.collect()}[1]
    assert (one["territories"], one["damaged_names"], one["small"]) == (5, 3, 5)  # the last three letters of CEYLON and BRAZIL have an L


def test_expected_names(spark):
    got = {r["name"]: (r["verdict"], r["volumes"]) for r in ac.expectations(docs(spark, [GOOD, GOOD, BAD])).collect()}
    assert got["HONGKONG"] == ("found", 2) and got["BRITISHGUIANA"] == ("missing", 0) and got["CEYLON"] == ("more", 1) and got["DOMINIONOFCANADA"] == ("more", 2)


def test_header_types(spark):
    names = ["DOMINION OF NEWLAND", "THE LEEWARD ISLANDS", "NOVA SCOTIA", "BISHOPS OF MALTA", "HONG KONG"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in rows.select(ac.header_type(rows["name"])).collect()] == ["dominion", "dominion", "province", "administrative", "crown_colony"]


def test_segments_end_where_the_next_begins(spark):
    text = "before\nFIRST LAND.\na\nSituation and Area.\n\nSECOND LAND.\nend"
    rows = h.header_segments(docs(spark, [text])).orderBy("start").collect()
    assert [(r["name"], r["start"], r["end"], r["has_geography"]) for r in rows] == [("FIRST LAND", 7, text.index("SECOND"), True), ("SECOND LAND", text.index("SECOND"), len(text), False)]


def test_gaps_are_the_complement(spark):
    rng = random.Random(6)
    texts, marks, want = [], [], []
    for i in range(60):
        n = rng.randrange(0, 40)
        own = sorted({(a, min(n, a + rng.randrange(1, 9))) for a in (rng.randrange(0, max(1, n)) for _ in range(rng.randrange(0, 6))) if a < n})
        texts.append("x" * n)
        marks += [(i, a, b) for a, b in own]
        free = [not any(a <= p < b for a, b in own) for p in range(n)] if own else []
        runs = [p for p in range(n) if own and free[p] and (p == 0 or not free[p - 1])]
        for k, p in enumerate(runs):
            stop = next((q for q in range(p, n) if not free[q]), n)
            want.append((i, k, "tail" if stop == n else "head" if p == 0 else "between", p, stop))
    marks.append((0, *marks[0][1:])) if marks[0][0] == 0 else None
    rows = spark.createDataFrame(marks, "doc_id long, first long, after long")
    got = sorted(tuple(r) for r in ac.gaps(docs(spark, texts), rows).collect())
    assert got == sorted(want)
    assert ac.gaps(docs(spark, texts), rows.limit(0)).count() == 0
