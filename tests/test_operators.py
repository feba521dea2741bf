import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import hierarchy, packing, splitting, structure


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


TEXTS = ["", "a", "One. Two! Three?  Four", "x\n\ny\n", "TITLE LINE ONE\n| a | b |\n| c | d |\nText.", "é" * 2000 + ". " + "b" * 900, " . " * 700]


def test_lines_round_trip(spark):
    rows = splitting.line_table(frame(spark, TEXTS)).orderBy("doc_id", "line_no").collect()
    for i, t in enumerate(TEXTS):
        own = [r for r in rows if r["doc_id"] == i]
        assert "\n".join(r["line"] for r in own) == t
        assert all(t[r["start"] : r["start"] + len(r["line"])] == r["line"] for r in own)


def test_windows_cover_the_text_and_end(spark):
    for make in (lambda d: splitting.windows(d, 800, 200), splitting.sentence_windows):
        rows = make(frame(spark, TEXTS)).orderBy("doc_id", "chunk_index").collect()
        for i, t in enumerate(TEXTS):
            own = [r for r in rows if r["doc_id"] == i]
            assert bool(own) == bool(t)
            for a, b in zip(own, own[1:]):
                assert a["start_pos"] < b["start_pos"] <= a["end_pos"]
            assert not own or (own[0]["start_pos"] == 0 and own[-1]["end_pos"] == len(t))


def test_packing_keeps_units_and_limits(spark):
    docs = frame(spark, TEXTS)
    rows = packing.pack(docs, tx.sentences(F.col("text")), packing.before_limit(50, 1), " ").collect()
    for i, t in enumerate(TEXTS):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["chunk_index"])
        want = [s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]
        assert " ".join(r["text"] for r in own) == " ".join(want)
        assert all(r["size"] <= 50 or r["units"] == 1 for r in own)


def test_segments_do_not_depend_on_partitions(spark):
    docs = frame(spark, TEXTS)
    one, many = (sorted(map(tuple, structure.segments(docs.repartition(n)).collect())) for n in (1, 8))
    assert one == many and {r[2] for r in one} >= {"title", "table"}


def test_transition_samples(spark):
    text = "Foreign Consuls.\nGermany - A. B.\n\nHONG KONG.\n\nSituation and Area.\nmore\nForeign Consuls.\nx\nJAMAICA.\n"
    rows = hierarchy.boundaries(frame(spark, [text]), r"Consuls\.$", hierarchy.HEADING, 2000).orderBy("end_pos").collect()
    assert [(r["end_pos"], r["start_pos"]) for r in rows] == [(text.index("Foreign"), text.index("HONG")), (text.rindex("Foreign"), text.index("JAMAICA"))]


def test_nesting(spark):
    long = "The colony, population, government, judge, revenue, trade, railway, police, education, church, island. " * 20
    heads = ["DOMINION OF CANADA", "ONTARIO", "EXECUTIVE COUNCIL", "JAMAICA", "ANTIGUA", "EXPORTS"]
    found = hierarchy.blocks(frame(spark, ["\n\n".join(f"{x}.\n{long}" for x in heads)]))
    got = {r["heading"]: (r["territory_no"], r["role"]) for r in hierarchy.nested(hierarchy.classified(found)).collect()}
    assert got == {"DOMINION OF CANADA": (1, "territory"), "ONTARIO": (1, "subunit"), "EXECUTIVE COUNCIL": (1, "admin_section"), "JAMAICA": (2, "territory"), "ANTIGUA": (3, "territory")}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40))
def test_group_rule(lengths):
    """The fold's rule, spelled out: a unit opens a group if it would lift it beyond the limit."""
    groups, size = [], 0
    for n in lengths:
        if groups and size + 1 + n <= 50:
            groups[-1].append(n)
            size += 1 + n
        else:
            groups.append([n])
            size = n
    assert all(sum(g) + len(g) - 1 <= 50 or len(g) == 1 for g in groups) and sum(map(len, groups)) == len(lengths)
