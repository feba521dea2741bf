import re

import pytest

from foliate.plans.registry import ORACLE_SQL, QUERIES
from foliate.plans import volumes as v  # noqa: I001 (the registry loads the plans)
from tests.oracle import compare, connect

NAMES = {**v._HEADS}


def heading(i):
    return NAMES.get(i % 8) or "TERRITORY " + str(i).translate(str.maketrans("0123456789", "ABCDEFGHIJ"))


def brute(docs):
    """(volume, heading, body) of every block of the volumes of all documents, in order."""
    out, parts = [], {}
    for i, t in sorted(docs):
        part = f"{heading(i)}.\n\nSituation and Area.\n{v._RICH * 12 if i % 8 == 6 else ''}{t or ''}\n\nForeign Consuls."
        parts.setdefault(i // v.RANGE, []).append(part)
    for volume, own in parts.items():
        for line in "\n\n".join(own).split("\n"):
            if re.fullmatch(r"[A-Z][A-Z\s\-'&,]+\.", line):
                out.append((volume, line[:-1], []))
            else:
                out[-1][2].append(line)
    return [(d, name, re.sub(r"^\s+|\s+$", "", "\n".join(lines))) for d, name, lines in out]


def test_every_document_is_in_a_volume(spark):
    docs = [(i, f"Text {i} word.\nEND OF PART.\nmore {i}") for i in (0, 7, 15, 24, 25, 31, 39, 1000, 1007, 12345)] + [(26, None), (27, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = v.h.blocks(v.volumes(frame)).orderBy("doc_id", "block_no").collect()
    assert [(r["doc_id"], r["heading"], r["body"]) for r in rows] == brute(docs)
    assert all(any(f"more {i}" in r["body"] for r in rows) for i in (7, 1007, 12345))


def test_rows_without_id_or_with_a_repeated_one_are_kept(spark):
    frame = spark.createDataFrame([(None, "lost a"), (None, "lost b"), (40, "first"), (40, "second")], "doc_id long, text string")
    text = "\n".join(r["text"] for r in v.volumes(frame).collect())
    assert all(w in text for w in ("lost a", "lost b", "first", "second")) and text.count("Foreign Consuls.") == 4


def test_blocks_of_all_documents(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    rows = QUERIES["t6_blocks"](spark, sf).select("doc_id", "block_no", "heading").orderBy("doc_id", "block_no").collect()
    assert [(r["doc_id"], r["heading"]) for r in rows] == [w[:2] for w in want]
    assert {heading(i) for i, _ in docs} <= {r["heading"] for r in rows} and len(rows) >= len(docs) > 25


def test_folding_below_160_characters(spark):
    # the given text stands between two lines of 19 and 16 characters, and empty lines
    docs = [(1, "x" * 100), (2, "Ontario"), (17, "x" * 200), (18, "Ontario")]
    rows = v.folded_prefixes(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "block_no").collect()
    assert [(r["heading"], r["prefix_headings"]) for r in rows] == [("ONTARIO", "DOMINION OF CANADA"), ("DOMINION OF CANADA", ""), ("ONTARIO", "")]


def test_no_query_reads_a_part_of_the_documents():
    assert not [n for n, q in ORACLE_SQL.items() if "n_nationkey" in q] and "t6_blocks" in QUERIES


ODD = [
    "plain words here",
    "ABLE, BAKER.\nCROWN.\nDELTA, EAST.\nmore words",  # headings without a line below
    "ABLE, BAKER.\n\nCROWN.\nABLE, BAKER.\nONTARIO.\nONTARIO.\nEXPORTS.\nlast",
    "GOLD COAST.\r\nA heading ends with its line.\r\nTHIRD PART.\r",
    "TERRITORY A.\nDOMINION OF CANADA.\nNOVA SCOTIA.\nPROVINCE OF\nMORE.\n" + v._RICH * 12,
    None,
]


def odd_tables(folder, spark):
    docs = [(i, ODD[i % len(ODD)]) for i in range(48)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/parts")
    (part,) = folder.glob("parts/*.parquet")
    part.rename(folder / "documents.parquet")
    return str(folder)


BLOCK_QUERIES = [
    "a20_topic_counts", "a21_section_analysis", "a22_hierarchy_counts", "a4_territory_statistics", "c9_merged_territories", "c9_territories", "g6_copies", "p25_container_sections", "p31_mentions",
    "t10_standard_sections", "t13_last_of_name", "t6_blocks", "t7_folded_prefixes", "t9_sections", "w13_until_next_territory", "x7_block_classes", "x9_body_classes",
]


@pytest.mark.parametrize("name", BLOCK_QUERIES)
def test_headings_without_lines_below_equal_sql(spark, tmp_path, name):
    folder = odd_tables(tmp_path, spark)
    assert compare(spark, connect(folder), QUERIES[name], ORACLE_SQL[name], folder) == ""


def test_a_heading_right_before_the_next_has_no_body(spark):
    rows = v.h.blocks(spark.createDataFrame([(1, "ABLE.\nBAKER.\n\nCROWN.\nwords")], "doc_id long, text string")).orderBy("block_no").collect()
    assert [(r["heading"], r["body"]) for r in rows] == [("ABLE", None), ("BAKER", ""), ("CROWN", "words")]


def test_the_score_of_a_block_is_computed_once(spark):
    found = v.h.classified(v.h.blocks(spark.createDataFrame([(1, "ABLE.\nwords")], "doc_id long, text string")))
    for rows in (found, v.h.nested(found), v.h.container_sections(found), v.h.territories(found)):
        assert str(rows._jdf.queryExecution().optimizedPlan()).count("protectorate") == 1
