import json
import re

import pytest
from pyspark.sql import functions as F

from foliate.operators import hierarchy, tree
from foliate.sources.documents import read_result_items, result_shape, write_tree

LONG = "words of a long text " * 300
VOLUME = f"""before the first heading
DOMINION OF CANADA.
too short

ONTARIO.
Situation and Area.
{'lakes ' * 30}
Finance.
money
FIJI ISLES.
{LONG}
  history.
old times
Foreign Consuls.
ONTARIO.
{'again ' * 30}
PRIME MINISTER OF FIJI.
{LONG}
SAMOA.
short"""


@pytest.fixture
def volumes(spark):
    return spark.createDataFrame([(1, VOLUME), (2, ""), (3, "no heading"), (4, f"FIJI ISLES.\n{LONG}\nFIJI ISLES.\n{LONG}")], "doc_id long, text string")


def by_hand(text):
    """(id, parent, type, name, text) of the nodes of a volume."""
    heads = [(m.start(), m.group().strip().replace(".", "")) for m in re.finditer(r"^[A-Z ]{5,}\.$", text, re.M)]
    titles = [(k, re.compile(f"(?:{t})", re.I)) for k, t in hierarchy.STANDARD.items()]
    territories, units, out = {}, hierarchy.CONTAINERS, []
    for (start, name), end in zip(heads, [h[0] for h in heads[1:]] + [len(text)]):
        own, container = text[start:end].strip(), next((c for c, u in units.items() if any(x in name for x in u)), None)
        if len(own) > 100 if container else len(own) > 5000 and not any(w in name for w in tree.NO_COLONY):
            territories.setdefault(container or start, []).append((container, name, start, end, own))
    for k, members in enumerate(territories.values(), 1):
        one = f"L1_{k:03d}"
        if members[0][0]:
            out.append((one, None, "dominion", members[0][0], text[members[0][2]:members[-1][3]].strip()))
        for i, (container, name, _start, _end, own) in enumerate(members, 1):
            two = f"L2_{k:03d}_{i:02d}"
            out.append((two, one, "province", name, own) if container else (one, None, "colony", name, own))
            sections = [["introduction", []]]
            for line in own.split("\n"):
                kind = next((x for x, p in titles if p.match(line.strip())), None)
                if kind:
                    sections.append([kind, []])
                sections[-1][1].append(line)
            for j, (kind, lines) in enumerate((s for s in sections if s[1]), 1):
                ids = (f"L3_{k:03d}_{i:02d}_{j:02d}", two) if container else (f"L2_{k:03d}_{j:02d}", one)
                out.append((*ids, "section", f"{name} - {kind.title()}", "\n".join(lines).strip()))
    return out


def test_nodes_are_those_found_by_hand(volumes):
    rows = tree.tree(volumes).collect()
    for doc, text in ((r["doc_id"], r["text"]) for r in volumes.collect()):
        got = sorted(((r["chunk_id"], r["parent_id"], r["type"], r["name"], r["text"]) for r in rows if r["doc_id"] == doc), key=repr)
        assert got == sorted(by_hand(text), key=repr)
    assert {r["level"] for r in rows if r["doc_id"] == 1} == {1, 2, 3} and not [r for r in rows if r["doc_id"] in (2, 3)]
    assert [r["province_names"] for r in rows if r["type"] == "dominion"] == [["ONTARIO", "ONTARIO"]]


def test_parents_and_counts(volumes):
    nodes = tree.described(tree.tree(volumes))
    rows = {(r["doc_id"], r["chunk_id"]): r for r in nodes.collect()}
    assert len(rows) == nodes.count() and all(r["parent_id"] is None or (r["doc_id"], r["parent_id"]) in rows for r in rows.values())
    for r in rows.values():
        children = [c for c in rows.values() if (c["doc_id"], c["parent_id"]) == (r["doc_id"], r["chunk_id"])]
        assert r["level"] == 3 or len(children) == (r["province_count"] or r["section_count"] or 0)
    assert {r["doc_id"]: (r["dominions"], r["colonies"], r["provinces"]) for r in tree.counts(nodes).collect()} == {1: (1, 1, 2), 4: (0, 2, 0)}


def test_pages_of_first_and_last_character(spark, volumes):
    pages = spark.createDataFrame([(1, 10, 7), (1, 100, 8), (1, 4000, 9)], "doc_id long, start long, page long")
    rows = hierarchy.paged(tree.tree(volumes), pages, "chunk_id").collect()
    assert len(rows) == tree.tree(volumes).count()
    at = lambda x: max([p for s, p in ((0, 7), (100, 8), (4000, 9)) if s <= x])
    for r in rows:
        known = r["doc_id"] == 1 and r["start_pos"] is not None
        assert (r["first_page"], r["last_page"]) == ((at(r["start_pos"]), at(r["end_pos"] - 1)) if known else (None, None))
    spans = spark.createDataFrame([(1, 0, 3, 5), (1, 1, 100, 101), (9, 0, 0, 1)], "doc_id long, n long, start_pos long, end_pos long")
    assert sorted(tuple(r)[1:] for r in hierarchy.paged(spans, pages, "n").collect() if r["doc_id"] == 1) == [(0, 3, 5, 7, 7), (1, 100, 101, 8, 8)]
    assert hierarchy.paged(spans, pages.limit(0), "n").where("first_page is null").count() == 3


def test_views_are_written_and_read(spark, volumes, tmp_path):
    nodes = tree.described(tree.tree(volumes))
    write_tree(nodes, str(tmp_path))
    whole = [json.loads(line) for f in (tmp_path / "complete").glob("*.json") for line in f.read_text().splitlines()]
    assert {v["doc_id"]: v["metadata"]["level2"] for v in whole} == {1: 5, 4: 2}
    first = next(v for v in whole if v["doc_id"] == 1)["territories"]
    assert [t["name"] for t in first] == ["DOMINION OF CANADA", "FIJI ISLES"] and [s["section_type"] for s in first[0]["children"][0]["children"]] == ["introduction", "geography", "finance"]
    found = read_result_items(spark, str(tmp_path / "complete"), "$.territories", {"$.chunk_id": "string", "$.size": "long", "$.none": "string", "$.name": "long"}, whole=False)
    assert sorted((r["chunk_id"], r["size"], r["none"], r["name"], r["error"]) for r in found.collect()) == sorted(
        (r["chunk_id"], r["size"], None, None, False) for r in nodes.where("level = 1").collect()
    )
    levels = {i: spark.read.json(str(tmp_path / f"level{i}")).count() for i in (1, 2, 3)}
    assert levels == {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}


def test_files_of_any_shape(spark, tmp_path):
    files = {"a": json.dumps({"chunks": [{"id": "x", "metadata": {"size": 3}}, {"id": 4}]}, indent=2), "b": "{broken", "c": '{"other": []}', "d": '{"chunks": "none"}', "e": ""}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    rows = read_result_items(spark, str(tmp_path), "$.chunks", {"$.id": "string", "$.metadata.size": "long"})
    got = sorted((r["file"], r["item"], r["id"], r["size"], r["error"]) for r in rows.collect())
    assert got == [("a.json", 0, "x", 3, False), ("a.json", 1, "4", None, False), ("b.json", 0, None, None, True)]
    assert "chunks" in result_shape(spark, str(tmp_path / "a.json")).first()["shape"]
    assert read_result_items(spark, str(tmp_path / "a.json"), "$.chunks", {}).where(F.col("rest").isNotNull()).count() == 2


def test_shape_reads_nodes_that_are_made_once(spark, sf):
    from foliate.plans import registry

    out = registry.QUERIES["c11_tree_shape"](spark, sf)
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()  # sections are not found anew for each level
    lines = [("HISTORY. x", "history"), ("finances.", "finance"), ("Postal.", "communications"), ("A Climate.", None), ("", None), (None, None)]
    got = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(lines)], "i int, line string").select("i", hierarchy.standard_kind(F.col("line")).alias("k"))
    assert [r["k"] for r in got.orderBy("i").collect()] == [k for _, k in lines]
