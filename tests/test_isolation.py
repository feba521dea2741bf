import re

from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import adaptive, hierarchy, packing, profile, structure

ENTRY = re.compile("|".join(structure.ENTRIES))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def faulty(group, length, mark, limit):
    return limit // (length - 7) < 0 or group.size + length > limit


def test_a_rule_that_raises_touches_its_own_document_only(spark):
    docs = frame(spark, ["one. two. three.", "one. seven77. one.", None, "", "x" * 9 + ". " + "y" * 9 + "."])
    units = F.transform(tx.sentences(F.col("text")), lambda s: F.replace(s, F.lit("."), F.lit("")))
    rows = packing.pack(docs, units, packing.Rule(faulty, (12,)), " ", isolate=True).collect()
    bad = [r for r in rows if r["error"]]
    assert sorted((r["doc_id"], r["error"].split(":")[0], r["text"]) for r in bad) == [(1, "ZeroDivisionError", None), (2, "no text", None)]
    good = {}
    for r in sorted((r for r in rows if not r["error"]), key=lambda r: (r["doc_id"], r["chunk_index"])):
        good.setdefault(r["doc_id"], []).append(r["text"])
    assert good[4] == ["x" * 9, "y" * 9] and {r["doc_id"] for r in bad} & set(good) == set()
    assert not [r for r in rows if r["doc_id"] == 3]


def test_faults_keep_their_text(spark):
    def rule(group, length, mark, limit):
        raise ValueError("no rule for this")

    rows = packing.pack(frame(spark, ["a. b.", "a.", None]), tx.sentences(F.col("text")), packing.Rule(rule, (1,)), " ", isolate=True).collect()
    # the rule is asked from the second unit on
    assert sorted((r["doc_id"], r["error"], r["text"]) for r in rows) == [(0, "ValueError: no rule for this", None), (1, None, "a."), (2, "no text", None)]


def test_quarantine_and_results_are_all_documents(spark):
    docs = frame(spark, ["plain text. " * 40, None, "", "The Colonial Office and a Protectorate. " * 3])
    made, bad = adaptive.results_or_errors(docs)
    assert [tuple(r) for r in bad.collect()] == [(1, "no text")]
    assert sorted(map(str, made.collect())) == sorted(map(str, adaptive.chunks(docs.where("text is not null")).collect()))
    made, bad = adaptive.results_or_errors(docs.limit(0))
    assert made.count() == bad.count() == 0


def test_metadata_of_each_chunk(spark):
    texts = ["The Colonial Office and the  protectorate. " + "Some words here. " * 100, "Nothing of it. " * 100, None, ""]
    rows = adaptive.with_metadata(frame(spark, texts)).collect()
    for r in rows:
        want = [f"{k}: {p}" for k, ps in profile.MARKERS.items() for p in ps if re.search(p, texts[r["doc_id"]], re.I)]
        assert r["markers_detected"] == want and r["colonial_discourse_detected"] == bool(want)
    assert {r["doc_id"] for r in rows} == {0, 1} and len([r for r in rows if r["doc_id"] == 0]) > 1


def split_by_hand(text, limit, around=5):
    lines = text.split("\n")
    if len(text) <= limit:
        return [text]
    middle = len(lines) // 2
    cut = next((i for i in range(max(0, middle - around), min(len(lines), middle + around)) if ENTRY.search(lines[i])), middle)
    return ["\n".join(lines[:cut]), "\n".join(lines[cut:])] if cut else [text]


def test_forced_splits_lose_nothing(spark):
    plain = "\n".join(f"line {i} of some text" for i in range(40))
    texts = [plain, plain.replace("line 22", "BIRCH,"), plain.replace("line 3 ", "BIRCH, "), "short", "x" * 900, "", "BIRCH, a\n" + "y" * 900, "y" * 900 + "\nBIRCH, a"]
    chunks = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, chunk_index int, text string")
    rows = packing.forced_splits(chunks, 800, structure.is_entry).orderBy("doc_id", "part").collect()
    for i, t in enumerate(texts):
        own = [r["text"] for r in rows if r["doc_id"] == i]
        assert own == split_by_hand(t, 800) and "\n".join(own) == t, t
    assert packing.forced_splits(chunks.limit(0), 800, structure.is_entry).count() == 0


def test_names_of_containers(spark):
    names = ["DOMINION OF CANADA", "CANADA WEST", "LEEWARD PASSAGE", "THE SEA", "ISLANDS", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", hierarchy.container_named(F.col("name")).alias("c")).collect()
    for n, got in rows:
        assert got == next((c for c in hierarchy.CONTAINERS if n and (c in n or any(w in n for w in c.split() if len(w) > 3))), None)


def test_analysis_joins_the_blocks_of_a_heading(spark):
    blocks = [(1, 1, "A", "Climate and Revenue"), (1, 2, "B", "none"), (1, 3, "A", "and expenditure. Situation, Area,\nand native tribes"), (2, 1, "A", ""), (2, 2, "A", None)]
    rows = {(r["doc_id"], r["heading"]): r for r in hierarchy.analysed(spark.createDataFrame(blocks, "doc_id long, block_no int, heading string, body string"), sample=10).collect()}
    a = rows[1, "A"]
    assert a["total_chunks"] == 2 and a["total_characters"] == len(blocks[0][3]) + len(blocks[2][3]) + 2 and a["opening"] == "Climate an" and a["ending"] == "ve tribes\n"
    assert a["subsections_found"] == [hierarchy.SUBSECTIONS[i] for i in (0, 2, 3)] and a["sections"] == ["Climate"]
    assert rows[1, "B"]["sections"] == [] and rows[2, "A"]["total_chunks"] == 2


def test_text_ahead_of_a_heading(spark):
    near = "SAMOA.\n" + "x\n" * 8 + "Situation and Area.\n" + "miles north of an island\n" * 4
    far = "TONGA.\n" + "x\n" * 9 + "Situation and Area."
    rows = hierarchy.transitions(frame(spark, [near + far + "\nForeign Consuls.", "", None])).collect()
    assert sorted((r["doc_id"], r["pos"], r["signal"], r["name"], r["confidence"]) for r in rows) == [
        (0, 0, "start", "SAMOA", 0.9), (0, len(near + far) + 1, "end", "Foreign Consuls.", 0.8),
    ]
