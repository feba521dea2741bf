"""Features, types and chunks against values derived by hand, and against Python's own regular expressions."""

import re

from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import adaptive, packing, profile, rosters

REPORT = "COLONIAL REPORTS\nREPORT FOR 1917\n£ 500 paid\nI.—GENERAL\nHis Majesty’s Government\nRevenue | Expenditure"
WORDS = ["See Cabinet.", "CASSIA, a tree", "in botany", "Colonial Office", "Secretary of\nState", "Her Majesty’s Government", "Crown Colony", "Dependencies", "Protectorate", "£ 12", "II.—b", "I.—x", "é", "ſee", "K", "| a | b |", "a\tb", "H. M. Government", "\n", "\n", " ", "Éa bc dé", "ÆTHER"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_values_by_hand(spark):
    entries = "\n".join(f"{w}, a plant." for w in ("ABACA", "ACACIA", "AGAVE", "ALDER", "ALOE", "ANISE"))
    stops = "\n".join(f"{w}. A plant." for w in ("ABACA", "ACACIA", "AGAVE", "ALDER", "ALOE", "ANISE"))
    marked = "Colonial Office. British Empire. Crown Colony. Protectorate. £ 5"
    rows = {r["doc_id"]: r for r in profile.features(frame(spark, [REPORT, entries, stops, marked, "", "nœud ne. Œuf"])).collect()}
    # signals of a report: the line REPORTS, REPORT FOR, His Majesty's Government, I.— and the two words of finance
    assert (rows[0]["report_signals"], rows[0]["has_money"], rows[0]["has_roman"], rows[0]["table_density"]) == (6, True, True, 1 / 6)
    assert rows[1]["has_entries"] and not rows[2]["has_entries"]  # a full stop begins no entry
    assert rows[3]["discourse_markers"] == 4 and rows[4]["avg_line"] == 0 and rows[4]["short_lines"] == 1
    kinds = {r["doc_id"]: (r["document_type"], round(r["confidence"], 6)) for r in profile.typed(frame(spark, [REPORT, entries, stops, marked, ""])).collect()}
    # 0.4 + 0.2 + 0.2; 0.4 + 0.2 for capitals + 0.3 for 12 signals (each line begins with a word, and has a comma after it); capitals alone; money and markers; nothing
    assert kinds == {0: ("government_report", 0.8), 1: ("reference", 0.9), 2: ("hybrid", 0.2), 3: ("administrative", 0.4), 4: ("hybrid", 0.0)}


def test_against_python(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", "\n", ". "]) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    rows = {r["doc_id"]: r for r in profile.features(frame(spark, texts)).collect()}
    groups = {"reference_signals": profile.REFERENCE, "administrative_signals": profile.ADMINISTRATIVE, "report_signals": profile.REPORT}
    for i, t in enumerate(texts):
        for name, patterns in groups.items():
            assert rows[i][name] == sum(len(re.findall(p, t, re.I | re.M)) for p in patterns), (name, t)
        assert rows[i]["discourse_markers"] == sum(bool(re.search(p, t, re.I)) for ps in profile.MARKERS.values() for p in ps)
        assert rows[i]["has_entries"] == (len(re.findall(profile.ENTRY, t, re.M)) > 5) and rows[i]["has_roman"] == bool(re.search(profile.ROMAN, t, re.M))
    counted = {r["doc_id"]: r for r in frame(spark, texts).select("doc_id", *[profile.matches(F.col("text"), p, "(?iU)").alias(k) for k, p in profile.OCR_ERRORS.items()]).collect()}
    for i, t in enumerate(texts):
        assert all(counted[i][k] == sum(len(re.findall(p, t, re.I)) for p in ps) for k, ps in profile.OCR_ERRORS.items()), t
    old = {r["doc_id"]: r for r in frame(spark, texts).select("doc_id", *[profile.matches(F.col("text"), p, "(?U)").alias(k) for k, p in profile.HISTORICAL.items()]).collect()}
    for i, t in enumerate(texts):
        assert all(old[i][k] == sum(len(re.findall(p, t)) for p in ps) for k, ps in profile.HISTORICAL.items()), t


def test_chunks_by_type_keep_their_text(spark):
    texts = [REPORT * 40, "\n".join(f"ALDER{'X' * (i % 5)}, a plant of the north. See Birch." for i in range(80)), "plain. " * 500, "", " \n "]
    rows = adaptive.chunks(frame(spark, texts)).orderBy("doc_id", "chunk_index").collect()
    assert {r["doc_id"]: r["strategy"] for r in rows} == {0: "paragraphs", 1: "entries", 2: "sentences"}
    for i in (0, 1, 2):
        own = [r for r in rows if r["doc_id"] == i]
        assert [r["chunk_index"] for r in own] == list(range(len(own)))
        assert re.sub(r"\s+", "", "".join(r["text"] for r in own)) == re.sub(r"\s+", "", texts[i])
    assert any(r["markers"] == 0 for r in rows)


def test_packing_is_linear(spark):
    import time

    def seconds(n):
        docs = frame(spark, ["word of some length. " * n])
        start = time.perf_counter()
        assert packing.pack(docs, tx.sentences(F.col("text")), packing.before_limit(200, 1), " ").agg(F.sum("units")).first()[0] == n
        return time.perf_counter() - start

    seconds(1_000)
    assert seconds(200_000) < 30


def test_roster_paths_and_outcomes(spark):
    body = "Smith, J. B.\nJones, A. C. He was appointed in the year 1889.\nA long text follows here, with sentences."
    heads = ["INDIA OFFICE", "CHAPTER I.", "**BENGAL**", "ROADS:", "NOTES", "CHAPTER II", "BENGAL DISTRICTS", "MILITARY", "ROADS"]
    text = "\n".join(f"{h}\n{body}" for h in heads) + "\nEMPTY\n\nPIANOS\nPRICE LIMITED WHOLESALE\nLAST LINE"
    docs = frame(spark, [text])
    got = [(r["title"], r["section_path"], r["chunk_type"]) for r in rosters.chunks(docs).orderBy("block_no").collect()]
    top, one, two = ["INDIA OFFICE"], ["INDIA OFFICE", "CHAPTER I"], ["INDIA OFFICE", "CHAPTER II"]
    assert got == [
        ("INDIA OFFICE", top, "roster"), ("CHAPTER I", one, "roster"), ("BENGAL", [*one, "BENGAL"], "roster"), ("ROADS", [*one, "BENGAL", "ROADS"], "roster"),
        ("CHAPTER II", two, "roster"), ("BENGAL DISTRICTS", [*two, "BENGAL DISTRICTS"], "roster"), ("MILITARY", ["MILITARY"], "roster"), ("ROADS", ["MILITARY", "ROADS"], "roster"),
    ]
    assert {(r["chunk_type"], r["n"]) for r in rosters.statistics(docs).collect()} >= {("roster", 8)}
    assert rosters.chunks(docs.limit(0)).count() == 0


def test_sections_of_a_container_and_mentions(spark):
    from foliate.operators import hierarchy as h

    rich = "The colony, population, government, judge, revenue, trade, railway, police, education, church, island. " * 20
    parts = [("DOMINION OF CANADA", rich), ("NOVA SCOTIA", "x" * 6000), ("EXECUTIVE COUNCIL", "y" * 6000), ("HALIFAX", "short"), ("LABRADOR", "z" * 300), ("JAMAICA", rich + "the Gold Coast Colony"), ("KINGSTON", "w" * 300)]
    docs = frame(spark, ["\n\n".join(f"{k}.\n{v}" for k, v in parts)])
    found = h.classified(h.blocks(docs))
    got = [(r["heading"], r["section_kind"], r["is_large"]) for r in h.container_sections(found).orderBy("block_no").collect()]
    assert got == [("NOVA SCOTIA", "province", True), ("EXECUTIVE COUNCIL", "administration", False)]
    assert [(r["name"], r["is_header"]) for r in h.mentions(h.blocks(docs), ["Gold Coast", "Cape"]).collect()] == [("Gold Coast", True)]
    large = h.first_large(frame(spark, ["a" * 9, "b" * 50, "c" * 60]), F.lit(True), 20).collect()
    assert [tuple(r) for r in large] == [(1, 50)] and h.first_large(docs, F.lit(False), 0).count() == 0


def test_merged_territories_and_their_statistics(spark):
    from foliate.operators import hierarchy as h

    rich = "The colony, population, government, judge, revenue, trade, railway, police, education, church, island. " * 20
    names = ["JAMAICA", "JAMAICA", "MALTA", "JAMAICA", "JAMAICA", "MALTA"]
    texts = [rich + "a", rich + "b", rich, rich + "a", rich + "c", rich]
    docs = frame(spark, ["\n\n".join(f"{n}.\n{t}" for n, t in zip(names, texts))])
    found = h.classified(h.blocks(docs))
    got = [(r["name"], r["merged"], r["number"], r["role"], r["is_duplicate"]) for r in h.territories(found).orderBy("territory_no").collect()]
    # the second entry of Jamaica begins with the text of the first; Malta is a copy
    assert got == [("JAMAICA", 2, 1, "primary", False), ("MALTA", 1, 1, "primary", False), ("JAMAICA", 2, 2, "appendix", True), ("MALTA", 1, 2, "appendix", True)]
    assert [tuple(r)[1:] for r in h.territory_statistics(found).collect()] == [(6, 4, 2, 2)]


ODD_CASES = [
    "ColonIal  Office, secretary\nof State. H. M. GOVERNMENT h.m.government Governor and Commander", "COLONİAL OFFICE Colonıal office Britiſh Empire BRITİSH JURISDICTION",
    "chief commiſſioner; Deputy Secretary $ 12,5 £3 |a|\n |b| c|", "Report for 1899 colonial reports REVENUE expendıture Fınancial His Majeſty’s Government", "I.—One\nII.—Two ııı.—three ADMİNISTRATION eſtabliſhment",
    "ſee Alpha. See Beta. in  botany in\nmedicıne", "native administratıon tribal authority barbarous cuſtoms civilizing mission PROTECTORATE crown colony dependencıes Her Majestys Government", "", None,
    "ABC A-B \u00a0ÀÉÎ\u2003x1Y 12345 A1 ΣΣΣ aBC ABC.\u0085DEF THE\u001fEND", "plain words without any", "\u212aEE see \u212a",
]


def test_features_equal_those_without_a_first_look_at_words(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_CASES)), "doc_id long, text string")
    t, words = F.col("text"), tx.words(F.col("text"))
    count = lambda patterns: sum((F.regexp_count(t, F.lit("(?imU)" + p)) for p in patterns), F.lit(0))
    plain = {
        "caps_density": tx.share(F.size(F.filter(words, lambda w: tx.is_upper(w) & (F.length(w) > 2))), F.size(words)), "reference_signals": count(profile.REFERENCE),
        "administrative_signals": count(profile.ADMINISTRATIVE), "report_signals": count(profile.REPORT),
        "discourse_markers": sum((t.rlike(f"(?iU){p}").cast("int") for ps in profile.MARKERS.values() for p in ps), F.lit(0)),
    }
    want = docs.select("doc_id", *[c.alias(k) for k, c in plain.items()]).orderBy("doc_id").collect()
    got = profile.features(docs).select("doc_id", *plain).orderBy("doc_id").collect()
    assert got == want and sum(r["discourse_markers"] or 0 for r in want) > 8 and want[1]["administrative_signals"] > 0


def test_every_pattern_of_phrases_has_words(spark):
    free = {profile.REFERENCE[0], profile.REFERENCE[2], *(p for ps in profile.MARKERS.values() for p in ps), *profile.ADMINISTRATIVE, *profile.REPORT} - set(profile.LITERALS)
    assert free == {profile.REFERENCE[0], profile.REFERENCE[2]}


def test_keywords_deal_texts_once(spark):
    rows = [(1, "Lorem ipsum lorem dolor"), (1, "dolor dolor amet"), (2, None), (3, ""), (4, "zeta alpha zeta alpha beta")]
    out = profile.keywords(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    # rows that share an id are counted together; ties by first place
    assert {tuple(r) for r in out.select("doc_id", "keyword", "n", "rank").collect()} == {(1, "dolor", 3, 1), (1, "lorem", 2, 2), (4, "zeta", 2, 1), (4, "alpha", 2, 2)}
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
