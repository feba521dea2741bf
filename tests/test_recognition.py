"""Counts of one pass against a search for each pattern, on texts made to meet their edges."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import profile, recognition
from foliate.plans.registry import QUERIES

PARTS = [
    "a", "b", "i", "l", "I", "L", "1", "|", "||", "| |", "|\n|", "rn", "RN", "cL", "tn", "o", "0", "O", "on", "ab", "abc", "abcd", "aB", "ABCD", "AbcDef", "x1", "e", "ye", "ae", "The", "A", "AB", "A.b", "Mr.x", "U.S.A.", "&c.", "&c",
    ".", "..", ",", ",,", ";:", ":", "a.b", ".c,d", " ", "  ", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u2003", "\u2028", "\u3000", "é", "É", "e\u0301", "\u017f", "A\u017fe", "Hou\u017fe", "Hou\u017fe\u017f", "\u212a", "a\u212a", "a\u212ab", "a\u212abc", "ab\u212ade", "\u212aab", "\u0131", "\u0131l", "\u0130", "i\u0130", "ab\u0130", "\u0130abc",
    "_", "-", "\u200d", "ß", "字", "😀", "𝒜", "Ⓐ", "٣", "\u0903", "\x00", "#", "x" * 99, "y" * 100, "|" + "z" * 100, "|" + "😀 " * 50, "|" + "w" * 99 + "|",
]


def both(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    t = F.col("text")
    searched = {"words": F.size(tx.words(t))} | {k: profile.matches(t, p, "(?iU)") for k, p in profile.OCR_ERRORS.items()} | {k: profile.matches(t, p, "(?U)") for k, p in profile.HISTORICAL.items()}
    want = docs.select("doc_id", *[c.alias(k) for k, c in searched.items()]).orderBy("doc_id").collect()
    return docs.select("doc_id", recognition.counts(t).alias("n")).select("doc_id", "n.*").orderBy("doc_id").collect(), want


def test_equal_to_a_search_for_each_pattern(spark):
    rng = random.Random(31)
    texts = ["", None, " ", "|", "\n", *PARTS, *(a + b for a in PARTS for b in PARTS)]
    texts += ["".join(rng.choice(PARTS) + rng.choice(["", "", " "]) for _ in range(rng.randrange(3, 40))) for _ in range(6000)]
    texts += ["".join(rng.choice("ab .|\u212a\nA1,\u017fe") for _ in range(rng.randrange(1, 30))) for _ in range(6000)]
    got, want = both(spark, texts)
    assert [(texts[g["doc_id"]], g, w) for g, w in zip(got, want) if g != w][:3] == [] and len(got) == len(texts)
    assert all(sum(w[k] or 0 for w in want) > 1000 for k in recognition.NAMES)


def test_counts_by_hand_across_slices(monkeypatch):
    texts = ["a b c d e", "", None, "A.b x.y.z.w", "| | | |", "Hou\u017fe &c. ABC", "one | bar", "ll" * 50]
    want = recognition.count_texts(pa.array(texts)).to_pylist()
    assert [w and w["words"] for w in want] == [5, 0, None, 2, 4, 3, 3, 1]
    # two pairs of single letters; pairs of bars; a lone bar; A. before b; &c. and ABC; the long s once and the e at the end for y or e and for a or e
    assert (want[0]["word_breaks"], want[4]["table_structure"], want[6]["table_structure"], want[3]["abbreviations"], want[5]["abbreviations"], want[5]["archaic_spelling"]) == (2, 2, 1, 1, 2, 3)
    assert want[3]["spacing_issues"] == 3 and want[2] is None  # A.b, x.y, z.w; .z shares its letter with no match
    for size in (1, 7, 20):
        monkeypatch.setattr(recognition, "SLICE", size)
        assert recognition.count_texts(pa.array(texts)).to_pylist() == want
    assert recognition.count_texts(pa.array([], pa.string())).to_pylist() == []


def test_long_texts_are_counted_in_pieces(monkeypatch):
    rng = random.Random(7)
    parts = [*PARTS, "plain words here", "three\nlines", "and the rest", "|", "some text behind a bar " * 4]
    texts = [rng.choice([" ", "", "\n"]).join(rng.choice(parts) for _ in range(rng.randrange(200))) for _ in range(300)] + ["one | bar and then many more words", "| " + "word " * 300]
    want = recognition.count_texts(pa.array(texts)).to_pylist()
    for size in (1, 10, 60, 500):
        monkeypatch.setattr(recognition, "SLICE", size)
        assert sum(len(list(recognition._pieces(t))) for t in texts) > len(texts)
        assert all("".join(recognition._pieces(t)) == t for t in texts)
        assert recognition.count_texts(pa.array(texts)).to_pylist() == want


def test_texts_are_not_searched_for_each_pattern(spark, sf):
    for name in ("a11_ocr_errors", "a18_historical_features", "a18b_quality_bundle", "a19_corpus_error_rate"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "regexp_extract_all" not in plan and plan.count("arrowevalpython") == 1 and plan.count("count_texts(") == 1, name
