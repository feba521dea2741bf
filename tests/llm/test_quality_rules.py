import random

from pyspark.sql import functions as F

from foliate.llm import quality_rules as q


def test_tree_rules_parse_every_path():
    debug = """DecisionTreeClassificationModel: depth=2
  If (feature 0 <= 1.5)
   If (feature 1 > -2.0E-3)
    Predict: 0.0
   Else (feature 1 <= -2.0E-3)
    Predict: 1.0
  Else (feature 0 > 1.5)
   Predict: 1.0
"""
    got = {r.tests for r in q.tree_rules(debug, ["x", "y"])}
    assert got == {(("x", True, 1.5),), (("x", True, 1.5), ("y", False, -0.002)), (("x", True, 1.5), ("y", True, -0.002)), (("x", False, 1.5),)}


def test_compiled_score_equals_rule_by_rule(spark, sf):
    rng = random.Random(1)
    rows = [(i, None if i == 0 else " ".join(rng.choice(["Ab", "cd|", "$$$", "e."]) for _ in range(i % 40)), "z", 3) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, label int")
    stats = [r.asDict() for r in docs.select(*[c.alias(n) for n, c in q.statistics(F.col("text")).items()]).collect()]
    model = q.RuleModel(-0.5, [(q.Rule((("pipes", False, 0.05), ("upper", True, 0.2))), 1.5), (q.Rule((("log_chars", True, 3.0),)), -2.0)])
    import math

    got = [r["p"] for r in q.with_scores(docs, model, out="p").collect()]
    for s, p in zip(stats, got):
        z = -0.5 + 1.5 * (s["pipes"] > 0.05 and s["upper"] <= 0.2) - 2.0 * (s["log_chars"] <= 3.0)
        assert abs(p - 1 / (1 + math.exp(-z))) < 1e-12


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    scored = q.op7_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    right, n = scored.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 50 and right >= 0.95


def test_one_class_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0)], "doc_id long, quality int, toxic int")
    model = q.learn(docs, labels)
    assert not model.rules and 0.5 <= q.with_scores(docs, model).first()["score"] < 1
    assert q.with_scores(docs.limit(0), model).count() == 0


def test_very_long_texts_and_rows_without_id(spark):
    docs = spark.createDataFrame([(1, "Word and word, " * 150_000), (None, "a b"), (2, "x" * 1_000_000)], "doc_id long, text string")
    model = q.RuleModel(0.0, [(q.Rule((("variety", True, 0.3),)), 2.0), (q.Rule((("word_chars", False, 100.0),)), -2.0)])
    got = {r["doc_id"]: (round(r["score"], 3), r["h"]) for r in q.with_scores(docs, model).withColumn("h", q.held_out(F.col("doc_id"))).collect()}
    assert got[1][0] > 0.8 and got[2][0] < 0.5 and got[None][1] is None
