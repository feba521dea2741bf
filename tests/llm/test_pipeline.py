import corpus_pipeline
from foliate.llm import quality_rules as q
from pyspark.sql import functions as F

from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_secrets import brute as spans


def masked(t):
    out, at = "", 0
    for s, _, e in spans(t):
        if s >= at:
            out += t[at:s] + "[SECRET]"
        at = max(at, e)
    return out + (t or "")[at:]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 2 = 0")
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    docs = docs.union(docs.where("doc_id = 4")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality"](spark, docs, sf)
    assert first.columns == docs.columns
    lost = docs.where("doc_id is null").first()["text"]  # a row without doc_id is judged like any other
    assert first.where("doc_id is null").count() == int(any(r["text"] == lost for r in first.where("doc_id is not null").collect()))
    first = first.where("doc_id is not null")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r[0] for r in first.select("doc_id").collect()}
    wrong = [r for r in labels.join(docs.select("doc_id"), "doc_id").collect() if (r["doc_id"] in kept) != bool(r["quality"])]
    assert len(wrong) <= 0.1 * docs.count()
    rows = sorted({(r["doc_id"], r["text"]) for r in first.collect()})
    second = stages["near_duplicates"](spark, first, sf)
    want = {i for i, _, _, keep in groups(rows, 5, 80) if keep}
    got = [r["doc_id"] for r in second.collect()]
    assert sorted(got) == sorted(want) and second.columns == docs.columns
    third = stages["decontamination"](spark, second, sf)
    texts = {i: t for i, t in rows if i in want}
    dirty = {r[0] for r in leaks(sorted(texts.items()), bench) if r[5]}
    assert {r["doc_id"] for r in third.collect()} == want - dirty
    fourth = stages["secrets"](spark, third, sf)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in fourth.collect()} == {i: (masked(texts[i]), len(masked(texts[i]))) for i in want - dirty}
    fifth = stages["packing"](spark, fourth, sf)
    total = {r["doc_id"]: r["n"] for r in fifth.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {i: len(masked(texts[i]).encode()) for i in want - dirty}


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.isEmpty(), name


def test_threshold_is_the_query_s():
    assert q.THRESHOLD == 0.7


def test_clashing_columns_keep_their_values(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    names = ["_score", "score", "_row", "row", "_spans", "spans", "_stats_of_text", "stats", "row_id", "id", "h", "kept", "text_a", "base", "a.b", "n", "bucket", "root", "start"]
    more = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, sf)
        assert got.columns == more.columns, name
        assert all(r[n] == f"{n}:{r['doc_id']}" for r in got.collect() for n in names), name
    assert stage(spark, more, sf).count() == stage(spark, docs, sf).count()
    assert corpus_pipeline.best_fit_packing(spark, more, sf).count() == corpus_pipeline.best_fit_packing(spark, docs, sf).count()


def test_rows_without_or_with_shared_ids_are_documents_of_their_own(spark, sf):
    word = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("size(split(text, ' ')) > 12").first()["text"]
    rows = [(1, word("a", 40)), (1, word("b", 40)), (1, word("b", 40)), (None, word("c", 40)), (None, word("c", 40)), (2, word("a", 40)), (3, word("d", 30)), (3, word("e", 30) + " " + item), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    left = stages["near_duplicates"](spark, docs, sf)
    assert sorted(r["text"] for r in left.collect()) == sorted({t for _, t in rows})
    clean = stages["decontamination"](spark, docs, sf)
    assert sorted(r["text"] for r in clean.collect()) == sorted(t for _, t in rows if item not in t)


def test_without_labels_all_documents_stay(spark, tmp_path):
    spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == 2
