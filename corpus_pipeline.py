"""The training-data pipeline over ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; its output is written
and read again before the next. All but the last keep the columns of ``documents``,
also such whose names the operators use themselves. Null texts are empty texts; empty
tables give empty tables; without a usable label the first stage keeps all documents.
Decisions are made for rows, not for doc_ids: rows without doc_id, and rows that share
one with another text, are documents of their own, after all others. Of rows with the
same doc_id and text the near-duplicate stage keeps one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import decontaminate, near_dedup, packing, quality_rules, secrets
from foliate.llm.common import free, own_columns, read, store, temporary

#: Keys of dropped rows that are broadcast at most (counted first); more of them meet the rows in a shuffled join.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``dropped``, a stored table of that column; few keys leave the texts where they are."""
    few = dropped.count() <= BROADCAST_KEYS
    return docs.join(F.broadcast(dropped) if few else dropped, key, "left_anti")


def with_row_ids(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column of ids, one for each pair of doc_id and text: doc_id itself where it has one text only."""
    name, h = free(docs, "row_id"), F.xxhash64("text")
    apart = F.lit(1 << 62) + h.bitwiseAND(F.lit((1 << 62) - 1))
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low < high")
    several = store(several.select("doc_id", F.lit(True).alias(name)), "several")
    rows = docs
    if several.isEmpty():
        rows = rows.select(*own_columns(docs), F.lit(False).alias(name))
    else:
        rows = rows.join(several, "doc_id", "left")
    own = F.when(F.col("doc_id").isNull() | F.coalesce(F.col(name), F.lit(False)), apart).otherwise(F.col("doc_id").cast("long"))
    return rows.select(*own_columns(docs), own.alias(name)), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score reaches the threshold."""
    model = quality_rules.learn(docs, read(spark, sf_dir, "labels"))
    if not model.labelled:
        return docs
    score = free(docs, "score")
    return quality_rules.with_scores(docs, model, out=score).where(F.col(score) >= quality_rules.THRESHOLD).select(own_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group: shingles of five words, similarity 0.8."""
    rows, row_id = with_row_ids(docs)
    found = near_dedup.near_duplicates(rows.select(F.col(row_id).alias("doc_id"), "text"), shingle=5, percent=80)
    dropped = store(found.where("not kept").select(F.col("doc_id").alias(row_id)).distinct(), "dropped")
    left = without(rows, row_id, dropped)
    # equal rows: repeated ids are few, rows of unique ids are not shuffled with their texts
    twice = store(rows.groupBy(row_id).count().where("count > 1").select(row_id), "repeated")
    if not twice.isEmpty():
        left = without(left, row_id, twice).union(left.join(twice, row_id, "left_semi").dropDuplicates([row_id]))
    return left.select(own_columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share a window of words with a benchmark item."""
    rows, row_id = with_row_ids(docs)
    found = decontaminate.decontaminate(rows.select(F.col(row_id).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    dropped = store(found.where("contaminated").select(F.col("doc_id").alias(row_id)).distinct(), "dropped")
    return without(rows, row_id, dropped).select(own_columns(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the text and sets n_chars anew."""
    out = secrets.redact(docs)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(own_columns(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places every byte of the kept documents in training sequences."""
    return packing.best_fit(docs, F.octet_length("text"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", best_fit_packing),
]
#: SQL cannot express the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary(spark) as kept:
            docs = store(stage(spark, docs, sf_dir), name, kept)
    return docs
