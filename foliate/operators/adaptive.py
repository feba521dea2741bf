"""Chunking by document type: profile, choose a strategy and its sizes, pack, number, summarise.

Type, sizes, units and the packing rule are columns of a document's row, so documents of
all types are packed in one pass, without a join or a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import packing, profile
from foliate.operators.profile import bound
from foliate.operators.structure import is_entry

#: Strategy of each type; the others are packed by sentences.
STRATEGIES = {"reference": "entries", "administrative": "registers", "government_report": "paragraphs"}


def in_register(u: Column) -> Column:
    return u.contains("|") | u.contains("\t")


def chunks(docs: DataFrame, mark: str = "\n", *keep: str, isolate: bool = False) -> DataFrame:
    """``doc_id, keep, document_type, confidence, strategy, markers, chunk_index, units, size, text``; blank chunks are left out.

    markers: how many phrases of colonial discourse a chunk has. isolate: with ``error``, see ``packing.pack``.
    """
    strategy = F.lit("sentences")
    for kind, name in STRATEGIES.items():
        strategy = F.when(F.col("document_type") == kind, name).otherwise(strategy)
    rows = bound(profile.typed(docs, "text", *keep).withColumn("strategy", strategy))
    text, low, high = F.col("text"), F.col("min_size"), F.col("max_size")

    def chosen(entries, registers, paragraphs, sentences) -> Column:
        s = F.col("strategy")
        return F.when(s == "entries", entries).when(s == "registers", registers).when(s == "paragraphs", paragraphs).otherwise(sentences)

    lines = F.transform(tx.lines(text), tx.strip)
    units = F.when(F.col("strategy").isin("entries", "registers"), lines).when(F.col("strategy") == "paragraphs", tx.paragraphs(text, mark)).otherwise(tx.sentences(text))
    rules = [packing.at_marks(low, 3, high), packing.around_runs(1 << 30, high), packing.before_limit(high, 2), packing.before_limit(high, 1)]
    separator = chosen(*map(F.lit, ("\n", "\n", "\n\n", " ")))
    marked = lambda u: chosen(is_entry(u), in_register(u), F.lit(False), F.lit(False))
    rule = packing.by_number(chosen(*map(F.lit, range(4))), rules)
    out = packing.pack(rows, units, rule, separator, marked, *keep, "document_type", "confidence", "strategy", blank=False, isolate=isolate)
    return out.withColumn("markers", sum(profile.markers(F.col("text")).values(), F.lit(0)))


def with_metadata(docs: DataFrame, mark: str = "\n") -> DataFrame:
    """Chunks with the metadata of their document: ``colonial_discourse_detected`` and ``markers_detected``, the phrases that flag its bias.

    A document's phrases are looked for once, in its own row, and kept on each of its chunks.
    """
    rows = bound(docs.select("doc_id", "text", profile.marker_names(F.col("text")).alias("markers_detected")))
    made = chunks(rows, mark, "markers_detected")
    return made.withColumnRenamed("confidence", "document_confidence").withColumn("colonial_discourse_detected", F.size("markers_detected") > 0)


def results_or_errors(docs: DataFrame, mark: str = "\n") -> tuple[DataFrame, DataFrame]:
    """Chunks of all documents that can be chunked, and the quarantine: ``doc_id, error`` of the others. A document's fault touches no other."""
    made = chunks(docs, mark, isolate=True)
    return made.where("error is null").drop("error"), made.where("error is not null").select("doc_id", "error")


def summary(docs: DataFrame, made: DataFrame) -> DataFrame:
    """A row for each document, also of those without chunks."""
    per = made.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum("size").alias("total_chars"), F.avg("size").alias("avg_chunk_size"))
    return docs.select("doc_id").join(per, "doc_id", "left").fillna(0)
