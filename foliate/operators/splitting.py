"""Documents to rows: lines, paragraphs, sentences, windows. Each row carries (doc_id, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx


def explode_units(docs: DataFrame, units: Column, position: str, unit: str, *keep: str) -> DataFrame:
    return docs.select("doc_id", *keep, F.posexplode(units).alias(position, unit))


def line_table(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, start, line``: the start is the running sum of the lines before, with their line feeds."""
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = explode_units(docs, tx.lines(F.col("text")), "line_no", "line")
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Fixed windows of characters; the last is the first that reaches the end. An empty text has none."""
    n, step = F.length("text"), size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    rows = docs.where(n > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))
    start = F.col("chunk_index") * step
    return rows.select("doc_id", "chunk_index", start.alias("start_pos"), F.least(start + size, F.length("text")).alias("end_pos"), tx.strip(F.substring("text", start + 1, F.lit(size))).alias("text"))


def sentence_windows(docs: DataFrame, size: int = 800, overlap: int = 200, least: float = 0.7, mark: str = ".") -> DataFrame:
    """Windows that end after their last ``mark`` (a sign) where it lies beyond ``least`` of the window; the next starts ``overlap`` before the end."""
    limit, text = int(size * least), F.col("text")

    def step(acc: Column, _: Column) -> Column:
        start = acc["at"]
        part = F.substring(text, start + 1, F.lit(size))
        dot = F.length(part) - F.instr(F.reverse(part), mark)
        full = start + size < F.length(text)
        end = F.when(~full, F.length(text)).when((F.instr(part, mark) > 0) & (dot > limit), start + dot + 1).otherwise(start + size)
        row = F.struct(start.alias("start_pos"), end.cast("int").alias("end_pos"))
        done = acc["done"]
        return F.struct(
            F.when(done, acc["at"]).otherwise(F.greatest(end - overlap, start + 1)).cast("int").alias("at"),
            (done | ~full).alias("done"),
            F.when(done, acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"),
        )

    most = F.ceil(F.length(text) / max(1, limit - overlap)).cast("int") + 1
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("done"), F.array().cast("array<struct<start_pos:int,end_pos:int>>").alias("out"))
    cuts = F.aggregate(F.sequence(F.lit(1), most), zero, step, lambda a: a["out"])
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", F.posexplode(cuts).alias("chunk_index", "c"))
    return rows.select("doc_id", "chunk_index", "c.start_pos", "c.end_pos", tx.strip(F.substring(text, F.col("c.start_pos") + 1, F.col("c.end_pos") - F.col("c.start_pos"))).alias("text"))
