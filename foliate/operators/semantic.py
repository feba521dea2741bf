"""Chunks of ordered vectors by max-min similarity, and sections around anchors of names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators.graphs import cut
from foliate.operators.vectors import unit

#: Rows that a task looks at to find certain starts.
BLOCK = 4096


def opens(similar: list[float], least: float, first: float, hard: float, factor: float) -> bool:
    """Whether a row opens a chunk, by its similarities with all rows of the open one; least: the smallest of its pairs (none: one row).

    It joins a single row from ``first`` on; a larger chunk if its best similarity is ``hard``
    or more and ``factor`` of the smallest pair or more.
    """
    best = max(similar)
    return best < first if least is None else best < max(hard, factor * least)


def _chunk_starts(u: np.ndarray, most: int, first: float, hard: float, factor: float) -> np.ndarray:
    """Whether each row opens a chunk; the first always does."""
    out, start, least = np.zeros(len(u), bool), 0, None
    out[:1] = True
    for i in range(1, len(u)):
        similar = (u[start:i] @ u[i]).tolist()
        if i - start >= most or opens(similar, least, first, hard, factor):
            out[i], start, least = True, i, None
        else:
            low = min(similar)
            least = low if least is None else min(least, low)
    return out


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def max_min_chunks(df: DataFrame, group: str, order: str, most: int, first: float, hard: float, factor: float, block: int = BLOCK) -> DataFrame:
    """``group, order, chunk_index`` (from 0) of each row: chunks of ``most`` rows at most whose rows are alike, see ``opens``.

    Whether a row joins depends on the open chunk, so a group is one fold. But a row that is
    less like each of the ``most`` rows before it than any rule asks opens a chunk in any
    case: there the fold starts anew, whatever came before. These rows are found in blocks
    (each with the last ``most`` rows of the one before), and the parts between them are
    folded apart. ``order`` is unique in a group.
    """
    kind, names = df.schema[group].dataType.simpleString(), {"_group": group, "_order": order}
    df, group, order = df.select(F.col(group).alias("_group"), F.col(order).alias("_order"), "embedding"), "_group", "_order"
    w = Window.partitionBy(group).orderBy(order)
    rows = df.select(group, F.col(order).cast("long").alias("o"), (F.row_number().over(w) - 1).cast("long").alias("i"), unit(F.col("embedding")).alias("u"))
    rows = cut(rows.withColumn("b", F.floor(F.col("i") / block)))
    ahead = rows.where(F.col("i") % block >= block - most).withColumn("b", F.col("b") + 1)
    both = rows.withColumn("own", F.lit(True)).union(ahead.withColumn("own", F.lit(False)))
    limit = min(first, hard)

    def certain(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        u, own = _matrix(table.column("u")), table.column("own").to_numpy(zero_copy_only=False)
        top = np.full(len(u), -np.inf)
        for k in range(1, most + 1):
            if k < len(u):
                top[k:] = np.maximum(top[k:], np.einsum("ij,ij->i", u[k:], u[:-k]))
        sure = top < limit - 1e-9
        keep = pa.array(own)
        return pa.table({group: table.column(group), "i": table.column("i"), "sure": pa.array(sure)}).filter(keep)

    sure = both.groupBy(group, "b").applyInArrow(certain, f"{group} {kind}, i long, sure boolean")
    part = F.sum((F.col("sure") | (F.col("i") == 0)).cast("int")).over(Window.partitionBy(group).orderBy("i"))
    parts = sure.withColumn("part", part).select(F.col(group).alias("g"), F.col("i").alias("j"), "part")
    met = rows.join(parts, (F.col(group) == F.col("g")) & (F.col("i") == F.col("j"))).select(group, "o", "i", "u", "part")

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        starts = _chunk_starts(_matrix(table.column("u")), most, first, hard, factor)
        return pa.table({group: table.column(group), "o": table.column("o"), "i": table.column("i"), "starts": pa.array(starts)})

    folded = met.groupBy(group, "part").applyInArrow(fold, f"{group} {kind}, o long, i long, starts boolean")
    number = F.sum(F.col("starts").cast("int")).over(Window.partitionBy(group).orderBy("i")) - 1
    return folded.select(group, F.col("o").alias(order), number.alias("chunk_index")).withColumnsRenamed(names)


def anchored_sections(df: DataFrame, names: DataFrame, group: str, order: str, least: float) -> DataFrame:
    """``group, name, anchor, first, last, section``: for each name that a group of ``df(group, order, text, embedding)`` mentions, the rows around its anchor.

    The anchor is the first row with the name as a heading (``THE NAME`` or ``NAME COLONY``),
    else the first that mentions it, in any case. The section goes on to either side while
    rows are more like the anchor than ``least`` or mention the name. Sections that overlap
    have one ``section`` number (from 1). ``names(name)`` is a short list and is broadcast;
    places count from 1. Anchors meet the rows of their group only.
    """
    before, df, group, order = group, df.select(F.col(group).alias("_group"), F.col(order).alias("_order"), "text", "embedding"), "_group", "_order"
    w = Window.partitionBy(group).orderBy(order)
    rows = cut(df.select(group, order, F.row_number().over(w).alias("i"), "text", unit(F.col("embedding")).alias("u")))
    text, name = F.coalesce(F.col("text"), F.lit("")), F.col("name")
    said = rows.join(F.broadcast(names.select("name")), F.contains(F.lower(text), F.lower(name)))
    head = F.contains(F.upper(text), F.concat(F.lit("THE "), F.upper(name))) | F.contains(F.upper(text), F.concat(F.upper(name), F.lit(" COLONY")))
    said = cut(said.select(group, "name", "i", head.alias("head")))
    anchors = said.groupBy(group, "name").agg(F.coalesce(F.min(F.when(F.col("head"), F.col("i"))), F.min("i")).alias("anchor"))
    place = rows.select(F.col(group).alias("g"), F.col("i").alias("anchor"), F.col("u").alias("a"))
    anchors = anchors.join(place, (F.col(group) == F.col("g")) & (anchors["anchor"] == place["anchor"])).select(group, "name", anchors["anchor"], "a")
    mentions = said.select(F.col(group).alias("mg"), F.col("name").alias("mn"), F.col("i").alias("mi"))
    met = rows.select(group, "i", "u").join(anchors, group).withColumn("alike", tx.dot(F.col("a"), F.col("u")) > least)
    # only rows that are not alike may still mention the name; the others never end a section
    ends = met.where("not alike").join(mentions, (F.col(group) == F.col("mg")) & (F.col("name") == F.col("mn")) & (F.col("i") == F.col("mi")), "left_anti")
    sizes = rows.groupBy(F.col(group).alias("sg")).agg(F.max("i").alias("n"))
    low, high = F.max(F.when(F.col("i") < F.col("anchor"), F.col("i"))), F.min(F.when(F.col("i") > F.col("anchor"), F.col("i")))
    found = ends.groupBy(F.col(group).alias("eg"), F.col("name").alias("en")).agg(low.alias("low"), high.alias("high"))
    out = anchors.drop("a").join(sizes, F.col(group) == F.col("sg")).join(found, (F.col(group) == F.col("eg")) & (F.col("name") == F.col("en")), "left")
    out = out.select(group, "name", "anchor", (F.coalesce("low", F.lit(0)) + 1).alias("first"), (F.coalesce("high", F.col("n") + 1) - 1).alias("last"))
    by_first = Window.partitionBy(group).orderBy("first", "last", "name")
    fresh = F.col("first") > F.coalesce(F.max("last").over(by_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumn("fresh", fresh).withColumn("section", F.sum(F.col("fresh").cast("int")).over(by_first)).drop("fresh").withColumnRenamed(group, before)
