"""Places in a total order over a whole table, and neighbours in it, without one task for all rows."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.operators.graphs import cut

#: Rows of a range; a range is one window.
ROWS = 1_000_000


def placed(rows: DataFrame, *keys: str | Column, parts: int | None = None) -> DataFrame:
    """``rows`` with ``place`` from 1 on, by ``keys``, which must tell all rows apart.

    Ranges are stored with their number before they are counted: both later reads see the
    same ranges, however the plan is made anew.
    """
    parts = parts or max(1, -(-rows.count() // ROWS))
    ranged = cut(rows.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    sizes = dict(ranged.groupBy("_range").count().collect())  # a row for each range
    before = dict(zip(sorted(sizes), accumulate((sizes[r] for r in sorted(sizes)), initial=0)))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*keys)).cast("long")
    if len(before) < 2:
        return ranged.withColumn("place", at).drop("_range")
    starts = F.broadcast(rows.sparkSession.createDataFrame(list(before.items()), "_range int, _before long"))
    return ranged.withColumn("place", at).join(starts, "_range").withColumn("place", F.col("place") + F.col("_before")).drop("_range", "_before")


def neighbours(rows: DataFrame, width: int, block: int = ROWS) -> DataFrame:
    """``a, b``: each row of ``rows`` (with ``place``) and each of the next ``width`` rows, as structs of the other columns.

    Windows are blocks of places; a block also holds the first rows of the next.
    """
    columns = [c for c in rows.columns if c != "place"]
    number = F.floor((F.col("place") - 1) / block)
    rows = rows.select("place", F.struct(*columns).alias("a"), number.alias("_block"))
    ahead = rows.where((F.col("_block") > 0) & ((F.col("place") - 1) % block < width)).withColumn("_block", F.col("_block") - 1)
    every = rows.withColumn("_own", F.lit(True)).union(ahead.withColumn("_own", F.lit(False)))
    w = Window.partitionBy("_block").orderBy("place")
    next_ones = F.array(*[F.lead("a", i).over(w) for i in range(1, width + 1)])
    met = every.withColumn("_next", next_ones).where("_own")
    return met.select("a", F.explode(F.filter("_next", lambda x: x.isNotNull())).alias("b"))
