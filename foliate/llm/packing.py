"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost. Pieces are taken by falling
length; each goes to the open bin that it fills best. If it fits none, a bin is opened:
every permitted size is tried by filling it, largest first, with the pieces still to
come, and the size with the least cost for a token placed is opened. At the end each
bin is downsized to the least permitted size that holds its contents. This is done once
with all sizes and once without the smallest, and so on to the largest alone; the cheapest result stays.

A document longer than the largest size is cut into pieces of that size and a rest.
Pieces are dealt by a hash of their row into shards of about ``SHARD`` tokens, packed
independently in one task each; the number of shards grows with the corpus and the
memory of a task does not. Nothing is dropped: an empty or null text is a piece of
length 0. Repeated rows and doc_ids are packed each; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import read, store

SIZES = (4096, 8192, 16384)
SHARD = 24_000_000


def default_cost(size: int, largest: int) -> float:
    """Linear work for a sequence, and the growing share of attention."""
    return size * (1 + size / (8 * largest))


def placed_with(lengths: list[int], sizes: tuple[int, ...], costs: tuple[float, ...]) -> tuple[list[tuple[int, int]], list[int]]:
    """(bin, offset) of each piece, and what each bin holds, if bins are opened in these sizes (rising)."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    falling = [-lengths[i] for i in order]

    def filled(j: int, gap: int) -> int:
        """Tokens that fit into a gap, largest first, of the pieces from j on."""
        start = gap
        while gap > 0 and (j := bisect_left(falling, -gap, j)) < len(falling) and falling[j] < 0:
            gap += falling[j]
            j += 1
        return start - gap

    open_: list[tuple[int, int]] = []  # (gap, bin), sorted
    used: list[int] = []
    place = [(0, 0)] * len(lengths)
    for n, i in enumerate(order):
        length = lengths[i]
        at = bisect_left(open_, (length, -1))
        if at < len(open_):
            gap, b = open_.pop(at)
        else:
            fits = [(cost / max(1, length + filled(n + 1, size - length)), size) for size, cost in zip(sizes, costs) if size >= length]
            gap, b = min(fits)[1], len(used)
            used.append(0)
        place[i] = (b, used[b])
        used[b] += length
        insort(open_, (gap - length, b))
    return place, used


def pack(lengths: list[int], sizes: tuple[int, ...], costs: tuple[float, ...] | None = None) -> list[tuple[int, int, int]]:
    """(bin, offset, final size of the bin) of each piece; no length exceeds the largest size. costs: one for each of ``sizes``."""
    cost_of = dict(zip(sizes, costs)) if costs else {s: default_cost(s, max(sizes)) for s in sizes}
    sizes = tuple(sorted(sizes))
    best, least = [], float("inf")
    for first in range(len(sizes)):
        openers = sizes[first:]
        place, used = placed_with(lengths, openers, tuple(cost_of[s] for s in openers))
        final = [sizes[bisect_left(sizes, u)] for u in used]
        total = sum(cost_of[s] for s in final)
        if total < least:
            best, least = [(b, o, final[b]) for b, o in place], total
    return best


def best_fit(docs: DataFrame, length: Column, sizes: tuple[int, ...] = SIZES, costs: tuple[float, ...] | None = None, shard: int = SHARD) -> DataFrame:
    """``doc_id, piece, start, length, bin_id, offset, bin_size`` for each piece of ``docs``; ``length``: tokens of a row."""
    largest = max(sizes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(length, F.lit(0)).cast("long").alias("n"))
    last = F.greatest(F.floor((F.col("n") - 1) / largest), F.lit(0))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last))).select(
        "doc_id", "piece", (F.col("piece") * largest).alias("start"), F.least(F.col("n") - F.col("piece") * largest, F.lit(largest)).cast("long").alias("length"), F.monotonically_increasing_id().alias("row")
    )
    pieces = store(pieces, "pieces")
    total, count = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-total // shard), -(-count // 50_000))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        placed = pack(group["length"].tolist(), sizes, costs)
        group["bin_id"] = [(int(key[0]) << 32) + b for b, _, _ in placed]
        group["offset"] = [o for _, o, _ in placed]
        group["bin_size"] = [s for _, _, s in placed]
        return group[["doc_id", "piece", "start", "length", "bin_id", "offset", "bin_size"]]

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "doc_id long, piece long, start long, length long, bin_id long, offset long, bin_size long")


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(read(spark, sf_dir, "documents"), F.octet_length("text"))
