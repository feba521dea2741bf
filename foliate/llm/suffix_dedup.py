"""Removal of repeated 100-byte strings by bucket-pointer refinement.

Strings of SPAN bytes are put in buckets by a q-gram that each of them contains: the
one with the smallest hash (the last of equals), so equal strings choose the same gram
at the same offset. Neighbouring strings of a text share their choice; they form one
entry (anchor, range of offsets), which keeps a bucket's entries far fewer than bytes.

A bucket is refined on the identifiers of buckets at later offsets. An entry's own
identifier chains those of the q-grams that follow in it, one every GRAM bytes, so
entries with equal bytes are found at once. Buckets whose entries differ go on: strings of a
range of offsets share a core, whose bucket is known, and the range is cut in parts whose
cores reach further to either side. The identifier of a part's bucket is that of the core
(a pointer to the bucket refined before) with those of the q-grams that begin where the core
has ended. These new pointers are the cores of the next cut, and so on to single offsets, in
four rounds. Entries carry the pointer and the bytes that no pointer stands for yet. A
bucket is done as soon as it has one entry, or entries that agree on all their bytes; then
all but the first repeat it. Only identifiers, counts and first places are aggregated, so
a bucket with a third of all entries is never in one task.

Within a text, entries that repeat an earlier one of it are found in the task that
reads it, and runs of them are one span: a periodic text is a few entries, not one a byte.

The first step needs no bytes: it counts identifiers of all buckets. Repeated buckets
are marked in bitmaps of fixed size while they are few enough for these to be
selective (``bits``); beyond that, entries meet the repeated buckets in a shuffled
join and fetch their bytes by document. Tables of a step are deleted once it is done.

Identifiers have 128 bits. Null or empty text: nothing to remove. Rows that repeat a
doc_id are ordered by a hash of their text, and equal rows count once; both get a
result. A row without doc_id comes before all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import BYTE_CODES, Tables, byte_view, mix, read, slices, store, texts

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
SPAN, GRAM = 100, 32
#: Bits of a bitmap (16 MB); it is used while there are this many times fewer repeated buckets.
BITS, SELECTIVE = 1 << 27, 4
#: Parts into which a bucket's range of offsets is cut at a time.
SPLIT = 4
_PLACE = (1 << 20) - 1
_PIECE = 1 << 19


def gram_hash(raw: np.ndarray) -> np.ndarray:
    """Hash of each GRAM bytes, by doubling."""
    h, n = BYTE_CODES[raw], 1
    factor = 0xD1342543DE82EF95
    with np.errstate(over="ignore"):
        while n < GRAM:
            h = h[:-n] * _U(factor) + h[n:]
            factor = factor * factor % (1 << 64)
            n *= 2
    return mix(h)


def entries(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, first start, last start, bucket, identifier) of the entries of some texts of a megabyte together.

    Places are within ``raw``.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, _U),) * 2
    if len(raw) < SPAN:
        return none
    g = gram_hash(raw)
    places = np.arange(len(g), dtype=_U)
    low = (g & ~_U(_PLACE)) | (_U(_PLACE) - places)
    width, n = SPAN - GRAM + 1, 1
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    low = np.minimum(low[: len(low) - (width - n)], low[width - n :])  # for each start of a string
    valid = np.ones(len(low) + 1, bool)
    valid[-1] = False
    for end in offsets[1:]:
        valid[max(0, end - SPAN + 1) : end] = False
    begins, stays = valid[:-1].copy(), (low[1:] == low[:-1]) & valid[:-2]
    begins[1:] &= ~stays
    lo = np.flatnonzero(begins)
    if not len(lo):
        return none
    ends = valid[:-1].copy()
    ends[:-1] &= ~((low[1:] == low[:-1]) & valid[1:-1])
    hi = np.flatnonzero(ends)
    anchor = _PLACE - (low[lo] & _U(_PLACE)).astype(np.int64)
    # the identifiers of the buckets at later offsets, to the last one inside the entry
    with np.errstate(over="ignore"):
        u = mix((anchor - lo).astype(_U) * _GOLD + (hi - lo).astype(_U))
        for at in range(0, 2 * SPAN - GRAM, GRAM):
            u = mix(u * _GOLD + g[np.minimum(lo + at, hi + SPAN - GRAM)])
    return np.searchsorted(offsets, lo, "right") - 1, anchor, lo, hi, g[anchor], u


def own_repeats(row: np.ndarray, lo: np.ndarray, hi: np.ndarray, bucket: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whether an entry is the first of its kind in its text; and the others as (row, start, end) of runs."""
    order = np.lexsort((u, bucket, row))
    first = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    first[b[(row[a] == row[b]) & (bucket[a] == bucket[b]) & (u[a] == u[b])]] = False
    r, start, end = row[~first], lo[~first], hi[~first] + SPAN
    opens = np.ones(len(r), bool)
    opens[1:] = (r[1:] != r[:-1]) | (start[1:] > end[:-1])
    closes = np.append(opens[1:], True) if len(r) else opens
    return first, r[opens], start[opens], end[closes]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Slices of about half a megabyte: (batch, bytes, offsets, place of the bytes in the text). A longer text comes in overlapping pieces."""
    for batch in slices(batches, "text", _PIECE):
        raw, offsets = byte_view(batch.column("text"))
        if len(raw) <= 2 * _PIECE - SPAN:
            yield batch, raw, offsets, 0
        else:  # one text; each string starts in one piece
            batch = batch.slice(batch.num_rows - 1) if offsets[-2] == 0 else batch
            for at in range(0, len(raw), _PIECE):
                part = raw[at : at + _PIECE + SPAN - 1]
                yield batch, part, np.array([0, len(part)]), at


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, id, h, text``: id and h tell the texts apart and order them."""
    docs = texts(docs)
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"), "text")


def identifiers(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets, _ in pieces(batches):
            row, _, lo, hi, bucket, u = entries(raw, offsets)
            first = own_repeats(row, lo, hi, bucket, u)[0]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row[first])), pa.array(bucket[first].view(np.int64)), pa.array(u[first].view(np.int64))], ["id", "k", "u"])

    return docs.select("id", "text").mapInArrow(run, "id long, k long, u long")


_ENTRY = "id long, h long, k long, u long, pos long, left int, first int, before binary, after binary"


def all_entries(docs: DataFrame, bits: np.ndarray | None, with_bytes: bool) -> DataFrame:
    """Entries ``id, h, k, u, pos, left, first, before, after``: strings start ``left`` to ``first`` bytes before ``pos``.

    bits: a bitmap of the wanted buckets, None for all. Entries that repeat one of their
    own text are left out; ``own_spans`` has them. before, after: the bytes on either
    side of the q-gram that belong to strings of the entry, if asked for.
    """
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch, raw, offsets, base in pieces(batches):
            row, anchor, lo, hi, bucket, u = entries(raw, offsets)
            on = own_repeats(row, lo, hi, bucket, u)[0]
            if wanted is not None:
                slot = (bucket & _U(8 * len(wanted) - 1)).astype(np.int64)
                on &= wanted[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
            row, anchor, lo, hi, bucket, u = (x[on] for x in (row, anchor, lo, hi, bucket, u))
            before: list[bytes | None] = [None] * len(row)
            after = before
            if with_bytes:
                data = raw.tobytes()
                before = [data[a:b] for a, b in zip(lo.tolist(), anchor.tolist())]
                after = [data[a + GRAM : b + SPAN] for a, b in zip(anchor.tolist(), hi.tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("h").take(take), pa.array(bucket.view(np.int64)), pa.array(u.view(np.int64)), pa.array(anchor - offsets[row] + base), pa.array((anchor - lo).astype(np.int32)), pa.array((anchor - hi).astype(np.int32)), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                ["id", "h", "k", "u", "pos", "left", "first", "before", "after"],
            )

    return docs.select("id", "h", "text").mapInArrow(run, _ENTRY)


def own_spans(docs: DataFrame) -> DataFrame:
    """``id, h, start, end``: runs of entries that repeat an earlier one in the same half megabyte of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, offsets, base in pieces(batches):
            row, _, lo, hi, bucket, u = entries(raw, offsets)
            _, r, start, end = own_repeats(row, lo, hi, bucket, u)
            take, shift = pa.array(r), base - offsets[r]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("h").take(take), pa.array(start + shift), pa.array(end + shift)], ["id", "h", "start", "end"])

    return docs.select("id", "h", "text").mapInArrow(run, "id long, h long, start long, end long")


def bitmap(values: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of ``values(k)`` modulo ``bits``."""
    slot = F.pmod(F.col("k"), F.lit(bits)) + 1
    parts = values.groupBy(F.bitmap_bucket_number(slot).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("b")).collect()
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for n, b in parts:
        out[(n - 1) * 4096 : n * 4096] = np.frombuffer(bytes(b), np.uint8)
    return out[: bits // 8]


def repeated_buckets(docs: DataFrame, tables: Tables) -> DataFrame:
    """``k, refine, first_id`` of buckets with several entries; refine: these differ."""
    counted = identifiers(docs).groupBy("k").agg(F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high"), F.min("id").alias("first_id"))
    return store(counted.where("n > 1").select("k", (F.col("low") < F.col("high")).alias("refine"), "first_id"), "buckets", tables)


def span(first: str | Column, last: str | Column) -> list[Column]:
    """Bytes of the strings that start ``last`` to ``first`` bytes before ``pos``."""
    return [(F.col("pos") - last).alias("start"), (F.col("pos") - first + SPAN).alias("end")]


def uniform_repeats(docs: DataFrame, buckets: DataFrame, bits: np.ndarray | None, tables: Tables) -> DataFrame:
    """Repeats in buckets whose entries are all equal: all but the first."""
    met = all_entries(docs, bits, False).drop("before", "after").join(buckets.where("not refine").select("k", "first_id"), "k")
    met = store(met.select("k", "id", "h", "pos", "left", "first", (F.col("id") > F.col("first_id")).alias("later")), "uniform", tables)
    # of a text in several pieces, or of texts of one id, all but the first
    own = met.where("not later").groupBy("k", "id").agg(F.count("*").alias("n"), F.min(F.struct("h", "pos")).alias("head")).where("n > 1")
    own = met.where("not later").join(own, ["k", "id"]).where(F.struct("h", "pos") != F.col("head"))
    where = ["id", "h", *span(F.col("first"), F.col("left"))]
    return met.where("later").select(where).union(own.select(where))


def refinable(docs: DataFrame, buckets: DataFrame, bits: np.ndarray | None, tables: Tables) -> DataFrame:
    """Entries of the buckets to refine, with the bytes around their q-gram."""
    if bits is not None:
        return store(all_entries(docs, bits, True), "entries", tables)
    found = all_entries(docs, None, False).drop("before", "after").join(buckets.where("refine").select("k"), "k").distinct()
    places = found.groupBy("id", "h").agg(F.collect_list(F.struct("pos", "left", "first", "k", "u")).alias("places"))
    here = places.join(docs.select("id", "h", F.col("text").cast("binary").alias("raw")).distinct(), ["id", "h"])
    before = F.expr("substring(raw, cast(p.pos - p.left + 1 as int), p.left)")
    after = F.expr(f"substring(raw, cast(p.pos + {GRAM + 1} as int), {SPAN - GRAM} - p.first)")
    one = here.select("id", "h", "raw", F.explode("places").alias("p")).select("id", "h", "p.*", before.alias("before"), after.alias("after"))
    return store(one, "entries", tables)


def refined(found: DataFrame, entries_: Tables, spans: Tables) -> list[DataFrame]:
    """Repeats ``id, h, start, end`` among entries of buckets with different ones; drops the table of the entries."""
    spark, place = found.sparkSession, F.struct("id", "h", "pos")
    # equal entries of a bucket repeat the first of them; only these are refined
    now_at = Tables(spark)
    heads = found.groupBy("k", "u").agg(F.min(place).alias("head"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("left", "first", "before", "after")])
    heads = store(heads, "heads", now_at)
    met = found.drop("before", "after").join(heads.where("n > 1").select("k", "u", "head"), ["k", "u"])
    out = [store(met.where(place != F.col("head")).select("id", "h", *span(F.col("first"), F.col("left"))), "repeats", spans)]
    entries_.drop()
    zero = F.lit(0).cast("long")
    rest = heads.select("head.*", F.col("k").alias("b1"), zero.alias("b2"), F.lit(0).alias("o1"), F.lit(SPAN - GRAM).alias("o2"), F.col("first").alias("c1"), F.col("left").alias("c2"), "before", "after")
    while True:
        x, before, after = (lambda c: F.col(f"x.{c}")), F.col("before"), F.col("after")
        now = rest.withColumn("x", F.explode(F.array(*parts(F.col("c1"), F.col("c2"), F.col("o1"), F.col("o2"))))).where("x.c1 <= x.c2")
        # what the core gains on either side: the q-grams at the next offsets
        gained = [F.substring(before, F.col("c2") - x("o1") + 1, x("o1") - F.col("o1")), F.substring(after, F.lit(1), F.col("o2") - x("o2"))]
        kept = [F.substring(before, F.col("c2") - x("c2") + 1, x("c2") - x("o1")), F.substring(after, F.col("o2") - x("o2") + 1, x("o2") - x("c1"))]
        ids = [F.xxhash64("b1", x("o1"), *gained).alias("b1"), F.xxhash64(*gained, x("o2"), "b2").alias("b2")]
        now = now.select("id", "h", "pos", *ids, "x.*", kept[0].alias("before"), kept[1].alias("after")).withColumn("u", F.xxhash64("before", "c1", "after", "c2"))
        buckets = now.groupBy("b1", "b2").agg(F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high"), F.min(place).alias("head")).where("n > 1").drop("n")
        next_at = Tables(spark)
        met = store(now.join(buckets, ["b1", "b2"]).drop("u"), "refined", next_at)
        now_at.drop()
        now_at = next_at
        out.append(store(met.where((F.col("low") == F.col("high")) & (place != F.col("head"))).select("id", "h", *span(F.col("c1"), F.col("c2"))), "repeats", spans))
        rest = met.where("low < high").drop("low", "high", "head")
        if rest.isEmpty():
            now_at.drop()
            return out


def parts(c1: Column, c2: Column, o1: Column, o2: Column) -> list[Column]:
    """A range of offsets o1 to o2 in SPLIT parts, each with the entry's own offsets (c1 to c2) in it."""
    out, size = [], F.ceil((o2 - o1 + 1) / SPLIT).cast("int")
    for i in range(SPLIT):
        a, b = o1 + i * size, F.least(o2, o1 + (i + 1) * size - 1)
        out.append(F.struct(a.alias("o1"), b.alias("o2"), F.greatest(c1, a).alias("c1"), F.least(c2, b).alias("c2")))
    return out


def find_repeats(docs: DataFrame, bits: int, spans: Tables) -> DataFrame:
    """Repeats ``id, h, start, end`` of ``docs`` (see ``keyed``), in the tables of ``spans``."""
    tables, own = Tables(docs.sparkSession), Tables(docs.sparkSession)
    buckets = repeated_buckets(docs, tables)
    few = buckets.count() * SELECTIVE <= bits
    equal, differ = (bitmap(buckets.where(c), bits) if few else None for c in ("not refine", "refine"))
    out = store(own_spans(docs), "repeats", spans)
    for more in refined(refinable(docs, buckets, differ, own), own, spans):
        out = out.union(more)
    out = out.union(store(uniform_repeats(docs, buckets, equal, own), "repeats", spans))
    own.drop()
    tables.drop()
    return out


def repeats(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Repeats of ``docs``: see ``refined``; ``id`` and ``h`` as in ``keyed``."""
    return find_repeats(keyed(docs), bits, Tables(docs.sparkSession)).distinct()


def deduplicate(docs: DataFrame, bits: int = BITS, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and the remaining bytes (``kept``) of each row."""
    docs = keyed(docs)
    found = Tables(docs.sparkSession)
    spans = find_repeats(docs, bits, found).groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    spans = store(spans, "spans")
    found.drop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw, offsets = byte_view(batch.column("text"))
            removed, runs, digests, kept = [], [], [], []
            lists = batch.column("spans")
            for i in range(batch.num_rows):
                own = raw[offsets[i] : offsets[i + 1]]
                spans = lists[i]
                if spans.is_valid:
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, spans.values.field("start").to_numpy(), 1)
                    np.add.at(edge, spans.values.field("end").to_numpy(), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    runs.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    own = own[~gone]
                else:
                    removed.append(0)
                    runs.append(0)
                rest = own.tobytes()
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            arrays = [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return docs.join(spans, ["id", "h"], "left").select("doc_id", "text", "spans").mapInArrow(run, schema)


def op6_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"), with_text=False)
