"""Benchmark decontamination by winnowing.

Both sides are cut into words and k-word grams are hashed; in every run of w grams
the smallest hash is kept (the last one of equals), with k + w - 1 = the window's
words, so two texts that share a window keep the same gram at the same place in it.
Kept grams of documents are first held against a bitmap of fixed size made of the
benchmark's, joined with these, and each hit is extended word by word; it counts if
it grows to a whole window. Such a hit agrees in half of the missing words at least on
one side, so the join is on the gram and the words of one side: a common gram with many
surroundings does not meet them all. An item shorter than a window is a window itself and is
found by the hash of all its words.

The bitmap's size is a constant. The benchmark's grams are broadcast only if they
are few (``BROADCAST_ROWS``, counted first); otherwise both sides are shuffled.

Null or empty text has no words; items without words or item_id match nothing.
Repeated rows and doc_ids give a row each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm.common import BYTE_CODES, LOWER, byte_view, grams, mix, read, slices, spans_hash, store, texts, words_of

WINDOW, GRAM = 10, 5
BITS = 1 << 23
BROADCAST_ROWS = 100_000
#: Bytes of words after lower-casing: digits, a-z and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_HIT = pa.struct([("kind", pa.int32()), ("fp", pa.int64()), ("pos", pa.int64()), ("gram", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])
_SCHEMA = "row long, id long, n_words long, hits array<struct<kind:int,fp:long,pos:long,gram:string,left:array<string>,right:array<string>>>"


def winnow(h: np.ndarray, rows: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that winnowing keeps; windows do not cross rows."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, k)
    best, at = g[:n].copy(), np.arange(n)
    for i in range(1, window - k + 1):
        lower = g[i : i + n] <= best
        best[lower] = g[i : i + n][lower]
        at[lower] = np.flatnonzero(lower) + i
    at = np.unique(at[rows[:n] == rows[window - 1 :]])
    return at, g[at]


def fingerprints(table: DataFrame, short: list[int], bitmap: np.ndarray | None, whole_short: bool) -> DataFrame:
    """Words and kept grams of each row of ``table(row, id, text)``.

    short: lengths of short items whose grams are looked for. whole_short: a short text is one gram.
    """
    held = table.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in slices(batches, "text", 1 << 20):
            raw, offsets = byte_view(batch.column("text"))
            low = LOWER[raw]
            starts, ends, rows = words_of(low, offsets, WORD)
            h = spans_hash(BYTE_CODES[low], starts, ends)
            n_words = np.bincount(rows, minlength=batch.num_rows)
            first = np.cumsum(n_words) - n_words
            kept = [(0, *winnow(h, rows, WINDOW, GRAM))]
            for n in short:
                g = mix(grams(h, n) + np.uint64(n))
                at = np.flatnonzero(rows[: len(g)] == rows[n - 1 :]) if len(g) else np.zeros(0, np.int64)
                if whole_short:
                    at = at[n_words[rows[at]] == n]
                kept.append((n, at, g[at]))
            hits: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            data = low.tobytes()
            word = lambda i: data[starts[i] : ends[i]].decode()
            for kind, at, fp in kept:
                if bits is not None:
                    slot = (fp & np.uint64(BITS - 1)).astype(np.int64)
                    on = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0
                    at, fp = at[on], fp[on]
                size, around = (kind, 0) if kind else (GRAM, WINDOW - GRAM)
                for p, f in zip(at.tolist(), fp.view(np.int64).tolist()):
                    r = int(rows[p])
                    lo, hi = int(first[r]), int(first[r] + n_words[r])
                    hits[r].append({
                        "kind": kind, "fp": f, "pos": p - lo, "gram": " ".join(map(word, range(p, p + size))),
                        "left": [word(i) for i in range(p - 1, max(lo, p - around) - 1, -1)],
                        "right": [word(i) for i in range(p + size, min(hi, p + size + around))],
                    })
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(_HIT))], ["row", "id", "n_words", "hits"])

    return table.mapInArrow(run, _SCHEMA)


def same_run(a: Column, b: Column) -> Column:
    """Words from the start in which two arrays of WINDOW - GRAM words at most agree."""
    run, total = F.lit(True), F.lit(0)
    for i in range(WINDOW - GRAM):
        run = run & (F.get(a, F.lit(i)) == F.get(b, F.lit(i)))
        total = total + F.when(run, 1).otherwise(0)
    return total


def sides(kind: Column, left: Column, right: Column) -> Column:
    """The join's keys: a hash of the nearest words of either side, as many as a hit must agree in on one of them."""
    need = (WINDOW - GRAM + 1) // 2
    one = lambda n, words: F.when(F.size(words) >= need, F.struct(F.lit(n).alias("side"), F.xxhash64(F.slice(words, 1, need)).alias("near")))
    return F.when(kind > 0, F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("long").alias("near")))).otherwise(F.array_compact(F.array(one(1, left), one(2, right))))


def bitmap_of(grams_: DataFrame) -> np.ndarray:
    """A bit for each fingerprint modulo BITS: BITS / 8 bytes, whatever the benchmark's size."""
    slot = F.pmod(F.col("fp"), F.lit(BITS)) + 1
    parts = grams_.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for bucket, bits in parts:
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents ``(row, doc_id, n_words)``, hit spans ``(row, start, end)`` in words, and items ``(row, item_id)``."""
    number = F.monotonically_increasing_id()
    items = benchmark.select(number.alias("row"), F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("id is not null")
    all_short = list(range(1, WINDOW))
    test = store(fingerprints(items, all_short, None, True), "items")
    short = sorted(r[0] for r in test.where(f"n_words between 1 and {WINDOW - 1}").select("n_words").distinct().collect())
    test = test.select("id", F.explode("hits").alias("h")).select("id", "h.*")
    key = ["kind", "fp", "gram", "left", "right"]
    contexts = store(test.select(*key).distinct().withColumn("context", number), "contexts")
    of_item = test.join(contexts, key).select("context", F.col("id").alias("item_id")).distinct()

    rows = texts(docs).select(number.alias("row"), F.col("doc_id").alias("id"), "text")
    train = store(fingerprints(rows, short, bitmap_of(contexts), False), "train")
    hits = train.select("row", F.explode("hits").alias("h")).select("row", F.col("h.pos").alias("pos"), *[F.col(f"h.{c}").alias(c) for c in ("kind", "fp", "gram")], F.col("h.left").alias("l"), F.col("h.right").alias("r"))
    small = contexts.count() <= BROADCAST_ROWS
    around = contexts.withColumn("s", F.explode(sides(F.col("kind"), F.col("left"), F.col("right")))).select("*", "s.side", "s.near").drop("s")
    hits = hits.withColumn("s", F.explode(sides(F.col("kind"), F.col("l"), F.col("r")))).select("*", "s.side", "s.near").drop("s")
    met = hits.join(F.broadcast(around) if small else around, ["kind", "fp", "gram", "side", "near"])
    size = F.when(F.col("kind") > 0, F.col("kind")).otherwise(GRAM)
    met = met.withColumn("before", same_run(F.col("l"), F.col("left"))).withColumn("after", same_run(F.col("r"), F.col("right")))
    met = met.where((F.col("kind") > 0) | (F.col("before") + F.col("after") >= WINDOW - GRAM))
    met = store(met.select("row", "context", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + size + F.col("after")).alias("end")).distinct(), "hits")
    spans = met.select("row", "start", "end").distinct()
    found = met.select("row", "context").distinct().join(of_item, "context").select("row", "item_id").distinct()
    return train.select("row", F.col("id").alias("doc_id"), "n_words"), spans, found


def covered(spans: DataFrame) -> DataFrame:
    """Words inside any span, for each row."""
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0))
    return spans.withColumn("reach", reach).groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "reach"))).cast("long").alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows, spans, found = contamination(docs, benchmark)
    items = found.select("row", F.col("item_id").cast("string").alias("item")).groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = rows.join(covered(spans), "row", "left").join(items, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dg AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT DISTINCT doc_id, p, n, item_id FROM dg JOIN iw USING (g, n)),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
