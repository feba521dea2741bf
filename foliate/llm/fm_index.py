"""Removal of repeated passages of words by compressed FM-indexes.

A window is WINDOW consecutive words. An index of the whole corpus that every document is
streamed past would take time with the square of the corpus, so windows are routed: each
chooses the gram of GRAM words in it with the smallest hash (the first of equals), equal
windows choose alike, and neighbours that share their choice are one segment of
``WINDOW`` to ``2 * WINDOW - GRAM`` words. Every window is in one segment, and equal
windows meet in the shard of their gram. Segments whose gram is nowhere else go nowhere.

A shard's segments, each different one once with the number of its occurrences, are
indexed: the suffixes are sorted, their preceding words (the Burrows-Wheeler transform)
go into a wavelet matrix of packed bits with counts, and the suffix array is thrown away;
kept are counts of smaller words, the borders between suffixes that differ in their first
WINDOW - 1 words, and running sums of occurrences. Segments are then streamed past it, all
of a shard together: backward search takes one word after the other from the right, and
once WINDOW - 1 words have matched, the interval is widened to that length before the
next, so the interval of each window is exact. A window whose interval has two or more
occurrences is reported.

The number of shards grows with the segments, so an index is of bounded size. A gram with
more than CROWD different segments (a common line in many contexts) is in no shard: its
windows are told apart by 128-bit hashes and counted, an exact way without a group in one
task. Words are compared as bytes in a shard; grams, segments and windows of crowds by
64 + 64 bits. Repeated grams are marked in a bitmap of fixed size while it is selective;
beyond that, segments meet them in a shuffled join.

Null or empty texts have no words. Rows that repeat a doc_id, or a doc_id and its text,
are documents of their own, so equal rows repeat each other; all rows get a result, also
one without doc_id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import BYTE_CODES, Tables, byte_view, grams, mix, read, slices, spans_hash, store, words_of
from foliate.llm.periodic_runs import IS_WORD, word_numbers
from foliate.llm.suffix_dedup import BITS, SELECTIVE, bitmap, keyed

_U = np.uint64
WINDOW, GRAM = 35, 12
#: Words of a shard's segments, and different segments of a gram, beyond which it is a crowd.
SHARD, CROWD = 250_000, 2_048
_BATCH = 1 << 20


def cut_segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first word within the row, windows, byte start, byte end, gram, content) of the segments of some texts, and the words' (code, row)."""
    starts, ends, row = words_of(raw, offsets, IS_WORD)
    h = spans_hash(BYTE_CODES[raw], starts, ends)
    none = (*(np.zeros(0, np.int64),) * 5, *(np.zeros(0, _U),) * 2, h, row)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return none
    g = grams(h, GRAM)
    # smallest gram of each window; equal hashes: the first
    width, best = WINDOW - GRAM + 1, np.arange(len(g))
    step = 1
    while step < width:
        by = min(step, width - step)
        a, b = best[:-by], best[by:]
        best = np.where(g[b] < g[a], b, a)
        step += by
    whole = np.flatnonzero(row[:n] == row[WINDOW - 1 :])
    if not len(whole):
        return none
    anchor = best[whole]
    opens = np.ones(len(whole), bool)
    opens[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(whole) > 1)
    lo = whole[opens]
    hi = whole[np.append(opens[1:], True)]
    content = mix(spans_hash(h, lo, hi + WINDOW) + mix((anchor[opens] - lo).astype(_U)))
    first = np.searchsorted(row, row[lo])
    return row[lo], lo - first, hi - lo + 1, starts[lo], ends[hi + WINDOW - 1], g[anchor[opens]], content, h, row


def gram_counts(docs: DataFrame) -> DataFrame:
    """``k``: grams of two or more segments, whatever their contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH):
            k, n = np.unique(cut_segments(*byte_view(batch.column("text")))[5], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["k", "n"])

    return docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n > 1").select("k")


_PLACE = "id long, h long, first long, windows int, k long, u long"


def segments(docs: DataFrame, bits: np.ndarray | None, with_text: bool) -> DataFrame:
    """``id, h, first, windows, k, u`` of the segments whose gram is in the bitmap (None: all), or ``k, u, windows, n, words`` with their texts, equal ones of a batch together."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value
        for batch in slices(batches, "text", _BATCH):
            raw, offsets = byte_view(batch.column("text"))
            row, first, windows, a, b, k, u = cut_segments(raw, offsets)[:7]
            if wanted is not None:
                slot = (k & _U(8 * len(wanted) - 1)).astype(np.int64)
                on = wanted[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
                row, first, windows, a, b, k, u = (x[on] for x in (row, first, windows, a, b, k, u))
            if with_text:
                order = np.lexsort((u, k))
                head = np.ones(len(order), bool)
                head[1:] = (k[order[1:]] != k[order[:-1]]) | (u[order[1:]] != u[order[:-1]])
                n = np.diff(np.append(np.flatnonzero(head), len(order)))
                order, data = order[head], raw.tobytes()
                words = [data[x:y] for x, y in zip(a[order].tolist(), b[order].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(k[order].view(np.int64)), pa.array(u[order].view(np.int64)), pa.array(windows[order].astype(np.int32)), pa.array(n), pa.array(words, pa.binary())], ["k", "u", "windows", "n", "words"])
            else:
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("h").take(take), pa.array(first), pa.array(windows.astype(np.int32)), pa.array(k.view(np.int64)), pa.array(u.view(np.int64))], ["id", "h", "first", "windows", "k", "u"])

    if with_text:
        return docs.select("text").mapInArrow(run, "k long, u long, windows int, n long, words binary")
    return docs.select("id", "h", "text").mapInArrow(run, _PLACE)


class Wavelet:
    """Counts of a symbol before a place, in a matrix of bits: a packed word and a running count for each 64 symbols of a level."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.n = levels, len(symbols)
        self.words, self.counts, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            packed = np.packbits(np.append(bit, np.zeros(64 - len(bit) % 64, np.uint8)), bitorder="little").view(_U)
            self.words.append(packed)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        # where each symbol's block begins after the last level
        values, at = np.unique(symbols, return_index=True)
        self.begins = np.zeros(int(values.max(initial=0)) + 1, np.int64)
        self.begins[values] = at

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        at = place
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            block, rest = at >> 6, (at & 63).astype(_U)
            ones = self.counts[i][block] + np.bitwise_count(self.words[i][block] & ((_U(1) << rest) - _U(1)))
            at = np.where(symbol >> level & 1, self.zeros[i] + ones, at - ones)
        return at - self.begins[symbol]


class Index:
    """FM-index of sequences of word numbers (from 1 on), with a weight for each sequence.

    Sequences end at separators, which are smaller than all words and differ from each other.
    """

    def __init__(self, numbers: np.ndarray, lengths: np.ndarray, weights: np.ndarray, window: int):
        """numbers: the words of all sequences, one after the other."""
        m, n = len(lengths), len(numbers) + len(lengths)
        owner = np.repeat(np.arange(m), lengths + 1)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        text[np.setdiff1d(np.arange(n), ends, assume_unique=True)] = numbers
        rank = text + m
        rank[ends] = np.arange(m)
        # suffixes are told apart by their first 1, 2, 4 ... words; the separators end it
        width, near, near_width = 1, rank, 1
        while width <= int(lengths.max(initial=0)):
            pair = rank * (n + m + 1)
            pair[:-width] += rank[width:] + 1
            order = np.argsort(pair, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(0, np.diff(pair[order]) != 0))
            width *= 2
            if width < window:
                near, near_width = rank, width
        order = np.argsort(rank, kind="stable")
        bwt = text[order - 1]
        self.n = n
        self.smaller = np.append(0, np.cumsum(np.bincount(text)))  # places of suffixes that begin with a smaller word
        self.wavelet = Wavelet(bwt, int(text.max(initial=0)).bit_length())
        self.weight = np.append(0, np.cumsum(weights[owner[order]]))
        # borders between suffixes that differ in their first window - 1 words
        later = np.minimum(order + (window - 1 - near_width), n - 1)
        a, b = near[order], near[later]
        self.borders = np.append(np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))), n)
        self.window = window

    def step(self, word: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with the word and go on like those of the interval."""
        both = self.wavelet.rank(np.concatenate([word, word]), np.concatenate([left, right])) + np.tile(self.smaller[word], 2)
        return both[: len(word)], both[len(word) :]

    def widen(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of all suffixes that begin with the same window - 1 words."""
        return self.borders[np.searchsorted(self.borders, left, "right") - 1], self.borders[np.searchsorted(self.borders, right)]

    def repeated(self, numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last start of a window with two or more occurrences in each sequence, -1 if none. Streamed are sequences that the index holds."""
        by_length = np.argsort(-lengths, kind="stable")
        long, ends = lengths[by_length], np.cumsum(lengths)[by_length]
        active = np.searchsorted(-long, -np.arange(1, int(long.max(initial=0)) + 1), "right")
        first, last = np.full(len(lengths), -1), np.full(len(lengths), -1)
        left, right = np.zeros(len(long), np.int64), np.full(len(long), self.n)
        for t, count in enumerate(active.tolist()):
            l, r = left[:count], right[:count]
            if t >= self.window:
                l, r = self.widen(l, r)
            l, r = self.step(numbers[ends[:count] - 1 - t], l, r)
            left[:count], right[:count] = l, r
            if t >= self.window - 1:
                hit = np.flatnonzero(self.weight[r] - self.weight[l] > 1)
                start = long[hit] - 1 - t
                first[by_length[hit]] = start
                fresh = hit[last[by_length[hit]] < 0]
                last[by_length[fresh]] = long[fresh] - 1 - t
        return first, last


def search_shard(table: pa.Table) -> pa.Table:
    """``k, u, first, last`` of the segments of a shard with repeated windows."""
    raw, offsets = byte_view(table.column("words").combine_chunks().cast(pa.string()))
    starts, ends, row = words_of(raw, offsets, IS_WORD)
    numbers = word_numbers(raw, starts, ends)[0] + 1
    lengths = np.bincount(row, minlength=table.num_rows)
    index = Index(numbers, lengths, table.column("n").to_numpy(), WINDOW)
    first, last = index.repeated(numbers, lengths)
    on = np.flatnonzero(first >= 0)
    take = pa.array(on)
    return pa.table({"k": table.column("k").take(take), "u": table.column("u").take(take), "first": first[on].astype(np.int32), "last": last[on].astype(np.int32)})


def crowd_windows(crowd: DataFrame) -> DataFrame:
    """``k, u, at, n, a, b``: the windows of segments ``k, u, n, words`` with a hash of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "words", _BATCH):
            raw, offsets = byte_view(batch.column("words"))
            starts, ends, row = words_of(raw, offsets, IS_WORD)
            h = spans_hash(BYTE_CODES[raw], starts, ends)
            at = np.flatnonzero(row[: max(0, len(h) - WINDOW + 1)] == row[WINDOW - 1 :])
            a, b = spans_hash(h, at, at + WINDOW), spans_hash(mix(h), at, at + WINDOW)
            take = pa.array(row[at])
            place = at - np.searchsorted(row, row[at])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("k", "u", "n")), pa.array(place.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["k", "u", "n", "at", "a", "b"])

    return crowd.select("k", "u", "n", F.col("words").cast("string").alias("words")).mapInArrow(run, "k long, u long, n long, at int, a long, b long")


def repeated_segments(docs: DataFrame, repeated: DataFrame, bits: np.ndarray | None, found: Tables) -> DataFrame:
    """``k, u, first, last``: windows first to last of the segment contain all its repeated ones, and cover the words of these only."""
    tables = Tables(docs.sparkSession)
    parts = segments(docs, bits, True)
    parts = parts if bits is not None else parts.join(repeated, "k")
    different = parts.groupBy("k", "u").agg(F.sum("n").alias("n"), F.first("windows").alias("windows"), F.first("words").alias("words"))
    different = store(different, "segments", tables)
    per_gram = different.groupBy("k").agg(F.count("*").alias("d"), F.sum("n").alias("n")).where("n > 1")
    per_gram = store(per_gram.withColumn("crowd", F.col("d") > CROWD).drop("n"), "grams", tables)
    words = different.agg(F.sum(F.col("windows") + WINDOW - 1)).first()[0] or 0
    shards = max(1, -(-words // SHARD))
    met = different.join(per_gram.select("k", "crowd"), "k")
    shard = met.where("not crowd").select(F.pmod(F.xxhash64("k"), F.lit(shards)).alias("shard"), "k", "u", "n", "words")
    out = store(shard.groupBy("shard").applyInArrow(search_shard, "k long, u long, first int, last int"), "found", found)
    if not per_gram.where("crowd").isEmpty():
        windows = store(crowd_windows(met.where("crowd")), "windows", tables)
        several = windows.groupBy("a", "b").agg(F.sum("n").alias("all")).where("all > 1").select("a", "b")
        spans = windows.join(several, ["a", "b"]).groupBy("k", "u").agg(F.min("at").alias("first"), F.max("at").alias("last"))
        out = out.union(store(spans, "found", found))
    tables.drop()
    return out


def spans_of(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """``id, h, spans`` (start, end in words) of the texts of ``docs`` (see ``keyed``) with repeated windows; stored."""
    tables = Tables(docs.sparkSession)
    repeated = store(gram_counts(docs), "repeated", tables)
    marks = bitmap(repeated, bits) if repeated.count() * SELECTIVE <= bits else None
    found = repeated_segments(docs, repeated, marks, tables)
    places = segments(docs, marks, False).join(found.withColumnsRenamed({"first": "low", "last": "high"}), ["k", "u"])
    span = F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + WINDOW).alias("end"))
    # rows of one id and text have the same spans
    out = store(places.groupBy("id", "h").agg(F.collect_set(span).alias("spans")), "spans")
    tables.drop()
    return out


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def without_spans(rows: DataFrame, with_text: bool) -> DataFrame:
    """The result for ``rows(doc_id, text, spans)``: the kept words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH):
            raw, offsets = byte_view(batch.column("text"))
            starts, ends, row = words_of(raw, offsets, IS_WORD)
            cuts, data, spans = np.searchsorted(row, np.arange(batch.num_rows + 1)), raw.tobytes(), batch.column("spans")
            n, removed, digests, kept = np.diff(cuts), [], [], []
            for i in range(batch.num_rows):
                own = slice(cuts[i], cuts[i + 1])
                a, b = starts[own], ends[own]
                gone = 0
                if spans[i].is_valid:
                    edge = np.zeros(len(a) + 1, np.int64)
                    np.add.at(edge, spans[i].values.field("start").to_numpy(), 1)
                    np.add.at(edge, spans[i].values.field("end").to_numpy(), -1)
                    on = np.cumsum(edge[:-1]) == 0
                    gone, a, b = len(a) - int(on.sum()), a[on], b[on]
                text = b" ".join([data[x:y] for x, y in zip(a.tolist(), b.tolist())])
                removed.append(gone)
                digests.append(hashlib.sha256(text).hexdigest())
                kept.append(text)
            arrays, names = [batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays, names = [*arrays, pa.array([t.decode() for t in kept], pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(run, _RESULT + ", kept string" * with_text)


def deduplicate(docs: DataFrame, bits: int = BITS, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and the kept words (``kept``) of each row.

    Texts without repeats meet no spans: a bitmap of fixed size of the texts that have some
    sends the others past the join.
    """
    docs = keyed(docs)
    spans = spans_of(docs, bits)
    key = F.pmod(F.xxhash64("id", "h"), F.lit(bits))
    marks = bitmap(spans.select(key.alias("k")), bits)
    held = docs.sparkSession.sparkContext.broadcast(marks)

    def some(k: pa.Array) -> pa.Array:
        slot = k.to_numpy()
        return pa.array(held.value[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0)

    marked = F.arrow_udf(some, "boolean")(key)
    no_spans = F.lit(None).cast(spans.schema["spans"].dataType)
    plain = docs.where(~marked).select("doc_id", "text", no_spans.alias("spans"))
    met = docs.where(marked).join(spans, ["id", "h"], "left").select("doc_id", "text", "spans")
    return without_spans(plain, with_text).union(without_spans(met, with_text))


def op13_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"), with_text=False)


ORACLE_SQL = f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT r, unnest(range(1, len(words) - {WINDOW} + 2)) AS i, words FROM w WHERE len(words) >= {WINDOW}),
k AS MATERIALIZED (SELECT r, i, md5(array_to_string(words[i:i + {WINDOW - 1}], ' ')) AS h FROM s),
d AS (SELECT h FROM k GROUP BY h HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(range(i, i + {WINDOW})) AS p FROM k JOIN d USING (h)),
c AS (SELECT r, list(p) AS gone, count(*) AS n FROM g GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
 sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256 FROM w LEFT JOIN c USING (r)"""
