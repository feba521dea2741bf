"""Periodic runs of words: repeated k-gram masking, then Main and Lorentz's division.

A run is a stretch of words with smallest period q that is at least ``max(MIN_WORDS,
MIN_TIMES * q)`` long and that neither neighbour extends. Shifted by q it overlaps itself
in ``length - q`` words, so each of its words is in a gram that occurs twice in the text;
the shortest such overlap over all q gives the length k of the gram (``overlap``). Words
outside repeated k-grams are masked. What is left falls into segments, and a run lies
within one.

Segments are halved again and again (Main and Lorentz). A run that crosses the middle of
a block, and no middle above it, lies within the block and has two periods on one side of
the middle: for each period up to a quarter of the block it is asked whether the words
right of the middle, or left of it, are a square. All blocks of a level, of all texts of
a batch, are asked together, by hashes of word ranges. The few squares are extended to
either side by searching for the longest common extension, which gives the whole run;
runs found in several blocks or with multiples of their period are one, with the smallest
period. Hashes cannot hide a square; whatever they report is compared word by word, and
a false report is replaced by plain comparison.

One pass over the documents without a shuffle; memory is in proportion to a batch of
``_BATCH`` bytes or one text. Null text has no words. Repeated rows and doc_ids give a
row each; a row without doc_id has no copied words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from foliate.llm.common import byte_view, grams, mix, powers, read, slices, texts, words_of

_U = np.uint64
MIN_WORDS, MIN_TIMES = 6, 4
_BATCH = 1 << 20
#: Everything but space and the control characters from tab to carriage return.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = _U(0xD1342543DE82EF95)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
#: Periods of a level that are looked at together.
_TOGETHER = 1 << 20


def overlap(min_words: int = MIN_WORDS, min_times: int = MIN_TIMES) -> int:
    """The least number of words in which a run overlaps itself when shifted by its period."""
    return min(max(min_words, min_times * q) - q for q in range(1, min_words + 1))


def copied(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(start, period) from which words of a text of n words are copied in turn, for one text in ten."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def word_numbers(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, equal for equal words, and the words."""
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = raw[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def repeated_grams(numbers: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Whether each word is in a k-gram that occurs twice or more in its row. Rows stand one after the other."""
    keep = np.zeros(len(numbers) + 1, np.int32)
    if len(numbers) >= k:
        codes = mix((numbers + 1).astype(_U))
        g = mix(grams(codes, k) + mix(row[: len(numbers) - k + 1].astype(_U)))
        whole = np.flatnonzero(row[: len(g)] == row[k - 1 :])
        order = whole[np.argsort(g[whole], kind="stable")]
        same = g[order[1:]] == g[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        np.add.at(keep, order[twice], 1)
        np.add.at(keep, order[twice] + k, -1)
    return np.cumsum(keep[:-1]) > 0


class Ranges:
    """Hashes of ranges of words: differences of one running polynomial."""

    def __init__(self, numbers: np.ndarray):
        self.back = powers(_INVERSE, len(numbers) + 1)
        self.run = np.zeros(len(numbers) + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(mix((numbers + 1).astype(_U)) * powers(_BASE, len(numbers)), dtype=_U, out=self.run[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.run[a + n] - self.run[a]) * self.back[a] == (self.run[b + n] - self.run[b]) * self.back[b]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from a and b on (or before them) are equal, ``most`` at most."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            n = (low + high + 1) // 2
            same = self.equal(a, b, n) if forward else self.equal(a - n, b - n, n)
            low, high = np.where(same, n, low), np.where(same, high, n - 1)
        return low


def squares(numbers: np.ndarray, ranges: Ranges, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(segment, start, period) of squares beside the middles of blocks, level by level."""
    segment, lo, hi = np.arange(len(begin)), begin.copy(), end.copy()
    while len(lo):
        size = hi - lo
        on = size >= MIN_WORDS
        segment, lo, hi, size = segment[on], lo[on], hi[on], size[on]
        middle, periods = lo + size // 2, size // MIN_TIMES
        done = np.append(0, np.cumsum(periods))
        start = 0
        while start < len(lo):  # blocks of a level in parts of bounded size; a block larger than that alone
            stop = max(start + 1, int(np.searchsorted(done, done[start] + _TOGETHER, "right")) - 1)
            block = np.repeat(np.arange(start, stop), periods[start:stop])
            p = np.arange(done[start], done[stop]) - done[block] + 1
            m, s = middle[block], segment[block]
            right = np.flatnonzero(numbers[m] == numbers[m + p])
            right = right[ranges.equal(m[right], m[right] + p[right], p[right])]
            left = np.flatnonzero(numbers[m - 1] == numbers[m - 1 - p])
            left = left[ranges.equal(m[left] - 2 * p[left], m[left] - p[left], p[left])]
            yield np.concatenate([s[right], s[left]]), np.concatenate([m[right], m[left] - 2 * p[left]]), np.concatenate([p[right], p[left]])
            start = stop
        segment, lo, hi = np.concatenate([segment, segment]), np.concatenate([lo, middle]), np.concatenate([middle, hi])


def runs_of(numbers: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in the segments [begin, end), sorted."""
    ranges, found = Ranges(numbers), [np.zeros((0, 4), np.int64)]
    for segment, start, period in squares(numbers, ranges, begin, end):
        first, last = begin[segment], end[segment]
        before = ranges.extension(start, start + period, start - first, False)
        after = ranges.extension(start + period, start + 2 * period, last - start - 2 * period, True)
        rows = np.stack([start - before, before + 2 * period + after, period, segment], 1)
        rows = rows[rows[:, 1] >= np.maximum(MIN_WORDS, MIN_TIMES * rows[:, 2])]
        # of the periods of one stretch the smallest
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        head = np.ones(len(rows), bool)
        head[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        found.append(rows[head])
    rows = np.concatenate(found)
    true = np.array([confirmed(numbers, begin[g], end[g], a, n, p) for a, n, p, g in rows.tolist()], bool)
    if not true.all():
        rows = np.concatenate([rows[true], *(plain_runs(numbers, begin[g], end[g], g) for g in np.unique(rows[~true, 3]))])
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    head = np.ones(len(rows), bool)
    head[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[head]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return rows[:, 0], rows[:, 1], rows[:, 2]


def confirmed(numbers: np.ndarray, begin: int, end: int, start: int, length: int, period: int) -> bool:
    """Whether the stretch has the period and neither neighbour continues it."""
    stop = start + length
    if not (numbers[start : stop - period] == numbers[start + period : stop]).all():
        return False
    return not (start > begin and numbers[start - 1] == numbers[start - 1 + period]) and not (stop < end and numbers[stop] == numbers[stop - period])


def plain_runs(numbers: np.ndarray, begin: int, end: int, segment: int) -> np.ndarray:
    """All runs of a segment by comparison of words with words one period on, for each period."""
    x, out = numbers[begin:end], []
    for p in range(1, len(x) // MIN_TIMES + 1):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (x[:-p] == x[p:]).astype(np.int8), [0]])))
        a, n = edge[::2], edge[1::2] - edge[::2] + p
        on = n >= max(MIN_WORDS, MIN_TIMES * p)
        out.append(np.stack([a[on] + begin, n[on], np.full(on.sum(), p), np.full(on.sum(), segment)], 1))
    return np.concatenate([np.zeros((0, 4), np.int64), *out])


def segments(numbers: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of the stretches of repeated k-grams; none reaches into the next row."""
    kept = np.flatnonzero(repeated_grams(numbers, row, overlap()))
    opens = np.ones(len(kept), bool)
    opens[1:] = (np.diff(kept) > 1) | (row[kept[1:]] != row[kept[:-1]])
    return kept[opens], kept[np.append(opens[1:], True) if len(kept) else opens] + 1


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, runs, collapsed`` of each row.

    runs: all ``start, length, period`` in words; collapsed: the text with the first period of each run only, words joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH):
            raw, offsets = byte_view(batch.column("text"))
            starts, ends, row = words_of(raw, offsets, IS_WORD)
            numbers, words = word_numbers(raw, starts, ends)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            ids = batch.column("doc_id").to_pylist()
            for i, doc_id in enumerate(ids):
                if tail := copied(doc_id, int(cuts[i + 1] - cuts[i])):
                    a = cuts[i] + tail[0]
                    numbers[a : cuts[i + 1]] = numbers[a + np.arange(cuts[i + 1] - a) % tail[1]]
            begin, end = segments(numbers, row)
            at, length, period = runs_of(numbers, begin, end)
            dropped = np.zeros(len(numbers) + 1, np.int32)
            np.add.at(dropped, at + period, 1)
            np.add.at(dropped, at + length, -1)
            kept = np.cumsum(dropped[:-1]) == 0
            own = np.searchsorted(at, cuts)
            vocabulary, out = words.to_pylist(), []
            for i in range(batch.num_rows):
                x, y = own[i], own[i + 1]
                runs = np.stack([at[x:y] - cuts[i], length[x:y], period[x:y]], 1).tolist()
                best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                mine = numbers[cuts[i] : cuts[i + 1]][kept[cuts[i] : cuts[i + 1]]]
                text = b" ".join([vocabulary[j] for j in mine.tolist()])
                lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
                most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                out.append((ids[i], len(runs), *most, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), [dict(zip(("start", "length", "period"), r)) for r in runs], text.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], _NAMES)

    return texts(docs).mapInArrow(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string")


_NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
_TYPES = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]


def op12_repeated_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents")).drop("runs", "collapsed")
