"""Words of texts and scores of asked terms, counted in Arrow functions: a text is read and scored in one task, and only its words' sums or the best of a query leave it.

A word is a run of bytes of ``IS_WORD``: letters and digits of ASCII, A-Z in small letters, and every byte of a character beyond it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a slice of texts (one text at least), cells of a block of texts and queries, rows that a task keeps besides the k of each query.
SLICE, CELLS, HELD = 1 << 22, 1 << 19, 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
Part = Callable[[np.ndarray, np.ndarray], np.ndarray]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of batches ``doc_id, text`` (no nulls), bytes of their texts and where each text begins in them, ``SLICE`` bytes at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, texts = batch.column("doc_id").to_numpy(), batch.column("text")
        _, offsets, data = texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        start = 0
        while start < len(ids):
            stop = min(max(int(np.searchsorted(at, at[start] + SLICE, "right")) - 1, start + 1), len(ids))
            yield ids[start:stop], raw[at[start] : at[stop]], at[start : stop + 1] - at[start]
            start = stop


def _borders(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are of words, which begin a word and which end one."""
    word = IS_WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    return word, begins, ends


def words(raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts in their order, and how many each text has."""
    word, begins, ends = _borders(raw, at)
    starts = np.flatnonzero(begins)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(ends) + 1 - starts, out=offsets[1:])
    held = [pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[word]])]
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, *held]), np.diff(np.searchsorted(starts, at))


def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``n, words``: how many texts there are in a task, and words in them."""
    n = total = 0
    for ids, raw, at in slices(batches):
        n, total = n + len(ids), total + int(np.count_nonzero(_borders(raw, at)[1]))
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "words"])


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, length, term, tf``."""
    for ids, raw, at in slices(batches):
        found, lengths = words(raw, at)
        coded = pc.dictionary_encode(found)
        many = max(1, len(coded.dictionary))
        key, tf = np.unique(np.repeat(np.arange(len(ids)), lengths) * many + coded.indices.to_numpy(), return_counts=True)
        row, term = np.divmod(key, many)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[row]), pa.array(lengths[row].astype(np.int32)), coded.dictionary.take(pa.array(term)).cast(pa.string()), pa.array(tf.astype(np.int64))],
            ["doc_id", "length", "term", "tf"],
        )


def summed(batches: Iterator[pa.RecordBatch], part: Part) -> Iterator[pa.RecordBatch]:
    """``term, df, part`` of each slice: in how many of its texts a term is, and the largest ``part(tf, length)``."""
    for _, raw, at in slices(batches):
        found, lengths = words(raw, at)
        if not len(found):
            continue
        coded, rows = pc.dictionary_encode(found), len(lengths)
        key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * rows + np.repeat(np.arange(rows), lengths), return_counts=True)
        term, row = np.divmod(key, rows)
        first = np.flatnonzero(np.diff(term, prepend=-1))
        most = np.maximum.reduceat(part(tf, lengths[row]), first)
        df = np.diff(np.append(first, len(term)))
        yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(df.astype(np.int64)), pa.array(most)], ["term", "df", "part"])


@dataclass
class Asked:
    """Queries by number and what they ask for: terms that open texts by the term, terms that are only looked up by the query.

    least: a score below which no text is among a query's best; rest: the most that its looked-up terms can add.
    """

    ids: np.ndarray
    terms: pa.Array
    idf: np.ndarray
    open_from: np.ndarray
    open_query: np.ndarray
    lack_from: np.ndarray
    lack_term: np.ndarray
    rest: np.ndarray
    least: np.ndarray


def asked(table: pa.Table, least: np.ndarray | None = None, bounded: bool = True) -> tuple[Asked, np.ndarray]:
    """The queries of ``table(query_id, term, idf, bound)`` and which of its rows open texts: all without ``least`` (of the queries, ordered by id) or bounds that hold.

    From the smallest bound on, terms whose bounds together stay below ``least`` open none.
    """
    ids, query = np.unique(table.column("query_id").to_numpy(), return_inverse=True)
    coded = pc.dictionary_encode(table.column("term").combine_chunks())
    term, bound = coded.indices.to_numpy(), table.column("bound").to_numpy()
    idf = np.zeros(len(coded.dictionary))
    idf[term] = table.column("idf").to_numpy()
    least = np.zeros(len(ids), np.int64) if least is None else least
    opens = np.ones(len(query), bool)
    if bounded:
        order = np.lexsort((bound, query))
        upto = np.cumsum(bound[order])
        first = np.searchsorted(query[order], np.arange(len(ids)))
        before = upto[first] - bound[order][first]
        opens[order] = upto - before[query[order]] >= least[query[order]]
    by_term, by_query = np.flatnonzero(opens), np.flatnonzero(~opens)
    by_term, by_query = by_term[np.argsort(term[by_term], kind="stable")], by_query[np.argsort(query[by_query], kind="stable")]
    rest = np.bincount(query[by_query], bound[by_query], len(ids)).astype(np.int64)
    froms = lambda x, n: np.searchsorted(x, np.arange(n + 1))
    held = (froms(term[by_term], len(idf)), query[by_term], froms(query[by_query], len(ids)), term[by_query])
    return Asked(ids, coded.dictionary, idf, *held, rest, least), opens


def _each(froms: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``froms[i]`` to ``froms[i + 1]`` for each i of ``of``, one after the other, and how many each has."""
    n = froms[of + 1] - froms[of]
    return np.repeat(froms[of] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


class Best:
    """The texts of a task that can be among the ``k`` best of a query, ties by id; the k-th raises what others must reach. Without ``k``: all that can be."""

    def __init__(self, asked: Asked, k: int | None):
        self.asked, self.k, self.least = asked, k, asked.least.copy()
        self.found: list[tuple[np.ndarray, ...]] = []
        self.rows, self.most = 0, HELD + 2 * len(asked.ids) * (k or 0)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.found.append((query, ids, score))
        self.rows += len(query)
        if self.k is not None and self.rows > self.most:
            self.choose()

    def choose(self) -> None:
        query, ids, score = (np.concatenate(x) for x in zip(*self.found))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep, last = order[place < self.k], place == self.k - 1
        self.least[query[last]] = np.maximum(self.least[query[last]], score[order][last])
        self.found, self.rows = [(query[place < self.k], ids[keep], score[keep])], len(keep)

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.found and self.k is not None:
            self.choose()
        for query, ids, score in self.found:
            yield pa.RecordBatch.from_arrays([pa.array(self.asked.ids[query]), pa.array(ids), pa.array(score)], ["query_id", "doc_id", "score"])
        self.found, self.rows = [], 0

    def score(self, ids: np.ndarray, row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> None:
        """Texts ``ids``; of text ``row`` a ``term`` has a ``weight``, ordered by row and term. Texts and queries meet in blocks of ``CELLS`` sums."""
        a, many = self.asked, len(self.asked.ids)
        step = max(1, CELLS // many)
        cuts = np.searchsorted(row, np.arange(0, len(ids) + step, step))
        for at, lo, hi in zip(range(0, len(ids), step), cuts, cuts[1:]):
            r, t, w = row[lo:hi] - at, term[lo:hi], weight[lo:hi]
            place, n = _each(a.open_from, t)
            if not len(place):
                continue
            cell = np.repeat(r * many, n) + a.open_query[place]
            total = np.bincount(cell, np.repeat(w, n), min(step, len(ids) - at) * many)
            reach = self.least - a.rest
            if w.all():  # a sum above 0 tells that a text has a term
                hit = np.flatnonzero(total.reshape(-1, many) >= np.maximum(reach, 1))
            else:
                hit = np.flatnonzero((total.reshape(-1, many) >= reach) & (np.bincount(cell, minlength=len(total)) > 0).reshape(-1, many))
            text, query = np.divmod(hit, many)
            other = ids[at + text] != a.ids[query]
            text, query, score = text[other], query[other], total[hit[other]]
            if self.k is not None:
                place, n = _each(a.lack_from, query)
                if len(place):
                    own, want = r * len(a.idf) + t, np.repeat(text * len(a.idf), n) + a.lack_term[place]
                    there = np.minimum(np.searchsorted(own, want), len(own) - 1)
                    score = score + np.bincount(np.repeat(np.arange(len(query)), n), np.where(own[there] == want, w[there], 0), len(query))
                keep = score >= self.least[query]
                text, query, score = text[keep], query[keep], score[keep]
            if len(query):
                self.add(query, ids[at + text], score.astype(np.int64))


def best_of_texts(batches: Iterator[pa.RecordBatch], asked: Asked, k: int | None, weight: Callable[[np.ndarray, np.ndarray], np.ndarray], part: Part) -> Iterator[pa.RecordBatch]:
    """``query_id, doc_id, score`` from texts ``doc_id, text``, each with an id of its own."""
    best, many = Best(asked, k), len(asked.idf)
    for ids, raw, at in slices(batches):
        found, lengths = words(raw, at)
        term = pc.index_in(found, asked.terms)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), lengths)[known]
        key, tf = np.unique(row * many + term.drop_null().to_numpy(), return_counts=True)
        row, term = np.divmod(key, many)
        best.score(ids, row, term, weight(asked.idf[term], part(tf, lengths[row])))
        if k is None:
            yield from best.take()
    yield from best.take()


def best_of_lists(batches: Iterator[pa.RecordBatch], asked: Asked, k: int | None) -> Iterator[pa.RecordBatch]:
    """``query_id, doc_id, score`` from ``doc_id, term, weight``, where the rows of an id follow each other; the last id of a batch waits for the next."""
    best, many, left = Best(asked, k), len(asked.idf), None

    def score(rows: pa.Table) -> None:
        term = pc.index_in(rows.column("term").combine_chunks(), asked.terms)
        rows, term = rows.filter(term.is_valid()), term.drop_null().to_numpy()
        if len(term):
            ids, row = np.unique(rows.column("doc_id").to_numpy(), return_inverse=True)
            order = np.argsort(row * many + term, kind="stable")
            best.score(ids, row[order], term[order], rows.column("weight").to_numpy()[order].astype(np.float64))

    for batch in batches:
        rows = pa.Table.from_batches([batch]) if left is None else pa.concat_tables([left, pa.Table.from_batches([batch])])
        if not rows.num_rows:
            continue
        ids = rows.column("doc_id").to_numpy()
        last = len(ids) - int(np.argmax(ids[::-1] != ids[-1])) if (ids != ids[-1]).any() else 0
        left = rows.slice(last)
        score(rows.slice(0, last))
        if k is None:
            yield from best.take()
    if left is not None:
        score(left)
    yield from best.take()
