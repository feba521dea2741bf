"""Token counts of whole documents, huge ones by overlap resynchronisation.

A byte-level BPE encodes each pre-token by itself. No pre-token holds a visible
character followed by white space, nor two neighbours of different kinds (letter, number,
other) but for an apostrophe before a letter. So there is a boundary at each such change,
whatever stands before and after: a *proven stable boundary*. Two things follow.

* An ordinary document is a sequence of units cut before spaces that follow a visible
  character; equal units have equal counts, so each task keeps a bounded table of counts
  and hands only new units to the tokenizer.
* A huge document (more than ``CHUNK`` characters: one in 140 of the given table, a
  fourteenth of its text) is encoded in overlapping chunks with offsets. Neighbours are
  spliced at a proven boundary inside the overlap at which both start a token and agree on
  the tokens that follow. Where they never do, the overlap is widened to the whole chunk,
  and then the chunk is doubled: text without any boundary is one pre-token, which no
  splice may cut, and is encoded a bounded number of times.

Kinds are told by characters whose category has not changed since Unicode 3.2, so that the
tokenizer's own tables agree; other characters prove nothing.

Null or empty text: zero bytes, zero tokens. Repeated rows give repeated rows;
other columns are ignored. Memory: one chunk of a document and one table.
"""

from __future__ import annotations

import os
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import read, slices, texts

SCHEMA = "doc_id long, n_bytes long, n_tokens long, n_chunks int"
#: Characters of a chunk, first overlap of two chunks, tokens that must agree.
CHUNK, OVERLAP, AGREE = 16_384, 256, 4
#: White space of the tokenizer's pattern, and the strings it takes out of a text first.
SPACES = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
SPECIAL = ("<|endoftext|>",)
#: Units whose counts a task remembers at most, and the longest that it does.
TABLE, UNIT = 400_000, 64


def load(path: str):
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def kind(c: str) -> str:
    """``L`` letter, ``N`` number, ``P`` other visible character, ``S`` white space, empty if that may differ between Unicode versions."""
    if c in SPACES:
        return "S"
    now, old = unicodedata.category(c), unicodedata.ucd_3_2_0.category(c)
    if now[0] != old[0] or now[0] == "C" or c.isspace():
        return ""
    return now[0] if now[0] in "LN" else "P"


def proven(text: str, i: int) -> bool:
    """Whether a pre-token ends before text[i] in any context."""
    if not 0 < i < len(text):
        return False
    a, b = text[i - 1], text[i]
    x, y = kind(a), kind(b)
    if not x or not y or x == "S" or x == y or (a == "'" and y == "L"):
        return False
    return not any(s in text[max(0, i - len(s) + 1) : i + len(s) - 1] for s in SPECIAL)


def units(text: str) -> list[str]:
    """``text`` cut before each space that follows a visible character."""
    parts = text.split(" ")
    if "" not in parts and text.isprintable():
        return [parts[0], *[" " + p for p in parts[1:]]]
    out, held = [], parts[0]
    for p in parts[1:]:
        if held and held[-1] > " " and not held[-1].isspace():
            out.append(held)
            held = " " + p
        else:
            held += " " + p
    out.append(held)
    return out


class Counter:
    """Counts tokens with one tokenizer; made once for each task."""

    def __init__(self, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.tokenizer, self.chunk, self.overlap, self.table = tokenizer, chunk, overlap, {}

    def encode(self, text: str):
        """The library's encoding: tokens with their offsets (code points)."""
        return self.tokenizer.encode(text, add_special_tokens=False)

    def many(self, batch: list[str]) -> list[int]:
        cut = [units(t) for t in batch]
        table = self.table
        new = list({u for us in cut for u in us} - table.keys())
        fresh = {}
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            fresh.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        if len(table) + len(fresh) > TABLE:
            table = {u: table[u] for us in cut for u in us if u in table}
        both = table | fresh
        counts = [sum(map(both.__getitem__, us)) for us in cut]
        table.update((u, n) for u, n in fresh.items() if len(u) <= UNIT)
        self.table = table if len(table) <= TABLE else {}
        return counts

    def splice(self, text: str, at: int, left, left_start: int, right_start: int):
        """The first proven boundary in text[right_start:at] at which both encodings start a token and agree on those that follow.

        Gives the places of that token in both, the end of the right chunk and its encoding.
        """
        stop = min(len(text), at + self.chunk)
        right = self.encode(text[right_start:stop])
        for p in range(right_start + 1, at):
            if not proven(text, p):
                continue
            i, j = left.char_to_token(p - left_start), right.char_to_token(p - right_start)
            if i is None or j is None or i + AGREE > len(left) or j + AGREE > len(right):
                continue
            starts = [(left.token_to_chars(i + n)[0] + left_start, right.token_to_chars(j + n)[0] + right_start) for n in range(AGREE)]
            if starts[0] == (p, p) and all(x == y for x, y in starts):
                return i, j, stop, right
        return None

    def huge(self, text: str) -> tuple[int, int]:
        """Tokens and chunks of a text longer than a chunk."""
        # the encoding held, its place in the text, and its first token that is not yet counted
        end, start, first = self.chunk, 0, 0
        held, total, chunks = self.encode(text[:end]), 0, 1
        while end < len(text):
            overlap, found = self.overlap, None
            while found is None and overlap < end - start:
                right_start = end - overlap
                found = self.splice(text, end, held, start, right_start)
                overlap *= 4
            if found is None:  # no common boundary in the whole chunk: encode it again, twice as long
                whole = held.token_to_chars(first)[0] + start if first else start
                end = min(len(text), end + max(self.chunk, end - whole))
                held, start, first = self.encode(text[whole:end]), whole, 0
            else:
                i, first_right, end, right = found
                total += i - first
                held, start, first = right, right_start, first_right
            chunks += 1
        return total + len(held) - first, chunks


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, n_chunks`` for each row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in slices(batches, "text", 1 << 20):
            counter = counter or Counter(load(path), chunk, overlap)
            rows = batch.column("text").to_pylist()
            out = [(0, 1)] * len(rows)
            short = [i for i, t in enumerate(rows) if len(t) <= chunk]
            for i, n in zip(short, counter.many([rows[i] for i in short])):
                out[i] = (n, 1)
            for i, t in enumerate(rows):
                if len(t) > chunk:
                    out[i] = counter.huge(t)
            sizes = [len(t.encode()) for t in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([n for n, _ in out], pa.int64()), pa.array([c for _, c in out], pa.int32())], ["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    return texts(docs).mapInArrow(run, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)
