"""Words, recognition errors and spellings of the period: how many a text has, all counted in one Arrow function.

The counts are those of the patterns in ``profile.OCR_ERRORS`` and ``profile.HISTORICAL``
(matches without overlaps, from the left, with ``(?iU)`` and ``(?U)``). One search a pattern reads
a text some twenty times, character by character; here the texts of a slice lie in one numpy array,
a byte for each code point, and a pattern is a few comparisons of that array with itself, shifted.
A text longer than two slices is counted in pieces, cut only where the sum of their counts is that of the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliate.operators import profile

#: Characters of a slice. A text with no place to cut it is a slice of its own, however long.
SLICE = 1 << 18
NAMES = ("words", *profile.OCR_ERRORS, *profile.HISTORICAL)
#: Letters beyond ASCII that equal one in ASCII where case is ignored, the byte that stands for them, and the byte between texts.
LONG_S, KELVIN, DOTLESS, DOTTED, END = 0x80, 0x81, 0x82, 0x83, 0xFF
FOLDED = {0x17F: LONG_S, 0x212A: KELVIN, 0x131: DOTLESS, 0x130: DOTTED}
WORD, SPACE, LETTER, CAPITAL, SMALL, STROKE, STOP = (1 << i for i in range(7))
_HUMP = re.compile(rb"[a-zA-Z\x80\x82][a-zA-Z\x80-\x83]+[a-zA-Z\x80\x82][a-zA-Z\x80-\x83]+")
_JOINED = re.compile(rb"[a-zA-Z\x80-\x83]+[a-zA-Z\x80\x82]")
_LONG_S = re.compile(rb"[A-Z][a-z]*\x80[a-z]*")
_CUT = re.compile(r"[a-zA-Z]{3}(?=[ \n][a-zA-Z]{3})")


def _is_word(c: str) -> bool:
    kind, i = unicodedata.category(c), ord(c)
    enclosed = 0x24B6 <= i <= 0x24E9 or 0x1F130 <= i <= 0x1F149 or 0x1F150 <= i <= 0x1F169 or 0x1F170 <= i <= 0x1F189
    return kind[0] in "LM" or kind in ("Nl", "Nd", "Pc") or i in (0x200C, 0x200D) or enclosed


@cache
def _bytes_of() -> np.ndarray:
    """The byte of each code point: ASCII as it is, else ``_`` for word characters, a space for white space, ``-`` for others."""
    out = np.full(0x110000, ord("-"), np.uint8)
    out[:128] = np.arange(128)
    for i in range(128, 0x110000):
        c = chr(i)
        if _is_word(c):
            out[i] = ord("_")
        elif c.isspace():
            out[i] = ord(" ")
    for i, b in FOLDED.items():
        out[i] = b
    return out


def _flags() -> bytes:
    out = bytearray(256)
    for i in (*range(128), *FOLDED.values()):
        c, folded = chr(i), i >= 128
        out[i] = WORD * (folded or c.isalnum() or c == "_") | SPACE * (c in "\t\n\x0b\f\r ") | LETTER * (folded or c.isalpha()) | CAPITAL * ("A" <= c <= "Z") | SMALL * ("a" <= c <= "z")
        out[i] |= STROKE * (c in "ilIL1|" or i in (DOTLESS, DOTTED)) | STOP * (c in ".,:;")
    return bytes(out)


_FLAGS = _flags()


def _alternate(chained: np.ndarray) -> np.ndarray:
    """The first, third, fifth ... of each run of true values: matches from the left that share no end."""
    at = np.arange(len(chained))
    begins = chained.copy()
    begins[1:] &= ~chained[:-1]
    return chained & ((at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0)


def _odd_words(u: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the words that have a letter for which case is not that of ASCII."""
    odd = np.flatnonzero((u == LONG_S) | (u == KELVIN) | (u == DOTTED))
    if len(odd):
        first, last = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:])
        for k in np.unique(np.searchsorted(first, odd, "right") - 1):
            yield int(first[k]), u[first[k] : last[k] + 1].tobytes()


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces that begin with the white space between two words of three letters or more.

    No match lies across such a place but that of a bar and the 100 characters behind it: there are none before the cut that lack some of these.
    """
    start = 0
    while len(text) - start > 2 * SLICE:
        cut = next((m.end() for m in _CUT.finditer(text, start + SLICE) if "|" not in text[max(0, m.end() - 100) : m.end()]), None)
        if cut is None:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def count_slice(texts: list[str]) -> np.ndarray:
    """A row for each text with its counts in the order of ``NAMES``, but for the match of a whole text that has one bar."""
    joined = "\n" + "\n".join(texts) + "\n\n\n"
    if joined.isascii():
        u = np.frombuffer(joined.encode(), np.uint8).copy()
    else:
        u = _bytes_of()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    lengths = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(lengths)
    u[0] = u[ends] = u[-2:] = END
    starts = ends - lengths + 1
    flags = np.frombuffer(u.tobytes().translate(_FLAGS), np.uint8)
    has = lambda kind: (flags & kind) != 0
    word, space, letter, capital, small, stroke, stop = map(has, (WORD, SPACE, LETTER, CAPITAL, SMALL, STROKE, STOP))
    low, bar = u | 0x20, u == ord("|")

    n = len(u) - 3  # places 1 to n; one before and two behind are ends of texts
    at = lambda x, k=0: x[1 + k : 1 + k + n]
    places = lambda x: np.flatnonzero(x) + 1
    begins = lambda x: places(at(x) & ~at(x, -1))
    closes = lambda x: places(at(x) & ~at(x, 1))
    doubled = lambda x: at(x) & at(x, 1) & ~at(x, -1)
    total = {k: np.zeros(len(u), np.uint8) for k in NAMES}

    def add(name: str, *marks: np.ndarray) -> None:
        """Masks of the places 1 to n, or places of which none comes twice."""
        for x in marks:
            if x.dtype == bool:
                at(total[name])[:] += x
            else:
                total[name][x] += 1

    filled = ~space & (u != END)
    add("words", at(filled) & ~at(filled, -1))

    add("character_substitution", doubled(stroke), doubled((u == ord("0")) | (low == ord("o"))))
    add("character_substitution", (at(low == ord("r")) | at(low == ord("t"))) & at(low == ord("n"), 1), at(low == ord("c")) & at(low == ord("l"), 1))

    # runs of letters that begin a word, and those that are all of it
    first, last = begins(letter), closes(letter)
    opens, size = ~word[first - 1], last - first + 1
    whole = opens & ~word[last + 1]
    humps, joints = first[whole & (size >= 4)], first[opens & (size >= 2)]
    odd = list(_odd_words(u, word))
    if odd:
        where = np.array([p for p, _ in odd])
        match = lambda pattern, whole: where[[bool(pattern.fullmatch(w) if whole else pattern.match(w)) for _, w in odd]]
        humps, joints = (np.concatenate([np.setdiff1d(x, where), match(p, all_)]) for x, p, all_ in ((humps, _HUMP, True), (joints, _JOINED, False)))
        add("archaic_spelling", match(_LONG_S, True))
    short, end = first[whole & (size <= 2)], last[whole & (size <= 2)]
    pairs = _alternate((short[1:] == end[:-1] + 2) & space[end[:-1] + 1])
    add("word_breaks", short[:-1][pairs], humps)

    add("punctuation_errors", doubled(u == ord(".")), doubled(u == ord(",")), doubled((u == ord(";")) | (u == ord(":"))), at(space, -1) & at(stop))

    between = places(at(letter) & at(stop, 1) & at(letter, 2))
    follows = np.zeros(len(between), bool)
    follows[1:] = between[1:] == between[:-1] + 2
    skipped = _alternate(follows)  # it begins with the letter that ends the match before
    add("spacing_issues", at(space) & at(space, 1) & at(space, 2) & ~at(space, -1), between[~skipped], joints)

    bars = places(at(bar))
    if len(bars):
        linked = np.diff(np.searchsorted(np.flatnonzero(~space), bars)) == 1
        halts = np.flatnonzero(bar | (u == ord("\n")) | (u == END))
        room = halts[np.searchsorted(halts, bars, "right")] - bars - 1
        add("table_structure", bars[:-1][_alternate(linked)], bars[room >= 100])

    ends_word = at(word) & ~at(word, 1)
    e, y, a = (at(u == ord(c)) & ends_word for c in "eya")
    add("archaic_spelling", e, e, y, a)

    first, last = begins(capital), closes(capital)
    add("abbreviations", first[(last > first) & ~word[first - 1] & ~word[last + 1]])
    dots = places(at(u == ord(".")) & (at(capital, -1) | at(small, -1)) & at(word, 1))
    if len(dots):
        other = np.flatnonzero(~small)
        head = other[np.searchsorted(other, dots) - 1]
        add("abbreviations", dots[capital[head] & ~word[head - 1]])
    add("abbreviations", at(u == ord("&")) & at(u == ord("c"), 1) & at(u == ord("."), 2))
    return np.stack([np.add.reduceat(total[k], starts, dtype=np.int64) for k in NAMES], axis=1)


def count_texts(texts: pa.Array) -> pa.Array:
    """Structs of counts; null for null."""
    out, part, owner, size = [np.zeros((0, len(NAMES)), np.int64)], [], [], 0
    total = np.zeros((len(texts), len(NAMES)), np.int64)
    for i, t in enumerate(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())):
        text = (t.as_py() or b"").decode("utf-8", "replace")
        total[i, NAMES.index("table_structure")] = text.count("|") == 1
        for piece in _pieces(text):
            part.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= SLICE:
                out.append(count_slice(part))
                part, size = [], 0
    if part:
        out.append(count_slice(part))
    np.add.at(total, owner, np.concatenate(out))
    columns = total.astype(np.int32).T
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], list(NAMES), mask=texts.is_null())


def counts(text: Column) -> Column:
    """A struct of the counts of a text: ``words``, the errors and the spellings by category."""
    return F.arrow_udf(count_texts, "struct<" + ",".join(f"{k}:int" for k in NAMES) + ">")(text)
