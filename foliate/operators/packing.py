"""Packing of ordered units into chunks: one fold over the units' lengths for each document, never over their text.

The fold is an Arrow function: it gets lengths and marks, a few bytes for each unit, and
gives the places where groups begin; texts stay in the JVM. (As a Spark ``aggregate`` it
would copy all places found so far at each unit.) Chunks are slices of the units between
these places: no shuffle, and work in proportion to the text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Group:
    """The open group: ``n`` units, ``size`` characters, ``marks`` marked units, ``last`` whether the last was marked."""

    n: int = 0
    size: int = 0
    marks: int = 0
    last: bool = False


@dataclass(frozen=True)
class Rule:
    """``opens(group, length, mark, *values)`` tells whether a unit opens a new group; values: columns of the document's row, or constants."""

    opens: Callable[..., Any]
    values: tuple[Column | int, ...]


def _before_limit(g: Group, length: int, mark: bool, limit: int, separator: int) -> bool:
    return g.n > 0 and g.size + separator + length > limit


def _after_limit(g: Group, length: int, mark: bool, limit: int) -> bool:
    return g.size > limit


def _at_marks(g: Group, length: int, mark: bool, least: int, units: int, limit: int) -> bool:
    return g.n > 0 and (g.size > limit or (mark and (g.size >= least or g.marks >= units)))


def _headed(g: Group, length: int, mark: bool, least_units: int, limit: int) -> bool:
    return g.size > limit or (mark and g.n > least_units)


def _around_runs(g: Group, length: int, mark: bool, before: int, limit: int) -> bool:
    if mark and g.last:
        return False
    return g.size > limit or (mark and g.size > before)


def _at_headings(g: Group, length: int, mark: bool, least: int) -> bool:
    return g.n > 0 and mark and g.size > least


def before_limit(limit: int | Column, separator: int) -> Rule:
    """A unit that would lift the group beyond the limit opens the next."""
    return Rule(_before_limit, (limit, separator))


def after_limit(limit: int | Column) -> Rule:
    """A group that has passed the limit is closed."""
    return Rule(_after_limit, (limit,))


def at_marks(least: int | Column, units: int, limit: int | Column) -> Rule:
    """A marked unit opens a group once the last has ``least`` characters or ``units`` marks; beyond the limit any unit does."""
    return Rule(_at_marks, (least, units, limit))


def headed(least_units: int, limit: int | Column) -> Rule:
    """A marked unit opens a group if the last has more than ``least_units`` units; beyond the limit any unit does."""
    return Rule(_headed, (least_units, limit))


def around_runs(before: int | Column, limit: int | Column) -> Rule:
    """Runs of marked units stay together: one opens a group if the last has more than ``before`` characters, and beyond the limit a group ends outside a run."""
    return Rule(_around_runs, (before, limit))


def at_headings(least: int | Column) -> Rule:
    """A marked unit opens a group once the last has more than ``least`` characters."""
    return Rule(_at_headings, (least,))


def by_number(number: Column, rules: list[Rule]) -> Rule:
    """The rule with the given number (from 0), which may differ from row to row."""
    cuts = [0]
    for r in rules:
        cuts.append(cuts[-1] + len(r.values))
    tests = [(r.opens, a, b) for r, a, b in zip(rules, cuts, cuts[1:])]

    def opens(g: Group, length: int, mark: bool, chosen: int, *values: int) -> bool:
        test, a, b = tests[chosen]
        return test(g, length, mark, *values[a:b])

    return Rule(opens, (number, *(v for r in rules for v in r.values)))


def fold(lengths: list[int], marks: list[bool] | None, separator: int, rule: Callable[..., Any], values: list[int]) -> list[int]:
    """The place (from 0) of the first unit of each group."""
    out, g = [], Group()
    for at, length in enumerate(lengths):
        mark = marks is not None and marks[at]
        if not at or rule(g, length, mark, *values):
            out.append(at)
            g.n, g.size, g.marks = 1, length, int(mark)
        else:
            g.n, g.size, g.marks = g.n + 1, g.size + separator + length, g.marks + mark
        g.last = mark
    return out


def group_starts(units: Column, rule: Rule, separator: int | Column, mark: Callable[[Column], Column] | None = None, isolate: bool = False) -> Column:
    """The place (from 0) of the first unit of each group, as an array; null units give null.

    isolate: a struct of the array as ``starts`` and an ``error``; where the rule raises, starts are null and the error is its text.
    """
    opens = rule.opens

    def one(lengths: list[int], marks: list[bool] | None, separator: int, values: list[int]) -> tuple[list[int] | None, str | None]:
        try:
            return fold(lengths, marks, separator, opens, values), None
        except Exception as e:  # a rule is given by the user; its fault is this document's, kept with its text
            return None, f"{type(e).__name__}: {e}"

    def starts_or_error(lengths: pa.Array, marks: pa.Array, separators: pa.Array, *values: pa.Array) -> pa.Array:
        apart, given = separators.to_pylist(), [v.to_pylist() for v in values]
        rows = ((lengths[i].as_py(), marks[i].as_py()) for i in range(len(lengths)))
        made = [(None, None) if n is None else one(n, m, apart[i], [v[i] for v in given]) for i, (n, m) in enumerate(rows)]
        return pa.StructArray.from_arrays([pa.array([s for s, _ in made], pa.list_(pa.int32())), pa.array([e for _, e in made], pa.string())], ["starts", "error"])

    def starts(lengths: pa.Array, marks: pa.Array, separators: pa.Array, *values: pa.Array) -> pa.Array:
        apart, given = separators.to_pylist(), [v.to_pylist() for v in values]
        rows = ((lengths[i].as_py(), marks[i].as_py()) for i in range(len(lengths)))
        return pa.array([None if n is None else fold(n, m, apart[i], opens, [v[i] for v in given]) for i, (n, m) in enumerate(rows)], pa.list_(pa.int32()))

    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    marks = F.transform(units, mark) if mark else F.lit(None).cast("array<boolean>")
    udf = F.arrow_udf(starts_or_error, "struct<starts:array<int>,error:string>") if isolate else F.arrow_udf(starts, "array<int>")
    return udf(F.transform(units, F.length), marks, as_column(separator), *map(as_column, rule.values))


def pack(docs: DataFrame, units: Column, rule: Rule, separator: str | Column, mark: Callable[[Column], Column] | None = None, *keep: str, blank: bool = True, isolate: bool = False) -> DataFrame:
    """``doc_id, keep, chunk_index, units, size, text`` of the packed units of each document; rules and separator may be columns of it.

    blank: whether chunks of white space only stay. isolate: with ``error``; a document without text, or whose rule raises, has one row
    with it and no chunk, and the others go on.
    """
    sep = F.lit(separator) if isinstance(separator, str) else separator
    starts = group_starts(units, rule, F.length(sep), mark, isolate)
    rows = docs.select("doc_id", *keep, units.alias("_units"), starts.alias("_starts"), sep.alias("_sep"))
    if isolate:
        rows = rows.select("doc_id", *keep, "_units", "_sep", F.when(F.col("_units").isNull(), "no text").otherwise(F.col("_starts.error")).alias("error"), F.col("_starts.starts").alias("_starts"))
    stops = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_units")))
    groups = F.zip_with("_starts", stops, lambda a, b: F.struct((b - a).cast("long").alias("units"), F.call_function("array_join", F.slice("_units", a + 1, b - a), F.col("_sep")).alias("text")))
    if not blank:
        groups = F.filter(groups, lambda g: g["text"].rlike(r"(?U)\S"))
    if isolate:
        rows = rows.where((F.size("_units") > 0) | F.col("error").isNotNull())
        rows, keep = rows.select("doc_id", *keep, "error", F.posexplode_outer(groups).alias("chunk_index", "g")).where("error is not null or chunk_index is not null"), (*keep, "error")
    else:
        rows = rows.where(F.size("_units") > 0).select("doc_id", *keep, F.posexplode(groups).alias("chunk_index", "g"))
    return rows.select("doc_id", *keep, "chunk_index", "g.units", F.length("g.text").cast("long").alias("size"), "g.text")


def forced_splits(chunks: DataFrame, limit: int, mark: Callable[[Column], Column], around: int = 5) -> DataFrame:
    """Chunks of lines of more than ``limit`` characters are cut in two: before the first marked line up to ``around`` lines from the middle, else in the middle.

    ``doc_id, chunk_index, part, units, size, text``: both halves stay (part 0 and 1); a single line is never cut.
    """
    lines, n = F.split("text", "\n", -1), F.size("_lines")
    rows = chunks.select("doc_id", "chunk_index", lines.alias("_lines"), (F.length("text") > limit).alias("_long"))
    middle = F.floor(n / 2).cast("int")
    low = F.greatest(middle - around, F.lit(0))
    near = F.slice("_lines", low + 1, F.least(n, middle + around) - low)
    marked = F.array_position(F.transform(near, mark), True)
    cut = F.when(marked > 0, low + marked.cast("int") - 1).otherwise(middle)
    rows = rows.withColumn("_cut", F.when(F.col("_long") & (cut > 0), cut))
    halves = F.when(F.col("_cut").isNull(), F.array("_lines")).otherwise(F.array(F.slice("_lines", F.lit(1), F.col("_cut")), F.slice("_lines", F.col("_cut") + 1, n)))
    out = rows.select("doc_id", "chunk_index", F.posexplode(halves).alias("part", "p")).select("doc_id", "chunk_index", "part", F.size("p").cast("long").alias("units"), F.array_join("p", "\n").alias("text"))
    return out.select("doc_id", "chunk_index", "part", "units", F.length("text").cast("long").alias("size"), "text")


def pack_within(parts: DataFrame, part: str, units: Column, limit: int, rule: Rule, separator: str, mark: Callable[[Column], Column] | None = None) -> DataFrame:
    """Packs each part (``doc_id, part, size, text``) by itself: one of ``limit`` characters at most is one chunk, a longer one is cut into units and packed.

    ``doc_id, part, piece, units, size, text``; chunks of white space only are left out.
    """
    whole = F.when(F.col("size") <= limit, F.array("text")).otherwise(units)
    return pack(parts, whole, rule, separator, mark, part, blank=False).withColumnRenamed("chunk_index", "piece")
