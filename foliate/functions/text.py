"""Column expressions on text. Positions are code points; white space and case follow Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_upper(x: Column) -> Column:
    """At least one capital and no small letter."""
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}")


def occurrences(x: Column, part: str) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / len(part)).cast("int")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def paragraphs(text: Column, mark: str = "\n\n") -> Column:
    """Stripped, not empty."""
    parts = F.split(text, F.lit(rf"\Q{mark}\E"), -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Cut after a full stop, exclamation or question mark before white space; stripped, not empty."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
