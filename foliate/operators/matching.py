"""Matches of a pattern with their places in whole texts, and territories found by them.

A place follows from the lengths of what stands between matches (``split``) and of the
matches before it (``regexp_extract_all``), summed over a text's matches: no text is
searched twice for a match, and no loop runs over characters. Patterns must not match
the empty text. White space is written out as the six characters of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_S = r"\t-\r "
#: Headings in capitals or in title case on a line of their own, perhaps in bold; the name and the line ends are groups.
CAPITALS = rf"(?md)^(?:\*\*)?([A-Z][A-Z{_S}\-'&,]+)\.(?:\*\*)?(?=(\n{{1,2}}))"
TITLE = rf"(?md)^(?:\*\*)?([A-Z][a-z]+(?:[{_S}]+[A-Z][a-z]+)*)\.(?:\*\*)?(?=(\n{{1,2}}))"
#: A name in capitals, a full stop, and all text to the next such or the end.
NAMED = rf"(?s)([A-Z{_S},]+)\.[{_S}]+(.*?)(?=[{_S}]+[A-Z{_S},]+\.[{_S}]+|\z)"
# Territories whose headings may be in title case.
TITLE_NAMES = (
    "ANTIGUA", "BAHAMAS", "BARBADOS", "BASUTOLAND", "BERMUDA", "BRITISH CENTRAL AFRICA", "BRITISH EAST AFRICA", "BRITISH GUIANA", "BRITISH HONDURAS",
    "BRITISH NEW GUINEA", "BRUNEI", "CEYLON", "CYPRUS", "DOMINICA", "FALKLAND ISLANDS", "FIJI", "GAMBIA", "GIBRALTAR", "GOLD COAST", "GOLD COAST COLONY",
    "GRENADA", "HONG KONG", "JAMAICA", "LAGOS", "LEEWARD ISLANDS", "MALTA", "MAURITIUS", "MONTSERRAT", "NATAL", "NIGER COAST PROTECTORATE", "NEW SOUTH WALES",
    "NEW ZEALAND", "NORTH BORNEO", "QUEENSLAND", "SEYCHELLES ISLANDS", "SIERRA LEONE", "SOUTH AUSTRALIA", "ST. HELENA", "ST. LUCIA", "ST. VINCENT", "TASMANIA",
    "TOBAGO", "TRINIDAD", "TURKS ISLANDS", "UGANDA PROTECTORATE", "VICTORIA", "WESTERN AUSTRALIA", "WESTERN PACIFIC", "ZULULAND",
)
SEPARATOR = "\n\n---\n\n"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{_S}]+|[{_S}]+$", "")


def matches(docs: DataFrame, pattern: str, groups: int = 0) -> DataFrame:
    """``doc_id, no, start, end, whole, g1 ...`` of all matches that do not overlap, from left to right; positions are code points, ``no`` counts from 0.

    Null texts have none. ``doc_id`` is unique.
    """
    every = [F.regexp_extract_all("text", F.lit(pattern), g).alias(n) for g, n in enumerate(["whole", *(f"g{i}" for i in range(1, groups + 1))])]
    gaps = F.transform(F.split("text", pattern, -1), F.length)
    rows = docs.where("text is not null").select("doc_id", gaps.alias("gaps"), *every)
    names = ["whole", *(f"g{i}" for i in range(1, groups + 1))]
    rows = rows.where(F.size("whole") > 0).select("doc_id", F.posexplode(F.arrays_zip(F.slice("gaps", F.lit(1), F.size("whole")).alias("gap"), *names)).alias("no", "m"))
    order = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.length("m.whole")).over(order)
    return rows.select("doc_id", "no", end.alias("end"), "m.*").select("doc_id", "no", (F.col("end") - F.length("whole")).alias("start"), "end", *names)


def headings(volumes: DataFrame) -> DataFrame:
    """``doc_id, heading, kind, start, content_start, end``: headings in capitals, and those in title case with a known name that are no match of the first kind.

    start: where the name begins; the content begins after the line and an empty one below it, and goes to the next heading or the end.
    """
    found = None
    for kind, pattern in (("capitals", CAPITALS), ("title", TITLE)):
        one = matches(volumes, pattern, 2)
        if kind == "title":
            one = one.where(F.upper(trimmed(F.col("g1"))).isin(*TITLE_NAMES))
        place = F.col("start") + F.when(F.col("whole").startswith("**"), 2).otherwise(0)
        one = one.select("doc_id", place.alias("start"), trimmed(F.col("g1")).alias("heading"), (F.col("end") + F.length("g2")).alias("after"), F.lit(kind).alias("kind"))
        found = one if found is None else found.union(one)
    first = found.groupBy("doc_id", "start").agg(F.min_by(F.struct("heading", "after", "kind"), "kind").alias("m"))
    lengths = volumes.where("text is not null").select("doc_id", F.length("text").cast("long").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("start")
    rows = first.select("doc_id", "start", "m.*").join(lengths, "doc_id").withColumn("end", F.coalesce(F.lead("start").over(order), F.col("n")))
    return rows.select("doc_id", "heading", "kind", "start", F.col("after").alias("content_start"), "end")


def named_parts(volumes: DataFrame) -> DataFrame:
    """``doc_id, name, start, seen, text``: every name in capitals with the text to the next, separators between pages left out; of equal names the last stays, ``seen`` counts them."""
    # Matches touch: each but the last ends where a next one begins, the last with the text. So lengths give all places, the first full stop
    # parts name and body, and a text is searched once.
    clean = volumes.where("text is not null").select("doc_id", F.replace("text", F.lit(SEPARATOR), F.lit("\n\n")).alias("text"))
    rows = clean.select("doc_id", F.length("text").alias("n"), F.posexplode(F.regexp_extract_all("text", F.lit(NAMED), F.lit(0))).alias("no", "m"))
    onward = Window.partitionBy("doc_id").orderBy(F.desc("no")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.col("n") - F.sum(F.length("m")).over(onward))
    name = F.substring_index("m", ".", 1)
    rows = rows.select("doc_id", trimmed(name).alias("name"), "start", F.substring(F.col("m"), F.length(name) + 2, F.length("m")).alias("body"))
    last = rows.groupBy("doc_id", "name").agg(F.max("start").alias("start"), F.count("*").alias("seen"), F.max_by("body", "start").alias("body"))
    return last.select("doc_id", "name", "start", "seen", F.concat(F.col("name"), F.lit(".\n\n"), trimmed(F.col("body"))).alias("text"))


def section(volumes: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """``volumes`` with the characters from ``start`` to ``end`` of each text; by default all."""
    length = F.lit(end - start) if end is not None else F.length("text")
    return volumes.withColumn("text", F.substring(F.col("text"), F.lit(start + 1), length))
