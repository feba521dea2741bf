"""Acceptance of an extraction: types of headings, expected names, and gates with a value, a limit and a verdict.

Territories are level 1 (a container with all its units, or a heading of its own), units
of containers level 2. All measures of a volume are one aggregate of its territories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.operators import hierarchy as h

# What an accepted extraction has, and has not.
EXPECTED = ("BASUTOLAND", "BERMUDA", "BRITISH GUIANA", "BRITISH HONDURAS", "GIBRALTAR", "JAMAICA", "MAURITIUS", "HONG KONG")
PROVINCES = ("ONTARIO", "QUEBEC", "NOVA SCOTIA", "NEW BRUNSWICK", "MANITOBA", "BRITISH COLUMBIA", "PRINCE EDWARD ISLAND")
OFFICES = ("SENATE OF CANADA", "EXECUTIVE COUNCIL", "LEGISLATIVE COUNCIL", "PRIME MINISTER", "ECCLESIASTICAL", "BISHOPS", "CIVIL SERVICE")
BROAD_OFFICES = ("SENATE", "COUNCIL", "ECCLESIASTICAL", "BISHOPS", "CIVIL SERVICE")
OFTEN_TWICE = ("CEYLON", "EASTERN PROVINCE")
TYPES = {"DOMINION OF CANADA": "dominion", "ONTARIO": "province", "HONG KONG": "crown_colony", "SENATE OF CANADA": "administrative", "BRITISH GUIANA": "crown_colony"}
#: Gates: measure -> (limit, whether the value must reach it, else not pass it).
GATES = {
    "grouped_provinces": (4.0, True), "ungrouped_provinces": (0.0, False), "offices_as_territories": (1.0, False), "same_names": (0.0, False), "known_twice": (0.0, False),
    "least_size": (1001.0, True), "geography_percent": (30.1, True), "orphans": (0.0, False), "empty_dominions": (0.0, False), "expected_percent": (70.0, True), "types_percent": (80.0, True),
}


def normalised(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), r"[^\p{L}\p{N}]", "")


def any_of(x: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))


def header_type(name: Column) -> Column:
    """dominion, administrative, province (a unit of a container) or crown_colony."""
    units = tuple(u for v in h.CONTAINERS.values() for u in v)
    return (
        F.when(name.isin(*h.CONTAINERS) | name.startswith("DOMINION OF"), "dominion").when(any_of(name, OFFICES), "administrative")
        .when(any_of(name, units), "province").otherwise("crown_colony")
    )


def levels(volumes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, name, kind, size, has_geography`` of the territories, and ``doc_id, name, parent`` of the units of containers."""
    placed = h.in_containers(h.header_segments(volumes))
    key = F.coalesce("container", F.concat_ws("@", "name", "start"))
    first = placed.groupBy("doc_id", key.alias("key")).agg(
        F.coalesce(F.max("container"), F.max("name")).alias("name"), F.when(F.max("container").isNotNull(), "dominion").otherwise("colony").alias("kind"),
        F.sum(F.col("end") - F.col("start")).alias("size"), F.max("has_geography").alias("has_geography"),
    ).drop("key")
    return first, placed.where("container is not null").select("doc_id", "name", F.col("container").alias("parent"))


def measures(volumes: DataFrame) -> DataFrame:
    """A row for each volume: counts of territories and everything that a gate asks for."""
    first, second = levels(volumes)
    name, n = F.col("name"), F.count("*")
    times = [F.count_if(F.contains(name, F.lit(w))) for w in OFTEN_TWICE]
    expected = sum((F.max(F.contains(name, F.lit(w))).cast("int") for w in EXPECTED), F.lit(0))
    per = first.groupBy("doc_id").agg(
        n.alias("territories"), F.count_if(F.col("kind") == "dominion").alias("dominions"), F.count_if(F.col("kind") == "colony").alias("colonies"),
        F.count_if(any_of(name, PROVINCES)).cast("double").alias("ungrouped_provinces"), F.count_if(any_of(name, OFFICES)).cast("double").alias("offices_as_territories"),
        F.count_if((F.col("kind") == "colony") & any_of(name, BROAD_OFFICES)).alias("broad_offices"), (n - F.countDistinct(normalised(name))).cast("double").alias("same_names"),
        sum(((t > 1).cast("double") for t in times), F.lit(0.0)).alias("known_twice"), F.min("size").cast("double").alias("least_size"), (100 * F.count_if(F.col("has_geography")) / n).alias("geography_percent"),
        expected.alias("expected_found"), (100 * expected / len(EXPECTED)).alias("expected_percent"),
        F.count_if((F.col("kind") == "colony") & (F.contains(name, F.lit('"""')) | F.contains(F.substring("name", -3, 3), F.lit("L")))).alias("damaged_names"), F.count_if(F.col("size") < 5000).alias("small"),
    )
    of = first.where("kind = 'dominion'").select("doc_id", F.col("name").alias("parent"), F.lit(True).alias("known"))
    units = second.join(of, ["doc_id", "parent"], "left").groupBy("doc_id").agg(
        F.count_if(F.contains("parent", F.lit("CANADA"))).cast("double").alias("grouped_provinces"), F.count_if(F.col("known").isNull()).cast("double").alias("orphans"), F.countDistinct("parent").alias("parents"),
    )
    found = h.header_segments(volumes).select("doc_id", "name", header_type(F.col("name")).alias("type"))
    tests = F.broadcast(volumes.sparkSession.createDataFrame(list(TYPES.items()), "name string, expected string"))
    typed = found.join(tests, "name").groupBy("doc_id").agg((100 * F.count_if(F.col("type") == F.col("expected")) / F.count("*")).alias("types_percent"))
    rows = per.join(units, "doc_id", "left").join(typed, "doc_id", "left").fillna(0, ["grouped_provinces", "orphans", "parents"])
    return rows.withColumn("empty_dominions", (F.col("dominions") - F.col("parents")).cast("double")).drop("parents")


def gates(measured: DataFrame) -> DataFrame:
    """``doc_id, gate, value, bound, passed``: a row for each gate of each volume; a gate without a value has no verdict."""
    rows = []
    for gate, (limit, reach) in GATES.items():
        value = F.round(F.col(gate), 4)
        rows.append(F.struct(F.lit(gate).alias("gate"), value.alias("value"), F.lit(limit).alias("bound"), (value >= limit if reach else value <= limit).alias("passed")))
    return measured.select("doc_id", F.inline(F.array(*rows)))


def mended(measured: DataFrame) -> DataFrame:
    """Which of four earlier faults each volume no longer has, and whether it has none."""
    flags = {"provinces": F.col("grouped_provinces") > 0, "duplicates": F.col("known_twice") <= 2, "offices": F.col("broad_offices") <= 1, "names": F.col("expected_found") >= 6}
    rows = measured.select("doc_id", *[v.alias(k) for k, v in flags.items()])
    return rows.withColumn("overall", F.expr(" and ".join(flags)))


def expectations(volumes: DataFrame) -> DataFrame:
    """``name, verdict, volumes``: expected names and those found, by normalised name: found, missing or more."""
    first = levels(volumes)[0].groupBy(normalised(F.col("name")).alias("name")).agg(F.countDistinct("doc_id").alias("volumes"))
    wanted = volumes.sparkSession.createDataFrame([(n,) for n in EXPECTED], "wanted string").select(normalised(F.col("wanted")).alias("name"), F.lit(True).alias("wanted"))
    verdict = F.when(F.col("wanted").isNull(), "more").when(F.col("volumes").isNull(), "missing").otherwise("found")
    return first.join(wanted, "name", "full").select("name", verdict.alias("verdict"), F.coalesce("volumes", F.lit(0)).alias("volumes"))


def gaps(volumes: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``doc_id, section_id, kind, start, stop``: the complement of ``boundaries(doc_id, first, after)`` in each volume that has some, without empty parts."""
    sizes = volumes.select("doc_id", F.length("text").cast("long").alias("n")).join(boundaries.select("doc_id").distinct(), "doc_id", "left_semi")
    ends = sizes.select("doc_id", F.col("n").alias("first"), F.col("n").alias("after"), F.lit(True).alias("is_end"))
    every = boundaries.select("doc_id", "first", "after", F.lit(False).alias("is_end")).union(ends)
    order = Window.partitionBy("doc_id").orderBy("first", "is_end", "after")
    before = F.coalesce(F.max("after").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = every.withColumn("start", before).where(F.col("first") > F.col("start"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("start")) - 1
    kind = F.when(F.col("is_end"), "tail").when(F.col("start") == 0, "head").otherwise("between")
    return rows.select("doc_id", number.alias("section_id"), kind.alias("kind"), "start", F.col("first").alias("stop"))
