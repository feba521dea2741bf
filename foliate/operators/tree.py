"""A volume as a tree: territories, their provinces or sections, the sections of provinces.

A row is a node; parents are named by ``parent_id``. Sections are arrays of a segment's
row, so only headings are ordered in a window; text is joined to volumes for containers
alone, of which a volume has a few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import hierarchy
from foliate.operators.profile import bound

#: A part of a container has more characters than the first, a territory of its own more than the second.
LEAST_PART, LEAST_TERRITORY = 100, 5000
# Words of headings that are no territory's.
NO_COLONY = ("ECCLESIASTICAL", "EXECUTIVE COUNCIL", "LEGISLATIVE COUNCIL", "CONTROL AND AUDIT", "PRIME MINISTER", "KCMG", "BISHOPS")
_NODE = """array<struct<chunk_id:string,parent_id:string,level:int,type:string,name:string,parent_territory:string,section_type:string,
start_pos:bigint,end_pos:bigint,text:string,section_types:array<string>,province_names:array<string>>>"""
COLUMNS = ["chunk_id", "parent_id", "level", "type", "name", "parent_territory", "section_type", "start_pos", "end_pos", "text", "section_types", "province_names"]


def container_of(name: Column) -> Column:
    """The first container one of whose units a heading contains, or null."""
    out = F.lit(None).cast("string")
    for container, units in reversed(hierarchy.CONTAINERS.items()):
        out = F.when(hierarchy.contains_any(name, units), container).otherwise(out)
    return out


def with_sections(rows: DataFrame) -> DataFrame:
    """``rows`` with ``sections``, type and text of each part of ``text`` from one standard title to the next; before the first it is the introduction."""
    kind = hierarchy.standard_kind
    rows = bound(rows.withColumn("_lines", tx.lines(F.col("text"))))
    rows = bound(rows.withColumn("_kinds", F.transform("_lines", lambda x: kind(tx.strip(x)))))
    at = F.transform("_kinds", lambda k, i: F.when(k.isNotNull() | (i == 0), i))
    rows = bound(rows.withColumn("_at", F.array_compact(at)))

    def part(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(F.col("_at"), i + 1), F.size("_lines"))
        text = F.call_function("array_join", F.slice("_lines", start + 1, stop - start), F.lit("\n"))
        return F.struct(F.coalesce(F.get(F.col("_kinds"), start), F.lit("introduction")).alias("type"), tx.strip(text).alias("text"))

    return rows.withColumn("sections", F.transform("_at", part)).drop("_lines", "_kinds", "_at")


def parts(volumes: DataFrame) -> DataFrame:
    """Headed segments that stay: ``doc_id, territory_no, part_no, container, name, first, start, end, text``.

    Segments of one container are one territory, wherever they stand; numbers are in the order of first headings, from 1.
    """
    rows = bound(hierarchy.header_segments(volumes, text=True).withColumn("container", container_of(F.col("name"))))
    n = F.length("text")
    stays = F.when(F.col("container").isNotNull(), n > LEAST_PART).otherwise((n > LEAST_TERRITORY) & ~hierarchy.contains_any(F.upper("name"), NO_COLONY))
    first = F.when(F.col("container").isNull(), F.col("start")).otherwise(F.min("start").over(Window.partitionBy("doc_id", "container")))
    rows = rows.withColumn("first", first).where(stays)
    rows = rows.withColumn("territory_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("first")))
    rows = rows.withColumn("part_no", F.row_number().over(Window.partitionBy("doc_id", "first").orderBy("start")))
    return rows.select("doc_id", "territory_no", "part_no", "container", "name", "first", "start", "end", "text")


def titled(kind: Column) -> Column:
    return F.replace(F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit("_"))


def tree(volumes: DataFrame) -> DataFrame:
    """``doc_id`` and the columns of ``COLUMNS``, a row for each node.

    Level 1 are territories (type dominion or colony), level 2 provinces of a dominion or sections of a colony, level 3 sections of a
    province. ``section_types`` are those of a node's sections, ``province_names`` those of a dominion. Places are the volume's; sections have none.
    A volume without headings has no rows. Repeated headings are nodes of their own.
    """
    headed = parts(volumes)
    base = bound(with_sections(headed))
    null, inside = F.lit(None), F.col("container").isNotNull()
    one, two = F.format_string("L1_%03d", "territory_no"), F.format_string("L2_%03d_%02d", "territory_no", "part_no")
    own = F.struct(
        F.when(inside, two).otherwise(one), F.when(inside, one), F.when(inside, 2).otherwise(1), F.when(inside, "province").otherwise("colony"), "name",
        "container", null, "start", "end", "text", F.transform("sections", lambda s: s["type"]), null,
    )

    def child(s: Column, i: Column) -> Column:
        three = F.format_string("L3_%03d_%02d_%02d", F.col("territory_no"), F.col("part_no"), i + 1)
        name = F.concat(F.col("name"), F.lit(" - "), titled(s["type"]))
        return F.struct(
            F.when(inside, three).otherwise(F.format_string("L2_%03d_%02d", F.col("territory_no"), i + 1)), F.when(inside, two).otherwise(one), F.when(inside, 3).otherwise(2),
            F.lit("section"), name, F.coalesce("container", "name"), s["type"], null, null, s["text"], null, null,
        )

    nodes = F.concat(F.array(own).cast(_NODE), F.transform("sections", child).cast(_NODE))
    rows = base.select("doc_id", F.inline(nodes))
    of = headed.where(inside).groupBy("doc_id", "territory_no").agg(
        F.max("container").alias("name"), F.min("first").alias("first"), F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("start", "name"))).alias("names")
    )
    text = tx.strip(F.substring("text", F.col("first") + 1, F.col("end") - F.col("first")))
    whole = F.struct(one, null, F.lit(1), F.lit("dominion"), "name", null, null, "first", "end", text, null, F.transform("names", lambda x: x["name"]))
    return rows.union(of.join(volumes, "doc_id").select("doc_id", F.inline(F.array(whole).cast(_NODE))))


def described(nodes: DataFrame) -> DataFrame:
    """Nodes with ``size``, ``preview`` and ``ending`` (200 characters in one line), ``section_count``, ``province_count``, ``has_geography``."""
    flat = lambda x: F.translate(x, "\n", " ")
    return nodes.withColumns({
        "size": F.length("text"), "preview": flat(F.substring("text", 1, 200)), "ending": flat(F.substring("text", -200, 200)),
        "section_count": F.when(F.col("section_types").isNotNull(), F.size("section_types")), "province_count": F.when(F.col("province_names").isNotNull(), F.size("province_names")),
        "has_geography": F.array_contains("section_types", "geography"),
    })


def counts(nodes: DataFrame) -> DataFrame:
    """Per volume, how many nodes there are of each level and type."""
    of = {f"level{i}": F.col("level") == i for i in (1, 2, 3)} | {f"{k}s" if k != "colony" else "colonies": F.col("type") == k for k in ("dominion", "colony", "province", "section")}
    return nodes.groupBy("doc_id").agg(*[F.count_if(c).alias(k) for k, c in of.items()])


def nested(nodes: DataFrame) -> DataFrame:
    """``doc_id, metadata, territories``: a row for each volume, children in their parents, in order."""
    rest = [c for c in nodes.columns if c not in ("doc_id", "parent_id")]

    def under(level: int, children: DataFrame | None) -> DataFrame:
        rows, fields = nodes.where(F.col("level") == level), rest
        if children is not None:
            rows, fields = rows.join(children, ["doc_id", "chunk_id"], "left").withColumn("children", F.coalesce("children", F.array())), [*rest, "children"]
        key = F.col("parent_id").alias("chunk_id") if level > 1 else None
        made = F.array_sort(F.collect_list(F.struct(*fields))).alias("children" if level > 1 else "territories")
        return rows.groupBy("doc_id", *([key] if key is not None else [])).agg(made)

    metadata = counts(nodes)
    metadata = metadata.select("doc_id", F.struct(*[c for c in metadata.columns if c != "doc_id"]).alias("metadata"))
    return metadata.join(under(1, under(2, under(3, None))), "doc_id").select("doc_id", "metadata", "territories")
