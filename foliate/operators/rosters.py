"""Lists of an office: headed blocks, their class, the path of headings above them, and what is dropped.

A heading is a line of capitals, digits and signs, which may be set in bold. Blocks are
judged in order of place; the path is a window over flags, nothing is looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import hierarchy
from foliate.operators.splitting import line_table
from foliate.operators.structure import islands

HEADING = r"^(\*\*)?[A-Z][A-Z0-9\s&'\-/,.;:()]+(\*\*)?$"
# Words of advertisements.
ADVERTS = ("LIMITED", "PRICE", "PIANOS", "ORGAN", "SHIRT", "PATENT", "WAREHOUSE", "DISCOUNT", "WHOLESALE", "CATALOGUE", "CATALOGUES", "PATTERNS", "FACTORY")
# Headings of whole parts.
TOP = ("INDIA OFFICE", "CIVIL SERVICE", "MILITARY", "GENERAL", "EXAMINATIONS FOR THE CIVIL SERVICE OF INDIA", "FOREST EXAMINATION", "FOREST SERVICE IN INDIA")
CHAPTER = "CHAPTER "
# Regions.
REGIONS = (
    "ASSAM", "BENGAL", "BOMBAY", "BURMA", "CENTRAL PROVINCES", "COORG", "HYDERABAD", "INDIA", "MADRAS", "NORTH WEST PROVINCES", "NORTH-WEST PROVINCES",
    "NORTH-WESTERN PROVINCES", "NORTH WESTERN PROVINCES", "N.W. PROVINCES", "N.W.P.", "NORTH-WESTERN PROVINCES AND OUDH", "ORISSA", "PUNJAB", "QUETTA DISTRICT",
    "SIND DISTRICT", "SIND", "QUETTA", "BOMBAY PRESIDENCY", "UNITED PROVINCES OF AGRA AND OUDH", "UNITED PROVINCES", "NORTH-WEST FRONTIER PROVINCE", "N.W.F.P.", "NWFP",
    "BIHAR AND ORISSA", "DELHI", "AJMER-MERWARA", "BRITISH BALUCHISTAN", "ANDAMAN AND NICOBAR ISLANDS", "RAJPUTANA AGENCY", "CENTRAL INDIA AGENCY", "MYSORE RESIDENCY",
    "KASHMIR RESIDENCY", "ADEN", "PERSIAN GULF RESIDENCY",
)
# Headings that are left out with their text.
SKIP = (
    "CONTENTS", "TABLE OF CONTENTS", "INDEX", "ILLUSTRATIONS", "MAPS", "PREFACE", "ADVERTISEMENTS", "NOTE", "NOTES", "LIST OF TABLES", "RULES FOR ADMISSION", "FORM OF TESTIMONIAL",
)
#: Characters below which a narrative block without any fact is dropped.
LEAST = 250


def clean_heading(heading: Column) -> Column:
    """Without emphasis, closing signs and repeated white space, in capitals."""
    bare = F.regexp_replace(heading, r"^[\s*]+|[\s*]+$", "")
    return F.upper(F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), "[.,;:-]+$", ""))


def blocks(volumes: DataFrame) -> DataFrame:
    """``doc_id, block_no, heading, start_pos, end_pos, body``: from the end of a heading to the next heading; the last line is none, and blocks without text are left out."""
    rows = line_table(volumes)
    seq = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumns({"is_heading": F.col("line").rlike(HEADING) & F.lead("line").over(seq).isNotNull(), "next_start": F.lead("start").over(seq)})
    rows = islands(rows, F.col("is_heading"), "block_no", "line_no").where("block_no > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    head = lambda c: F.max(F.when(F.col("is_heading"), c))
    end = F.max(F.coalesce("next_start", F.col("start") + F.length("line")))
    out = rows.groupBy("doc_id", "block_no").agg(head(F.col("line")).alias("heading"), head(F.col("start") + F.length("line")).alias("start_pos"), end.alias("end_pos"), tx.strip(body).alias("body"))
    return out.where("body <> ''").withColumn("heading", clean_heading(F.col("heading")))


def classified(found: DataFrame) -> DataFrame:
    """Blocks with ``kind`` (toc, advertisement, roster, noise, narrative), ``name_hits``, ``has_table`` and ``density``."""
    adverts = F.lit(0)
    for w in ADVERTS:
        for text in (F.upper("heading"), F.upper("body")):
            adverts = adverts + text.rlike(rf"(?U)\b{w}\b").cast("int")
    money = F.col("body").contains("£") | F.col("body").rlike(r"(?U)\bRs?\.\s*\d")
    judged = hierarchy.body_class(found.withColumns({"adverts": adverts, "money": money}), "heading", "start_pos", "end_pos", "body", "adverts", "money")
    advert = ((F.col("adverts") >= 3) & (F.col("density") < 0.5)) | ((F.col("adverts") >= 1) & F.col("money") & (F.col("density") < 0.3) & (F.col("name_hits") == 0))
    return judged.withColumn("kind", F.when((F.col("kind") != "toc") & advert, "advertisement").otherwise(F.col("kind"))).drop("adverts", "money")


def is_region(heading: Column) -> Column:
    out = heading.isin(list(REGIONS))
    for r in REGIONS:
        out = out | heading.startswith(r + " ")
    return out


def with_paths(found: DataFrame) -> DataFrame:
    """Classified blocks with ``section_path``, the headings above a block and its own.

    A part ends the chapter and region before it, a chapter the region; a region holds until the next.
    """
    name = F.col("heading")
    top, chapter = name.isin(list(TOP)), name.startswith(CHAPTER)
    rows = found.withColumns({"is_top": top, "is_chapter": ~top & chapter, "is_region": ~top & ~chapter & is_region(name)})
    upto = lambda *keys: Window.partitionBy("doc_id", *keys).orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("top_no", F.sum(F.col("is_top").cast("int")).over(upto()))
    rows = rows.withColumn("chapter_no", F.sum(F.col("is_chapter").cast("int")).over(upto("top_no")))
    last = lambda flag, *keys: F.last(F.when(F.col(flag), name), ignorenulls=True).over(upto(*keys))
    rows = rows.withColumns({"t": last("is_top", "top_no"), "c": last("is_chapter", "top_no"), "r": last("is_region", "top_no", "chapter_no")})
    above = F.array_compact(F.array(F.col("t"), F.when(F.col("c") != name, F.col("c")), F.when(F.col("r") != name, F.col("r"))))
    path = F.when((F.size(above) > 0) & (F.element_at(above, -1) == name), above).otherwise(F.concat(above, F.array(name)))
    return rows.withColumn("section_path", F.when(F.size(above) > 0, path).otherwise(F.array(name))).drop("is_top", "is_chapter", "is_region", "top_no", "chapter_no", "t", "c", "r")


def judged(volumes: DataFrame, least: int = LEAST) -> DataFrame:
    """Every block whose heading is not left out, with its path and ``outcome``: its kind, or skipped_short."""
    rows = blocks(volumes).where((F.col("heading") != "") & ~F.col("heading").isin(list(SKIP)))
    rows = with_paths(classified(rows))
    no_fact = (F.col("name_hits") == 0) & ~F.col("has_table") & ~F.col("body").rlike(r"\p{Nd}") & ~F.col("body").contains("£")
    short = (F.col("kind") == "narrative") & (F.length("body") < least) & no_fact
    return rows.withColumn("outcome", F.when(short, "skipped_short").otherwise(F.col("kind")))


def chunks(volumes: DataFrame, least: int = LEAST) -> DataFrame:
    """The blocks of rosters and narratives: ``doc_id, block_no, title, section_path, chunk_type, start_pos, end_pos, chars, name_hits, has_table, density, text``."""
    rows = judged(volumes, least).where(F.col("outcome").isin("roster", "narrative"))
    return rows.select("doc_id", "block_no", F.col("heading").alias("title"), "section_path", F.col("kind").alias("chunk_type"), "start_pos", "end_pos", F.length("body").alias("chars"), "name_hits", "has_table", "density", F.col("body").alias("text"))


def statistics(volumes: DataFrame, least: int = LEAST) -> DataFrame:
    """How many blocks of each outcome a volume has, dropped ones too."""
    return judged(volumes, least).groupBy("doc_id", F.col("outcome").alias("chunk_type")).agg(F.count("*").alias("n"))
