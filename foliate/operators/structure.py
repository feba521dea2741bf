"""Line classes and the segments they form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators.splitting import line_table

# Patterns that decide a line's class.
TITLE = r"^[A-Z\s]{10,}$"
CHAPTER = r"(?i)^(CHAPTER|PART|SECTION)\s+[IVX\d]+"
DATE = r"(?i)^\s*(JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)\s*,?\s*\d{4}"
TABLE_ROW = r"\|.*\|"
LIST_ITEM = r"^\s*[-*•]\s+"
NUMBERED = r"^\s*\d+[.)]\s+"


# Beginnings of entries of a work of reference.
ENTRIES = [r"^[A-Z]{2,}[A-Z\s]*[A-Z]\s*,", r"^[A-Z][A-Z\s]+[A-Z]\s*\.", r"^[A-Z]+\s*\("]


def is_entry(line: Column) -> Column:
    """A stripped line that begins an entry of a work of reference."""
    return line.rlike(ENTRIES[0]) | line.rlike(ENTRIES[1]) | line.rlike(ENTRIES[2])


def line_class(s: Column) -> Column:
    """Class of a stripped line that is not empty; the first that fits."""
    return (
        F.when(s.rlike(TITLE), "title").when(s.rlike(CHAPTER), "chapter_header").when(s.rlike(DATE), "date_header").when(s.rlike(TABLE_ROW), "table_row")
        .when(s.rlike(LIST_ITEM), "list_item").when(s.rlike(NUMBERED), "numbered_list").when((F.length(s) > 50) & ~tx.is_upper(s), "paragraph").otherwise("other")
    )


def register_class(line: Column) -> Column:
    """Class of a line of an official register."""
    s = tx.strip(line)
    heading = tx.is_upper(s) & (F.length(s) > 10) & ~s.startswith("|") & ~s.contains("£")
    return (
        F.when(s == "", "empty").when(heading, "major_heading").when(s.rlike("^[A-Z][a-z]+.*(Department|Office|Service)"), "department_header")
        .when(s.contains("|") | s.contains("\t"), "table_row").when(s.rlike(r"^[A-Z]\.|,.*£"), "personnel_entry").otherwise("content")
    )


def report_content(text: Column) -> Column:
    return (
        F.when(text.rlike("(?i)revenue|expenditure|financial"), "financial").when(text.rlike("(?i)government|administration|council"), "administrative")
        .when(text.contains("|"), "tabular_data").otherwise("narrative")
    )


def begins_register(line: Column) -> Column:
    """Whether a line can begin a section of a register."""
    return register_class(line).isin("major_heading", "department_header")


def header_positions(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, text, kind``: lines that are a title, chapter, date or numbered header; a line of several kinds has a row for each."""
    s = F.col("s")
    kinds = {"title": s.rlike(TITLE), "chapter": s.rlike(CHAPTER), "date": s.rlike(DATE), "header": s.rlike(NUMBERED)}
    rows = line_table(docs).select("doc_id", F.col("start").alias("pos"), tx.strip(F.col("line")).alias("s"))
    found = F.explode(F.array_compact(F.array(*[F.when(cond, k) for k, cond in kinds.items()])))
    return rows.select("doc_id", "pos", s.alias("text"), found.alias("kind"))


def page_breaks(docs: DataFrame) -> DataFrame:
    """``doc_id, pos``: the first line feed of each run of white space with three or more line feeds."""
    rows = line_table(docs).withColumn("blank", tx.strip(F.col("line")) == "")
    seq = Window.partitionBy("doc_id").orderBy("line_no")
    rows = rows.withColumn("run", F.sum((~F.col("blank")).cast("int")).over(seq.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("last", F.lead("line_no").over(seq).isNull())
    runs = rows.groupBy("doc_id", "run").agg(
        F.count_if("blank").alias("n"), F.min("line_no").alias("first"), F.min(F.struct("line_no", "start", F.length("line").alias("len"))).alias("head"), F.bool_or(F.col("last") & F.col("blank")).alias("at_end")
    )
    # line feeds of the run: one before each blank line and one after the last, where there are lines
    feeds = F.col("n") + 1 - (F.col("run") == 0).cast("int") - F.col("at_end").cast("int")
    return runs.where((F.col("n") > 0) & (feeds >= 3)).select("doc_id", (F.col("head.start") + F.col("head.len")).cast("long").alias("pos"))


def is_table(line: Column) -> Column:
    return tx.occurrences(line, "|") >= 2


def is_header(s: Column) -> Column:
    """A stripped line longer than 5 that is upper-case, title-like with a full stop, or a numbered part."""
    return (F.length(s) > 5) & (tx.is_upper(s) | s.rlike(r"^[A-Z][A-Za-z\s]+\.$") | s.rlike("^(CHAPTER|PART|SECTION)"))


def islands(df: DataFrame, opens: Column, name: str, *order: str) -> DataFrame:
    """Numbers the runs that rows with ``opens`` begin, within a document."""
    upto = Window.partitionBy("doc_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(opens.cast("int")).over(upto).cast("int"))


def segments(docs: DataFrame) -> DataFrame:
    """Typed segments: neighbouring table rows, and paragraphs less than 50 characters apart, are merged."""
    rows = line_table(docs).withColumn("s", tx.strip(F.col("line"))).where("s <> ''")
    rows = rows.select("doc_id", "line_no", "s", "start", (F.col("start") + F.length("line")).alias("stop"), line_class(F.col("s")).alias("kind"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    same = F.col("kind") == F.lag("kind").over(w)
    near = F.col("start") - F.lag("stop").over(w) < 50
    joins = F.coalesce(same & ((F.col("kind") == "table_row") | ((F.col("kind") == "paragraph") & near)), F.lit(False))
    rows = islands(rows.withColumn("opens", ~joins), F.col("opens"), "segment_no", "line_no")
    kind = F.when(F.count("*") == 1, F.min("kind")).when(F.min("kind") == "table_row", "table").otherwise("text_block")
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "s"))), lambda x: x["s"]), "\n")
    return rows.groupBy("doc_id", "segment_no").agg(kind.alias("segment_type"), F.min("start").alias("start_pos"), F.max("stop").alias("end_pos"), F.count("*").alias("merged_count"), content.alias("content"))


def table_runs(docs: DataFrame) -> DataFrame:
    """First and last line of each run of table lines."""
    rows = line_table(docs).where(is_table(F.col("line"))).select("doc_id", "line_no")
    rows = rows.withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    return rows.groupBy("doc_id", "island").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.count("*").alias("rows")).drop("island")


def _text(column: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", column))), lambda x: x[column]), "\n").alias("text")


def sections(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Runs of table lines, and headers with the text below them. Blank lines neither open nor close one."""
    rows = line_table(docs).withColumn("s", tx.strip(F.col("line"))).where("s <> ''")
    rows = rows.withColumn("kind", F.when(is_table(F.col("line")), "table").when(is_header(F.col("s")), "header").otherwise("text"))
    before = F.lag("kind").over(Window.partitionBy("doc_id").orderBy("line_no"))
    opens = before.isNull() | (F.col("kind") == "header") | ((F.col("kind") == "table") != (before == "table"))
    rows = islands(rows.withColumn("opens", opens), F.col("opens"), "section_no", "line_no")
    kind = F.when(F.bool_or(F.col("kind") == "table"), "table").when(F.bool_or(F.col("kind") == "text"), "text").otherwise("header")
    return rows.groupBy("doc_id", "section_no").agg(kind.alias("section_type"), F.count("*").alias("n_lines"), F.sum(F.length("line")).cast("long").alias("chars"), *([_text("line")] if with_text else []))


def report_sections(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Sections of a report: a numbered or upper-case line begins one unless it is the first line; flags are of the other lines."""
    s = F.col("s")
    begins = s.rlike(r"^[IVX]+\.—[A-Z]") | (tx.is_upper(s) & (F.length(s) > 8) & ~s.startswith("|") & ~s.rlike(r"[£$]\d"))
    rows = line_table(docs).select("doc_id", "line_no", "line", tx.strip(F.col("line")).alias("s")).withColumn("b", begins)
    rows = islands(rows, F.col("b") & (F.col("line_no") > 0), "section_no", "line_no")
    plain = lambda cond: F.coalesce(F.bool_or(F.when(~F.col("b"), cond)), F.lit(False))
    return rows.groupBy("doc_id", "section_no").agg(F.coalesce(F.max(F.when(F.col("b"), s)), F.lit("")).alias("title"), F.count("*").alias("n_lines"), plain(s.contains("|")).alias("has_table"), plain(s.rlike(r"[£$]\s*\d")).alias("has_money"), *([_text("line")] if with_text else []))
