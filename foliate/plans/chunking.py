"""Splitting, classifying, packing: queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import packing, splitting, structure
from foliate.plans.registry import query

LINES = """lines AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))),
stripped AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM lines)"""
SENTENCES = """sents AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, s FROM
  (SELECT doc_id, i, regexp_replace(l[i], '^\\s+|\\s+$', '', 'g') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
    FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents))) WHERE s <> '')"""
UPPER = "(regexp_matches({0}, '\\p{{Lu}}') AND NOT regexp_matches({0}, '\\p{{Ll}}'))"


def fold_sql(units: str, opens: str, separator: int | str, mark: str = "false", more: str = "", joint: str = "") -> str:
    """A recursive CTE over ``units(doc_id, pos, s)``; ``opens`` refers to the group so far (r.n, r.len, r.m, r.last) and the unit (u.s, l, mk).

    joint: what joins the units' texts, by default a sign in place of the separator of the same length.
    """
    joint = joint or ("'§§'" if separator == 2 else "' '")
    return f"""u AS (SELECT doc_id, pos, s, length(s) AS l, {mark} AS mk{more} FROM {units}),
r AS (SELECT doc_id, pos, 0 AS g, 1 AS n, l AS len, mk::INT AS m, mk AS last FROM u WHERE pos = 0
  UNION ALL SELECT u.doc_id, u.pos, r.g + ({opens})::INT, CASE WHEN {opens} THEN 1 ELSE r.n + 1 END, CASE WHEN {opens} THEN l ELSE r.len + {separator} + l END, CASE WHEN {opens} THEN 0 ELSE r.m END + mk::INT, mk
  FROM r JOIN u ON u.doc_id = r.doc_id AND u.pos = r.pos + 1),
packed AS (SELECT doc_id, g AS chunk_index, count(*) AS units, string_agg(s, {joint} ORDER BY pos) AS text FROM r JOIN u USING (doc_id, pos) GROUP BY ALL)"""


def digest(column: str = "text") -> F.Column:
    return F.sha2(F.col(column), 256)


@query("t1_lines", f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, line FROM lines", documents="documents")
def lines(documents: DataFrame) -> DataFrame:
    return splitting.line_table(documents).select("doc_id", "line_no", "start", "line")


@query("t2_paragraphs", f"WITH {LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no)::INT - 1 AS para_no, s AS paragraph FROM stripped WHERE s <> ''", documents="documents")
def paragraphs(documents: DataFrame) -> DataFrame:
    return splitting.explode_units(documents, tx.paragraphs(F.col("text"), "\n"), "para_no", "paragraph")


@query("t3_sentences", f"WITH {SENTENCES} SELECT doc_id, pos::INT AS sentence_no, s AS sentence FROM sents", documents="documents")
def sentences(documents: DataFrame) -> DataFrame:
    return splitting.explode_units(documents, tx.sentences(F.col("text")), "sentence_no", "sentence")


@query("t5_word_counts", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INT AS n_words FROM documents WHERE text IS NOT NULL", documents="documents")
def word_counts(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null").select("doc_id", F.size(tx.words(F.col("text"))).alias("n_words"))


@query(
    "p3_register_lines",
    f"""WITH {LINES} SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN s = '' THEN 'empty'
  WHEN {UPPER.format('s')} AND length(s) > 10 AND NOT starts_with(s, '|') AND NOT contains(s, '£') THEN 'major_heading'
  WHEN regexp_matches(s, '^[A-Z][a-z]+.*(Department|Office|Service)') THEN 'department_header'
  WHEN contains(s, '|') OR contains(s, chr(9)) THEN 'table_row' WHEN regexp_matches(s, '^[A-Z]\\.|,.*£') THEN 'personnel_entry' ELSE 'content' END AS kind FROM stripped) GROUP BY ALL""",
    documents="documents",
)
def register_lines(documents: DataFrame) -> DataFrame:
    return splitting.line_table(documents).select("doc_id", structure.register_class(F.col("line")).alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("p5_report_content", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)revenue|expenditure|financial') THEN 'financial' WHEN regexp_matches(text, '(?i)government|administration|council') THEN 'administrative' WHEN contains(text, '|') THEN 'tabular_data' ELSE 'narrative' END AS content_type FROM documents", documents="documents")
def report_content(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", structure.report_content(F.col("text")).alias("content_type"))


_PIPES = "(length(line) - length(replace(line, '|', '')))"


@query("p6_table_lines", f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, {_PIPES}::INT AS pipes FROM lines WHERE {_PIPES} >= 2", documents="documents")
def table_lines(documents: DataFrame) -> DataFrame:
    return splitting.line_table(documents).select("doc_id", "line_no", tx.occurrences(F.col("line"), "|").alias("pipes")).where("pipes >= 2")


_HEADER = f"(length(s) > 5 AND ({UPPER.format('s')} OR regexp_matches(s, '^[A-Z][A-Za-z\\s]+\\.$') OR regexp_matches(s, '^(CHAPTER|PART|SECTION)')))"


@query("p7_headers", f"WITH {LINES} SELECT doc_id, line_no::INT AS line_no, s AS header FROM stripped WHERE {_HEADER}", documents="documents")
def headers(documents: DataFrame) -> DataFrame:
    return splitting.line_table(documents).select("doc_id", "line_no", tx.strip(F.col("line")).alias("header")).where(structure.is_header(F.col("header")))


_CLASS = f"""CASE WHEN regexp_matches(s, '^[A-Z\\s]{{10,}}$') THEN 'title' WHEN regexp_matches(s, '(?i)^(CHAPTER|PART|SECTION)\\s+[IVX\\d]+') THEN 'chapter_header'
 WHEN regexp_matches(s, '(?i)^\\s*(JANUARY|FEBRUARY|MARCH|APRIL|MAY|JUNE|JULY|AUGUST|SEPTEMBER|OCTOBER|NOVEMBER|DECEMBER)\\s*,?\\s*\\d{{4}}') THEN 'date_header'
 WHEN regexp_matches(s, '\\|.*\\|') THEN 'table_row' WHEN regexp_matches(s, '^\\s*[-*•]\\s+') THEN 'list_item' WHEN regexp_matches(s, '^\\s*\\d+[.)]\\s+') THEN 'numbered_list'
 WHEN length(s) > 50 AND NOT {UPPER.format('s')} THEN 'paragraph' ELSE 'other' END"""
SEGMENTS = f"""{LINES}, pos AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM stripped),
cls AS (SELECT *, start + length(line) AS stop, {_CLASS} AS kind FROM pos WHERE s <> ''),
prev AS (SELECT *, lag(kind) OVER w AS pk, lag(stop) OVER w AS ps FROM cls WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
isl AS (SELECT *, sum(CASE WHEN (pk = kind AND kind = 'table_row') OR (pk = kind AND kind = 'paragraph' AND start - ps < 50) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS seg FROM prev),
segs AS (SELECT doc_id, seg::INT AS segment_no, CASE WHEN count(*) = 1 THEN min(kind) WHEN min(kind) = 'table_row' THEN 'table' ELSE 'text_block' END AS segment_type,
  min(start)::BIGINT AS start_pos, max(stop)::BIGINT AS end_pos, count(*) AS merged_count, string_agg(s, chr(10) ORDER BY line_no) AS content FROM isl GROUP BY doc_id, seg)"""


@query("p8_line_classes", f"WITH {LINES} SELECT doc_id, {_CLASS} AS kind, count(*) AS n FROM stripped WHERE s <> '' GROUP BY ALL", documents="documents")
def line_classes(documents: DataFrame) -> DataFrame:
    rows = splitting.line_table(documents).select("doc_id", tx.strip(F.col("line")).alias("s")).where("s <> ''")
    return rows.groupBy("doc_id", structure.line_class(F.col("s")).alias("kind")).agg(F.count("*").alias("n"))


@query("g3_segments", f"WITH {SEGMENTS} SELECT * EXCLUDE (content), sha256(content) AS content_sha256 FROM segs", documents="documents")
def segments(documents: DataFrame) -> DataFrame:
    return structure.segments(documents).withColumn("content_sha256", digest("content")).drop("content")


@query("a9_segment_summary", f"WITH {SEGMENTS} SELECT segment_type, count(*) AS segments, sum(end_pos - start_pos)::BIGINT AS chars, count(DISTINCT doc_id) AS docs FROM segs GROUP BY ALL", documents="documents")
def segment_summary(documents: DataFrame) -> DataFrame:
    return structure.segments(documents).groupBy("segment_type").agg(F.count("*").alias("segments"), F.sum(F.col("end_pos") - F.col("start_pos")).alias("chars"), F.countDistinct("doc_id").alias("docs"))


@query(
    "p9_table_runs",
    f"""WITH {LINES}, f AS (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM lines WHERE {_PIPES} >= 2)
SELECT doc_id, min(line_no)::INT AS first_line, max(line_no)::INT AS last_line, count(*) AS rows FROM f GROUP BY doc_id, island""",
    documents="documents",
)
def table_runs(documents: DataFrame) -> DataFrame:
    return structure.table_runs(documents)


def _shapes() -> str:
    return f"""{LINES}, c AS (SELECT doc_id, line_no, line, CASE WHEN {_PIPES} >= 2 THEN 'table' WHEN {_HEADER} THEN 'header' ELSE 'text' END AS k FROM stripped WHERE s <> ''),
p AS (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY line_no) AS pk FROM c),
g AS (SELECT *, sum(CASE WHEN pk IS NULL OR k = 'header' OR (k = 'table') <> (pk = 'table') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec FROM p)"""


@query("t16_structure_sections", f"WITH {_shapes()} SELECT doc_id, sec::INT AS section_no, CASE WHEN bool_or(k = 'table') THEN 'table' WHEN bool_or(k = 'text') THEN 'text' ELSE 'header' END AS section_type, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM g GROUP BY doc_id, sec", documents="documents")
def structure_sections(documents: DataFrame) -> DataFrame:
    return structure.sections(documents)


@query("c7_hybrid_packing", f"WITH RECURSIVE {SENTENCES}, {fold_sql('sents', 'r.n > 0 AND r.len + 1 + l > 1000', 1)} SELECT doc_id, chunk_index, units, length(text) AS size, sha256(text) AS text_sha256 FROM packed", documents="documents")
def hybrid_packing(documents: DataFrame) -> DataFrame:
    packed = packing.pack(documents, tx.sentences(F.col("text")), packing.before_limit(1000, 1), " ")
    return packed.withColumn("text_sha256", digest()).drop("text")


PARAS = f"{LINES}, paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos, s FROM stripped WHERE s <> '')"


@query("c6b_paragraph_packing", f"WITH RECURSIVE {PARAS}, {fold_sql('paras', 'r.n > 0 AND r.len + 2 + l > 1000', 2)} SELECT doc_id, chunk_index, units, length(text) AS size FROM packed", documents="documents")
def paragraph_packing(documents: DataFrame) -> DataFrame:
    return packing.pack(documents, tx.paragraphs(F.col("text"), "\n"), packing.before_limit(1000, 2), "\n\n").drop("text")


@query("c3b_soft_overflow", f"WITH RECURSIVE {PARAS}, {fold_sql('paras', 'r.len > 1200', 2)} SELECT doc_id, chunk_index, units, length(text) AS size FROM packed", documents="documents")
def soft_overflow(documents: DataFrame) -> DataFrame:
    return packing.pack(documents, tx.paragraphs(F.col("text"), "\n"), packing.after_limit(1200), "\n\n").drop("text")


LINE_UNITS = f"{LINES}, units AS (SELECT doc_id, line_no AS pos, s FROM stripped)"
_UPPER_LINE = UPPER.format("s")
_TABLE_LINE = "(length(s) - length(replace(s, '|', '')) >= 2)"
_ENTRY_LINE = "(regexp_matches(s, '^[A-Z]{2,}[A-Z\\s]*[A-Z]\\s*,') OR regexp_matches(s, '^[A-Z][A-Z\\s]+[A-Z]\\s*\\.') OR regexp_matches(s, '^[A-Z]+\\s*\\('))"
def line_units() -> F.Column:
    return F.transform(tx.lines(F.col("text")), tx.strip)


def packed_lines(documents: DataFrame, rule: packing.Rule, mark) -> DataFrame:
    return packing.pack(documents.where("text is not null"), line_units(), rule, "\n", mark).drop("text")


def packed_lines_sql(opens: str, mark: str) -> str:
    return f"WITH RECURSIVE {LINE_UNITS}, {fold_sql('units', opens, 1, mark)} SELECT doc_id, chunk_index, units, length(text) AS size FROM packed"


@query("c4_reference_entries", packed_lines_sql("r.n > 0 AND ((mk AND (r.len >= 400 OR r.m >= 3)) OR r.len > 800)", _ENTRY_LINE), documents="documents")
def reference_entries(documents: DataFrame) -> DataFrame:
    return packed_lines(documents, packing.at_marks(400, 3, 800), structure.is_entry)


_CUT = f"list_filter(range(greatest(n // 2 - 5, 0), least(n, n // 2 + 5)), lambda i: {_ENTRY_LINE.replace('(s,', '(l[i + 1],')})[1]"


@query(
    "c4b_forced_splits",
    f"""WITH RECURSIVE {LINE_UNITS}, {fold_sql('units', 'r.n > 0 AND ((mk AND (r.len >= 400 OR r.m >= 3)) OR r.len > 800)', 1, _ENTRY_LINE, joint='chr(10)')},
x AS (SELECT doc_id, chunk_index, text, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM packed), y AS (SELECT *, CASE WHEN length(text) > 800 THEN nullif(coalesce({_CUT}, n // 2), 0) END AS cut FROM x),
z AS (SELECT doc_id, chunk_index, unnest(CASE WHEN cut IS NULL THEN [{{'part': 0, 'p': l}}] ELSE [{{'part': 0, 'p': l[1:cut]}}, {{'part': 1, 'p': l[cut + 1:]}}] END) AS h FROM y)
SELECT doc_id, chunk_index, h.part::INT AS part, len(h.p) AS units, length(array_to_string(h.p, chr(10))) AS size, sha256(array_to_string(h.p, chr(10))) AS text_sha256 FROM z""",
    documents="documents",
)
def forced_splits(documents: DataFrame) -> DataFrame:
    """Entry chunks beyond the limit are cut before an entry near their middle; both halves stay."""
    made = packing.pack(documents.where("text is not null"), line_units(), packing.at_marks(400, 3, 800), "\n", structure.is_entry)
    return packing.forced_splits(made, 800, structure.is_entry).withColumn("text_sha256", digest()).drop("text")


@query("c3c_headed_lines", packed_lines_sql("(mk AND r.n > 5) OR r.len > 1500", f"({_UPPER_LINE} AND length(s) > 15 AND NOT starts_with(s, '|'))"), documents="documents")
def headed_lines(documents: DataFrame) -> DataFrame:
    def mark(u: F.Column) -> F.Column:
        return tx.is_upper(u) & (F.length(u) > 15) & ~u.startswith("|")

    return packed_lines(documents, packing.headed(5, 1500), mark)


@query("c3d_whole_tables", packed_lines_sql("(mk AND NOT r.last AND r.len > 800) OR (NOT (mk AND r.last) AND r.len > 1200)", _TABLE_LINE), documents="documents")
def whole_tables(documents: DataFrame) -> DataFrame:
    return packed_lines(documents, packing.around_runs(800, 1200), structure.is_table)


@query("c5b_register_sections", packed_lines_sql("(NOT (mk AND r.last) AND r.len > 1200)", "(contains(s, '|') OR contains(s, chr(9)))"), documents="documents")
def register_sections(documents: DataFrame) -> DataFrame:
    def mark(u: F.Column) -> F.Column:
        return u.contains("|") | u.contains("\t")

    return packed_lines(documents, packing.around_runs(1 << 30, 1200), mark)


_REGISTER = f"(({UPPER.format('st')} AND length(st) > 10 AND NOT starts_with(st, '|') AND NOT contains(st, '£')) OR regexp_matches(st, '^[A-Z][a-z]+.*(Department|Office|Service)'))"
_RAW_LINES = f"{LINES}, raw AS (SELECT doc_id, line_no AS pos, line AS s, s AS st FROM stripped)"
_T14 = f"{_RAW_LINES}, {fold_sql('raw', 'r.n > 0 AND mk AND r.len > 100', 1, _REGISTER, joint='chr(10)')}"


def register_parts(documents: DataFrame) -> DataFrame:
    lines = tx.lines(F.col("text"))
    return packing.pack(documents.where("text is not null"), lines, packing.at_headings(100), "\n", structure.begins_register)


@query("t14_register_sections", f"WITH RECURSIVE {_T14} SELECT doc_id, chunk_index AS section_no, units AS n_lines, length(text) AS chars, sha256(text) AS text_sha256 FROM packed", documents="documents")
def register_parts_digest(documents: DataFrame) -> DataFrame:
    return register_parts(documents).select("doc_id", F.col("chunk_index").alias("section_no"), F.col("units").alias("n_lines"), F.col("size").alias("chars"), digest().alias("text_sha256"))


_IN_REGISTER = "(contains(s, '|') OR contains(s, chr(9)))"
# sections are documents of the second fold: their key is one number
_PARTS = """parts AS (SELECT doc_id * 1000000 + {no} AS doc_id, {text} AS text, length({text}) AS size FROM {source}),
pieces AS (SELECT doc_id, 0::BIGINT AS pos, text AS s, true AS whole FROM parts WHERE size <= {limit} UNION ALL SELECT doc_id, i - 1, l[i], false FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {units} AS l FROM parts WHERE size > {limit})))"""
_STRIPPED = "list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))"
_CHUNKS = "SELECT doc_id // 1000000 AS doc_id, (doc_id % 1000000)::INT AS section_no, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index)::INT - 1 AS piece, units, length(text) AS size, sha256(text) AS text_sha256 FROM packed WHERE regexp_matches(text, '\\S')"


@query(
    "c5_register_chunks",
    f"""WITH sections AS (WITH RECURSIVE {_T14} SELECT doc_id, chunk_index, text FROM packed)
SELECT * FROM (WITH RECURSIVE {_PARTS.format(no='chunk_index', text='text', source='sections', limit=1200, units=_STRIPPED)}, {fold_sql('pieces', 'NOT (mk AND r.last) AND r.len > 1200', 1, _IN_REGISTER, joint='chr(10)')} {_CHUNKS})""",
    documents="documents",
)
def register_chunks(documents: DataFrame) -> DataFrame:
    """Sections of a register, the long ones cut between their table runs."""
    parts = register_parts(documents).withColumnRenamed("chunk_index", "section_no")
    mark = lambda u: u.contains("|") | u.contains("\t")
    made = packing.pack_within(parts, "section_no", line_units(), 1200, packing.around_runs(1 << 30, 1200), "\n", mark)
    return made.withColumn("text_sha256", digest()).drop("text")


_REPORT_START = f"(regexp_matches(s, '^[IVX]+\\.—[A-Z]') OR ({UPPER.format('s')} AND length(s) > 8 AND NOT starts_with(s, '|') AND NOT regexp_matches(s, '[£$]\\d')))"
_FILLED_PARAS = f"list_filter({_STRIPPED}, lambda x: x <> '')"


@query(
    "c6_report_chunks",
    f"""WITH sections AS (WITH {LINES}, f AS (SELECT *, {_REPORT_START} AS b FROM stripped), g AS (SELECT *, sum((b AND line_no > 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec FROM f)
 SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g GROUP BY doc_id, sec)
SELECT * FROM (WITH RECURSIVE {_PARTS.format(no='sec', text='text', source='sections', limit=1000, units=_FILLED_PARAS)}, {fold_sql('pieces', 'r.n > 0 AND r.len + 2 + l > 1000', 2, joint='chr(10) || chr(10)')} {_CHUNKS})""",
    documents="documents",
)
def report_chunks(documents: DataFrame) -> DataFrame:
    """Sections of a report, the long ones packed by paragraphs."""
    parts = structure.report_sections(documents, with_text=True).select("doc_id", "section_no", F.length("text").cast("long").alias("size"), "text")
    made = packing.pack_within(parts, "section_no", tx.paragraphs(F.col("text"), "\n"), 1000, packing.before_limit(1000, 2), "\n\n")
    return made.withColumn("text_sha256", digest()).drop("text")


_SHAPE_TEXT = _shapes()


@query(
    "c3_structure_chunks",
    f"""WITH sections AS (WITH {_SHAPE_TEXT} SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g GROUP BY doc_id, sec)
SELECT * FROM (WITH RECURSIVE {_PARTS.format(no='sec', text='text', source='sections', limit=1200, units=_FILLED_PARAS)}, {fold_sql('pieces', 'r.len > 1200', 1, joint='chr(10)')} {_CHUNKS})""",
    documents="documents",
)
def structure_chunks(documents: DataFrame) -> DataFrame:
    """Sections of tables and headed text, the long ones cut once they pass the limit."""
    parts = structure.sections(documents, with_text=True).select("doc_id", "section_no", F.length("text").cast("long").alias("size"), "text")
    made = packing.pack_within(parts, "section_no", tx.paragraphs(F.col("text"), "\n"), 1200, packing.after_limit(1200), "\n")
    return made.withColumn("text_sha256", digest()).drop("text")


_KINDS = {"title": structure.TITLE, "chapter": structure.CHAPTER, "date": structure.DATE, "header": structure.NUMBERED}


@query(
    "p10_header_positions",
    f"""WITH {LINES}, p AS (SELECT doc_id, s, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM stripped)
SELECT doc_id, pos::BIGINT AS pos, s AS text, unnest(list_filter([{', '.join(f"CASE WHEN regexp_matches(s, '{x}') THEN '{k}' END" for k, x in _KINDS.items())}], lambda x: x IS NOT NULL)) AS kind FROM p""",
    documents="documents",
)
def header_positions(documents: DataFrame) -> DataFrame:
    return structure.header_positions(documents)


@query(
    "a30_marker_counts",
    "SELECT doc_id, length(text) - length(replace(text, chr(10), '')) AS line_feeds, length(text) - length(replace(text, '|', '')) AS pipes, length(text) - length(replace(text, '.', '')) AS stops, (length(text) - length(replace(text, '**', ''))) // 2 AS bold FROM documents",
    documents="documents",
)
def marker_counts(documents: DataFrame) -> DataFrame:
    count = lambda part: tx.occurrences(F.col("text"), part).cast("long")
    return documents.select("doc_id", count("\n").alias("line_feeds"), count("|").alias("pipes"), count(".").alias("stops"), count("**").alias("bold"))


@query(
    "t15_report_sections",
    f"""WITH {LINES}, f AS (SELECT *, regexp_matches(s, '^[IVX]+\\.—[A-Z]') OR ({UPPER.format('s')} AND length(s) > 8 AND NOT starts_with(s, '|') AND NOT regexp_matches(s, '[£$]\\d')) AS b FROM stripped),
g AS (SELECT *, sum((b AND line_no > 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sec FROM f)
SELECT doc_id, sec::INT AS section_no, coalesce(max(s) FILTER (b), '') AS title, count(*) AS n_lines, coalesce(bool_or(contains(s, '|')) FILTER (NOT b), false) AS has_table, coalesce(bool_or(regexp_matches(s, '[£$]\\s*\\d')) FILTER (NOT b), false) AS has_money FROM g GROUP BY doc_id, sec""",
    documents="documents",
)
def report_sections(documents: DataFrame) -> DataFrame:
    return structure.report_sections(documents)


@query("c2_paragraph_groups", f"WITH {PARAS} SELECT doc_id, (pos // 3)::INT AS chunk_index, count(*) AS paragraphs, (sum(length(s)) + 2 * (count(*) - 1))::BIGINT AS size FROM paras GROUP BY doc_id, pos // 3", documents="documents")
def paragraph_groups(documents: DataFrame) -> DataFrame:
    paras = splitting.explode_units(documents, tx.paragraphs(F.col("text"), "\n"), "pos", "s")
    return paras.groupBy("doc_id", F.floor(F.col("pos") / 3).cast("int").alias("chunk_index")).agg(F.count("*").alias("paragraphs"), (F.sum(F.length("s")) + 2 * (F.count("*") - 1)).alias("size"))


@query(
    "c2b_paragraph_groups",
    f"WITH {PARAS} SELECT doc_id, k::INT AS k, (pos // k)::INT AS chunk_index, count(*) AS paragraphs, (sum(length(s)) + 2 * (count(*) - 1))::BIGINT AS size FROM paras, (VALUES (2), (4)) AS g(k) GROUP BY doc_id, k, pos // k",
    documents="documents",
)
def paragraph_pairs(documents: DataFrame) -> DataFrame:
    """Groups of two and of four paragraphs."""
    paras = splitting.explode_units(documents, tx.paragraphs(F.col("text"), "\n"), "pos", "s").withColumn("k", F.explode(F.array(F.lit(2), F.lit(4))))
    return paras.groupBy("doc_id", "k", F.floor(F.col("pos") / F.col("k")).cast("int").alias("chunk_index")).agg(F.count("*").alias("paragraphs"), (F.sum(F.length("s")) + 2 * (F.count("*") - 1)).alias("size"))


FIXED = """fixed AS (SELECT doc_id, i AS chunk_index, i * 600 AS start_pos, least(i * 600 + 800, length(text)) AS end_pos, regexp_replace(substring(text, i * 600 + 1, 800), '^\\s+|\\s+$', '', 'g') AS text
 FROM (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 800) / 600.0), 0)::BIGINT + 1)) AS i FROM documents WHERE length(text) > 0))"""


@query("c1b_fixed_windows", f"WITH {FIXED} SELECT doc_id, chunk_index::INT AS chunk_index, start_pos::INT AS start_pos, end_pos::INT AS end_pos, sha256(text) AS text_sha256 FROM fixed", documents="documents")
def fixed_windows(documents: DataFrame) -> DataFrame:
    return splitting.windows(documents, 800, 200).withColumn("text_sha256", digest()).drop("text")


def windows_sql(size: int, overlap: int, limit: int, mark: str) -> str:
    part = f"substring(text, n + 1, {size})"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, text, 0 AS k, 0::BIGINT AS a, 0::BIGINT AS b, false AS done FROM documents WHERE length(text) > 0
 UNION ALL SELECT doc_id, text, k + 1, n, CASE WHEN n + {size} >= length(text) THEN length(text) WHEN dot > {limit} THEN n + dot + 1 ELSE n + {size} END, n + {size} >= length(text)
 FROM (SELECT *, CASE WHEN instr({part}, {mark}) > 0 THEN length({part}) - instr(reverse({part}), {mark}) ELSE -1 END AS dot
   FROM (SELECT *, CASE WHEN k = 0 THEN 0 ELSE greatest(b - {overlap}, a + 1) END AS n FROM w WHERE NOT done)))
SELECT doc_id, k - 1 AS chunk_index, a::INT AS start_pos, b::INT AS end_pos FROM w WHERE k > 0"""


@query("c1_sentence_windows", windows_sql(800, 200, 560, "'.'"), documents="documents")
def sentence_windows(documents: DataFrame) -> DataFrame:
    return splitting.sentence_windows(documents).drop("text")


@query("c1c_paragraph_windows", windows_sql(1000, 200, 600, "chr(10)"), documents="documents")
def paragraph_windows(documents: DataFrame) -> DataFrame:
    """Windows that end after a paragraph where one ends in their last two fifths."""
    return splitting.sentence_windows(documents, 1000, 200, 0.6, "\n").drop("text")


_STATS = "count(*) AS chunks, avg(size) AS avg_size, min(size) AS min_size, max(size) AS max_size, coalesce(stddev_samp(size), 0) AS std_size, count_if(size < 300) AS small, count_if(size > 1500) AS large"
_UNION = f"""{SENTENCES}, {PARAS.replace(LINES, LINES)}, {FIXED}, {fold_sql('sents', 'r.n > 0 AND r.len + 1 + l > 1000', 1)},
allc AS (SELECT doc_id, 'hybrid' AS strategy, length(text) AS size FROM packed UNION ALL SELECT doc_id, 'overlapping', length(text) FROM fixed
 UNION ALL SELECT doc_id, 'paragraph', (sum(length(s)) + 2 * (count(*) - 1))::BIGINT FROM paras GROUP BY doc_id, pos // 3)"""


def strategies(documents: DataFrame, *keep: str) -> DataFrame:
    """``doc_id, keep, strategy, size`` of every chunk of three strategies, in one scan: chunks are ranges of lengths, texts are only measured."""
    t = F.col("text")
    total = lambda xs, sep: F.aggregate(xs, F.lit(-sep).cast("long"), lambda s, x: s + x + sep)
    rows = documents.select("doc_id", *keep, "text", tx.sentences(t).alias("_s"), F.transform(tx.paragraphs(t, "\n"), F.length).alias("_p"))
    rows = rows.withColumn("_starts", packing.group_starts(F.col("_s"), packing.before_limit(1000, 1), 1)).withColumn("_s", F.transform("_s", F.length))
    stops = F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_s")))
    last = F.greatest(F.ceil((F.length(t) - 800) / 600), F.lit(0)).cast("int")
    made = {
        "hybrid": F.zip_with("_starts", stops, lambda a, b: total(F.slice("_s", a + 1, b - a), 1)),
        "overlapping": F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.length(tx.strip(F.substring(t, i * 600 + 1, F.lit(800)))).cast("long"))),
        "paragraph": F.when(F.size("_p") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_p") - 1) / 3).cast("int")), lambda i: total(F.slice("_p", i * 3 + 1, F.lit(3)), 2))),
    }

    def named(k: str, v: F.Column) -> F.Column:
        return F.transform(F.coalesce(v, F.array().cast("array<bigint>")), lambda x: F.struct(F.lit(k).alias("strategy"), x.alias("size")))

    sizes = [named(k, v) for k, v in made.items()]
    return rows.select("doc_id", *keep, F.explode(F.concat(*sizes)).alias("c")).select("doc_id", *keep, "c.strategy", "c.size")


def size_stats() -> list[F.Column]:
    return [F.count("*").alias("chunks"), F.avg("size").alias("avg_size"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.coalesce(F.stddev_samp("size"), F.lit(0.0)).alias("std_size"), F.count_if(F.col("size") < 300).alias("small"), F.count_if(F.col("size") > 1500).alias("large")]


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("a7_strategy_matrix", f"WITH RECURSIVE {_UNION}, s AS (SELECT doc_id, strategy, {_STATS} FROM allc GROUP BY ALL) SELECT * REPLACE (round(avg_size, 6) AS avg_size, round(std_size, 6) AS std_size) FROM s", documents="documents")
def strategy_matrix(documents: DataFrame) -> DataFrame:
    return rounded(strategies(documents).groupBy("doc_id", "strategy").agg(*size_stats()))


@query(
    "a8_strategy_summary",
    f"""WITH RECURSIVE {_UNION}, s AS (SELECT doc_id, strategy, {_STATS} FROM allc GROUP BY ALL)
SELECT strategy, round(avg(chunks), 6) AS avg_chunks, round(avg(avg_size), 6) AS avg_length, round(avg(std_size) FILTER (std_size > 0), 6) AS avg_std FROM s GROUP BY ALL""",
    documents="documents",
)
def strategy_summary(documents: DataFrame) -> DataFrame:
    per = strategies(documents).groupBy("doc_id", "strategy").agg(*size_stats())
    return rounded(per.groupBy("strategy").agg(F.avg("chunks").alias("avg_chunks"), F.avg("avg_size").alias("avg_length"), F.avg(F.when(F.col("std_size") > 0, F.col("std_size"))).alias("avg_std")))


@query(
    "o5_steadiest_strategy",
    f"""WITH RECURSIVE {_UNION}, s AS (SELECT doc_id, strategy, {_STATS} FROM allc GROUP BY ALL),
best AS (SELECT doc_id, strategy, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN std_size > 0 THEN round(std_size, 6) ELSE 1e18 END, strategy) AS k FROM s) SELECT doc_id, strategy FROM best WHERE k = 1""",
    documents="documents",
)
def steadiest_strategy(documents: DataFrame) -> DataFrame:
    per = strategies(documents).groupBy("doc_id", "strategy").agg(*size_stats())
    order = F.struct(F.when(F.col("std_size") > 0, F.round("std_size", 6)).otherwise(F.lit(1e18)), F.col("strategy"))
    return per.groupBy("doc_id").agg(F.min_by("strategy", order).alias("strategy"))


@query(
    "a2_corpus_statistics",
    f"""WITH RECURSIVE {_UNION} SELECT coalesce(lang, '*') AS lang, coalesce(strategy, '*') AS strategy, count(*) AS chunks, sum(size)::BIGINT AS chars, min(size) AS min_size, max(size) AS max_size, count(DISTINCT doc_id) AS docs
FROM allc JOIN documents d USING (doc_id) GROUP BY GROUPING SETS ((lang), (strategy), (lang, strategy), ())""",
    documents="documents",
)
def corpus_statistics(documents: DataFrame) -> DataFrame:
    return strategies(documents, "lang").cube("lang", "strategy").agg(F.count("*").alias("chunks"), F.sum("size").alias("chars"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.countDistinct("doc_id").alias("docs")).select(
        F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("strategy", F.lit("*")).alias("strategy"), "chunks", "chars", "min_size", "max_size", "docs"
    )


@query("w8_chunk_index", f"WITH {PARAS} SELECT doc_id, pos::INT AS chunk_index, (count(*) OVER (PARTITION BY doc_id))::BIGINT AS chunk_count, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM paras", documents="documents")
def chunk_index(documents: DataFrame) -> DataFrame:
    rows = splitting.explode_units(documents, tx.paragraphs(F.col("text"), "\n"), "chunk_index", "s")
    doc = Window.partitionBy("doc_id")
    before = doc.orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("doc_id", "chunk_index", F.count("*").over(doc).alias("chunk_count"), F.coalesce(F.sum(F.length("s")).over(before), F.lit(0)).cast("long").alias("chars_before"))
