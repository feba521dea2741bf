"""Lists of an office built from ``documents``: queries and SQL. A volume is a range of ids; every document stands in it under a heading made from its id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import hierarchy, rosters
from foliate.plans.analysis import WORDED
from foliate.plans.chunking import UPPER, rounded
from foliate.plans.registry import query
from foliate.plans.volumes import _FILLED, _PAGES_SQL, _TOC, RANGE, in_sql, pages

_HEADS = ["INDIA OFFICE", "**CHAPTER I.**", "BENGAL", "ROADS AND CANALS:", "CONTENTS", "CHAPTER II", "BOMBAY PRESIDENCY", "LIST (OF) 1889", "MILITARY", "BURMA DIVISION", "NOTES"]
_HEAD = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(_HEADS)) + " END"
VOLUMES = f"""volumes AS (SELECT doc_id // {RANGE} AS doc_id, string_agg(({_HEAD}) || chr(10) || coalesce(text, ''), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY doc_id // {RANGE})"""
_SQL_HEADING = rosters.HEADING.replace("'", "''")
_WORDED = lambda c: WORDED.replace("text", c)
_ADVERTS = " + ".join(f"regexp_matches(upper({c}), '\\b{w}\\b')::INT" for c in ("heading", "m") for w in rosters.ADVERTS)
_REGION = "(" + in_sql("heading", list(rosters.REGIONS)) + " OR " + " OR ".join(f"starts_with(heading, '{r} ')" for r in rosters.REGIONS) + ")"
_OVER = "OVER (PARTITION BY doc_id{} ORDER BY block_no ROWS UNBOUNDED PRECEDING)"
JUDGED = f"""{VOLUMES}, rl AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line, i < len(l) AS more FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM volumes))),
rp AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, more AND regexp_matches(line, '{_SQL_HEADING}') AS hd FROM rl),
rb AS (SELECT *, sum(hd::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block_no FROM rp),
bl AS (SELECT doc_id, block_no, max(line) FILTER (hd) AS raw, max(start + length(line)) FILTER (hd) AS start_pos, max(start + length(line) + more::INT) AS end_pos,
 regexp_replace(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT hd), '^\\s+|\\s+$', '', 'g') AS body FROM rb WHERE block_no > 0 GROUP BY doc_id, block_no),
bh AS (SELECT *, upper(regexp_replace(regexp_replace(regexp_replace(raw, '^[\\s*]+|[\\s*]+$', '', 'g'), '\\s+', ' ', 'g'), '[.,;:-]+$', '')) AS heading, {_WORDED('body')} AS m FROM bl WHERE body <> ''),
bs AS (SELECT *, {_FILLED.format('body')} AS s, {_FILLED.format('m')} AS sm, len(regexp_extract_all(m, '{hierarchy.PERSON.replace("'", "''")}')) AS names, {_ADVERTS} AS adverts,
 contains(body, '£') OR regexp_matches(m, '\\bRs?\\.\\s*\\d') AS money FROM bh WHERE heading <> '' AND NOT {in_sql('heading', list(rosters.SKIP))}),
bk AS (SELECT *, len(list_filter(sm, lambda x: {_TOC})) AS toc, len(list_filter(s, lambda x: starts_with(x, '|'))) > 0 AS tab, len(list_filter(s, lambda x: {UPPER.format('x')})) AS up,
 len(list_filter(s, lambda x: regexp_matches(x, '[a-z]{{3,}}'))) / greatest(len(s), 1) AS density FROM bs),
bc AS (SELECT *, CASE WHEN toc >= greatest(3, floor(len(s) * 0.6)) THEN 'toc' WHEN (adverts >= 3 AND density < 0.5) OR (adverts >= 1 AND money AND density < 0.3 AND names = 0) THEN 'advertisement'
 WHEN tab OR names >= 2 THEN 'roster' WHEN length(body) < 120 AND up / greatest(len(s), 1) > 0.5 THEN 'noise' ELSE 'narrative' END AS kind,
 {in_sql('heading', list(rosters.TOP))} AS tp, NOT {in_sql('heading', list(rosters.TOP))} AND starts_with(heading, '{rosters.CHAPTER}') AS ch FROM bk),
b1 AS (SELECT *, sum(tp::INT) {_OVER.format('')} AS tn, NOT tp AND NOT ch AND {_REGION} AS rg FROM bc), b2 AS (SELECT *, sum(ch::INT) {_OVER.format(', tn')} AS cn FROM b1),
b3 AS (SELECT *, last_value(CASE WHEN tp THEN heading END IGNORE NULLS) {_OVER.format(', tn')} AS t, last_value(CASE WHEN ch THEN heading END IGNORE NULLS) {_OVER.format(', tn')} AS c,
 last_value(CASE WHEN rg THEN heading END IGNORE NULLS) {_OVER.format(', tn, cn')} AS r FROM b2),
b4 AS (SELECT *, list_filter([t, CASE WHEN c <> heading THEN c END, CASE WHEN r <> heading THEN r END], lambda x: x IS NOT NULL) AS above FROM b3),
judged AS (SELECT *, CASE WHEN len(above) > 0 AND above[-1] = heading THEN above ELSE list_append(above, heading) END AS path,
 CASE WHEN kind = 'narrative' AND length(body) < {rosters.LEAST} AND names = 0 AND NOT tab AND NOT regexp_matches(body, '\\p{{Nd}}') AND NOT contains(body, '£') THEN 'skipped_short' ELSE kind END AS outcome FROM b4)"""


def volumes(documents: DataFrame) -> DataFrame:
    """``doc_id`` (the number of the id range) and ``text``; documents without doc_id share a volume with those of the same text."""
    head = F.expr(f"coalesce({_HEAD}, '{_HEADS[0]}')")
    text = F.coalesce("text", F.lit(""))
    volume = F.coalesce(F.floor(F.col("doc_id") / RANGE), -F.pmod(F.xxhash64(text), F.lit(1 << 61)) - F.lit(1 << 62))
    rows = documents.select(volume.alias("volume"), F.struct(F.col("doc_id").alias("id"), F.concat(head, F.lit("\n"), text).alias("part")).alias("p"))
    return rows.groupBy(F.col("volume").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "\n").alias("text"))


@query(
    "c10_roster_chunks",
    f"""WITH {JUDGED} SELECT doc_id, block_no::INT AS block_no, heading AS title, array_to_string(path, ' / ') AS section_path, kind AS chunk_type, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos,
 length(body)::INT AS chars, names::INT AS name_hits, tab AS has_table, round(density, 6) AS density, sha256(body) AS text_sha256, {_PAGES_SQL} FROM judged WHERE outcome IN ('roster', 'narrative')""",
    documents="documents",
)
def roster_chunks(documents: DataFrame) -> DataFrame:
    v = volumes(documents)
    rows = hierarchy.paged(rosters.chunks(v), pages(v), "block_no").withColumns({"section_path": F.array_join("section_path", " / "), "text_sha256": F.sha2("text", 256)})
    return rounded(rows.drop("text"))


@query("a5_roster_statistics", f"WITH {JUDGED} SELECT doc_id, outcome AS chunk_type, count(*) AS n FROM judged GROUP BY doc_id, outcome", documents="documents")
def roster_statistics(documents: DataFrame) -> DataFrame:
    return rosters.statistics(volumes(documents))
