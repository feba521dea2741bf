"""Headings and territories found by matches in whole volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import matching
from foliate.plans.registry import query
from foliate.plans.volumes import VOLUMES, volumes

T = {"documents": "documents"}
_S = "\\t-\\r "
_NAMES = ", ".join(f"'{n}'" for n in matching.TITLE_NAMES)
#: Some headings in title case and in bold, a name that no list has, and separators of pages.
_SWAPS = {"EXPORTS.": "Gold Coast.", "NOVA SCOTIA.": "**Sierra Leone.**", "ONTARIO.": "Ontario.", "EXECUTIVE COUNCIL.": "**EXECUTIVE COUNCIL.**", "Foreign Consuls.": "---"}


def _swapped_sql() -> str:
    out = "text"
    for a, b in _SWAPS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


_TITLED = f"{VOLUMES}, titled AS MATERIALIZED (SELECT doc_id, {_swapped_sql()} AS text FROM volumes)"


def titled(documents: DataFrame) -> DataFrame:
    text = F.col("text")
    for a, b in _SWAPS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return volumes(documents).withColumn("text", text)


def _found_sql(pattern: str, source: str = "titled") -> str:
    """Matches of a pattern without lookahead: ``doc_id, no, start, whole``, by the lengths of the parts between them."""
    return f"""(SELECT doc_id, i AS no, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS start, found[i] AS whole
 FROM (SELECT doc_id, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found FROM {source})))"""


def _heading_sql(kind: str, pattern: str) -> str:
    # the line end is consumed here, where the operator looks ahead; a second one is seen in the text
    name = f"regexp_replace(regexp_replace(whole, '^(\\*\\*)?', ''), '\\.(\\*\\*)?\\n$', '')"
    bold = "CASE WHEN starts_with(whole, '**') THEN 2 ELSE 0 END"
    return f"SELECT doc_id, start + {bold} AS start, regexp_replace({name}, '^[{_S}]+|[{_S}]+$', '', 'g') AS heading, start + length(whole) AS after, '{kind}' AS kind FROM {_found_sql(pattern)}"


@query(
    "u1_heading_positions",
    f"""WITH {_TITLED}, c AS ({_heading_sql('capitals', f"(?m)^(?:[*][*])?[A-Z][A-Z{_S}\\-''&,]+[.](?:[*][*])?\\n")}), t AS ({_heading_sql('title', f"(?m)^(?:[*][*])?[A-Z][a-z]+(?:[{_S}]+[A-Z][a-z]+)*[.](?:[*][*])?\\n")}),
a AS (SELECT * FROM c UNION ALL SELECT * FROM t WHERE upper(heading) IN ({_NAMES}) AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = t.doc_id AND c.start = t.start))
SELECT doc_id, heading, kind, start::BIGINT AS start, (after + CASE WHEN substring(text, after::INT + 1, 1) = chr(10) THEN 1 ELSE 0 END)::BIGINT AS content_start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text))::BIGINT AS stop FROM a JOIN titled USING (doc_id)""",
    **T,
)
def heading_positions(documents: DataFrame) -> DataFrame:
    """Headings in capitals and known ones in title case, with the spans of their contents."""
    return matching.headings(titled(documents)).withColumnRenamed("end", "stop")


_HEAD = f"[A-Z{_S},]+[.][{_S}]+"
_REST = f"[{_S}]{_HEAD}"


@query(
    "t12_named_parts",
    f"""WITH {_TITLED}, z AS (SELECT doc_id, replace(text, chr(10) || chr(10) || '---' || chr(10) || chr(10), chr(10) || chr(10)) AS text FROM titled),
h AS (SELECT doc_id, text, regexp_extract(text, '{_HEAD}') AS head, length(regexp_split_to_array(text, '{_HEAD}')[1]) AS h0 FROM z WHERE regexp_matches(text, '{_HEAD}')),
rest AS MATERIALIZED (SELECT doc_id, h0 + length(head) AS base, substring(text, h0::INT + length(head)::INT + 1) AS text FROM h),
n AS (SELECT doc_id, 0 AS no, h0 AS start, h0 + length(head) AS stop, head AS whole FROM h UNION ALL SELECT doc_id, no, base + start, base + start + length(whole), whole FROM {_found_sql(_REST, 'rest')} JOIN rest USING (doc_id)),
p AS (SELECT doc_id, start, regexp_replace(regexp_replace(whole, '[.][{_S}]+$', ''), '^[{_S}]+|[{_S}]+$', '', 'g') AS name, stop, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY no), length(text)) AS upto, text FROM n JOIN z USING (doc_id)),
l AS (SELECT doc_id, name, max(start) AS start, count(*) AS seen, max_by(substring(text, stop::INT + 1, upto::INT - stop::INT), start) AS body FROM p GROUP BY doc_id, name)
SELECT doc_id, name, start::BIGINT AS start, seen, sha256(name || '.' || chr(10) || chr(10) || regexp_replace(body, '^[{_S}]+|[{_S}]+$', '', 'g')) AS text_sha256 FROM l""",
    **T,
)
def named_parts(documents: DataFrame) -> DataFrame:
    """Each name in capitals with the text to the next one; the last of a name stays."""
    return matching.named_parts(titled(documents)).select("doc_id", "name", "start", "seen", F.sha2("text", 256).alias("text_sha256"))


@query("p28_section", f"WITH {VOLUMES} SELECT doc_id, length(substring(text, 1001, 500000))::INT AS size, sha256(substring(text, 1001, 500000)) AS text_sha256 FROM volumes", **T)
def section(documents: DataFrame) -> DataFrame:
    """A part of each volume between two fixed positions."""
    return matching.section(volumes(documents), 1000, 501_000).select("doc_id", F.length("text").alias("size"), F.sha2("text", 256).alias("text_sha256"))
