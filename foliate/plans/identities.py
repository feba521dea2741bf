"""Lists of services built from ``documents``: entries of persons, and persons across volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import identities as ids
from foliate.plans.registry import query

T = {"documents": "documents"}
RANGE, FIRST_YEAR, YEARS = 16, 1886, 14

_PARTS = f"""p AS (SELECT coalesce(doc_id // {RANGE}, -1) AS doc_id, doc_id AS id, CASE doc_id % {RANGE} WHEN 0 THEN 'DESCRIPTION OF SERVICES.' || chr(10) WHEN 8 THEN 'RECORD OF SERVICES' || chr(10) ELSE '' END
  || upper(coalesce(w[1], 'ANON')) || ', ' || upper(coalesce(w[2], 'X')) || '.' || chr(10) || coalesce(text, '') AS part FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]{{4,}}') AS w FROM documents)),
v AS (SELECT doc_id, string_agg(part, chr(10) ORDER BY id, part) AS text FROM p GROUP BY doc_id)"""
_ENTRIES = f"""{_PARTS}, l AS (SELECT doc_id, i, x[i] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM v))),
m AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, regexp_matches(line, '^[A-Z][A-Z''\\- ]+,') AS begins,
 CASE WHEN regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\.$', '') IN ('DESCRIPTION OF SERVICES', 'RECORD OF SERVICES') THEN regexp_replace(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '\\.$', '') END AS title FROM l),
n AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS section_title, sum((begins OR title IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS part, regexp_extract(line, '^([A-Z][A-Z''\\- ]+,( [A-Z][A-Z''\\-]*\\b\\.?)*)', 1) AS h FROM m),
g AS (SELECT doc_id, part, max(regexp_replace(h, '[ .]+$', '')) FILTER (begins) AS name_heading, max(section_title) AS section_title, min(start) AS start, max(start + length(line)) AS stop,
 string_agg(CASE WHEN begins THEN substring(line, length(h) + 1) ELSE line END, chr(10) ORDER BY i) AS body FROM n WHERE section_title IS NOT NULL AND part > 0 GROUP BY doc_id, part),
entries AS MATERIALIZED (SELECT doc_id AS volume, section_title, row_number() OVER (PARTITION BY doc_id ORDER BY start) AS entry_no, start, stop, name_heading,
 regexp_replace(trim(string_split(name_heading, ',')[1]), '[ .]+', ' ', 'g') AS surname, regexp_replace(trim(substring(name_heading, instr(name_heading, ',') + 1)), '[ .]+', ' ', 'g') AS given,
 regexp_replace(body, '^\\s+|\\s+$', '', 'g') AS entry_text FROM g WHERE name_heading IS NOT NULL)"""
_LETTERS = "regexp_replace(surname, '[^A-Z]', '', 'g')"
_NAMES = f"""{_ENTRIES}, names AS MATERIALIZED (SELECT *, {_LETTERS}[1] || substring(regexp_replace(substring({_LETTERS}, 2), '[AEIOUHWY]', '', 'g'), 1, 3) AS code FROM (SELECT surname, given, count(*) AS n FROM entries GROUP BY ALL))"""
_EDITS = "1 - (levenshtein(a.surname, b.surname) + levenshtein(a.given, b.given)) / (greatest(length(a.surname), length(b.surname)) + greatest(length(a.given), length(b.given)))"
_LIKE = f"CASE WHEN a.surname = b.surname AND least(length(a.given), length(b.given)) = 1 AND a.given[1] = b.given[1] THEN greatest(round({_EDITS}, 4), 0.8::DOUBLE) ELSE round({_EDITS}, 4) END"


def _near_sql(order: str) -> str:
    return f"SELECT a.surname AS s1, a.given AS g1, b.surname AS s2, b.given AS g2, {_LIKE} AS likeness FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM names) a JOIN (SELECT *, row_number() OVER (ORDER BY {order}) AS i FROM names) b ON b.i BETWEEN a.i + 1 AND a.i + {ids.WIDTH} AND a.code = b.code"


_LINKS = f"""{_NAMES}, pairs AS ({_near_sql('code, surname, given')} UNION ALL {_near_sql('code, given, surname')}),
links AS MATERIALIZED (SELECT DISTINCT least((s1, g1), (s2, g2)) AS a, greatest((s1, g1), (s2, g2)) AS b, likeness FROM pairs WHERE likeness >= {ids.LEAST})"""


def volumes(documents: DataFrame) -> DataFrame:
    """``doc_id`` (a range of ids), ``text``: every document is an entry with its whole text, named by its first two words of four letters or more."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]{4,})"), 1)
    title = F.expr(f"CASE pmod(doc_id, {RANGE}) WHEN 0 THEN 'DESCRIPTION OF SERVICES.\\n' WHEN 8 THEN 'RECORD OF SERVICES\\n' ELSE '' END")
    title = F.coalesce(title, F.lit(""))
    name = F.concat(F.upper(F.coalesce(F.get("w", F.lit(0)), F.lit("ANON"))), F.lit(", "), F.upper(F.coalesce(F.get("w", F.lit(1)), F.lit("X"))), F.lit(".\n"))
    rows = documents.select("doc_id", "text", words.alias("w"))
    part = F.struct(F.col("doc_id").alias("id"), F.concat(title, name, F.coalesce("text", F.lit(""))).alias("part"))
    volume = F.coalesce(F.floor(F.col("doc_id") / RANGE), F.lit(-1)).alias("doc_id")
    return rows.select(volume, part.alias("p")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "\n").alias("text"))


def year():
    return F.pmod("volume", F.lit(YEARS)) + FIRST_YEAR


@query("t18_service_entries", f"WITH {_ENTRIES} SELECT volume, section_title, 'VOLUME ' || volume || ' / ' || section_title AS section_path, entry_no::INT AS entry_no, start::BIGINT AS start, stop::BIGINT AS stop, name_heading, sha256(entry_text) AS entry_sha256 FROM entries", **T)
def service_entries(documents: DataFrame) -> DataFrame:
    """Entries of persons with their provenance."""
    out = ids.entries(volumes(documents))
    return out.select("volume", "section_title", F.array_join("section_path", " / ").alias("section_path"), "entry_no", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "name_heading", F.sha2("entry_text", 256).alias("entry_sha256"))


@query("t18_name_blocks", f"WITH {_NAMES} SELECT code, count(*) AS names, sum(n)::BIGINT AS entries FROM names GROUP BY code", **T)
def name_blocks(documents: DataFrame) -> DataFrame:
    return ids.blocks(ids.entries(volumes(documents)))


@query("t18_name_links", f"WITH {_LINKS} SELECT a[1] AS surname, a[2] AS given, b[1] AS other_surname, b[2] AS other_given, likeness FROM links", **T)
def name_links(documents: DataFrame) -> DataFrame:
    made = ids.links(ids.entries(volumes(documents)))
    return made.select("a.surname", "a.given", F.col("b.surname").alias("other_surname"), F.col("b.given").alias("other_given"), "likeness")


@query(
    "t18_persons",
    f"""WITH RECURSIVE {_LINKS}, both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT (surname, given) AS name, (surname, given) AS other FROM names UNION SELECT r.name, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
root AS MATERIALIZED (SELECT name, min(other) AS person, count(*) AS variants FROM reach GROUP BY name),
least AS (SELECT person, min(likeness) AS confidence FROM links JOIN root ON root.name = links.a GROUP BY person),
e AS (SELECT *, ((volume % {YEARS}) + {YEARS}) % {YEARS} + {FIRST_YEAR} AS year FROM entries),
f AS (SELECT person, min((volume, entry_no)) AS first, min(year) AS first_year, max(year) AS last_year FROM e JOIN root ON root.name = (e.surname, e.given) GROUP BY person)
SELECT volume, entry_no::INT AS entry_no, name_heading, first[1] AS person_volume, first[2]::INT AS person_entry, variants, first_year, last_year, coalesce(confidence, 1.0::DOUBLE) AS confidence
FROM e JOIN root ON root.name = (e.surname, e.given) JOIN f USING (person) LEFT JOIN least USING (person)""",
    **T,
)
def persons(documents: DataFrame) -> DataFrame:
    """The person of each entry, its variants and years."""
    out = ids.persons(ids.entries(volumes(documents)), year())
    return out.select("volume", "entry_no", "name_heading", "person_volume", "person_entry", "variants", "first_year", "last_year", "confidence")
