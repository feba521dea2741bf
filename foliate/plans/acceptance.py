"""Acceptance of the extraction from volumes, and the parts between transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import acceptance as ac
from foliate.operators import hierarchy as h
from foliate.plans.registry import query
from foliate.plans.volumes import _GAZETTEER, _HEADERS, _UNITS, BLOCKS, any_sql, in_sql, volumes

T = {"documents": "documents"}
_TYPE = f"CASE WHEN {in_sql('name', list(h.CONTAINERS))} OR starts_with(name, 'DOMINION OF') THEN 'dominion' WHEN {any_sql('name', ac.OFFICES)} THEN 'administrative' WHEN {any_sql('name', tuple(_UNITS))} THEN 'province' ELSE 'crown_colony' END"
_PLAIN = "regexp_replace(upper(name), '[^\\p{L}\\p{N}]', '', 'g')"
_LEVELS = f"""{_HEADERS}, gz(ord, container, unit) AS (VALUES {_GAZETTEER}),
geo AS MATERIALIZED (SELECT m.doc_id, m.start, m.stop, m.name, bool_or(contains(lower(v.line), '{h.OPENING}')) AS geography FROM mj m JOIN vp v ON v.doc_id = m.doc_id AND v.start >= m.start AND v.start < m.stop GROUP BY ALL),
o AS MATERIALIZED (SELECT doc_id, start, stop, name, geography, min_by(container, ord) AS container FROM geo LEFT JOIN gz ON contains(name, unit) GROUP BY ALL),
l1 AS MATERIALIZED (SELECT doc_id, coalesce(max(container), max(name)) AS name, CASE WHEN max(container) IS NULL THEN 'colony' ELSE 'dominion' END AS kind, sum(stop - start)::BIGINT AS size, bool_or(geography) AS geography FROM o GROUP BY doc_id, coalesce(container, name || '@' || start))"""
_KNOWN = "(" + " + ".join(f"max(contains(name, '{w}')::INT)" for w in ac.EXPECTED) + ")"
_MEASURES = f"""{_LEVELS}, a AS (SELECT doc_id, count(*) AS territories, count_if(kind = 'dominion') AS dominions, count_if(kind = 'colony') AS colonies,
 count_if({any_sql('name', ac.PROVINCES)})::DOUBLE AS ungrouped_provinces, count_if({any_sql('name', ac.OFFICES)})::DOUBLE AS offices_as_territories, count_if(kind = 'colony' AND {any_sql('name', ac.BROAD_OFFICES)}) AS broad_offices,
 (count(*) - count(DISTINCT {_PLAIN}))::DOUBLE AS same_names, ({' + '.join(f"(count_if(contains(name, '{w}')) > 1)::INT" for w in ac.OFTEN_TWICE)})::DOUBLE AS known_twice, min(size)::DOUBLE AS least_size,
 100.0 * count_if(geography) / count(*) AS geography_percent, {_KNOWN} AS expected_found, 100.0 * {_KNOWN} / {len(ac.EXPECTED)} AS expected_percent,
 count_if(kind = 'colony' AND (contains(name, repeat(chr(34), 3)) OR contains(right(name, 3), 'L'))) AS damaged_names, count_if(size < 5000) AS small FROM l1 GROUP BY doc_id),
u AS (SELECT o.doc_id, count_if(contains(o.container, 'CANADA'))::DOUBLE AS grouped_provinces, count_if(l1.name IS NULL)::DOUBLE AS orphans, count(DISTINCT o.container) AS parents
 FROM o LEFT JOIN l1 ON l1.doc_id = o.doc_id AND l1.name = o.container AND l1.kind = 'dominion' WHERE o.container IS NOT NULL GROUP BY o.doc_id),
y AS (SELECT doc_id, 100.0 * count_if({_TYPE} = expected) / count(*) AS types_percent FROM mj JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in ac.TYPES.items())}) t(tested, expected) ON tested = name GROUP BY doc_id),
m AS (SELECT a.*, coalesce(grouped_provinces, 0) AS grouped_provinces, coalesce(orphans, 0) AS orphans, types_percent, (dominions - coalesce(parents, 0))::DOUBLE AS empty_dominions FROM a LEFT JOIN u USING (doc_id) LEFT JOIN y USING (doc_id))"""
_GATES = " UNION ALL ".join(f"SELECT doc_id, '{g}' AS gate, round({g}, 4) AS value, {v}::DOUBLE AS bound, round({g}, 4) {'>=' if reach else '<='} {v} AS passed FROM m" for g, (v, reach) in ac.GATES.items())


@query("x18_header_types", f"WITH {_HEADERS} SELECT doc_id, start, name, {_TYPE} AS type FROM mj", **T)
def header_types(documents: DataFrame) -> DataFrame:
    return h.header_segments(volumes(documents)).select("doc_id", "start", "name", ac.header_type(F.col("name")).alias("type"))


@query("a27_gates", f"WITH {_MEASURES} {_GATES}", **T)
def gates(documents: DataFrame) -> DataFrame:
    """Every gate of every volume with its value, limit and verdict."""
    return ac.gates(ac.measures(volumes(documents)))


@query("a27_expected_names", f"WITH {_LEVELS}, f AS (SELECT {_PLAIN} AS name, count(DISTINCT doc_id) AS volumes FROM l1 GROUP BY {_PLAIN}), w AS (SELECT {_PLAIN} AS name FROM (VALUES {', '.join(f'({w!r})' for w in ac.EXPECTED)}) t(name)) SELECT coalesce(f.name, w.name) AS name, CASE WHEN w.name IS NULL THEN 'more' WHEN f.name IS NULL THEN 'missing' ELSE 'found' END AS verdict, coalesce(volumes, 0) AS volumes FROM f FULL JOIN w ON f.name = w.name", **T)
def expected_names(documents: DataFrame) -> DataFrame:
    return ac.expectations(volumes(documents))


@query("a26_validation", f"WITH {_MEASURES} SELECT doc_id, territories, dominions, colonies, expected_found::INT AS expected_found, broad_offices, damaged_names, small, known_twice FROM m", **T)
def validation(documents: DataFrame) -> DataFrame:
    return ac.measures(volumes(documents)).select("doc_id", "territories", "dominions", "colonies", "expected_found", "broad_offices", "damaged_names", "small", "known_twice")


@query("a26b_mended", f"WITH {_MEASURES} SELECT *, provinces AND duplicates AND offices AND names AS overall FROM (SELECT doc_id, grouped_provinces > 0 AS provinces, known_twice <= 2 AS duplicates, broad_offices <= 1 AS offices, expected_found >= 6 AS names FROM m)", **T)
def mended(documents: DataFrame) -> DataFrame:
    return ac.mended(ac.measures(volumes(documents)))


@query(
    "t17_parts",
    f"""WITH {BLOCKS}, e AS (SELECT doc_id, start FROM vp WHERE regexp_matches(line, 'Consuls\\.$')), b AS (SELECT doc_id, start FROM vp WHERE hd),
k AS (SELECT e.doc_id, e.start AS first, min(b.start) AS after FROM e JOIN b ON b.doc_id = e.doc_id AND b.start > e.start AND b.start - e.start < 2000 GROUP BY ALL),
n AS (SELECT doc_id, length(text) AS n FROM volumes WHERE doc_id IN (SELECT doc_id FROM k)),
c AS (SELECT doc_id, first, after, false AS is_end FROM k UNION ALL SELECT doc_id, n, n, true FROM n),
g AS (SELECT *, coalesce(max(after) OVER (PARTITION BY doc_id ORDER BY first, is_end, after ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1)::INT AS section_id, CASE WHEN is_end THEN 'tail' WHEN start = 0 THEN 'head' ELSE 'between' END AS kind, start::BIGINT AS start, first::BIGINT AS stop FROM g WHERE first > start""",
    **T,
)
def parts(documents: DataFrame) -> DataFrame:
    """The parts of a volume before, between and after its transitions."""
    rows = volumes(documents)
    return ac.gaps(rows, h.boundaries(rows, r"Consuls\.$", h.HEADING, 2000).select("doc_id", F.col("end_pos").alias("first"), F.col("start_pos").alias("after")))
