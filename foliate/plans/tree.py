"""Volumes as trees: queries and their SQL, over the volumes built from ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import hierarchy as h
from foliate.operators import tree
from foliate.operators.graphs import cut
from foliate.plans.registry import query
from foliate.plans.volumes import _HEADERS, T, any_sql, pages, volumes

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_CONTAINER = "CASE " + " ".join(f"WHEN {any_sql('name', u)} THEN '{c}'" for c, u in h.CONTAINERS.items()) + " END"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i)^(?:{t})') THEN '{k}'" for k, t in h.STANDARD.items()) + " END"
_TITLED = "array_to_string(list_transform(string_split({0}, '_'), lambda x: upper(x[1]) || x[2:]), '_')"
_ONE, _TWO, _THREE = "format('L1_{:03d}', k)", "format('L2_{:03d}_{:02d}', k, i)", "format('L3_{:03d}_{:02d}_{:02d}', k, i, s)"
_SECTION = "format('L2_{:03d}_{:02d}', k, s)"
NODES = f"""{_HEADERS}, th AS (SELECT mj.*, {_CONTAINER} AS container, {_STRIP.format('substring(text, start + 1, stop - start)')} AS txt FROM mj JOIN volumes USING (doc_id)),
tg AS (SELECT *, CASE WHEN container IS NULL THEN start ELSE min(start) OVER (PARTITION BY doc_id, container) END AS first,
 CASE WHEN container IS NULL THEN length(txt) > {tree.LEAST_TERRITORY} AND NOT {any_sql('upper(name)', tree.NO_COLONY)} ELSE length(txt) > {tree.LEAST_PART} END AS stays FROM th),
tn AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY first) AS k, row_number() OVER (PARTITION BY doc_id, first ORDER BY start) AS i FROM tg WHERE stays),
tl AS (SELECT doc_id, k, i, j, {_STRIP.format('l[j]')} AS line, l[j] AS raw FROM (SELECT *, unnest(range(1, len(l) + 1)) AS j FROM (SELECT doc_id, k, i, string_split(txt, chr(10)) AS l FROM tn))),
tk AS (SELECT *, {_KIND} AS kind FROM tl),
tc AS (SELECT *, count(kind) OVER (PARTITION BY doc_id, k, i ORDER BY j ROWS UNBOUNDED PRECEDING) AS c FROM tk),
ts AS MATERIALIZED (SELECT doc_id, k, i, row_number() OVER (PARTITION BY doc_id, k, i ORDER BY c) AS s, coalesce(max(kind), 'introduction') AS kind, {_STRIP.format('string_agg(raw, chr(10) ORDER BY j)')} AS txt FROM tc GROUP BY doc_id, k, i, c),
ty AS (SELECT doc_id, k, i, list(kind ORDER BY s) AS kinds FROM ts GROUP BY doc_id, k, i),
td AS (SELECT doc_id, k, max(container) AS container, min(first) AS first, max(stop) AS stop, list(name ORDER BY start) AS names FROM tn WHERE container IS NOT NULL GROUP BY doc_id, k),
nodes AS (SELECT doc_id, CASE WHEN container IS NULL THEN {_ONE} ELSE {_TWO} END AS chunk_id, CASE WHEN container IS NOT NULL THEN {_ONE} END AS parent_id, CASE WHEN container IS NULL THEN 1 ELSE 2 END AS level,
 CASE WHEN container IS NULL THEN 'colony' ELSE 'province' END AS type, name, container AS parent_territory, NULL AS section_type, start AS start_pos, stop AS end_pos, txt, kinds, NULL::VARCHAR[] AS names FROM tn JOIN ty USING (doc_id, k, i)
UNION ALL SELECT ts.doc_id, CASE WHEN container IS NULL THEN {_SECTION} ELSE {_THREE} END, CASE WHEN container IS NULL THEN {_ONE} ELSE {_TWO} END, CASE WHEN container IS NULL THEN 2 ELSE 3 END, 'section',
 name || ' - ' || {_TITLED.format('kind')}, coalesce(container, name), kind, NULL, NULL, ts.txt, NULL, NULL FROM ts JOIN tn USING (doc_id, k, i)
UNION ALL SELECT doc_id, {_ONE}, NULL, 1, 'dominion', container, NULL, NULL, first, stop, {_STRIP.format('substring(text, first + 1, stop - first)')}, NULL, names FROM td JOIN volumes USING (doc_id))"""
_FLAT = "replace({0}, chr(10), ' ')"


@query(
    "c11_tree",
    f"""WITH {NODES} SELECT doc_id, chunk_id, parent_id, level::INT AS level, type, name, parent_territory, section_type, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos, length(txt)::INT AS size, sha256(txt) AS text_sha256,
 {_FLAT.format('substring(txt, 1, 200)')} AS preview, {_FLAT.format('right(txt, 200)')} AS ending, len(kinds)::INT AS section_count, len(names)::INT AS province_count, list_contains(kinds, 'geography') AS has_geography,
 array_to_string(kinds, ',') AS section_types, array_to_string(names, ',') AS province_names, (start_pos // 2000 + 1)::INT AS first_page, CASE WHEN end_pos IS NOT NULL THEN (greatest(end_pos - 1, 0) // 2000 + 1)::INT END AS last_page FROM nodes""",
    **T,
)
def chunk_tree(documents: DataFrame) -> DataFrame:
    """Nodes of all levels with the metadata and pages of each."""
    v = volumes(documents)
    rows = h.paged(tree.described(tree.tree(v)), pages(v), "chunk_id").withColumn("text_sha256", F.sha2("text", 256))
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.array_join(c, ",")) for c in ("section_types", "province_names")}).drop("text")


@query(
    "c11_tree_counts",
    f"""WITH {NODES} SELECT doc_id, {', '.join(f'count_if(level = {i}) AS level{i}' for i in (1, 2, 3))}, count_if(type = 'dominion') AS dominions, count_if(type = 'colony') AS colonies, count_if(type = 'province') AS provinces,
 count_if(type = 'section') AS sections FROM nodes GROUP BY doc_id""",
    **T,
)
def tree_counts(documents: DataFrame) -> DataFrame:
    return tree.counts(tree.tree(volumes(documents)))


@query(
    "c11_tree_shape",
    f"""WITH {NODES}, a AS (SELECT doc_id, count_if(level = 1) AS territories, count(DISTINCT parent_id) FILTER (level = 2) AS parents, max(level) AS depth, sum(length(txt)) FILTER (level = 3) AS chars FROM nodes GROUP BY doc_id)
SELECT doc_id, territories, parents, depth::INT AS depth, coalesce(chars, 0)::BIGINT AS third_level_chars FROM a""",
    **T,
)
def tree_shape(documents: DataFrame) -> DataFrame:
    """What the nested form holds: territories, those with children, depth, characters at the third level."""
    nodes = tree.described(tree.tree(volumes(documents)))
    # each level reads the nodes: they are made once, without their texts
    rows = tree.nested(cut(nodes.select("doc_id", "chunk_id", "parent_id", "level", "type", "size")))
    t = F.col("territories")
    second = F.flatten(F.transform(t, lambda x: x["children"]))
    third = F.flatten(F.transform(second, lambda x: x["children"]))
    depth = F.when(F.size(third) > 0, 3).when(F.size(second) > 0, 2).otherwise(1)
    chars = F.aggregate(third, F.lit(0).cast("long"), lambda s, x: s + x["size"])
    return rows.select("doc_id", F.size(t).cast("long").alias("territories"), F.size(F.filter(t, lambda x: F.size(x["children"]) > 0)).cast("long").alias("parents"), depth.alias("depth"), chars.alias("third_level_chars"))
