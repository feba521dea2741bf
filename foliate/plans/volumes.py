"""Headed volumes built from ``documents``: a volume is a range of ``RANGE`` ids, and every document is in it with its own text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import hierarchy as h
from foliate.operators import profile
from foliate.operators.ordering import placed
from foliate.operators.profile import matches
from foliate.plans.analysis import WORDED
from foliate.plans.chunking import rounded
from foliate.plans.registry import query

_HEADS = {1: "DOMINION OF CANADA", 2: "ONTARIO", 3: "NOVA SCOTIA", 4: "EXECUTIVE COUNCIL", 5: "EXPORTS", 7: "TERRITORY A"}
_RICH = " The colony has a population, a government, a judge, revenue, trade, a railway, police, education and a church on an island. "
_HEAD = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _HEADS.items()) + " ELSE 'TERRITORY ' || translate(CAST(doc_id AS VARCHAR), '0123456789', 'ABCDEFGHIJ') END"
#: Documents (ids) of a volume.
RANGE = 16
# the words of a colony stand before the text of some, which is whole in all
_PART = f"({_HEAD}) || '.' || chr(10) || chr(10) || 'Situation and Area.' || chr(10) || CASE WHEN doc_id % 8 = 6 THEN repeat('{_RICH}', 12) ELSE '' END || coalesce(text, '') || chr(10) || chr(10) || 'Foreign Consuls.'"
VOLUMES = f"""volumes AS (SELECT doc_id // {RANGE} AS doc_id, string_agg(part, chr(10) || chr(10) ORDER BY doc_id) AS text FROM (SELECT doc_id, {_PART} AS part FROM documents) GROUP BY doc_id // {RANGE})"""
_UPTO = "ROWS UNBOUNDED PRECEDING"
BLOCKS = f"""{VOLUMES}, vl AS (SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM volumes))),
vp AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, regexp_matches(line, '^[A-Z][A-Z\\s\\-''&,]+\\.$') AS hd FROM vl),
vb AS (SELECT *, sum(hd::INT) OVER (PARTITION BY doc_id ORDER BY line_no {_UPTO}) AS block_no FROM vp),
blocks AS (SELECT doc_id, block_no, max(substring(line, 1, length(line) - 1)) FILTER (hd) AS heading, min(start) AS start_pos, max(start + length(line)) AS end_pos,
  regexp_replace(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT hd), '^\\s+|\\s+$', '', 'g') AS body FROM vb WHERE block_no > 0 GROUP BY doc_id, block_no)"""


def any_sql(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def in_sql(column: str, words: list[str]) -> str:
    return f"{column} IN ({', '.join(repr(w) for w in words)})"


_UNITS = [u for v in h.CONTAINERS.values() for u in v]
_LOW = "lower(substring(body, 1, 3500))"
_LETTERS = "len(regexp_extract_all(substring(body, 1, 2000), '{0}'))"
CLASSES = f"""{BLOCKS}, r AS (SELECT *, length(body) AS n, {_LETTERS.format(chr(92) + 'p{Lu}')} / greatest({_LETTERS.format(chr(92) + 'p{L}')}, 1) AS capitals FROM blocks),
s AS (SELECT *, ({' + '.join(any_sql(_LOW, w) + '::INT' for w in h.GROUPS.values())})::DOUBLE + CASE WHEN {any_sql(_LOW, ('colony', 'protectorate'))} THEN 0.5::DOUBLE ELSE 0 END + (n > 4000)::INT + (n > 10000)::INT - 4 * greatest(0::DOUBLE, capitals - 0.3::DOUBLE) AS score FROM r),
c AS (SELECT *, CASE WHEN {any_sql('heading', h.SKIP)} THEN 'skip' WHEN {in_sql('heading', list(h.CONTAINERS))} THEN 'dominion' WHEN {any_sql('heading', h.ADMIN)} THEN 'admin' WHEN {in_sql('heading', _UNITS)} THEN 'province'
  WHEN n < 400 AND score < 2 THEN 'skip' WHEN n < 1500 AND score < 4.25 THEN 'other' WHEN score >= 6 AND n >= 1500 THEN 'colony_high' WHEN score >= 4.25 AND n >= 1500 THEN 'colony_candidate' ELSE 'other' END AS kind FROM s)"""


def volumes(documents: DataFrame) -> DataFrame:
    """``doc_id`` (the number of the id range), ``text``: every document under a heading made from its doc_id.

    Repeated doc_ids share a volume. A document without doc_id is in a volume with those of the same text, below -2 ** 62.
    """
    letters = "translate(CAST(doc_id AS STRING), '0123456789', 'ABCDEFGHIJ')"
    heads = " ".join(f"WHEN {k} THEN '{v}'" for k, v in _HEADS.items())
    head = F.expr(f"coalesce(CASE pmod(doc_id, 8) {heads} ELSE 'TERRITORY ' || {letters} END, 'TERRITORY')")
    rich = F.when(F.expr("pmod(doc_id, 8) = 6"), _RICH * 12).otherwise("")
    text = F.coalesce("text", F.lit(""))
    part = F.concat(head, F.lit(".\n\nSituation and Area.\n"), rich, text, F.lit("\n\nForeign Consuls."))
    volume = F.coalesce(F.floor(F.col("doc_id") / RANGE), -F.pmod(F.xxhash64(text), F.lit(1 << 61)) - F.lit(1 << 62))
    rows = documents.select(volume.alias("volume"), F.struct(F.col("doc_id").alias("id"), part.alias("part")).alias("p"))
    return rows.groupBy(F.col("volume").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "\n\n").alias("text"))


def pages(volumes: DataFrame, size: int = 2000) -> DataFrame:
    """``doc_id, start, page``: pages of the same size."""
    n = F.floor(F.length("text") / size).cast("int")
    return volumes.select("doc_id", F.explode(F.sequence(F.lit(0), n)).alias("i")).select("doc_id", (F.col("i") * size).alias("start"), (F.col("i") + 1).alias("page"))


T = {"documents": "documents"}
_PAGES_SQL = "(start_pos // 2000 + 1)::INT AS first_page, (greatest(end_pos - 1, 0) // 2000 + 1)::INT AS last_page"
_WORDED_BODY = WORDED.replace("text", "body")


@query("t6_blocks", f"WITH {BLOCKS} SELECT doc_id, block_no::INT AS block_no, heading, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos, sha256(body) AS body_sha256 FROM blocks", **T)
def blocks(documents: DataFrame) -> DataFrame:
    return h.blocks(volumes(documents)).withColumn("body_sha256", F.sha2("body", 256)).drop("body")


@query("x7_block_classes", f"WITH {CLASSES} SELECT doc_id, block_no::INT AS block_no, n::INT AS n, round(capitals, 6) AS capitals, round(score, 6) AS score, kind FROM c", **T)
def block_classes(documents: DataFrame) -> DataFrame:
    return rounded(h.classified(h.blocks(volumes(documents))).select("doc_id", "block_no", "n", "capitals", "score", "kind"))


@query(
    "c9_territories",
    f"""WITH {CLASSES}, k AS (SELECT *, kind IN ('dominion', 'colony_high', 'colony_candidate') AS main FROM c WHERE kind <> 'skip'),
l AS (SELECT *, last_value(CASE WHEN main THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lm FROM k),
st AS (SELECT *, main OR (kind = 'province' AND coalesce(lm, '') <> 'dominion') AS starts FROM l),
t AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY block_no {_UPTO}) AS tn FROM st)
SELECT doc_id, tn::INT AS territory_no, block_no::INT AS block_no, heading, kind, CASE WHEN starts THEN 'territory' WHEN kind = 'province' THEN 'subunit' WHEN kind = 'admin' THEN 'admin_section' ELSE 'attachment' END AS role FROM t WHERE tn > 0""",
    **T,
)
def territories(documents: DataFrame) -> DataFrame:
    return h.nested(h.classified(h.blocks(volumes(documents))))


_LOW_ALL = "lower(substring(body, 1, 3500))"
_HITS = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {any_sql(_LOW_ALL, w)} THEN '{k}' END" for k, w in h.GROUPS.items()) + "], lambda x: x IS NOT NULL))"
TERRITORIES = f"""{CLASSES}, k AS (SELECT *, kind IN ('dominion', 'colony_high', 'colony_candidate') AS main FROM c WHERE kind <> 'skip'),
l AS (SELECT *, last_value(CASE WHEN main THEN kind END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lm FROM k),
tt AS (SELECT doc_id, block_no, heading AS name, CASE kind WHEN 'dominion' THEN 'dominion' ELSE 'colony' END AS tkind, kind = 'colony_candidate' AS cand, start_pos, end_pos, n,
 round(0.1::DOUBLE + 0.08::DOUBLE * greatest(0, least(10, score)), 3) AS conf, sha1(regexp_replace(lower(body), '\\s+', '', 'g')) AS fp, {_HITS} AS hits FROM l WHERE main OR (kind = 'province' AND coalesce(lm, '') <> 'dominion')),
tl AS (SELECT *, lag(name) OVER w AS pn, lag(tkind) OVER w AS pk FROM tt WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
ti AS (SELECT *, sum((NOT coalesce(name = pn AND tkind = pk, false))::INT) OVER (PARTITION BY doc_id ORDER BY block_no {_UPTO}) AS tn FROM tl),
tm AS (SELECT doc_id, tn, min(name) AS name, min(tkind) AS tkind, count(*) AS merged, min(start_pos) AS start_pos, max(end_pos) AS end_pos, sum(n) + 2 * (count(*) - 1) AS chars, min_by(conf, block_no) AS conf,
 min_by(fp, block_no) AS fp, list_sort(list_distinct(flatten(list(hits)))) AS hits, count_if(cand) AS candidates FROM ti GROUP BY doc_id, tn),
tr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY tn) AS number, row_number() OVER (PARTITION BY doc_id, name, fp ORDER BY tn) > 1 AS dup FROM tm)"""


@query(
    "c9_merged_territories",
    f"""WITH {TERRITORIES} SELECT doc_id, tn::INT AS territory_no, name, tkind AS kind, merged, start_pos::BIGINT AS start_pos, end_pos::BIGINT AS end_pos, chars::BIGINT AS chars, round(conf, 6) AS confidence,
 array_to_string(hits, ',') AS keyword_hits, candidates, number::INT AS number, dup AS is_duplicate, CASE WHEN number = 1 THEN 'primary' ELSE 'appendix' END AS role, {_PAGES_SQL} FROM tr""",
    **T,
)
def merged_territories(documents: DataFrame) -> DataFrame:
    v = volumes(documents)
    rows = h.paged(h.territories(h.classified(h.blocks(v))), pages(v), "territory_no")
    return rounded(rows.withColumn("keyword_hits", F.array_join("keyword_hits", ",")))


@query(
    "a4_territory_statistics",
    f"""WITH {TERRITORIES}, m AS (SELECT doc_id, count(*) AS territories, count_if(dup) AS duplicates, sum(candidates) + count_if(number > 1) AS review_items FROM tr GROUP BY doc_id)
SELECT b.doc_id, total_blocks, coalesce(territories, 0) AS territories, coalesce(duplicates, 0) AS duplicates, coalesce(review_items, 0)::BIGINT AS review_items
FROM (SELECT doc_id, count(*) AS total_blocks FROM c GROUP BY doc_id) b LEFT JOIN m USING (doc_id)""",
    **T,
)
def territory_statistics(documents: DataFrame) -> DataFrame:
    return h.territory_statistics(h.classified(h.blocks(volumes(documents))))


_CATEGORY = "CASE WHEN sn = 0 THEN 'overview' " + " ".join(f"WHEN {in_sql('lower(title)', list(t))} THEN '{k}'" for k, t in h.CATEGORIES.items()) + " ELSE 'other' END"


@query(
    "t9_sections",
    f"""WITH {BLOCKS}, sl AS (SELECT doc_id, block_no, i AS line_no, l[i] AS line, regexp_matches(l[i], '^[A-Z][^|]{{2,80}}\\.$') AND NOT regexp_matches(l[i], '\\s[a-z]') AS tt FROM (SELECT doc_id, block_no, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, block_no, string_split(body, chr(10)) AS l FROM blocks))),
sn AS (SELECT *, sum(tt::INT) OVER (PARTITION BY doc_id, block_no ORDER BY line_no {_UPTO}) AS sn FROM sl),
g AS (SELECT doc_id, block_no, sn, coalesce(max(substring(line, 1, length(line) - 1)) FILTER (tt), 'Introduction') AS title, sum(CASE WHEN tt THEN 0 ELSE length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) END) AS chars FROM sn GROUP BY doc_id, block_no, sn)
SELECT doc_id, block_no::INT AS block_no, sn::INT AS section_no, title, chars::BIGINT AS chars, {_CATEGORY} AS category FROM g WHERE chars > 0""",
    **T,
)
def sections(documents: DataFrame) -> DataFrame:
    return h.sections(h.blocks(volumes(documents)))


@query(
    "g6_copies",
    f"""WITH {BLOCKS}, f AS (SELECT doc_id, block_no, heading, sha1(regexp_replace(lower(body), '\\s+', '', 'g')) AS fingerprint FROM blocks)
SELECT doc_id, block_no::INT AS block_no, heading, fingerprint, CASE WHEN row_number() OVER (PARTITION BY doc_id, heading, fingerprint ORDER BY block_no) > 1 THEN 'duplicate' WHEN row_number() OVER (PARTITION BY doc_id, heading ORDER BY block_no) > 1 THEN 'appendix' ELSE 'primary' END AS role,
 (min(block_no) OVER (PARTITION BY doc_id, heading))::INT AS first_block FROM f""",
    **T,
)
def copies(documents: DataFrame) -> DataFrame:
    return h.copies(h.blocks(volumes(documents)))


@query("j4_block_pages", f"WITH {BLOCKS} SELECT doc_id, block_no::INT AS block_no, (start_pos // 2000 + 1)::INT AS first_page, (greatest(end_pos - 1, 0) // 2000 + 1)::INT AS last_page FROM blocks", **T)
def block_pages(documents: DataFrame) -> DataFrame:
    v = volumes(documents)
    return h.paged(h.blocks(v).select("doc_id", "block_no", "start_pos", "end_pos"), pages(v), "block_no").drop("start_pos", "end_pos")


@query(
    "j1_transition_boundaries",
    f"""WITH {BLOCKS}, e AS (SELECT doc_id, start FROM vp WHERE regexp_matches(line, 'Consuls\\.$')), b AS (SELECT doc_id, start FROM vp WHERE hd)
SELECT e.doc_id, e.start::BIGINT AS end_pos, min(b.start)::BIGINT AS start_pos FROM e JOIN b ON b.doc_id = e.doc_id AND b.start > e.start AND b.start - e.start < 2000 GROUP BY ALL""",
    **T,
)
def transition_boundaries(documents: DataFrame) -> DataFrame:
    return h.boundaries(volumes(documents), r"Consuls\.$", h.HEADING, 2000)


_GEO_SQL = " + ".join(f"len(regexp_extract_all(twenty, '(?i){p}'))" for p in h.GEOGRAPHY)
_ENDS_SQL = " OR ".join(f"regexp_matches(s, '{p}')" for p in h.ENDS)


@query(
    "x17_transitions",
    f"""WITH {BLOCKS}, la AS (SELECT doc_id, line_no, start, line, hd, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s,
 string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ten,
 string_agg({WORDED.replace('text', 'line')}, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS twenty FROM vp)
SELECT doc_id, start::BIGINT AS pos, 'end' AS signal, s AS name, 0.8::DOUBLE AS confidence FROM la WHERE {_ENDS_SQL}
UNION ALL SELECT doc_id, start::BIGINT, 'start', substring(s, 1, length(s) - 1), CASE WHEN ({_GEO_SQL}) / length(twenty) > 0.02 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END FROM la WHERE hd AND contains(lower(ten), '{h.OPENING}')""",
    **T,
)
def transitions(documents: DataFrame) -> DataFrame:
    return h.transitions(volumes(documents))


@query(
    "c11_hierarchical_ids",
    f"""WITH {BLOCKS}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS k FROM blocks WHERE length(body) > 100)
SELECT doc_id, format('L1_{{:03d}}', k) AS chunk_id, 1 AS level, heading AS name, length(body)::INT AS size FROM n
UNION ALL SELECT doc_id, format('L2_{{:03d}}_{{:02d}}', k, i), 2, heading, length(p[i])::INT FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT *, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM n))""",
    **T,
)
def hierarchical_ids(documents: DataFrame) -> DataFrame:
    rows = h.blocks(volumes(documents)).where(F.length("body") > 100).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no")))
    first = rows.select("doc_id", F.format_string("L1_%03d", "k").alias("chunk_id"), F.lit(1).alias("level"), F.col("heading").alias("name"), F.length("body").alias("size"))
    second = rows.select("doc_id", "k", "heading", F.posexplode(tx.paragraphs(F.col("body"))).alias("i", "p"))
    return first.unionByName(second.select("doc_id", F.format_string("L2_%03d_%02d", "k", F.col("i") + 1).alias("chunk_id"), F.lit(2).alias("level"), F.col("heading").alias("name"), F.length("p").alias("size")))


@query("x14_geographic_density", f"WITH {BLOCKS}, b AS (SELECT doc_id, block_no, {_WORDED_BODY} AS text FROM blocks WHERE length(body) > 0) SELECT doc_id, block_no::INT AS block_no, round((" + " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in h.GEOGRAPHY) + ") / length(text), 6) AS density FROM b", **T)
def geographic_density(documents: DataFrame) -> DataFrame:
    rows = h.blocks(volumes(documents)).where(F.length("body") > 0)
    return rounded(rows.select("doc_id", "block_no", (matches(F.col("body"), h.GEOGRAPHY, "(?iU)") / F.length("body")).alias("density")))


_STANDARD = "CASE " + " ".join(f"WHEN regexp_matches(l[i], '(?i)^(?:{t})') THEN '{k}'" for k, t in h.STANDARD.items()) + " END"


@query(
    "t10_standard_sections",
    f"""WITH {BLOCKS}, sl AS (SELECT doc_id, block_no, i, l[i] AS line, {_STANDARD} AS kind FROM (SELECT doc_id, block_no, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, block_no, string_split(body, chr(10)) AS l FROM blocks))),
sn AS (SELECT *, count(kind) OVER (PARTITION BY doc_id, block_no ORDER BY i {_UPTO}) AS sn FROM sl)
SELECT doc_id, block_no::INT AS block_no, sn::INT AS section_no, coalesce(max(kind), 'introduction') AS section_type, count(*) AS n_lines, sum(length(line))::BIGINT AS chars FROM sn GROUP BY doc_id, block_no, sn""",
    **T,
)
def standard_sections(documents: DataFrame) -> DataFrame:
    return h.standard_sections(h.blocks(volumes(documents)))


@query("p27_described_blocks", f"WITH {BLOCKS}, d AS (SELECT *, {' + '.join(f'contains(lower(body), {w!r})::INT' for w in h.DESCRIPTION)} AS hits FROM blocks WHERE length(body) >= 500 AND NOT {any_sql('upper(heading)', h.ADVERT_NAMES)}) SELECT doc_id, block_no::INT AS block_no, heading, hits FROM d WHERE hits >= 2", **T)
def described_blocks(documents: DataFrame) -> DataFrame:
    return h.described(h.blocks(volumes(documents))).select("doc_id", "block_no", "heading", "hits")


_PERSON = h.PERSON.replace("'", "''")
_TOC = "(regexp_matches(x, '\\b\\d{1,3}(?:[ab])?\\b') AND (contains(x, ':') OR contains(x, ';') OR regexp_matches(x, '\\b\\d{1,3}(?:[ab])?(?:\\.|;)?$'))) OR ends_with(x, '....')"


_FILLED = "list_filter(list_transform(string_split({0}, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(
    "x9_body_classes",
    f"""WITH {BLOCKS}, b AS (SELECT doc_id, block_no, body, {_WORDED_BODY} AS m FROM blocks),
s AS (SELECT *, {_FILLED.format('body')} AS s, {_FILLED.format('m')} AS sm, len(regexp_extract_all(m, '{_PERSON}')) AS names FROM b),
k AS (SELECT *, len(list_filter(sm, lambda x: {_TOC})) AS toc, len(list_filter(s, lambda x: starts_with(x, '|'))) > 0 AS tab,
 len(list_filter(s, lambda x: regexp_matches(x, '\\p{{Lu}}') AND NOT regexp_matches(x, '\\p{{Ll}}'))) AS up, len(list_filter(s, lambda x: regexp_matches(x, '[a-z]{{3,}}'))) AS sent FROM s)
SELECT doc_id, block_no::INT AS block_no, CASE WHEN toc >= greatest(3, floor(len(s) * 0.6)) THEN 'toc' WHEN tab OR names >= 2 THEN 'roster'
 WHEN length(body) < 120 AND up / greatest(len(s), 1) > 0.5 THEN 'noise' ELSE 'narrative' END AS kind, names::INT AS name_hits, tab AS has_table, round(sent / greatest(len(s), 1), 6) AS density FROM k""",
    **T,
)
def body_classes(documents: DataFrame) -> DataFrame:
    return rounded(h.body_class(h.blocks(volumes(documents))))


_DISCOURSE = ", ".join("(" + " + ".join("regexp_matches(text, '(?i)" + p.replace("'", "''") + "')::INT" for p in ps) + f")::INT AS {k}" for k, ps in h.DISCOURSE.items())


@query("x5_discourse_markers", f"WITH d AS (SELECT doc_id, {WORDED} AS text FROM documents) SELECT doc_id, {_DISCOURSE} FROM d", **T)
def discourse_markers(documents: DataFrame) -> DataFrame:
    return h.discourse(documents)


@query(
    "w13_until_next_territory",
    f"""WITH {CLASSES}, f AS (SELECT *, min(block_no) FILTER (heading = 'TERRITORY A') OVER (PARTITION BY doc_id) AS first FROM c),
w AS (SELECT *, min(block_no) FILTER (kind IN ('dominion', 'colony_high', 'colony_candidate') AND block_no > first) OVER (PARTITION BY doc_id) AS stop FROM f)
SELECT doc_id, block_no::INT AS block_no, heading, kind FROM w WHERE block_no >= first AND (stop IS NULL OR block_no < stop)""",
    **T,
)
def until_next_territory(documents: DataFrame) -> DataFrame:
    return h.until_next(h.classified(h.blocks(volumes(documents))), "TERRITORY A")


_SEE = [f"regexp_extract_all(text, '\\b[Ss]ee{also}\\s+([A-Z][A-Za-z]+)\\b', 1)" for also in ("", " also")]


@query(
    "c4c_cross_references",
    f"WITH d AS (SELECT doc_id, {WORDED} AS text FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat({', '.join(_SEE)}))), ',') AS targets FROM d",
    **T,
)
def cross_references(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.array_join(F.array_sort(h.cross_references(F.col("text"))), ",").alias("targets"))


@query(
    "a22_hierarchy_counts",
    f"WITH {CLASSES} SELECT doc_id, count_if(kind = 'dominion') AS dominions, count_if(starts_with(kind, 'colony')) AS colonies, count_if(kind = 'province') AS provinces, count_if(kind = 'admin') AS offices, count_if(kind = 'skip') AS skipped, min(n)::INT AS min_size, max(n)::INT AS max_size, (sum(n) // count(*))::BIGINT AS avg_size FROM c GROUP BY doc_id",
    **T,
)
def hierarchy_counts(documents: DataFrame) -> DataFrame:
    kinds = {"dominions": F.col("kind") == "dominion", "colonies": F.col("kind").startswith("colony"), "provinces": F.col("kind") == "province", "offices": F.col("kind") == "admin", "skipped": F.col("kind") == "skip"}
    rows = h.classified(h.blocks(volumes(documents)))
    return rows.groupBy("doc_id").agg(*[F.count_if(v).alias(k) for k, v in kinds.items()], F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.floor(F.sum("n") / F.count("*")).alias("avg_size"))


_HEADERS = f"""{BLOCKS}, mh AS (SELECT vp.doc_id, start, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM vp),
mj AS (SELECT doc_id, start::BIGINT AS start, replace(s, '.', '') AS name, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text))::BIGINT AS stop FROM mh JOIN volumes USING (doc_id)
  WHERE regexp_matches(s, '\\p{{Lu}}') AND NOT regexp_matches(s, '\\p{{Ll}}') AND ends_with(s, '.') AND length(s) >= 6 AND NOT {any_sql('s', h.NO_TERRITORY)})"""


@query("t11_major_headers", f"WITH {_HEADERS} SELECT doc_id, start, name, stop FROM mj", **T)
def major_headers(documents: DataFrame) -> DataFrame:
    return h.major_headers(volumes(documents)).withColumnRenamed("end", "stop")


_GAZETTEER = ", ".join(f"({i}, '{c}', '{u}')" for i, (c, v) in enumerate(h.CONTAINERS.items()) for u in v)


@query(
    "g4_dominion_groups",
    f"""WITH {_HEADERS}, gz(ord, container, unit) AS (VALUES {_GAZETTEER}),
o AS (SELECT doc_id, start, stop, name, min_by(container, ord) AS container FROM mj LEFT JOIN gz ON contains(name, unit) GROUP BY ALL)
SELECT doc_id, coalesce(max(container), max(name)) AS name, CASE WHEN max(container) IS NULL THEN 'colony' ELSE 'dominion' END AS kind, count(*) AS sections, min(start) AS start, max(stop) AS stop FROM o GROUP BY doc_id, coalesce(container, name || '@' || start)""",
    **T,
)
def dominion_groups(documents: DataFrame) -> DataFrame:
    return h.grouped(h.major_headers(volumes(documents))).withColumnRenamed("end", "stop")


_INTRO = "(" + " OR ".join(f"starts_with(heading, '{p}')" for p in h.PREFIXES) + ")"


@query(
    "t7_folded_prefixes",
    f"""WITH {BLOCKS}, f AS (SELECT *, length(body) > 0 AND NOT (length(body) < 160 AND {_INTRO}) AS stays FROM (SELECT * REPLACE (coalesce(body, '') AS body) FROM blocks)),
t AS (SELECT *, first_value(CASE WHEN stays THEN block_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tb FROM f)
SELECT doc_id, tb::INT AS block_no, max(heading) FILTER (stays) AS heading, coalesce(string_agg(heading, '|' ORDER BY block_no) FILTER (NOT stays), '') AS prefix_headings FROM t WHERE tb IS NOT NULL GROUP BY doc_id, tb""",
    **T,
)
def folded_prefixes(documents: DataFrame) -> DataFrame:
    return h.folded(h.blocks(volumes(documents)))


@query("t13_last_of_name", f"WITH {BLOCKS} SELECT doc_id, heading, max(block_no)::INT AS block_no, max_by(length(body), block_no)::INT AS size, count(*) AS seen FROM blocks GROUP BY doc_id, heading", **T)
def last_of_name(documents: DataFrame) -> DataFrame:
    return h.last_of_name(h.blocks(volumes(documents)))


@query("c3e_head_and_body", f"WITH {VOLUMES} SELECT doc_id, substring(text, 1, instr(text, chr(10)) - 1) AS head, (length(text) - instr(text, chr(10)))::INT AS body_size FROM volumes", **T)
def head_and_body(documents: DataFrame) -> DataFrame:
    parts = F.split("text", "\n", 2)
    return volumes(documents).select("doc_id", parts[0].alias("head"), F.length(parts[1]).alias("body_size"))


@query("j11_known_names", f"WITH {BLOCKS}, k(name) AS (VALUES ('CANADA'), ('ONTARIO'), ('TERRITORY B'), ('NOWHERE')) SELECT name, count(DISTINCT (doc_id, block_no)) FILTER (heading IS NOT NULL) AS found FROM k LEFT JOIN blocks ON contains(heading, name) GROUP BY name", **T)
def known_names(documents: DataFrame) -> DataFrame:
    found = h.blocks(volumes(documents)).select("doc_id", "block_no", "heading")
    names = found.sparkSession.createDataFrame([("CANADA",), ("ONTARIO",), ("TERRITORY B",), ("NOWHERE",)], "name string")
    counts = found.join(F.broadcast(names), F.col("heading").contains(F.col("name"))).groupBy("name").agg(F.countDistinct("doc_id", "block_no").alias("found"))
    return names.join(counts, "name", "left").fillna(0, ["found"])


_NAMED = "CASE " + " ".join(f"WHEN contains(heading, '{c}') OR {any_sql('heading', tuple(w for w in c.split() if len(w) > 3))} THEN '{c}'" for c in h.CONTAINERS) + " END"


@query("p23_container_names", f"WITH {BLOCKS} SELECT doc_id, block_no::INT AS block_no, heading, {_NAMED} AS container FROM blocks WHERE {_NAMED} IS NOT NULL", **T)
def container_names(documents: DataFrame) -> DataFrame:
    """Headings that name a container, whole or by a word."""
    return h.blocks(volumes(documents)).select("doc_id", "block_no", "heading", h.container_named(F.col("heading")).alias("container")).where("container is not null")


_FOUND = ", ".join(f"CASE WHEN regexp_matches(m, '(?i){p}') THEN '{p}' END" for p in h.SUBSECTIONS)
_SHOWN = ", ".join(f"CASE WHEN contains(t, '{p}') THEN '{n}' END" for p, n in h.SHOWN.items())


@query(
    "a21_section_analysis",
    f"""WITH {BLOCKS}, t AS (SELECT doc_id, heading, count(*) AS total_chunks, string_agg(coalesce(body, ''), chr(10) ORDER BY block_no) || chr(10) AS t FROM blocks GROUP BY doc_id, heading),
w AS (SELECT *, {WORDED.replace('text', 't')} AS m FROM t)
SELECT doc_id, heading, total_chunks, length(t)::BIGINT AS total_characters, array_to_string(list_filter([{_FOUND}], lambda x: x IS NOT NULL), ',') AS subsections_found, array_to_string(list_filter([{_SHOWN}], lambda x: x IS NOT NULL), ',') AS sections,
 sha256(substring(t, 1, 1000)) AS opening_sha256, sha256(right(t, 1000)) AS ending_sha256 FROM w""",
    **T,
)
def section_analysis(documents: DataFrame) -> DataFrame:
    """Size, phrases present, opening and ending of the text below each heading of a volume."""
    rows = h.analysed(h.blocks(volumes(documents)))
    rows = rows.withColumns({"subsections_found": F.array_join("subsections_found", ","), "sections": F.array_join("sections", ","), "opening_sha256": F.sha2("opening", 256), "ending_sha256": F.sha2("ending", 256)})
    return rows.drop("opening", "ending")


_CONTAINER = " ".join(f"WHEN m.heading = '{c}' AND {any_sql('heading', v)} THEN 'province'" for c, v in h.CONTAINERS.items())


@query(
    "p25_container_sections",
    f"""WITH {CLASSES}, x AS (SELECT *, last_value(CASE WHEN kind IN ('dominion', 'colony_high', 'colony_candidate') THEN {{'kind': kind, 'heading': heading}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no {_UPTO}) AS m FROM c WHERE kind <> 'skip'),
k AS (SELECT doc_id, block_no, m.heading AS container, heading, n, CASE {_CONTAINER} WHEN {any_sql('heading', h.ADMIN)} THEN 'administration' ELSE 'other' END AS section_kind FROM x WHERE m.kind = 'dominion' AND kind <> 'dominion' AND n > 100)
SELECT doc_id, block_no::INT AS block_no, container, heading, section_kind, n::INT AS n, n > 5000 AND section_kind <> 'administration' AS is_large FROM k""",
    **T,
)
def container_sections(documents: DataFrame) -> DataFrame:
    return h.container_sections(h.classified(h.blocks(volumes(documents))))


_NAMES = ["ONTARIO", "TERRITORY A", "Nova Scotia"]
_MENTIONS = " UNION ALL ".join(f"SELECT doc_id, block_no, '{n}' AS name, regexp_matches(x, '(?i)THE\\s+{n}\\s+COLONY') AS is_header FROM mt WHERE regexp_matches(x, '(?i)\\b{n}\\b')" for n in _NAMES)


@query("p31_mentions", f"WITH {BLOCKS}, mt AS (SELECT doc_id, block_no::INT AS block_no, heading || chr(10) || {_WORDED_BODY} AS x FROM blocks) {_MENTIONS}", **T)
def mentions(documents: DataFrame) -> DataFrame:
    return h.mentions(h.blocks(volumes(documents)).where("body is not null"), _NAMES)


@query(
    "a20_topic_counts",
    f"WITH {BLOCKS} SELECT doc_id, count(*) AS blocks, sum(length(body))::BIGINT AS chars, " + ", ".join(f"count_if(regexp_matches(body, '(?i){p}')) AS {k}" for k, p in profile.TOPICS.items()) + " FROM blocks GROUP BY doc_id",
    **T,
)
def topic_counts(documents: DataFrame) -> DataFrame:
    """How many blocks of a volume touch each topic."""
    rows = h.blocks(volumes(documents))
    return rows.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("body")).alias("chars"), *[F.count_if(F.col("body").rlike(f"(?iU){p}")).alias(k) for k, p in profile.TOPICS.items()])


@query("o9_headings", f"WITH {BLOCKS} SELECT heading, row_number() OVER (ORDER BY heading) AS place, seen FROM (SELECT heading, count(*) AS seen FROM blocks GROUP BY heading)", **T)
def headings(documents: DataFrame) -> DataFrame:
    """The distinct headings in order, with their places."""
    names = h.blocks(volumes(documents)).groupBy("heading").agg(F.count("*").alias("seen"))
    return placed(names, "heading").select("heading", "place", "seen")


@query(
    "p30_first_large",
    "SELECT doc_id, length(text)::INT AS chars FROM documents WHERE source = (SELECT min(source) FROM documents) AND length(text) > 5000 ORDER BY doc_id LIMIT 1",
    **T,
)
def first_large(documents: DataFrame) -> DataFrame:
    first = documents.agg(F.min("source").alias("s"))  # one row
    return h.first_large(documents.join(F.broadcast(first)), F.col("source") == F.col("s"), 5000)
