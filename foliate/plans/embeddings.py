"""Similarity, boundaries and clusters of vectors: queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.functions import text as tx
from foliate.operators import density, semantic, vectors
from foliate.plans.chunking import rounded
from foliate.plans.registry import query

_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))"
_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


@query("m5_adjacent_cosine", f"WITH {_E}, n AS (SELECT label, vec_id, v, lead(vec_id) OVER w AS next_id, lead(v) OVER w AS nv FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT label, vec_id, next_id, round({_COS.format('v', 'nv')}, 5) AS similarity, {_COS.format('v', 'nv')} < 0.5 AS is_break FROM n WHERE next_id IS NOT NULL", embeddings="embeddings")
def adjacent_cosine(embeddings: DataFrame) -> DataFrame:
    rows = vectors.adjacent(embeddings, "label", "vec_id")
    return rows.select("label", "vec_id", "next_id", F.round("similarity", 5).alias("similarity"), (F.col("similarity") < 0.5).alias("is_break"))


_UNIT = f"{_E}, u AS (SELECT label, vec_id, unnest(range(1, len(v) + 1)) AS d, unnest(v) / sqrt(list_dot_product(v, v)) AS x, unnest(v) AS raw FROM e)"


@query(
    "m4_strategy_coherence",
    f"""WITH {_UNIT}, c AS (SELECT label, d, sum(x) AS s, var_pop(raw) AS var, count(*) AS n FROM u GROUP BY ALL)
SELECT label, any_value(n) AS n, round((sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1)), 5) AS avg_similarity, round(avg(var), 5) AS variance FROM c GROUP BY label HAVING any_value(n) > 1""",
    embeddings="embeddings",
)
def strategy_coherence(embeddings: DataFrame) -> DataFrame:
    out = vectors.coherence(embeddings, "label")
    return out.select("label", "n", F.round("avg_similarity", 5).alias("avg_similarity"), F.round("variance", 5).alias("variance"))


@query(
    "w9_window_boundaries",
    f"""WITH {_E}, s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM e),
p AS (SELECT a.label, a.i AS pos, avg({_COS.format('b.v', 'c.v')}) AS similarity FROM s a JOIN s b ON a.label = b.label AND b.i BETWEEN a.i - 3 AND a.i - 1 JOIN s c ON a.label = c.label AND c.i BETWEEN a.i AND a.i + 2 GROUP BY a.label, a.i HAVING count(*) = 9)
SELECT label, pos, round(similarity, 5) AS similarity FROM p""",
    embeddings="embeddings",
)
def window_boundaries(embeddings: DataFrame) -> DataFrame:
    return vectors.window_similarity(embeddings, "label", "vec_id", 3).select("label", F.col("at").alias("pos"), F.round("similarity", 5).alias("similarity"))


@query(
    "w12_anchor_expansion",
    f"""WITH {_E}, s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM e), a AS (SELECT label, i AS ai, v AS av FROM s QUALIFY i = 1 + (count(*) OVER (PARTITION BY label)) // 2),
t AS (SELECT s.label, i, ai, {_COS.format('v', 'av')} >= 0.0 AS ok FROM s JOIN a USING (label)),
b AS (SELECT label, any_value(ai) AS anchor, coalesce(max(i) FILTER (NOT ok AND i < ai), 0) + 1 AS first, coalesce(min(i) FILTER (NOT ok AND i > ai), count(*) + 1) - 1 AS last FROM t GROUP BY label)
SELECT label, anchor, first, last FROM b""",
    embeddings="embeddings",
)
def anchor_expansion(embeddings: DataFrame) -> DataFrame:
    return vectors.expand_from_middle(embeddings, "label", "vec_id", 0.0)


@query("j9_nearest_to_query", f"WITH {_E}, q AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1), r AS (SELECT vec_id, {_COS.format('v', 'qv')} AS c FROM e, q) SELECT vec_id, round(c, 5) AS similarity FROM r ORDER BY c DESC, vec_id LIMIT 20", embeddings="embeddings")
def nearest_to_query(embeddings: DataFrame) -> DataFrame:
    anchor = embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))  # one row
    return embeddings.crossJoin(F.broadcast(anchor)).select("vec_id", tx.cosine(F.col("embedding"), F.col("q")).alias("c")).orderBy(F.desc("c"), "vec_id").limit(20).select("vec_id", F.round("c", 5).alias("similarity"))


@query(
    "j9_nearest",
    f"""WITH {_E}, u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), q AS (SELECT vec_id AS query_id, v AS q FROM u WHERE vec_id % 100 = 0),
r AS (SELECT query_id, vec_id, list_dot_product(q, v) AS c FROM q, u), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM r)
SELECT query_id, vec_id, round(c, 5) AS similarity, rank::INT AS rank FROM k WHERE rank <= 10""",
    embeddings="embeddings",
)
def nearest(embeddings: DataFrame) -> DataFrame:
    """Ten nearest rows of every row whose id is divisible by 100."""
    return vectors.nearest(embeddings, embeddings.where("vec_id % 100 = 0"), 10).withColumn("similarity", F.round("similarity", 5))


@query(
    "m7_semantic_boundaries",
    f"""WITH {_E}, s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM e),
p AS (SELECT a.label, a.i AS pos, avg({_COS.format('b.v', 'c.v')}) AS similarity FROM s a JOIN s b ON a.label = b.label AND b.i BETWEEN a.i - 3 AND a.i - 1 JOIN s c ON a.label = c.label AND c.i BETWEEN a.i AND a.i + 2 GROUP BY a.label, a.i HAVING count(*) = 9)
SELECT label, pos, round(similarity, 5) AS similarity FROM p WHERE similarity < 0.7""",
    embeddings="embeddings",
)
def semantic_boundaries(embeddings: DataFrame) -> DataFrame:
    """Places where three vectors and the next three are less alike than 0.7."""
    return window_boundaries(embeddings).where("similarity < 0.7")


@query(
    "w10_first_breaks",
    f"""WITH {_E}, n AS (SELECT label, vec_id, v, lead(vec_id) OVER w AS next_id, lead(v) OVER w AS nv FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
b AS (SELECT label, vec_id, next_id, {_COS.format('v', 'nv')} AS similarity FROM n WHERE next_id IS NOT NULL AND {_COS.format('v', 'nv')} < 0.7)
SELECT label, vec_id, next_id, round(similarity, 5) AS similarity, row_number() OVER (PARTITION BY label ORDER BY vec_id)::INT AS rank FROM b QUALIFY rank <= 10""",
    embeddings="embeddings",
)
def first_breaks(embeddings: DataFrame) -> DataFrame:
    return vectors.low_similarities(embeddings, "label", "vec_id", 0.7, 10).withColumn("similarity", F.round("similarity", 5))


@query("m3_kmeans_sizes", None, embeddings="embeddings")
def kmeans_sizes(embeddings: DataFrame) -> DataFrame:
    """Best of k = 2 to 7 by the silhouette, each from ten starts; a row for each cluster."""
    return rounded(vectors.best_kmeans(embeddings).groupBy("cluster", "silhouette").agg(F.count("*").alias("size")))


@query("m8_cluster_labels", None, embeddings="embeddings")
def cluster_labels(embeddings: DataFrame) -> DataFrame:
    """The cluster of each vector, of five."""
    return vectors.cluster_labels(embeddings, 5)


@query("m6_principal_components", None, embeddings="embeddings")
def principal_components(embeddings: DataFrame) -> DataFrame:
    return vectors.components(embeddings)


def _density_sql(eps: float, least: int) -> str:
    return f"""WITH RECURSIVE {_E}, u AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
n AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON list_dot_product(a.v, b.v) >= 1 - {eps}),
k AS MATERIALIZED (SELECT a AS vec_id, count(*) AS neighbours, count(*) >= {least} AS is_core FROM n GROUP BY a),
l AS MATERIALIZED (SELECT a, b FROM n JOIN k x ON x.vec_id = a JOIN k y ON y.vec_id = b WHERE x.is_core AND y.is_core),
r AS (SELECT a AS vec_id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id WHERE r.root < l.b),
c AS MATERIALIZED (SELECT vec_id, min(root) AS cluster FROM r GROUP BY vec_id),
o AS (SELECT n.a AS vec_id, min(c.cluster) AS cluster FROM n JOIN c ON c.vec_id = n.b GROUP BY n.a)
SELECT k.vec_id, o.cluster, k.is_core, k.neighbours FROM k LEFT JOIN o USING (vec_id)"""


@query("m8_density_clusters", _density_sql(0.3, 5), embeddings="embeddings")
def density_clusters(embeddings: DataFrame) -> DataFrame:
    """Density clusters with the surveyed values."""
    return density.density_clusters(embeddings, 0.3, 5)


@query("m8_density_clusters_wide", _density_sql(0.66, 4), embeddings="embeddings")
def density_clusters_wide(embeddings: DataFrame) -> DataFrame:
    """At a distance where the given vectors have neighbours: clusters, their borders and noise."""
    return density.density_clusters(embeddings, 0.66, 4)


_MOST, _FIRST, _HARD, _FACTOR = 12, 0.05, 0.1, 0.9
_BEFORE = " ".join(f"list_dot_product(v, lag(v, {k}) OVER w)," for k in range(1, _MOST)).rstrip(",")


@query(
    "m11_max_min_chunks",
    f"""WITH RECURSIVE {_E}, u AS (SELECT label, vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e),
s AS MATERIALIZED (SELECT label, vec_id, row_number() OVER w AS i, [{_BEFORE}] AS near FROM u WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
r AS (SELECT label, vec_id, i, 1 AS n, NULL::DOUBLE AS least, 0 AS chunk_index FROM s WHERE i = 1
UNION ALL SELECT label, vec_id, i, CASE WHEN o THEN 1 ELSE n + 1 END, CASE WHEN o THEN NULL ELSE least_with END, chunk_index + o::INT FROM (
 SELECT s.label, s.vec_id, s.i, r.n, r.chunk_index, least(coalesce(r.least, 2), list_min(near[1:r.n])) AS least_with,
  r.n >= {_MOST} OR list_max(near[1:r.n]) < CASE WHEN r.n = 1 THEN {_FIRST}::DOUBLE ELSE greatest({_HARD}::DOUBLE, {_FACTOR}::DOUBLE * r.least) END AS o FROM r JOIN s ON s.label = r.label AND s.i = r.i + 1))
SELECT label, vec_id, chunk_index FROM r""",
    embeddings="embeddings",
)
def max_min_chunks(embeddings: DataFrame) -> DataFrame:
    """Chunks of neighbouring vectors of a label by the max-min rule."""
    return semantic.max_min_chunks(embeddings, "label", "vec_id", _MOST, _FIRST, _HARD, _FACTOR)


_COMMON = """n AS MATERIALIZED (SELECT name FROM (SELECT unnest(regexp_extract_all(text, '[a-z]{6,}')) AS name FROM documents) GROUP BY name ORDER BY count(*) DESC, name LIMIT 5)"""


@query(
    "m9_anchored_sections",
    f"""WITH {_E}, {_COMMON}, s AS MATERIALIZED (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, coalesce(text, '') AS text, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e JOIN documents ON doc_id = vec_id),
m AS MATERIALIZED (SELECT label, name, i, contains(upper(text), 'THE ' || upper(name)) OR contains(upper(text), upper(name) || ' COLONY') AS head FROM s, n WHERE contains(lower(text), lower(name))),
a AS (SELECT label, name, coalesce(min(i) FILTER (head), min(i)) AS anchor FROM m GROUP BY ALL),
b AS (SELECT a.label, a.name, a.anchor, s.i FROM a JOIN s x ON x.label = a.label AND x.i = a.anchor JOIN s ON s.label = a.label WHERE NOT list_dot_product(x.v, s.v) > 0.1 AND NOT EXISTS (SELECT 1 FROM m WHERE m.label = a.label AND m.name = a.name AND m.i = s.i)),
z AS (SELECT label, max(i) AS size FROM s GROUP BY label),
f AS (SELECT a.label, a.name, a.anchor, coalesce(max(b.i) FILTER (b.i < a.anchor), 0) + 1 AS first, coalesce(min(b.i) FILTER (b.i > a.anchor), any_value(size) + 1) - 1 AS last FROM a JOIN z USING (label) LEFT JOIN b ON b.label = a.label AND b.name = a.name GROUP BY ALL),
g AS (SELECT *, first > coalesce(max(last) OVER (PARTITION BY label ORDER BY first, last, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh FROM f)
SELECT label, name, anchor::INT AS anchor, first::INT AS first, last::INT AS last, (sum(fresh::INT) OVER (PARTITION BY label ORDER BY first, last, name))::BIGINT AS section FROM g""",
    embeddings="embeddings",
    documents="documents",
)
def anchored_sections(embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections of each label's texts around the anchors of the five most frequent long words."""
    words = documents.select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{6,})"), 1)).alias("name")).groupBy("name").count()
    names = words.orderBy(F.desc("count"), "name").limit(5).select("name")
    rows = embeddings.join(documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return semantic.anchored_sections(rows, names, "label", "vec_id", 0.1)
