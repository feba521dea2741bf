"""Keyword search, rank fusion and retrieval quality over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators import retrieval, vectors
from foliate.plans.chunking import rounded
from foliate.plans.registry import query

TERMS, TOP = 12, 10

_INDEX = f"""w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{retrieval.WORD}') AS w FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean FROM w),
f AS MATERIALIZED (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM w) GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM f GROUP BY term),
p AS MATERIALIZED (SELECT term, doc_id, df, floor(1000000.0::DOUBLE * (ln(1 + (s.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / s.mean)))))::BIGINT AS weight FROM f JOIN g USING (term), s),
q AS MATERIALIZED (SELECT doc_id AS query_id, term FROM p WHERE doc_id % 100 = 0 AND df > 1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= {TERMS}),
b AS MATERIALIZED (SELECT query_id, doc_id, sum(weight)::BIGINT AS score FROM q JOIN p USING (term) WHERE doc_id <> query_id GROUP BY ALL),
words AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b QUALIFY rank <= {TOP})"""
_VECTORS = f"""u AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
r AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.v, b.v) AS c FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
near AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank FROM r QUALIFY rank <= {TOP})"""


def keyword_ranking(documents: DataFrame) -> DataFrame:
    """The ten best texts for the twelve typical terms of each text whose id is divisible by 100."""
    index = retrieval.build(documents)
    return retrieval.search(index, retrieval.typical_terms(index, F.col("doc_id") % 100 == 0, TERMS), TOP)


def vector_ranking(embeddings: DataFrame) -> DataFrame:
    """The ten nearest vectors of each whose id is divisible by 100, without itself."""
    near = vectors.nearest(embeddings, embeddings.where("vec_id % 100 = 0"), TOP + 1).where("vec_id <> query_id")
    last = near.groupBy("query_id").agg(F.collect_list(F.struct("rank", "vec_id")).alias("r"))  # eleven at most
    rows = last.select("query_id", F.posexplode(F.slice(F.array_sort("r"), 1, TOP)).alias("rank", "r"))
    return rows.select("query_id", F.col("r.vec_id").alias("doc_id"), (F.col("rank") + 1).alias("rank"))


@query("r1_keyword_search", f"WITH {_INDEX} SELECT query_id, doc_id, score, rank::INT AS rank FROM words", documents="documents")
def keyword_search(documents: DataFrame) -> DataFrame:
    return keyword_ranking(documents).select("query_id", "doc_id", "score", "rank")


@query(
    "r2_rank_fusion",
    f"""WITH {_INDEX}, {_VECTORS}, e AS (SELECT query_id, doc_id, rank FROM words UNION ALL SELECT query_id, doc_id, rank FROM near),
t AS (SELECT query_id, doc_id, sum(floor(1e9::DOUBLE / (60 + rank))::BIGINT)::BIGINT AS score FROM e GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM t QUALIFY rank <= {TOP}""",
    documents="documents",
    embeddings="embeddings",
)
def rank_fusion(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Both rankings as one; vectors and texts have their ids in common."""
    return retrieval.fused([keyword_ranking(documents), vector_ranking(embeddings)], TOP).select("query_id", "doc_id", "score", "rank")


@query(
    "r3_search_quality",
    f"""WITH {_INDEX}, d AS (SELECT doc_id, lang, source FROM documents),
j AS MATERIALIZED (SELECT a.doc_id AS query_id, b.doc_id, (a.lang = b.lang)::INT + (a.lang = b.lang AND a.source = b.source)::INT AS grade FROM d a JOIN d b ON a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id),
i AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM j WHERE grade > 0 QUALIFY r <= {TOP}),
best AS (SELECT query_id, sum((pow(2.0, grade) - 1) / log2(r + 1)) AS best FROM i GROUP BY query_id),
got AS (SELECT query_id, count(*) AS found, sum((coalesce(grade, 0) > 0)::INT) AS good, sum((pow(2.0, coalesce(grade, 0)) - 1) / log2(rank + 1)) AS dcg FROM words LEFT JOIN j USING (query_id, doc_id) GROUP BY query_id)
SELECT query_id, found, round(good / {TOP}, 6) AS precision, round(CASE WHEN best > 0 THEN dcg / best END, 6) AS ndcg FROM got LEFT JOIN best USING (query_id)""",
    documents="documents",
)
def search_quality(documents: DataFrame) -> DataFrame:
    """Precision and normalised gain of the keyword search: a text of the same language counts 1, of the same source too 2."""
    ranking = keyword_ranking(documents)
    of = documents.select("doc_id", "lang", "source")
    asked = of.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("l"), F.col("source").alias("s"))
    grade = lambda same: F.when(same, 2).otherwise(1)
    grades = ranking.join(asked, "query_id").join(of, "doc_id").where("lang = l").select("query_id", "doc_id", grade(F.col("source") == F.col("s")).alias("grade"))
    sizes = of.groupBy("lang", "source").count()
    ideal = asked.join(sizes, F.col("lang") == F.col("l")).groupBy("query_id", grade(F.col("source") == F.col("s")).alias("grade")).agg(F.sum("count").alias("all"))
    own = asked.select("query_id", F.when(F.col("s").isNull(), 1).otherwise(2).alias("grade"), F.lit(1).alias("self"))
    ideal = ideal.join(own, ["query_id", "grade"], "left").select("query_id", "grade", (F.col("all") - F.coalesce("self", F.lit(0))).alias("n")).where("n > 0")
    return rounded(retrieval.quality(ranking, grades, ideal, TOP))
