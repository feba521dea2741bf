"""Quality classifier: a sparse ensemble of rules compiled into Spark columns.

1. Statistics of the whole text, each a built-in column expression.
2. A small forest of shallow trees (Spark ML) over a bounded sample of labelled
   rows; every path from a root to an inner node or leaf is a conjunctive rule.
3. A lasso logistic regression over the rules' truth values keeps few of them.
4. The kept rules and weights become one column expression, so scoring is a scan
   with generated code: no Python, no shuffle.

Only labels are learned from; language, source and doc_id are never inputs.
Null and empty texts have zero statistics and are scored like any other text;
repeated rows are scored alike; other columns of the documents stay untouched.
Without labels, or with labels of one class only, the score is that class's
(smoothed) share for every text. A row without doc_id is not learned from, and its
``held_out`` is null.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import free, own_columns, read, store

#: Labelled rows to learn from at most, chosen by a hash of doc_id.
MAX_LABELLED = 8_000
THRESHOLD = 0.7


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics (doubles) of a text."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / n

    words = F.split(F.lower(t), r"[ \n]+")
    lines = F.split(t, "\n")
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "upper": share(r"\p{Lu}"),
        "digits": share("[0-9]"),
        "symbols": share(r"[^\p{L}\p{N}\s.,|!]"),
        "pipes": share(r"\|"),
        "shouts": share("!"),
        "stops": share(r"[.,]"),
        "word_chars": n / F.size(words),
        # a ratio of logarithms: the plain share of distinct words falls with a text's length
        "variety": F.log1p(F.size(F.array_distinct(words)).cast("double")) / F.log1p(F.size(words).cast("double")),
        "line_chars": F.log1p(n / F.size(lines)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is upper bound, threshold)."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self, stat) -> Column:
        out = None
        for name, upper, x in self.tests:
            one = stat(name) <= F.lit(x) if upper else stat(name) > F.lit(x)
            out = one if out is None else out & one
        return out


@dataclass
class RuleModel:
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)
    #: Labelled rows that were learned from.
    labelled: int = 0

    def score(self, stat) -> Column:
        """Probability of label 1; ``stat`` gives the column of a statistic's name."""
        logit = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            logit = logit + F.when(rule.column(stat), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def tree_rules(debug: str, names: list[str]) -> set[Rule]:
    """Every prefix of every path of a printed tree, with the tightest bound for each statistic."""
    rules: set[Rule] = set()
    path: list[tuple[str, bool, float]] = []
    base = None
    for line in debug.splitlines():
        m = re.match(r"( +)(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if not m:
            continue
        depth = len(m[1])  # one blank more a level
        base = depth if base is None else base
        del path[depth - base :]
        path.append((names[int(m[3])], m[4] == "<=", float(m[5])))
        bounds: dict[tuple[str, bool], float] = {}
        for name, upper, x in path:
            old = bounds.get((name, upper))
            bounds[name, upper] = x if old is None else min(old, x) if upper else max(old, x)
        rules.add(Rule(tuple(sorted((n, u, x) for (n, u), x in bounds.items()))))
    return rules


def fit(labelled: DataFrame, trees: int = 24, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Learn from ``labelled(text, label 0/1)``, a bounded table."""
    stats = statistics(F.col("text"))
    names = list(stats)
    rows = store(labelled.select(F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in stats.items()]), "labelled")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return RuleModel(_logit(share), labelled=n)
    # the sample is bounded: one sorted partition makes bagging and the fit repeatable
    rows = rows.coalesce(1).sortWithinPartitions(*names, "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", minInstancesPerNode=5, seed=seed)
    grown = forest.fit(rows.select("label", array_to_vector(F.array(*names)).alias("features")))
    rules = sorted({r for t in grown.trees for r in tree_rules(t.toDebugString, names)}, key=lambda r: (len(r.tests), r.tests))
    if not rules:
        return RuleModel(_logit((ones + 1) / (n + 2)), labelled=n)
    truth = F.array(*[r.column(F.col).cast("double") for r in rules])
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60)
    fitted = lasso.fit(rows.select("label", array_to_vector(truth).alias("features")))
    kept = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray()) if abs(w) > 1e-9]
    return RuleModel(float(fitted.intercept), kept, n)


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> RuleModel:
    """Fit on at most ``limit`` rows of ``labels(doc_id, quality)`` outside the held-out part."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(limit)  # bounded: fit to be broadcast
    return fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "label"))


def with_scores(docs: DataFrame, model: RuleModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``, which replaces one of that name; all others keep their values.

    The statistics are computed once a row, also where a filter on the score follows.
    """
    stats = F.struct(*[c.alias(n) for n, c in statistics(F.col(text)).items()])
    name = free(docs, "stats")
    # a row for each element of an array of one: filters do not pull the statistics through it, once for each rule
    rows = docs.select(*own_columns(docs), F.explode(F.array(stats)).alias(name))
    return rows.withColumn(out, model.score(lambda s: F.col(name)[s])).drop(name)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"))
    return with_scores(docs.select("doc_id", "text"), model).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
