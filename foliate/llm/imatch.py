"""Document fingerprints by I-Match with randomised lexicons, in DataFrame functions only.

The lexicon holds the terms whose document frequency, over all documents, lies in a
band: neither so common that every text has them nor so rare that they say nothing
about likeness. A document keeps its distinct lexicon terms, sorted; their hash is the
I-Match signature. Random subsets of the lexicon of falling density give further
signatures, which survive edits that touch none of their terms. The likeness of two
fingerprints is the share of equal ones among the subsets that have a term of either.

A text without lexicon terms has its own hash as signature and no subsets; two such
texts are alike (1.0) if the hashes are equal, else not (0.0). Null text is empty.
Documents are ordered by doc_id (null first), rows that repeat one by a hash of the
text; equal rows are one document in this order and get a row each. Other columns are
ignored. The lexicon is bounded: at most (mean distinct terms of a document) / ``LOW``
terms can be that frequent; it is broadcast if its count is below ``BROADCAST_ROWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm.common import read, store, texts

#: The band of document frequency, as shares of all documents; at least 4 documents are allowed.
LOW, HIGH, LEAST_HIGH = 0.0005, 0.005, 4
BROADCAST_ROWS = 2_000_000
#: (subsets, expected share of the lexicon in each as a power of 1/2)
DENSITIES = ((6, 1), (6, 3), (10, 5), (10, 7))
SUBSETS = sum(n for n, _ in DENSITIES)


def terms(text: Column) -> Column:
    """Distinct terms of a text as 64-bit identifiers."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def subset_mask(term: Column) -> Column:
    """Bit k is set if the term belongs to the k-th randomised lexicon."""
    mask, bits, at, used = F.lit(0).cast("long"), None, 0, 0
    for n, power in DENSITIES:  # powers rise: further hashes thin the bits out
        for i in range(used, power):
            one = F.xxhash64(term, F.lit(f"lexicon {i}"))
            bits = one if bits is None else bits.bitwiseAND(one)
        mask = mask.bitwiseOR(bits.bitwiseAND(F.lit(((1 << n) - 1) << at)))
        at, used = at + n, power
    return mask


def lexicon(docs: DataFrame) -> DataFrame:
    """``term`` of the terms in the band."""
    n = docs.count()
    found = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    high = max(LEAST_HIGH, HIGH * n)
    return store(found.where((F.col("df") >= LOW * n) & (F.col("df") <= high)).select("term"), "lexicon")


def signed(sorted_terms: Column) -> Column:
    """``full`` and ``subs`` of sorted lexicon terms; null if there are none. A subset without terms has no hash."""
    marked = F.transform(sorted_terms, lambda t: F.struct(t.alias("term"), subset_mask(t).alias("mask")))

    def subsets(m: Column) -> Column:
        def one(k: Column) -> Column:
            part = F.transform(F.filter(m, lambda t: F.call_function("getbit", t["mask"], k) == 1), lambda t: t["term"])
            return F.when(F.size(part) > 0, F.hash(part))

        return F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), one)

    # the outer array holds the marked terms once, so that no subset marks them again
    subs = F.element_at(F.transform(F.array(marked), subsets), 1)
    return F.when(F.size(sorted_terms) > 0, F.struct(F.xxhash64(sorted_terms).alias("full"), subs.alias("subs")))


def in_lexicon(split: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of ``split(id, h, term)`` with a lexicon term, or none at all.

    Beyond the broadcast, rows without a term meet the lexicon under a hash of their document, so that they are no hot key; one that
    meets a term by chance is kept once, as the others are.
    """
    known = words.select("term", F.lit(True).alias("known"))
    if words.count() <= BROADCAST_ROWS:
        return split.join(F.broadcast(known), "term", "left").where("known or term is null")
    dealt = split.withColumn("key", F.coalesce("term", F.xxhash64("id", "h")))
    return dealt.join(known.withColumnRenamed("term", "key"), "key", "left").where("known or term is null").drop("key")


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints: structs of ``full`` and ``subs``."""
    none = F.array_repeat(F.lit(None).cast("int"), SUBSETS)
    x, y = F.coalesce(a["subs"], none), F.coalesce(b["subs"], none)
    count = lambda cond: F.aggregate(F.zip_with(x, y, lambda p, q: F.when(cond(p, q), 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    either = count(lambda p, q: p.isNotNull() | q.isNotNull())
    same = count(lambda p, q: p == q)
    return F.when(either > 0, same / either).otherwise((a["full"] == b["full"]).cast("double"))


def printed(f: Column) -> Column:
    subs = F.transform(F.coalesce(f["subs"], F.array().cast("array<int>")), lambda s: F.coalesce(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), F.lit("-")))
    return F.concat_ws(".", F.hex(f["full"]), F.array_join(subs, "."))


def following(docs: DataFrame) -> DataFrame:
    """``id, h, n, next_id, next_h``: the next document of each, of the last one the first.

    Ranges of ids are ordered one by one; a table with one row a range links them.
    """
    ids = docs.select("id", "h", F.length("text").alias("n")).distinct()
    ranged = store(ids.repartitionByRange("id", "h").withColumn("part", F.spark_partition_id()), "ranges")
    key = F.struct("id", "h")
    firsts = ranged.groupBy("part").agg(F.min(key).alias("first"))
    after = F.lead("first").over(Window.orderBy("part"))
    start = F.min("first").over(Window.partitionBy())
    firsts = firsts.select("part", F.coalesce(after, start).alias("after"))  # a row for each partition: bounded
    inside = F.lead(key).over(Window.partitionBy("part").orderBy("id", "h"))
    nexts = ranged.withColumn("next", inside).join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("next", "after"))
    return store(nexts.select("id", "h", "n", F.col("next.id").alias("next_id"), F.col("next.h").alias("next_h")), "following")


def keyed(docs: DataFrame) -> DataFrame:
    docs = texts(docs)
    return docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"), "doc_id", "text")


def collected(condition: Column) -> Column:
    return F.array_sort(F.array_distinct(F.collect_list(F.when(condition, F.col("term")))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``id, h, f`` of each distinct document (see ``keyed``); f is null without lexicon terms."""
    docs = keyed(docs)
    none = F.array(F.lit(None).cast("long"))
    split = docs.select("id", "h", F.explode(F.concat(terms(F.col("text")), none)).alias("term"))
    return in_lexicon(split, lexicon(docs)).groupBy("id", "h").agg(collected(F.col("term").isNotNull()).alias("t")).select("id", "h", signed(F.col("t")).alias("f"))


def with_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is the next document's start, and their likeness."""
    docs = keyed(docs)
    words = lexicon(docs)
    nexts = following(docs)
    # both joins deal the texts by (id, h), so they are shuffled once
    plain = docs.select("id", "h", "text")
    half = F.floor(F.col("n") / 2).cast("int")
    other, own = plain.alias("other"), plain.alias("own")
    starts = nexts.join(other, (F.col("other.id") == F.col("next_id")) & (F.col("other.h") == F.col("next_h")))
    starts = starts.select(nexts["id"].alias("i"), nexts["h"].alias("j"), F.substring(F.col("other.text"), F.lit(1), half).alias("start")).groupBy("i", "j").agg(F.first("start").alias("start"))
    n = F.length("own.text")
    edited = own.join(starts, (F.col("own.id") == F.col("i")) & (F.col("own.h") == F.col("j")))
    edited = edited.select("own.id", "own.h", F.col("own.text").alias("text"), F.concat(F.substring(F.col("own.text"), F.lit(1), n - F.floor(n / 2).cast("int")), "start").alias("edited"))

    # a row for each term of either text, and one with the facts
    facts = F.struct(F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), F.xxhash64("edited").alias("eh"))

    def row(v: int, t: Column, f: Column) -> Column:
        return F.struct(F.lit(v).alias("v"), t.cast("long").alias("term"), f.cast("struct<n_chars:long,sha:string,eh:long>").alias("facts"))

    def of(v: int, c: str) -> Column:
        return F.transform(terms(F.col(c)), lambda t: row(v, t, F.lit(None)))

    rows = F.concat(of(0, "text"), of(1, "edited"), F.array(row(2, F.lit(None), facts)))
    split = edited.select("id", "h", F.explode(rows).alias("x")).select("id", "h", "x.*")
    prints = in_lexicon(split, words).groupBy("id", "h").agg(collected(F.col("v") == 0).alias("own"), collected(F.col("v") == 1).alias("new"), F.first("facts", ignorenulls=True).alias("facts"))

    def one(name: str, fallback: Column) -> Column:
        alone = F.struct(fallback.alias("full"), F.lit(None).cast("array<int>").alias("subs"))
        return F.coalesce(signed(F.col(name)), alone).alias(name)

    table = prints.select("id", "h", "facts", one("own", F.col("h")), one("new", F.col("facts.eh")))
    table = store(table, "fingerprints")
    next_own = table.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("own").alias("next"))
    out = table.join(nexts.select("id", "h", "next_id", "next_h"), ["id", "h"]).join(next_own, ["next_id", "next_h"])
    out = docs.select("id", "h", "doc_id").join(out, ["id", "h"])
    return out.select("doc_id", "facts.n_chars", F.col("facts.sha").alias("edited_sha256"), printed(F.col("own")).alias("fingerprint"), printed(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(read(spark, sf_dir, "documents"))
