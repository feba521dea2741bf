"""Near-duplicate grouping by SuperMinHash, banding, verification and union-find.

1. One pass hashes each text's word shingles, counts the distinct ones and draws a
   SuperMinHash signature: element by element a random permutation is revealed rank
   by rank, and a document's elements stop as soon as no later rank can lower it.
2. Documents with the same set are one class; only its smallest id goes on.
3. Bands of the signature are buckets. Every member of a bucket is verified on full
   sets against the bucket's smallest id, not against every other member. Where the
   rest of a bucket lies in several components, it is cut into a few parts of a bounded
   size, and each pair of parts is a block whose documents are compared across components
   in one task: texts meet by block, no pairs are made. Of buckets with the same members
   one is compared. Documents of rests with more than ``PARTS`` parts (many that share a
   band and little else) get new buckets first: each set's rarest shingles, as many as any
   similar set must share one of. What is left open in these is compared by parts.
4. Verified links are joined to components by union-find steps on tables.

No bucket is gathered in one task: smallest members are aggregates, members meet
them in joins that adaptive execution can split; members of large classes of equal sets
meet theirs in a broadcast, as long as these classes are few (counted first). With the chosen bands a link at
exactly the threshold is missed with a probability below 1e-6.

Null text, or one without words: empty set, linked with nothing, a component of its
own. Rows that repeat a doc_id are one document with several sets. A row without
doc_id is linked with nothing and kept; its component is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm.common import BYTE_CODES, LOWER, Tables, byte_view, components, grams, mix, read, slices, spans_hash, store, temporary, texts, words_of

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
#: Bytes of words: all but blank and U+0009 to U+000D.
WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Values of a signature at most; documents and shingles of one part of a bucket's rest (about).
WIDTH, BLOCK, BLOCK_SHINGLES = 128, 1024, 1 << 19
#: Documents of a shingle, or of a class of equal sets, from which on it is large; rows of these that are broadcast at most.
LARGE, BROADCAST_ROWS = 64, 500_000
#: Parts of a rest at most that are compared as pairs of parts at once; each text is then copied so often.
PARTS = 8


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each k-word shingle; of a shorter text, of its whole sequence."""
    low = LOWER[raw]
    starts, ends, rows = words_of(low, offsets, WORD)
    h = spans_hash(BYTE_CODES[low], starts, ends)
    if not len(h):
        return h, rows
    g = grams(h, k)
    inside = rows[: len(g)] == rows[k - 1 :] if len(g) else np.zeros(0, bool)
    out, out_rows = [g[inside]], [rows[: len(g)][inside]]
    words = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.cumsum(words) - words
    for n in range(1, k):
        short = np.flatnonzero(words == n)
        if len(short):
            with np.errstate(over="ignore"):
                value = np.full(len(short), n, _U)
                for i in range(n):
                    value = value * _GOLD + h[first[short] + i]
            out.append(mix(value))
            out_rows.append(short)
    return np.concatenate(out), np.concatenate(out_rows)


def distinct(h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash): a key of both, the hash, the row; sorted by key."""
    with np.errstate(over="ignore"):
        key = mix(h + rows.astype(_U) * _GOLD)
    key, at = np.unique(key, return_index=True)
    return key, h[at], rows[at]


def sets_of(text: pa.Array, k: int, limit: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``distinct`` shingles of a column of texts, about ``limit`` bytes of them at a time."""
    parts, done = [(np.zeros(0, _U), np.zeros(0, _U), np.zeros(0, np.int64))], 0
    for batch in slices(iter([pa.RecordBatch.from_arrays([text], ["text"])]), "text", limit):
        h, rows = shingles(*byte_view(batch.column("text")), k)
        parts.append(distinct(h, rows + done))
        done += batch.num_rows
    return tuple(map(np.concatenate, zip(*parts)))


def superminhash(h: np.ndarray, rows: np.ndarray, n: int, m: int = WIDTH) -> np.ndarray:
    """Signatures (n x m, uint32) of n sets; an element's value in slot p is its rank j of p, then a random fraction.

    A row takes part in round j only while some of its slots could still go below rank j.
    """
    sig = np.full((n, m), np.iinfo(np.uint32).max, np.uint32)
    flat = sig.reshape(-1)
    order = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1))
    at = np.arange(len(h))
    with np.errstate(over="ignore"):
        for j in range(m):
            if not len(at):
                break
            rnd = mix(h[at] + _U(j + 1) * _GOLD)
            k = j + (((rnd & _U(0xFFFFFF)) * _U(m - j)) >> _U(24)).astype(np.int64)
            slot = order[at, k]
            order[at, k] = order[at, j]
            value = (_U(j) << _U(24) | rnd >> _U(40)).astype(np.uint32)
            np.minimum.at(flat, rows[at] * m + slot, value)
            if j < 8 or j % 8 == 0:
                open_ = sig.max(1) >= np.uint32((j + 1) << 24)
                at = at[open_[rows[at]]]
    return sig


def banding(threshold: float, miss: float = 1e-6, m: int = WIDTH) -> tuple[int, int]:
    """Bands and rows of a band: the most rows at which a link at the threshold is missed with a probability below ``miss``."""
    fit = [(m // r, r) for r in range(1, m) if (1 - threshold**r) ** (m // r) < miss]
    return fit[-1] if fit else (m, 1)


def signed(docs: DataFrame, k: int, bands: int, rows_a_band: int) -> DataFrame:
    """``doc_id, n_shingles, s1, s2`` (the set's identity) and its ``bands``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            n = batch.num_rows
            h, rows = shingles(*byte_view(batch.column("text")), k)
            _, h, rows = distinct(h, rows)
            sig = np.full((n, bands * rows_a_band), np.iinfo(np.uint32).max, np.uint32)
            for i in range(0, len(h), 1 << 17):  # a very long text takes several blocks
                np.minimum(sig, superminhash(h[i : i + (1 << 17)], rows[i : i + (1 << 17)], n, bands * rows_a_band), out=sig)
            size = np.bincount(rows, minlength=n)
            ident = np.zeros((2, n), _U)
            with np.errstate(over="ignore"):
                np.add.at(ident[0], rows, h)
                np.add.at(ident[1], rows, mix(h + _GOLD))
                value = np.zeros((n, bands), _U)
                for i in range(rows_a_band):
                    value = mix(value * _GOLD + sig[:, i::rows_a_band].astype(_U))
                value = mix(value + np.arange(1, bands + 1, dtype=_U) * _GOLD).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(value.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(ident[0].view(np.int64)), pa.array(ident[1].view(np.int64)), lists], ["doc_id", "n_shingles", "s1", "s2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def verified(pairs: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * |A and B| >= percent * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "text_b", 1 << 19):
                n = batch.num_rows
                sizes, keys, rows = [], [], None
                for c in ("text_a", "text_b"):
                    key, _, rows = distinct(*shingles(*byte_view(batch.column(c)), k))
                    keys.append(key)
                    sizes.append(np.bincount(rows, minlength=n))
                _, _, at = np.intersect1d(*keys, assume_unique=True, return_indices=True)
                both = np.bincount(rows[at], minlength=n)
                ok = 100 * both >= percent * (sizes[0] + sizes[1] - both)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok))

    left, right = held.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), held.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def compared(blocks: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) in each block of ``blocks(bucket, i, j, part, doc, root, text)``: between parts i and j, or inside part i = j.

    A block has a bounded number of documents; each is compared with all others of another component at once.
    """

    def run(block: pa.Table) -> pa.Table:
        text = block.column("text").combine_chunks()
        doc, root, part = (block.column(c).to_numpy() for c in ("doc", "root", "part"))
        inside = block.column("i")[0] == block.column("j")[0]
        _, h, rows = sets_of(text, k)
        order = np.argsort(rows, kind="stable")
        values, ids = np.unique(h[order], return_inverse=True)
        size = np.bincount(rows, minlength=len(doc))
        starts = np.cumsum(size) - size
        roots, of_root = np.unique(root, return_inverse=True)
        largest = np.bincount(of_root).argmax()  # pairs inside a component are known
        mark, a, b = np.zeros(len(values), np.int32), [], []
        for x in np.flatnonzero(of_root != largest):
            own = ids[starts[x] : starts[x] + size[x]]
            mark[own] = 1
            both = np.where(size > 0, np.add.reduceat(np.append(mark[ids], 0), starts), 0)
            mark[own] = 0
            ok = (100 * both >= percent * (size[x] + size - both)) & (root != root[x])
            if not inside:
                ok &= part != part[x]
            found = doc[ok]
            a.append(np.minimum(found, doc[x]))
            b.append(np.maximum(found, doc[x]))
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return blocks.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long").distinct()


def near_labels(found: DataFrame) -> DataFrame:
    """``doc, root``: the smallest id within two links, not always of the whole component."""
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    one = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(one.select(F.col("a").alias("b"), "m"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("m").alias("root"))


def few(df: DataFrame) -> bool:
    return df.count() <= BROADCAST_ROWS


def meet(rows: DataFrame, groups: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their group in ``groups(key, n, ...)``, a stored table; rows of large groups meet it in a broadcast, so that no task has all of one."""
    large = groups.where(F.col("n") > LARGE)
    if not few(large):
        return rows.join(groups, key, how)
    large = F.broadcast(large)
    small = rows.join(large.select(key), key, "left_anti").join(groups.where(F.col("n") <= LARGE), key, how)
    return rows.join(large, key).unionByName(small)


def with_pivots(members: DataFrame) -> DataFrame:
    """``bucket, doc, n_shingles, pivot``: members of the buckets of several, and the smallest one."""
    first = store(members.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "pivots")
    return store(meet(members, first, ["bucket"]).drop("n"), "members")


def to_pivots(members: DataFrame, held: DataFrame, k: int, percent: int) -> DataFrame:
    """The verified links of members to the smallest one of their bucket."""
    pairs = members.where("doc > pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct()
    return store(verified(pairs, held, k, percent), "links")


def open_buckets(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of the buckets, ``bucket, doc, root``, and those whose rest lies in several components, ``bucket, parts``; of equal ones, one."""
    rest = members.where("doc <> pivot").join(near_labels(found), "doc", "left").select("bucket", "doc", F.coalesce("root", "doc").alias("root"), "n_shingles")
    rest = store(rest, "rest")
    h = F.xxhash64("doc")
    open_ = rest.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1))).alias("s")).where("low < high")
    open_ = open_.groupBy("n", "m", "x", "s").agg(F.min("bucket").alias("bucket"))
    open_ = open_.select("bucket", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("m") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    return rest, store(open_, "open")


def blocks_of(rest: DataFrame, open_: DataFrame, held: DataFrame) -> DataFrame:
    """The texts of each pair of parts of each open bucket."""
    part = F.pmod(F.xxhash64("doc", "bucket"), F.col("parts")).cast("int")
    dealt = rest.drop("n_shingles").join(open_, "bucket").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc", "root")
    return dealt.join(held.select(F.col("doc_id").alias("doc"), "text"), "doc")


def rare_shingles(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Members ``bucket, doc, n_shingles``: the first shingles of each set, rare ones first, so many that similar sets have one in common.

    Of two sets with the similarity each has at least ``percent`` of its own in common
    with the other; so they share one among all but that many of it, in any order that
    holds for all sets. Only frequent shingles need a count for the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 19):
            _, h, rows = distinct(*shingles(*byte_view(batch.column("text")), k))
            size = np.bincount(rows, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("doc_id").take(pa.array(rows)), pa.array(size[rows].astype(np.int64))], ["bucket", "doc", "n_shingles"])

    all_ = store(docs.select("doc_id", "text").mapInArrow(run, "bucket long, doc long, n_shingles long"), "shingles")
    frequent = store(all_.groupBy("bucket").count().where(F.col("count") > LARGE), "frequent")
    counted = all_.join(F.broadcast(frequent) if few(frequent) else frequent, "bucket", "left")
    order = Window.partitionBy("doc").orderBy(F.coalesce("count", F.lit(0)), "bucket")
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select("bucket", "doc", "n_shingles")


def links(classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes: enough of them to give the components of all links."""
    members = with_pivots(classes.select(F.explode("bands").alias("bucket"), F.col("rep").alias("doc"), "n_shingles"))
    held = store(docs.join(members.select(F.col("doc").alias("doc_id")).distinct(), "doc_id"), "candidates")
    found = to_pivots(members, held, k, percent)
    rest, open_ = open_buckets(members, found)
    small, large = open_.where(F.col("parts") <= PARTS), open_.where(F.col("parts") > PARTS)
    out = found.union(compared(blocks_of(rest, small, held), k, percent))
    if not large.isEmpty():
        ids = store(rest.join(large, "bucket").select(F.col("doc").alias("doc_id")).distinct(), "crowded")
        crowd = store(held.join(ids, "doc_id"), "crowd")
        members = with_pivots(rare_shingles(crowd, k, percent))
        more = to_pivots(members, crowd, k, percent)
        rest, open_ = open_buckets(members, found.union(more))
        out = out.union(more).union(compared(blocks_of(rest, open_, crowd), k, percent))
    return store(out, "links")


def grouped(docs: DataFrame, shingle: int, percent: int, key: list[str], kept: Tables) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and ``key, n, root`` of each class of equal sets, as tables of ``kept``."""
    bands, rows_a_band = banding(percent / 100)
    table = store(signed(docs, shingle, bands, rows_a_band), "signed", kept)
    real = table.where("n_shingles > 0 and doc_id is not null")
    reps = store(real.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "classes")
    classes = real.join(reps.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"]).select(F.col("doc_id").alias("rep"), "bands", "n_shingles")
    found = links(classes, docs.where("doc_id is not null"), shingle, percent)
    # a doc_id with several sets ties their classes together
    twice = real.groupBy("doc_id").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).where("low < high").select("doc_id")
    repeated = real.join(twice, "doc_id").join(reps, key).groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("all"))
    found = found.union(repeated.select("a", F.explode("all").alias("b")).where("a < b"))
    roots = components(found, "rep", "root")
    return table, store(reps.join(roots, "rep", "left").select(*key, "n", F.coalesce("root", "rep").alias("root")), "roots", kept)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``."""
    docs = texts(docs)
    key = ["s1", "s2", "n_shingles"]
    with temporary(docs.sparkSession) as kept:  # what the result does not read is deleted
        table, class_roots = grouped(docs, shingle, percent, key, kept)
    out = meet(table, class_roots, key, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS m FROM d UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(m) AS component_id, r.doc_id = min(m) AS kept FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
