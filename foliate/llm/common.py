"""Helpers shared by the operators: reading, scratch tables, hashing, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """A folder below ``spark.checkpoint.dir`` that driver and executors share.

    Where the setting is unset, a local master (tests, a single machine) gets a
    temporary folder; on a cluster that would be a different folder on each machine,
    so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _SCRATCH.get("")
        if base is None:
            base = _SCRATCH[""] = tempfile.mkdtemp(prefix="foliate-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    app = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/foliate-{app}"


class Tables:
    """Stored tables of one step, deleted together once no later plan reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def drop(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths.clear()


_SCOPE: ContextVar[Tables | None] = ContextVar("tables", default=None)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Tables]:
    """Tables that are stored inside are deleted at the end, but those noted elsewhere. Gives the place for these: the scope around, if any."""
    outer, own = _SCOPE.get() or Tables(spark), Tables(spark)
    token = _SCOPE.set(own)
    try:
        yield outer
    finally:
        _SCOPE.reset(token)
        own.drop()


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def store(df: DataFrame, name: str, tables: Tables | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a rerun. The shuffle
    files of the write are not needed afterwards and are deleted with it. ``tables``, or
    else the innermost ``temporary`` scope, notes the table, to drop it before the session ends.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    tables = tables or _SCOPE.get()
    if tables is not None:
        tables.paths.append(path)
    key = "spark.sql.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every stored table of this session."""
    delete(spark, scratch_folder(spark))


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long, ``text`` as string with null as empty, and ``more``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def free(df: DataFrame, name: str) -> str:
    """``name``, or the first of name_1, name_2 ... that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(taken) + 2))) if n.lower() not in taken)


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever their names contain."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = byte_view(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (not copied) and the row offsets into them."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: well-spread 64-bit values from 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random 64-bit value for each byte value, the same in every process.
BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_R = _U(0xD1342543DE82EF95)
_R_INVERSE = _U(pow(0xD1342543DE82EF95, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=_U)


_POWERS = [powers(_R, 1 << 10), powers(_R_INVERSE, 1 << 10)]


def spans_hash(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the codes in each [start, end): differences of one running polynomial."""
    if len(codes) + 1 > len(_POWERS[0]):
        n = 1 << int(len(codes) + 1).bit_length()
        _POWERS[:] = [powers(_R, n), powers(_R_INVERSE, n)]
    with np.errstate(over="ignore"):
        run = np.zeros(len(codes) + 1, _U)
        np.cumsum(codes * _POWERS[0][: len(codes)], dtype=_U, out=run[1:])
        h = (run[ends] - run[starts]) * _POWERS[1][starts]
        return mix(h + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k consecutive values (shorter by k - 1)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _R + h[i : i + n]
    return mix(out)


def words_of(raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes inside a row, and the row's number.

    is_word: for each byte value whether it belongs to words.
    """
    flag = np.zeros(len(raw) + 2, np.int8)
    flag[1:-1] = is_word[raw]
    step = np.diff(flag)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # A run that crosses row borders is cut at each of them.
    inner = offsets[1:-1]
    inner = np.unique(inner[(inner > 0) & (inner < len(raw))])
    if len(inner):
        cut = inner[(flag[inner] == 1) & (flag[inner + 1] == 1)]
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def components(edges: DataFrame, nodes_name: str = "node", label: str = "root") -> DataFrame:
    """Smallest id reachable over undirected ``edges(a, b)``: a row per node that has an edge.

    Union-find as alternating large-star and small-star steps: each step hooks
    neighbours onto the smallest known id, its result is stored in the shared
    folder, and the loop ends when the edges are stars. A hub's neighbours are
    never gathered: both steps are a min-aggregate and a join.
    """
    a, b = F.col("a"), F.col("b")
    now = store(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(b.alias("a"), a.alias("b")))
        # large star: every larger neighbour of a node hooks onto the node's smallest neighbour or itself
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours hook onto the smallest of them
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(small, "a")
        after = linked.select(b.alias("a"), F.col("m").alias("b")).union(linked.select("a", F.col("m").alias("b"))).where(a != b).distinct()
        after = store(after, "edges")
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before, now = sign, after
    roots = now.select(a.alias(nodes_name), b.alias(label))
    return roots.union(now.select(b.alias(nodes_name), b.alias(label)).distinct())
