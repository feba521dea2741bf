"""Secret scan with multipart credential linking.

One pass finds the base kinds in each whole text: ``assign`` (a named value),
``access`` (an access identifier), ``hex`` (a long run of hex digits). It also notes
weak parts that mean little alone: ``key`` (40 characters of base 64) and
``endpoint`` (a service address). Weak parts are then linked by interval joins in
Spark: each access identifier has a scope of ``REACH`` code points on either side;
a key is reported if it lies in such a scope, an endpoint if it lies in the scope of
an access identifier and in that of a secret (key, assign or hex). The joins are
semi-joins on (row, bin of positions), so no pairs are made; parts and scopes are in
every bin that they touch.

Positions are code points, ends exclusive. Null text is empty. Repeated rows and
doc_ids give a row each; other columns are kept by ``redact`` and else ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import free, own_columns, read, slices, store

KINDS = ("assign", "access", "hex", "key", "endpoint")
REACH, BIN = 300, 1024
MASK = "[SECRET]"

_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more
_KEY = re.compile("(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
_ADDRESS = re.compile(r"""(?:https?|s3|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+""")
_RUN, _HOST_START, _HOST_END = re.compile("[a-z0-9.-]+"), re.compile(r"\b[a-z0-9]"), re.compile(r"\.amazonaws\.com\b")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the base kinds, sorted."""
    low = text.lower()
    out = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def hosts(text: str) -> list[tuple[int, int]]:
    """(start, end) of the longest host name in each run of its characters; each run is looked at once."""
    ends = [m.span() for m in _HOST_END.finditer(text)]
    out, i = [], 0
    for run in _RUN.finditer(text) if ends else ():
        last = None
        while i < len(ends) and ends[i][0] < run.end():
            last, i = ends[i], i + 1
        if last and (first := _HOST_START.search(text, run.start(), last[0])):
            out.append((first.start(), last[1]))
    return out


def weak_spans(text: str) -> list[tuple[int, int, int]]:
    """Keys and endpoints; only texts with an access identifier can have linked ones."""
    out, reach = [(m.start(), 3, m.end()) for m in _KEY.finditer(text)], 0
    for start, end in sorted([m.span() for m in _ADDRESS.finditer(text)] + hosts(text)):
        if start >= reach:  # not inside an address
            out.append((start, 4, end))
            reach = end
    return sorted(out)


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_SPANS = "array<struct<start:long,kind:int,end:long>>"


def scan(rows: DataFrame) -> DataFrame:
    """``row, doc_id, base, weak`` for each row of ``rows(row, doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, weak = [], []
            for t in batch.column("text").to_pylist():
                base.append(found := base_spans(t))
                weak.append(weak_spans(t) if any(k == 1 for _, k, _ in found) else [])
            as_array = lambda spans: pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans], _SPAN)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), as_array(base), as_array(weak)], ["row", "doc_id", "base", "weak"])

    plain = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"row {plain.schema['row'].dataType.simpleString()}, doc_id long, base {_SPANS}, weak {_SPANS}")


def linked(found: DataFrame) -> DataFrame:
    """Reported weak parts: ``row, linked``, the spans sorted."""
    some = found.where(F.size("weak") > 0)
    parts = store(some.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.*"), "parts")
    a, b = F.col("start"), F.col("end")
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BIN), F.floor(hi / BIN)))
    scope = parts.select("row", "kind", a.alias("lo"), b.alias("hi"), bins(a - REACH, b + REACH).alias("bin"))
    weak = parts.where("kind >= 3")

    def within(left: DataFrame, kinds: list[int]) -> DataFrame:
        right = scope.where(F.col("kind").isin(kinds)).select(F.col("row").alias("r"), F.col("bin").alias("b"), "lo", "hi")
        near = (F.col("start") <= F.col("hi") + REACH) & (F.col("end") >= F.col("lo") - REACH)
        # a part that only touches a scope ends where it starts: the bin of the end counts too
        placed = left.withColumn("bin", bins(a, b))
        return placed.join(right, (F.col("row") == F.col("r")) & (F.col("bin") == F.col("b")) & near, "left_semi").drop("bin").distinct()

    keys = within(weak.where("kind = 3"), [1])
    ends = within(within(weak.where("kind = 4"), [1]), [0, 2, 3])
    return keys.union(ends).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end"))).alias("linked"))


def secrets(rows: DataFrame) -> DataFrame:
    """``row, doc_id, base, spans``: base spans, and these with the linked ones, by start and kind."""
    found = store(scan(rows), "secrets")
    return found.join(linked(found), "row", "left").select(
        "row", "doc_id", "base", F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "linked"))).alias("spans")
    )


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with a mask for each sorted (start, end); overlapping ones share it."""
    out, reach = [], 0
    for start, end in spans:
        if start >= reach:
            out += [text[reach:start], MASK]
        reach = max(reach, end)
    return "".join([*out, text[reach:]]) if out else text


def _mask_base(text: pa.Array) -> pa.Array:
    return pa.array([t and masked(t, [(a, b) for a, _, b in base_spans(t)]) for t in text.to_pylist()], pa.string())


def _mask_given(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([t and masked(t, [(s["start"], s["end"]) for s in own or ()]) for t, own in zip(text.to_pylist(), spans.to_pylist())], pa.string())


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by a mask; overlapping spans share one. Null text stays null; other columns keep their values.

    Only texts with an access identifier can have linked parts: these meet their spans in a
    join, all others are masked where they are read.
    """
    row, at = free(docs, "row"), free(docs, "spans")
    names, text = own_columns(docs), F.col("text").cast("string")
    may_link = F.coalesce(text.contains("AKIA"), F.lit(False))
    plain = docs.where(~may_link).withColumn("text", F.arrow_udf(_mask_base, "string")(text))
    # rows meet their spans by a hash of the text: equal texts have equal spans
    some = docs.where(may_link).select(*names, F.md5("text").alias(row))
    found = secrets(some.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), "text")).where(F.size("spans") > 0)
    hits = store(found.select(F.col("row").alias(row), F.col("spans").alias(at)).dropDuplicates([row]), "spans")
    met = some.join(hits, row, "left").withColumn("text", F.arrow_udf(_mask_given, "string")(text, F.col(at)))
    return plain.select(names).union(met.select(names))


def listed(spans: Column) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",")


def op10_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return secrets(rows).select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
