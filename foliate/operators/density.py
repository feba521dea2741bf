"""Density clusters (DBSCAN) of vectors under cosine distance, exact.

Equal vectors are one with a weight, so a group of copies makes no pairs. Unit vectors
are points whose squared distance is twice their cosine distance; each belongs to the
cell of its nearest pivot. A point is compared with the points of another cell only if
these can be near: the triangle inequality bounds the distance by the cell's radius, and
the plane between two pivots bounds it from below. Of two cells the point of the lower
one visits the higher. Cells of many points, and their visitors, are cut into blocks of
bounded size, and a task compares one block with one part of its visitors.

Blocks return no pairs: the first pass returns weights of neighbours for each point, the
second, which knows the core points, a forest of links among the core points of the
block (at most one a point) and the core neighbours of other points, of which each has
fewer than ``min_samples``. Components of the links are found on tables.

How many visits are spared depends on the data: clusters apart from each other meet only
themselves, while points without any structure in many dimensions are all near every
cell, and the work is that of all pairs in blocks (``visits`` gives the count).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.operators.graphs import components, cut

#: Points of a block, visitors that meet it in one task, and pivots at most (sent to all tasks).
BLOCK, VISITORS, PIVOTS = 2048, 8192, 2048
#: Blocks grow with the points to the size for which there are so many, up to so many times the points and visitors above: fewer copies are sent.
BLOCKS, LARGEST = 32, 8
#: Visitors and pairs of a matrix at most, points that choose their visits together, and rows of a batch that is sent.
_ROWS, _PAIRS, _POINTS, _SENT = 1024, 2_000_000, 2048, 8192


def block_sizes(count: int) -> tuple[int, int]:
    """Points of a block and visitors of a task for so many points."""
    times = min(LARGEST, max(1, -(-count // (BLOCK * BLOCKS))))
    return BLOCK * times, VISITORS * times


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def distinct_vectors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``vec_id, id`` of every row, and ``id, n, u`` of the different vectors: the smallest vec_id, how many rows, the unit vector.

    id is null for vectors that have no direction: null, with null or not finite components, or of length 0.
    """
    x = F.col("embedding")
    sound = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(sound, x).alias("x"))
    groups = cut(rows.where("x is not null").groupBy("x").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")))
    of = rows.where("x is not null").join(groups, "x").select("vec_id", "id").union(rows.where("x is null").select("vec_id", F.lit(None).cast("long")))
    square = F.aggregate("x", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    length = F.sqrt(square)
    return of, groups.select("id", "n", F.transform("x", lambda e: e.cast("double") / length).alias("u"))


def in_cells(points: DataFrame, eps: float) -> tuple[DataFrame, DataFrame]:
    """Home rows ``cell, slice, part, id, n, u`` and visitor rows (with ``own``: is it at home in that slice), to be met by (cell, slice, part)."""
    dims = points.select(F.size("u").alias("d")).groupBy("d").count().collect()
    if len(dims) > 1:
        raise ValueError("vectors of several lengths")
    count = dims[0]["count"] if dims else 0
    block, most = block_sizes(count)
    wanted = min(PIVOTS, max(1, -(-count // block)))
    pivots = np.array([r["u"] for r in points.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()], np.float64)
    chord = float(np.sqrt(2 * eps))

    def homes(batches):
        for batch in batches:
            if batch.num_rows:
                u = _matrix(batch.column("u"))
                d = np.sqrt(np.maximum(0, 2 - 2 * u @ pivots.T))
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["id", "n", "u", "cell", "far"])

    placed = cut(points.select("id", "n", "u").mapInArrow(homes, "id long, n long, u array<double>, cell int, far double"))
    sizes = {r["cell"]: (r["size"], r["radius"]) for r in placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("far").alias("radius")).collect()}
    slices = np.array([max(1, -(-sizes.get(c, (0, 0))[0] // block)) for c in range(len(pivots))])
    radius = np.array([sizes.get(c, (0, -9.0))[1] for c in range(len(pivots))])
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T)) if len(pivots) else np.zeros((0, 0))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("id"), F.element_at(F.array(*map(F.lit, slices.tolist() or [1])), F.col("cell") + 1)).cast("int"))

    def visits(batches):
        slack = 1e-9
        for batch in (b.slice(at, _POINTS) for b in batches for at in range(0, b.num_rows, _POINTS)):
            u, home, own_slice = _matrix(batch.column("u")), batch.column("cell").to_numpy(), batch.column("slice").to_numpy()
            d = np.sqrt(np.maximum(0, 2 - 2 * u @ pivots.T))
            near = d[np.arange(len(d)), home][:, None]
            apart = between[home]
            plane = np.where(apart > 0, (d * d - near * near) / (2 * np.where(apart > 0, apart, 1)), 0)
            go = (d <= chord + radius + slack) & (plane <= chord + slack) & (np.arange(len(pivots)) > home[:, None])
            row, cell = np.nonzero(go)
            row, cell = np.repeat(row, slices[cell]), np.repeat(cell, slices[cell])
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1]))) if len(row) else np.zeros(0, int)
            number = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            # the slices of the own cell from the own one on
            later = slices[home] - own_slice
            mine = np.repeat(np.arange(len(home)), later)
            number_mine = np.arange(len(mine)) - np.repeat(np.cumsum(later) - later, later) + own_slice[mine]
            row, cell = np.concatenate([row, mine]), np.concatenate([cell, home[mine]])
            number = np.concatenate([number, number_mine])
            own = (cell == home[row]) & (number == own_slice[row])
            for at in range(0, len(row), _SENT):
                some = slice(at, at + _SENT)
                take = pa.array(row[some])
                yield pa.RecordBatch.from_arrays([pa.array(cell[some].astype(np.int32)), pa.array(number[some].astype(np.int32)), pa.array(own[some]), *(batch.column(c).take(take) for c in ("id", "n", "u"))], ["cell", "slice", "own", "id", "n", "u"])

    going = placed.select("id", "n", "u", "cell", "slice").mapInArrow(visits, "cell int, slice int, own boolean, id long, n long, u array<double>")
    parts = {(r["cell"], r["slice"]): -(-r["count"] // most) for r in going.groupBy("cell", "slice").count().collect()} if count > most else {}
    widest = max(parts.values(), default=1)
    number_of = F.lit(1)
    if widest > 1:
        spark = points.sparkSession
        table = F.broadcast(spark.createDataFrame([(c, s, int(n)) for (c, s), n in parts.items()], "cell int, slice int, parts int"))
        going, placed, number_of = going.join(table, ["cell", "slice"]), placed.join(table, ["cell", "slice"]), F.col("parts")
    visitors = going.select("cell", "slice", F.pmod(F.xxhash64("id"), number_of).cast("int").alias("part"), "own", "id", "n", "u")
    at_home = placed.select("cell", "slice", F.explode(F.sequence(F.lit(0), (number_of - 1).cast("int"))).alias("part"), "id", "n", "u")
    return at_home, visitors


def near_in_block(home: pa.Table, visitors: pa.Table, eps: float):
    """(first visitor, neighbours) for some visitors at a time: a matrix of booleans, visitors x home, each pair of points once."""
    h, ids = _matrix(home.column("u")), home.column("id").to_numpy()
    v, visitor_ids, own = _matrix(visitors.column("u")), visitors.column("id").to_numpy(), visitors.column("own").to_numpy(zero_copy_only=False)
    rows = min(_ROWS, max(1, _PAIRS // len(h)))
    for at in range(0, len(v), rows):
        near = v[at : at + rows] @ h.T >= 1 - eps
        here = np.flatnonzero(own[at : at + rows])
        near[here] &= visitor_ids[at + here, None] < ids
        yield at, near


def neighbour_weights(home: DataFrame, visitors: DataFrame, eps: float) -> DataFrame:
    """``id, near``: for each point the rows within ``eps`` of it, without its own copies."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.int64())})
        n, m = left.column("n").to_numpy(), right.column("n").to_numpy()
        of_home, of_visitors = np.zeros(len(n), np.int64), np.zeros(len(m), np.int64)
        for at, near in near_in_block(left, right, eps):
            i, j = np.nonzero(near)
            np.add.at(of_visitors, at + i, n[j])
            np.add.at(of_home, j, m[at + i])
        ids, near = np.concatenate([left.column("id").to_numpy(), right.column("id").to_numpy()]), np.concatenate([of_home, of_visitors])
        return pa.table({"id": ids[near > 0], "near": near[near > 0]})

    key = ("cell", "slice", "part")
    return home.groupBy(*key).cogroup(visitors.groupBy(*key)).applyInArrow(run, "id long, near long").groupBy("id").agg(F.sum("near").alias("near"))


def core_links(home: DataFrame, visitors: DataFrame, eps: float) -> DataFrame:
    """``a, b, core``: links of a forest of the block's core points, and (core false) from other points ``a`` to their core neighbours ``b``. Rows have ``core``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, both = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        if left.num_rows and right.num_rows:
            ids, visitor_ids = left.column("id").to_numpy(), right.column("id").to_numpy()
            core, visitor_core = (t.column("core").to_numpy(zero_copy_only=False) for t in (left, right))
            root = ids.copy()  # of each home point; a forest over all visitors
            for at, near in near_in_block(left, right, eps):
                here, here_core = visitor_ids[at : at + len(near)], visitor_core[at : at + len(near)]
                i, j = np.nonzero(near & (here_core[:, None] != core))
                outer = ~here_core[i]
                a.append(np.where(outer, here[i], ids[j]))
                b.append(np.where(outer, ids[j], here[i]))
                both.append(np.zeros(len(i), bool))
                near &= here_core[:, None] & core
                used = near.any(1)
                near, here = near[used], here[used]
                top = np.iinfo(np.int64).max
                start, low = root.copy(), here.copy()
                while len(near):  # smallest id over the block's links
                    low = np.minimum(low, np.where(near, root, top).min(1))
                    now = np.minimum(root, np.where(near, low[:, None], top).min(0))
                    if (now == root).all():
                        break
                    root = now
                for x, y in ((here, low), (start, root)):  # each root was once the point itself: the links of roots hold all home points
                    on = x != y
                    x, y = np.unique(np.stack([x[on], y[on]]), axis=1)
                    a.append(x)
                    b.append(y)
                    both.append(np.ones(len(x), bool))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "core": np.concatenate(both)})

    key = ("cell", "slice", "part")
    return home.groupBy(*key).cogroup(visitors.groupBy(*key)).applyInArrow(run, "a long, b long, core boolean").distinct()


def visits(df: DataFrame, eps: float) -> int:
    """How many rows of vectors the join sends to blocks."""
    return in_cells(distinct_vectors(df)[1], eps)[1].count()


def density_clusters(df: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``vec_id, cluster, is_core, neighbours`` of each row of ``df(vec_id, embedding)``.

    neighbours: rows within ``eps`` cosine distance, itself included; core: ``min_samples`` of
    these or more. cluster: the smallest vec_id of a core point of the cluster; a point that
    is no core belongs to the first cluster with a core point near it; null for noise.
    Vectors without direction are noise without neighbours. vec_ids are unique.
    """
    of, points = distinct_vectors(df)
    points = cut(points)
    home, visitors = in_cells(points, eps)
    near = neighbour_weights(home, visitors, eps)
    counted = points.select("id", "n").join(near, "id", "left").select("id", (F.col("n") + F.coalesce("near", F.lit(0))).alias("neighbours"))
    known = cut(counted.select("id", "neighbours", F.expr(f"neighbours >= {int(min_samples)}").alias("core")))
    # aliased: the two sides of a cogroup must not share columns
    flagged = lambda rows: rows.join(known.select("id", F.col("core").alias("is_core")), "id").withColumn("core", F.col("is_core")).drop("is_core")
    links = cut(core_links(flagged(home), flagged(visitors), eps))
    cores = known.where("core").select("id")
    rooted = cut(components(links.where("core").select("a", "b").union(cores.select(F.col("id").alias("a"), F.col("id").alias("b")))))
    border = links.where("not core").select(F.col("a").alias("point"), F.col("b").alias("id")).join(rooted, "id").groupBy("point").agg(F.min("component").alias("cluster"))
    labels = rooted.select("id", F.col("component").alias("cluster")).union(border)
    found = known.join(labels, "id", "left")
    return of.join(found, "id", "left").select("vec_id", "cluster", F.coalesce("core", F.lit(False)).alias("is_core"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))
