"""Exact k-means against brute force and SQL."""

import hashlib

import numpy as np
import pytest

from foliate.llm import sort_means as s
from tests.oracle import compare, connect


def brute(rows):
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    x = [v for _, v in kept]
    c = [list(v) for v in x[:40]]

    def assign():
        return [min((sum((p - q) ** 2 for p, q in zip(v, w)), i) for i, w in enumerate(c)) for v in x]

    for _ in range(5):
        at = assign()
        for i in range(len(c)):
            own = [v for v, (_, j) in zip(x, at) if j == i]
            if own:
                c[i] = [sum(z) // len(own) for z in zip(*own)]
    at = assign()
    per = {i: sum(d for d, j in at if j == i) for i in range(len(c))}
    total = sum(per.values())
    return sorted(((i, j, d, per[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, v string, cluster int")


def test_brute_force_with_bad_repeated_and_tied_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 64).round(1)]) for i in range(90)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    bad = [(300, None), (301, []), (302, rows[0][1][:63]), (303, [*rows[0][1], 0.0]), (304, [None, *rows[0][1][1:]]), (305, [float("nan"), *rows[0][1][1:]]), (306, [float("-inf"), *rows[0][1][1:]])]
    # vectors of one or two values: many distances are equal
    rows += [(400 + i, [float(i % 2)] * 64) for i in range(30)]
    got = sorted(map(tuple, s.sort_means(table(spark, rows + bad)).collect()), key=str)
    assert got == brute(rows + bad)


def test_few_rows_none_and_too_large(spark):
    rows = [(i, [i / 7.0] * 64) for i in range(3)]
    got = sorted(map(tuple, s.sort_means(table(spark, rows)).collect()), key=str)
    assert got == brute([(i, [float(np.float32(x)) for x in v]) for i, v in rows]) and {r[2] for r in got} == {0}
    assert s.sort_means(table(spark, rows).limit(0)).count() == 0
    with pytest.raises(Exception, match="2\\*\\*27"):
        s.sort_means(table(spark, [(1, [1e30] * 64)])).collect()


def test_scan_equals_all_distances():
    rng = np.random.default_rng(1)
    for scale in (3, 300, 1 << 25):  # many ties; matrix products; whole numbers only
        x, c = rng.integers(-scale, scale, (500, 64)), rng.integers(-scale, scale, (40, 64))
        if scale == 3:
            x[:, 2:], c[:, 2:] = 0, 0
        every = ((x[:, None] - c[None]) ** 2).sum(2)
        at, d = s.nearest(x, c, rng.integers(0, 40, 500))
        assert (at == every.argmin(1)).all() and (d == every.min(1)).all()


def test_scan_stops_early(monkeypatch):
    rng = np.random.default_rng(2)
    centre = rng.integers(-9999, 9999, (40, 64))
    x = np.repeat(centre, 10, 0) + rng.integers(-3, 4, (400, 64))
    seen, before = [], s.squared
    monkeypatch.setattr(s, "_EXACT", 0)
    monkeypatch.setattr(s, "squared", lambda a, b: seen.append(len(a)) or before(a, b))
    s.nearest(x, centre, np.repeat(np.arange(40), 10))
    assert sum(seen) == 400  # nothing but the own centroid


def test_matches_sql(spark, sf):
    assert compare(spark, connect(sf), s.op11_sort_means, s.ORACLE_SQL, sf) == ""
