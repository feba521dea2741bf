from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate.llm.packing import best_fit, default_cost, pack

SIZES = (8, 16, 32)


def cost(placed, sizes):
    return sum(default_cost(s, max(sizes)) for s in {b: s for b, _, s in placed}.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 32), max_size=60))
def test_bins_hold_their_contents(lengths):
    placed = pack(lengths, SIZES)
    bins = defaultdict(list)
    for n, (b, o, s) in zip(lengths, placed):
        bins[b].append((o, n, s))
    for items in bins.values():
        at = 0
        for o, n, s in sorted(items):
            assert o == at
            at += n
        assert at <= items[0][2] and items[0][2] == min(x for x in SIZES if x >= at)
    # joint sizes never cost more than the worst single size, and little more than the best
    if lengths:
        assert cost(placed, SIZES) <= cost([(b, o, 32) for b, o, _ in pack(lengths, (32,))], SIZES) + 1e-9


def test_least_cost_bin_is_opened():
    # 20 + 12 fill the largest size; alone, 9 takes the middle one
    assert pack([20, 12], SIZES) == [(0, 0, 32), (0, 20, 32)]
    assert pack([9], SIZES) == [(0, 0, 16)] and pack([], SIZES) == [] and pack([0], SIZES) == [(0, 0, 8)]


def test_every_piece_is_placed_once(spark):
    rows = [(i, "x" * (i * 7 % 90)) for i in range(200)] + [(5, "x" * 35), (300, None), (301, ""), (None, "ab"), (302, "é" * 100)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    got = best_fit(docs, F.octet_length("text"), SIZES, shard=2000).collect()
    total = defaultdict(int)
    for r in got:
        total[r["doc_id"]] += r["length"]
    want = defaultdict(int)
    for i, t in rows:
        want[i] += len((t or "").encode())
    assert total == want and len({r["bin_id"] >> 32 for r in got}) > 2
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append((r["offset"], r["length"], r["bin_size"]))
    for items in bins.values():
        end = 0
        for o, n, s in sorted(items):
            assert o == end
            end += n
        assert end <= s
    assert best_fit(docs.limit(0), F.octet_length("text")).count() == 0


def naive(lengths, sizes, costs):
    """Best fit as the docstring says it, by full scans: every open bin, every permitted size filled with the pieces to come."""
    best = None
    for openers in (sizes[i:] for i in range(len(sizes))):
        todo = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
        bins = []  # [size, used, contents]
        for n, i in enumerate(todo):
            fits = [b for b in bins if b[0] - b[1] >= lengths[i]]
            if fits:
                bin_ = min(fits, key=lambda b: (b[0] - b[1], bins.index(b)))
            else:
                def price(size):
                    used = lengths[i]
                    for j in todo[n + 1 :]:
                        if 0 < lengths[j] <= size - used:
                            used += lengths[j]
                    return costs[size] / max(1, used), size

                bin_ = [min(price(s) for s in openers if s >= lengths[i])[1], 0, []]
                bins.append(bin_)
            bin_[1] += lengths[i]
            bin_[2].append(i)
        total = sum(costs[min(s for s in sizes if s >= used)] for _, used, _ in bins)
        if best is None or total < best[0]:
            best = total, sorted(map(tuple, (b[2] for b in bins)))
    return best or (0, [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 32), max_size=25), st.lists(st.integers(1, 60), min_size=3, max_size=3))
def test_against_naive_best_fit(lengths, prices):
    costs = dict(zip(SIZES, sorted(prices)))
    placed = pack(lengths, SIZES, tuple(costs[s] for s in SIZES))
    total, bins = naive(lengths, SIZES, costs)
    mine = defaultdict(list)
    for i, (b, _, _) in enumerate(placed):
        mine[b].append(i)
    assert sum(costs[s] for s in {b: s for b, _, s in placed}.values()) == total
    assert sorted(sorted(x) for x in mine.values()) == sorted(sorted(x) for x in bins)
