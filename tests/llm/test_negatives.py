"""Hard negatives: packed products, selection against brute force, edge cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracewing.llm import negatives

CLASH = ("key", "c", "a", "id", "rows", "asked", "scores", "l", "of", "at", "place", "rank", "anchor_id", "vector")


def brute_force(rows, positives=5, hard=5, percent=80):
    took = [
        (i, label, [math.floor(x * 256) for x in v])
        for i, label, v in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    result = []
    order = lambda found: sorted(found, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    for anchor, label, vector in {(i, la, tuple(v)) for i, la, v in took if i is not None and i % 10 == 0}:
        scored = [(i, max(min(sum(x * y for x, y in zip(vector, v)), negatives.MOST), negatives.LEAST), la) for i, la, v in took if i != anchor]
        for positive, p, _ in order(r for r in scored if r[2] == label)[:positives]:
            near = [r for r in scored if r[2] != label and percent * p <= 100 * r[1] <= 100 * p]
            result += [(anchor, positive, k, n, p, s) for k, (n, s, _) in enumerate(order(near)[:hard], 1)]
    return sorted(result, key=str)


def mined(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    df = df.withColumns({c: F.lit("clash") for c in CLASH})
    return sorted(map(tuple, negatives.mine(df, F.col("id") % 10 == 0, **sizes).collect()), key=str)


def vectors(n, dim, seed, copies=False):
    chance = random.Random(seed)
    rows = [(i, chance.randrange(3), [chance.randrange(-40, 60) / 64 for _ in range(dim)]) for i in range(n)]
    if copies:  # many equal vectors, so that scores tie
        rows = [(i, label, rows[i % 5][2]) for i, label, _ in rows]
    return rows


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("sizes", [{}, {"candidate_block": 7, "anchor_block": 2}])
def test_equals_brute_force(spark, copies, sizes):
    rows = vectors(120, 6, 3, copies)
    got = mined(spark, rows, **sizes)
    assert got == brute_force(rows) and len(got) > 50


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(40, 4, 9) + [
        (50, None, [1.0] * 4), (51, 1, None), (52, 1, [1.0, None]), (53, 1, [nan]), (54, 1, [inf, 0.0]), (60, 2, []),
        (61, 2, [0.5, 0.5]), (None, 0, [0.25] * 4), (None, 1, [0.3] * 4), (20, 7, [0.5] * 4), (0, 0, [0.5] * 9),
        (70, 9, [0.5] * 4),
    ]
    assert mined(spark, rows) == brute_force(rows)
    assert mined(spark, rows, candidate_block=3, anchor_block=1) == brute_force(rows)
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [(i, 1, [1.0]) for i in range(11)]) == []  # no negatives


def test_repeated_rows(spark):
    rows = vectors(30, 3, 4)
    assert mined(spark, rows + [rows[7]] * 3 + [rows[10]]) == brute_force(rows + [rows[7]] * 3 + [rows[10]])


def test_huge_components(spark):
    rows = [(0, 1, [1e30, -1.0]), (1, 1, [3e37, 2.0]), (2, 2, [2e36, 5.0]), (3, 2, [-3e38, 5.0]), (10, 2, [5e4, 0.5])]
    assert mined(spark, rows) == brute_force(rows)


def test_packed_products_are_exact():
    chance = random.Random(1)
    for size in (1, 3, 200, 70_000, 1 << 33, 1 << 40):
        block = [[chance.randint(-size, size) for _ in range(chance.randrange(1, 7))] for _ in range(9)]
        anchor = [chance.randint(-size, size) for _ in range(6)]
        got = negatives.Packed(block, max(map(abs, anchor))).products(anchor)
        exact = [sum(x * y for x, y in zip(anchor, v)) for v in block]
        assert got.tolist() == [min(max(e, negatives.LEAST), negatives.MOST) for e in exact]


def test_lowest_negative_score():
    for positive in range(-300, 300):
        for percent in (80, 100, 7):
            low = negatives.lowest(positive, percent)
            assert 100 * low >= percent * positive > 100 * (low - 1)
