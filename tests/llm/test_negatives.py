"""Hard negatives against brute force, on odd rows too."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roost.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, score string, tile string, query string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "a", "b", "c") for i, v, label in rows], SCHEMA)


def brute(rows, positives=5, wanted=5):
    usable = []
    for i, vec, label in rows:
        if label is not None and vec and all(x is not None and math.isfinite(x) and abs(x) < 2**54 for x in vec):
            usable.append((i, [math.floor(256.0 * x) for x in vec], label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (anchor, q, label) in enumerate(usable):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(a * b for a, b in zip(q, p, strict=True)), i, other == label) for m, (i, p, other) in enumerate(usable) if m != n and len(p) == len(q)]
        scored = [s for s in scored if abs(s[0]) < 2**63]
        best = sorted([s for s in scored if s[2]], key=order)[:positives]
        for score, positive, _ in best:
            fits = sorted([s for s in scored if not s[2] and 80 * score <= 100 * s[0] <= 100 * score], key=order)[:wanted]
            out += [(anchor, positive, k, s[1], score, s[0]) for k, s in enumerate(fits, 1)]
    return out


def mined(df):
    return [tuple(r) for r in negatives.hard_negatives(negatives.integer_rows(df), F.col("vec_id") % 100 == 0).collect()]


def listed(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("dim", [2, 6])
def test_equals_brute_force_over_several_tiles(spark, dim):
    draw = random.Random(dim)
    rows = [(i, [draw.gauss(0, 1) for _ in range(dim)], draw.randint(0, 3)) for i in range(5000)]
    want = brute(rows)
    assert len(want) > 500 and listed(mined(table(spark, rows).repartition(5))) == listed(want)


def test_odd_rows_copies_and_large_numbers(spark):
    draw = random.Random(4)
    vectors = [[draw.choice([-1.0, 0.0, 0.25, 1.0]) for _ in range(3)] for _ in range(12)]
    rows = [(i % 220, draw.choice(vectors), draw.randint(0, 1)) for i in range(700)]
    rows += [(1000 + i, [0.5, 0.5, 0.5], 1) for i in range(400)]
    rows += [(100, None, 1), (200, [], 1), (300, [0.1, 0.2, 0.3], None), (400, [0.1, None, 0.2], 1), (500, [0.1, float("nan"), 1.0], 0)]
    rows += [(600, [float("inf"), 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 1), (700, [1.0, 0.5], 0), (701, [0.9, 0.5], 0)]
    rows += [(702, [0.9, 0.49], 1), (800, [2.0**40, 3.0, 1.0], 2), (801, [5.0, 1.0, 0.0], 2), (802, [4.9, 2.0**20, 2.0**20], 3), (803, [2.0**50, 1.0, 1.0], 2)]
    want = brute(rows)
    assert {r[0] for r in want} >= {0, 700, 800}
    assert listed(mined(table(spark, rows).repartition(4))) == listed(want)


def test_empty_table_and_lone_labels(spark):
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(0, [1.0, 2.0], 1), (100, [1.0, 2.0], 2)])) == []


def test_packed_order_holds_every_row_and_exact_products():
    points = np.random.default_rng(1).integers(-50, 50, (1000, 3))
    order = negatives.str_order(points, 64, [2, 0])
    assert sorted(order.tolist()) == list(range(1000))
    lo, hi = negatives._boxes(points[order], points[order])
    levels = negatives._levels(1000)
    assert len(lo) == levels[-1] and (lo[-1] == points.min(axis=0)).all() and (hi[-1] == points.max(axis=0)).all()
    for size in (10, 1 << 28, 1 << 61):
        a, b = np.array([[size, -3, 7]]), np.array([[size, size - 1, 5]])
        assert int(negatives.products(a, b)[0, 0]) == size * size - 3 * (size - 1) + 35
