"""Hard negatives against plain integer products, in any number of tiles, and on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.llm import hardnegatives


def brute(rows, asked):
    """Rows: (vec_id, embedding, label); an anchor's repeats must be equal."""
    usable = [
        (i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out, seen = [], set()
    for anchor, label, vector in usable:
        if not asked(anchor) or anchor in seen:
            continue
        seen.add(anchor)
        scored = sorted((-dot(vector, w), i, other) for i, other, w in usable if i != anchor)
        for negated, positive, _ in [x for x in scored if x[2] == label][:5]:
            best = -negated
            fit = [(i, -s) for s, i, other in scored if other != label and 50 * best <= -100 * s <= 95 * best][:3]
            out += [(anchor, positive, rank, i, best, score) for rank, (i, score) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **sizes):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS weights", "2 AS block", "3 AS row")
    found = hardnegatives.mine(table, F.col("vec_id") % 5 == 0, **sizes).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in found)


def vectors(seed, n=90, dims=11):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, dims))
    rows = []
    for i in range(n):
        label = int(rng.integers(3))
        vector = (centre[label] * 0.7 + rng.normal(size=dims)).astype(np.float32)
        rows.append((i, [float(x) for x in vector], label))
    return rows


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "anchor_block": 3}])
def test_against_brute_force(spark, sizes):
    rows = vectors(1)
    assert mined(spark, rows, **sizes) == brute(rows, lambda i: i % 5 == 0)


def test_ties_and_a_common_vector(spark):
    rows = vectors(2, 40) + [(100 + i, [1.0] * 11, i % 3) for i in range(60)]
    assert mined(spark, rows, block=16, anchor_block=8) == brute(rows, lambda i: i % 5 == 0)


def test_odd_rows(spark):
    odd = [
        (None, [1.0, 2.0], 1), (200, None, 1), (201, [], 1), (202, [float("nan"), 1.0], 1), (203, [None, 1.0], 2), (204, [float("inf")], 0),
        (205, [1.0, 1.0], None), (206, [9.5, 1.0] + [0.5] * 20, 1), (210, [], 0), (211, [3.0], 2), (212, [3.0], 2), (212, [3.0], 2),
    ]
    rows = vectors(3, 50) + odd
    assert mined(spark, rows) == brute(rows, lambda i: i % 5 == 0)


def test_empty_and_too_large(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    with pytest.raises(Exception, match="63 bits"):
        mined(spark, [(0, [2.0**40], 1), (1, [2.0**40], 1), (2, [1.0], 2)])


def test_tables_give_full_products():
    rng = np.random.default_rng(4)
    for bits, dims in ((4, 3), (9, 64), (30, 9), (1, 8)):
        a, b = rng.integers(-(1 << bits), 1 << bits, (5, dims)), rng.integers(-(1 << bits), 1 << bits, (37, dims))
        planes = int(np.abs(b).max()).bit_length() + 1
        codes = hardnegatives.packed(b, planes).transpose(1, 2, 0)
        assert (hardnegatives.scores(codes.astype(np.intp), hardnegatives.subset_sums(a)) == b @ a.T).all()


def test_repeated_anchor_asks_once(spark):
    rows = vectors(6, 30)
    assert mined(spark, [*rows, rows[5]], block=4) == brute([*rows, rows[5]], lambda i: i % 5 == 0)
