"""Exact top-k against a plain sort."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mailsift.llm import topk


def brute(rows, every, k=5):
    whole = {}
    usable = [(i, [math.floor(x * 256) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in usable:
        if i % every == 0:
            whole[i] = min(whole.get(i, v), v)
    out = []
    for q, w in whole.items():
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in usable if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,query_block", [(4096, 1024), (7, 3)])
def test_equals_brute_force(spark, block, query_block):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.0, rng.uniform(-1, 1)]) for _ in range(12)]) for i in range(120)]
    rows += [(200 + i, list(rows[7][1])) for i in range(30)] + [(300, None), (310, [1.0, None]), (320, [float("nan")] * 12), (330, [float("inf")])]
    rows += [(340, []), (350, [0.5] * 20), (360, [0.0] * 12), (10, list(rows[10][1])), (None, [1.0] * 12), (400, [1e6] * 12)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("weights", F.lit(1)).withColumn("block", F.lit(2))
    found = topk.top_k(vectors, F.col("vec_id") % 10 == 0, 5, block, query_block)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 10)


def test_few_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(empty, F.col("vec_id") % 2 == 0).collect() == []
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(two, F.col("vec_id") % 2 == 0).collect()] == [(0, 1, 1, 131072)]
