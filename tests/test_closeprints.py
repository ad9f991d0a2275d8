"""Fingerprint blocks that meet in tiles: equal to brute force, and no pair of messages leaves a tile."""

import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators import similarity


def drawn(n, seed=5):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(3)]
    values = []
    for _ in range(n):
        value = rng.choice(base)
        for _ in range(rng.randrange(8)):
            value ^= 1 << rng.randrange(64)
        values.append(value - 2**64 if value >= 2**63 else value)
    return values


def apart(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


@pytest.mark.parametrize("block, least", [(131_072, 4096), (37, 10)])
def test_neighbours_equal_brute_force(spark, block, least):
    data = list(enumerate(drawn(400)))
    data += [(1000 + i, data[i % 7][1]) for i in range(30)] + [(-1, 0)]
    frame = spark.createDataFrame(data, "email_id long, fingerprint long")
    found = {r.fingerprint: tuple(r)[1:] for r in similarity.near_duplicate_neighbours(frame, 6, block, least).collect()}
    ids = {}
    for i, value in data:
        if value:
            ids.setdefault(value, []).append(i)
    want = {}
    for a in ids:
        near = [b for b in ids if b != a and apart(a, b) <= 6]
        if near:
            want[a] = (min(ids[a]), len(ids[a]), len(near), sum(len(ids[b]) for b in near), min(apart(a, b) for b in near), min(min(ids[b]) for b in near))
    assert found == want


@pytest.mark.parametrize("block, least", [(131_072, 4096), (29, 7)])
def test_window_counts_equal_brute_force(spark, block, least):
    rng = random.Random(8)
    # Many moments hold several messages, so blocks are cut inside a millisecond too.
    data = [(i, rng.randrange(120) * 10, value) for i, value in enumerate(drawn(300) + [12345] * 80)]
    rows = spark.createDataFrame(data, "email_id long, ms long, fingerprint long")
    found = {r.email_id: r.cluster_size for r in similarity._window_counts(rows, 250, 6, block, least).collect()}
    assert found == {i: sum(0 <= t - u < 250 and apart(a, b) <= 6 for _, u, b in data) for i, t, a in data}


def test_a_crowd_of_close_fingerprints_is_summed_in_its_tiles(spark):
    rows = spark.range(6000).select(F.col("id").alias("email_id"), F.col("id").alias("ms"), F.pmod("id", F.lit(4)).alias("fingerprint"))
    spread = rows.withColumn("fingerprint", F.col("fingerprint") + (F.lit(1).cast("long") * F.shiftleft(F.lit(1).cast("long"), 40)) + F.shiftleft(F.pmod("ms", F.lit(32)), 8))
    counted = similarity._window_counts(spread, 3000, 64)
    assert "BroadcastNestedLoop" not in counted._jdf.queryExecution().toString() and "combo" not in counted._jdf.queryExecution().toString()
    assert {r.email_id: r.cluster_size for r in counted.collect()} == {i: min(i + 1, 3000) for i in range(6000)}
