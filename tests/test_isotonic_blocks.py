"""The isotonic fit by chunks against one pass over all points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.operators import calibration


def one_pass(frame):
    points = frame.groupby("raw")["positive"].agg(["count", "sum"]).sort_index()
    found = calibration.pool(points.index.to_numpy(), points.index.to_numpy(), points["count"].to_numpy(float), points["sum"].to_numpy(float))
    return [(a, b, int(w), t / w) for a, b, w, t, _ in found]


def blocks(spark, frame):
    found = calibration.isotonic_blocks(frame, "raw", "positive").orderBy("low").collect()
    return [(r.low, r.high, r.n, r.value) for r in found]


def test_pool_is_the_max_min_of_means():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 5, 14).astype(float)
    w = rng.integers(1, 4, 14).astype(float)
    x = np.arange(14.0)
    fit = np.concatenate([[t / n] * int(b - a + 1) for a, b, n, t, _ in calibration.pool(x, x, w, y)])
    mean = lambda i, j: y[i : j + 1].sum() / w[i : j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, 14)) for i in range(k + 1)) for k in range(14)]
    assert np.allclose(fit, want)


@pytest.mark.parametrize("rule", ["rand(3) < id / 300000", "rand(3) < 0.5", "id < 1000"])
def test_many_distinct_scores(spark, rule):
    """Rising, flat and falling labels; a falling one pools everything into few blocks across all chunks."""
    frame = spark.range(300_000).select((F.col("id") / 300_000).alias("raw"), F.expr(f"CAST({rule} AS INT)").alias("positive")).checkpoint()
    assert blocks(spark, frame) == one_pass(frame.toPandas())


def test_ties_nulls_and_nothing(spark):
    rows = [(0.5, 1), (0.5, 0), (0.2, 1), (None, 1), (0.9, None), (0.7, 1)]
    frame = spark.createDataFrame(rows, "raw double, positive int")
    assert blocks(spark, frame) == [(0.2, 0.5, 3, 2 / 3), (0.7, 0.7, 1, 1.0)]
    assert blocks(spark, frame.filter("false")) == []
