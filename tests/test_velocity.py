"""Counts per message inside a stream: equal to the batch windows, whatever the order and deliveries."""

import random

import pytest

from mailsift.operators import windows
from mailsift.streaming import jobs, velocity

NAMES = "ts timestamp, sender string, message string"


@pytest.fixture
def keyed_state(spark):
    spark.conf.set(*velocity.PROVIDER)
    yield
    spark.conf.unset(velocity.PROVIDER[0])


def streamed(spark, folder, batches, window_ms=10_000, lateness="1 hour"):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "s double, sender string, message string").selectExpr(
            "timestamp_millis(CAST(s * 1000 AS LONG)) AS ts", "sender", "message"
        ).coalesce(1).write.parquet(f"{folder}/in/{k}")
        stream = spark.readStream.schema(NAMES).parquet(f"{folder}/in/*")
        counted = velocity.trailing_counts(stream, "ts", "sender", "message", window_ms, lateness)
        jobs.run_available(counted, f"{folder}/progress", velocity.largest_counts(f"{folder}/out"), mode="update")
    return {r.message: r.sender_count for r in spark.read.parquet(f"{folder}/out").collect()}


def batch(spark, rows, window_ms=10_000):
    events = spark.createDataFrame(rows, "s double, sender string, message string").selectExpr(
        "timestamp_millis(CAST(s * 1000 AS LONG)) AS ts", "sender", "message"
    )
    return {r.message: r.sender_count for r in windows.trailing_sender_counts(events, "sender", "message", "ts", window_ms).collect()}


def test_stream_equals_batch_in_any_order(spark, tmp_path, keyed_state):
    rng = random.Random(3)
    rows = [(1000 + rng.randrange(600) / 10, rng.choice("ab"), f"m{i}") for i in range(150)]
    again = rows + rng.sample(rows, 30)
    rng.shuffle(again)
    found = streamed(spark, tmp_path, [again[:100], again[100:]])
    assert found == batch(spark, rows)


def test_late_rows_change_nothing(spark, tmp_path, keyed_state):
    early = [(1000.0 + i, "a", f"m{i}") for i in range(5)]
    found = streamed(spark, tmp_path, [early, [(5000.0, "a", "far")], [(1001.5, "a", "late"), (5001.0, "a", "next")]], lateness="10 seconds")
    assert found == batch(spark, early) | {"far": 1, "next": 2}


def test_many_senders_share_keys(spark, tmp_path, keyed_state):
    """More senders than lanes are counted apart."""
    rows = [(1000 + i % 37 / 10, f"s{i % 300}", f"m{i}") for i in range(900)]
    assert velocity.LANES < 300
    found = streamed(spark, tmp_path, [rows[:500], rows[500:]])
    assert found == batch(spark, rows)
