"""The key ledger: exact answers, and parts that a batch cannot meet are left unread."""

from __future__ import annotations

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from mailsift.operators import feedback
from mailsift.sources import ledger
from mailsift.streaming import jobs

SHAPE = "k long, v string, n int"


def _frame(spark, data):
    return spark.createDataFrame(data, SHAPE)


def _parts(spark, keys, parts=8):
    placed = ledger._placed(_frame(spark, [(k, "", 0) for k in keys]), ["k"], parts)
    return {r["k"]: r["part"] for r in placed.collect()}


def test_random_batches_equal_a_set(spark, tmp_path):
    path, rng, held = str(tmp_path / "l"), random.Random(5), {}
    for number in range(4):
        batch = [(rng.randrange(60), f"{number}", i) for i in range(50)]
        ledger.insert(_frame(spark, batch), path, ["k"], ["n"], 4)
        for k, v, n in batch:
            held.setdefault(k, (v, n))
        found = {r["k"]: (r["v"], r["n"]) for r in ledger.rows(spark, path).collect()}
        assert found == held and ledger.rows(spark, path).count() == len(held)


def test_untouched_parts_are_not_read(spark, tmp_path):
    path = str(tmp_path / "l")
    ledger.insert(_frame(spark, [(k, "old", 0) for k in range(200)]), path, ["k"], ["n"], 8)
    part = _parts(spark, range(400))
    broken = part[0]
    for file in glob.glob(f"{path}/part={broken}/*.parquet"):
        checksum = os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc")
        os.remove(checksum)
        with open(file, "wb") as out:
            out.write(b"not a table")
    elsewhere = [k for k in range(400) if part[k] != broken]
    found = ledger.unseen(_frame(spark, [(k, "new", 1) for k in elsewhere]), path, ["k"], ["n"], 8).collect()
    assert sorted(r["k"] for r in found) == [k for k in elsewhere if k >= 200]
    # New keys of the broken part are told by its sketch alone, a stored one has to be looked up.
    inside = [(k, "new", 1) for k in range(200, 400) if part[k] == broken]
    assert inside and len(ledger.unseen(_frame(spark, inside), path, ["k"], ["n"], 8).collect()) == len(inside)
    with pytest.raises(Exception, match="(?i)parquet"):
        ledger.unseen(_frame(spark, [(0, "new", 1)]), path, ["k"], ["n"], 8).collect()


def test_full_sketches_cost_reads_and_no_answers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "SKETCH_BITS", 2)
    path = str(tmp_path / "l")
    ledger.insert(_frame(spark, [(k, "old", 0) for k in range(0, 100, 2)]), path, ["k"], ["n"], 2)
    found = ledger.unseen(_frame(spark, [(k, "new", 1) for k in range(100)]), path, ["k"], ["n"], 2).collect()
    assert sorted(r["k"] for r in found) == list(range(1, 100, 2))


def test_a_sketch_without_its_rows_hides_nothing(spark, tmp_path):
    path = str(tmp_path / "l")
    batch = _frame(spark, [(k, "a", k) for k in range(20)])
    ledger.insert(batch.filter("k < 5"), path, ["k"], ["n"], 4)
    lost = ledger._sketches(ledger._placed(batch, ["k"], 4))
    lost.write.mode("append").partitionBy("part").parquet(ledger.sketch_path(path))
    ledger.insert(batch, path, ["k"], ["n"], 4)
    assert sorted(r["k"] for r in ledger.rows(spark, path).collect()) == list(range(20))


def test_nulls_ties_empty_batches_and_clashing_columns(spark, tmp_path):
    path = str(tmp_path / "l")
    ledger.insert(_frame(spark, [(None, "a", 2), (None, "b", 1), (1, None, None), (1, None, None)]), path, ["k"], ["n"], 4)
    ledger.insert(_frame(spark, [(None, "c", 0), (2, "d", 0)]), path, ["k"], ["n"], 4)
    ledger.insert(_frame(spark, []), path, ["k"], ["n"], 4)
    nothing = str(tmp_path / "nothing")
    ledger.insert(_frame(spark, []), nothing, ["k"], ["n"], 4)
    assert ledger.rows(spark, nothing, _frame(spark, [])).collect() == []
    held = sorted(map(tuple, ledger.rows(spark, path).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert held == [(None, "b", 1), (1, None, None), (2, "d", 0)]
    with pytest.raises(ValueError):
        ledger.unseen(_frame(spark, []).withColumn("Part", F.lit(1)), path, ["k"], ["n"])


def test_rebuilt_with_more_parts(spark, tmp_path):
    path, wide = str(tmp_path / "l"), str(tmp_path / "wide")
    for start in (0, 30):
        ledger.insert(_frame(spark, [(k, "a", k) for k in range(start, start + 40)]), path, ["k"], ["n"], 2)
    ledger.rebuilt(spark, path, wide, ["k"], 16)
    assert len(glob.glob(f"{wide}/part=*")) > 2
    found = ledger.unseen(_frame(spark, [(k, "b", k) for k in range(80)]), wide, ["k"], ["n"], 16).collect()
    assert sorted(r["k"] for r in found) == list(range(70, 80))


def test_two_streams_into_one_ledger(spark, tmp_path):
    frame = _frame(spark, [(i % 40, "a", i) for i in range(120)])
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    for run in ("cp1", "cp2"):
        stream = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
        jobs.run_available(stream, str(tmp_path / run), jobs.insert_absent_batches(str(tmp_path / "l"), ["k"], ["n"], 4))
    found = {r["k"]: r["n"] for r in ledger.rows(spark, str(tmp_path / "l")).collect()}
    assert found == {k: k for k in range(40)} and ledger.rows(spark, str(tmp_path / "l")).count() == 40


def test_a_gate_run_again_emits_nothing_new(spark, tmp_path):
    groups = [("r", "s", "BAD", "AUTHENTICATED", 9.0, True), ("r", "t", "GOOD", "AUTHENTICATED", 2.0, True), ("r", "u", "BAD", "AUTHENTICATED", 0.1, False)]
    shape = "run_id string, sender_key string, signal string, bucket string, aggregate_weight double, trusted boolean"
    path = str(tmp_path / "l")
    for weight in (1.0, 2.0):  # evidence has grown by the second run; what was emitted stays as it was
        emitted = feedback.reputation_emissions(spark.createDataFrame(groups, shape).withColumn("aggregate_weight", F.col("aggregate_weight") * weight))
        ledger.insert(emitted, path, ["claim_key"], ["claim_key"], 4)
    assert {r["claim_key"]: r["weight"] for r in ledger.rows(spark, path).collect()} == {"r|s|BAD|AUTHENTICATED": 5.0, "r|t|GOOD|AUTHENTICATED": 2.0}
    assert ledger.rows(spark, path).count() == 2
