from datetime import datetime, timedelta
import json
import random

import pytest
from pyspark.sql import functions as F

from mailsift import schemas
from mailsift.operators import evalsplit, privacy, quality, reputation, similarity, windows
from mailsift.operators.scoring import Policy
from mailsift.sources import corpus, events, mime, sinks
from mailsift.streaming import jobs

c = F.col
DAY0 = datetime(2024, 1, 1)

MAIL = b"""From: "Smith, Ann" <Ann@Example.org>
To: a@x.org
To: b@x.org
Subject: =?utf-8?q?caf=C3=A9?=
Date: Tue, 02 Jan 2024 05:04:05 +0200
Reply-To: other@x.org
Authentication-Results: mx; spf=pass
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary=outer

--outer
Content-Type: multipart/alternative; boundary=inner

--inner
Content-Type: text/plain; charset=utf-8

plain part
--inner
Content-Type: text/html; charset=utf-8

<p>html&nbsp;part</p>
--inner--
--outer--
"""


def test_corpus_tree(spark, tmp_path):
    def put(path, data):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)

    put("enron/easy_ham/1.eml", b"Subject: a\n\nx")
    put("enron/spam/2.eml", b"Subject: b\n\ny")
    put("tank/phish/3.mbox", b"preface\nFrom x\nSubject: c\n\none\nFrom y\r\n  \nFrom z\nSubject: d\n\nFromage\n")
    found = corpus.corpus_messages(corpus.corpus_files(spark, str(tmp_path)))
    assert sorted((r["dataset"], r["label"], bytes(r["raw_content"])) for r in found.collect()) == [
        ("enron", "ham", b"Subject: a\n\nx"), ("enron", "spam", b"Subject: b\n\ny"),
        ("tank", "phish", b"Subject: c\n\none"), ("tank", "phish", b"Subject: d\n\nFromage"),
    ]
    put("enron/mystery/4.eml", b"z")
    with pytest.raises(Exception, match="unknown corpus class directory"):
        corpus.corpus_files(spark, str(tmp_path)).collect()


def test_mime_parsing(spark):
    frame = spark.createDataFrame([(1, bytearray(MAIL)), (2, bytearray(b"\xff\xfe garbage")), (3, None), (4, bytearray(b"From: \nDate: never\n\nhi"))], "email_id int, raw_content binary")
    found = {r["email_id"]: r for r in mime.parse_messages(frame).collect()}
    good = found[1]
    assert (good["sender"], good["sender_domain"], good["recipients"], good["subject"]) == ("Ann@Example.org", "Example.org", "a@x.org, b@x.org", "café")
    assert good["received_at"] == datetime(2024, 1, 2, 3, 4, 5) and good["reply_to"] == "other@x.org"
    assert "<p>" in good["body_raw"] and "<p>" not in good["body_display"] and good["body_display"].startswith("plain part")
    assert found[3]["sender"] is None and found[3]["body_display"] == ""
    assert (found[4]["sender"], found[4]["received_at"], found[4]["body_display"]) == (None, None, "hi")


def test_insert_if_absent_and_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda data: spark.createDataFrame(data, "k int, v string, n int")
    sinks.insert_if_absent(frame([(1, "a", 1), (1, "b", 2), (2, "c", 1)]), path, ["k"], ["n"])
    sinks.insert_if_absent(frame([(2, "z", 0), (3, "d", 1)]), path, ["k"], ["n"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 1)]
    table = str(tmp_path / "u")
    sinks.upsert(frame([(i, "old", 1) for i in range(30)]), table, ["k"], ["n"], buckets=4)
    sinks.upsert(frame([(3, "new", 2), (4, "stale", 0), (99, "added", 1)]), table, ["k"], ["n"], buckets=4)
    found = {r["k"]: r["v"] for r in spark.read.parquet(table).collect()}
    assert len(found) == 31 and (found[3], found[4], found[99], found[0]) == ("new", "old", "added", "old")


def test_replace_freeze_append_and_export(spark, tmp_path):
    rows = lambda v, n: spark.range(n).withColumn("model_version", F.lit(v))
    path = str(tmp_path / "c")
    for version, n in (("m1", 3), ("m2", 4), ("m1", 2)):
        sinks.replace_version(rows(version, n), path)
    assert {r["model_version"]: r["count"] for r in spark.read.parquet(path).groupBy("model_version").count().collect()} == {"m1": 2, "m2": 4}
    sinks.freeze(spark.range(2), str(tmp_path / "g"), "g1")
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.freeze(spark.range(2), str(tmp_path / "g"), "g1")
    log = spark.createDataFrame([("s", "GOOD", "AUTHENTICATED", 1.0, 1.0), (" ", "GOOD", "AUTHENTICATED", 1.0, 1.0)],
                                "sender_key string, signal string, bucket string, weight double, decay_factor double")
    sinks.append_valid(log, str(tmp_path / "ok"), str(tmp_path / "bad"), quality.reputation_event_rules())
    assert spark.read.parquet(str(tmp_path / "ok")).count() == spark.read.parquet(str(tmp_path / "bad")).count() == 1
    labels = spark.createDataFrame([(1, "ham", 1.0, "seed", "{}", "a@b.c", "b.c")], "email_id int, label string, weight double, source string, provenance string, sender string, sender_domain string")
    export = privacy.training_export(labels, labels.limit(0), b"k")
    sinks.write_export(export, privacy.export_manifest(export), str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x" / "manifest")).first()["examples"] == 1
    assert spark.read.json(str(tmp_path / "x" / "examples")).first()["sender_pseudonym"].startswith("snd_")


def test_schemas_are_checked(spark):
    frame = spark.createDataFrame([("1", "ham", "d", DAY0)], schemas.schema("ground_truth"))
    assert schemas.require(frame.withColumn("extra", F.lit(1)), "ground_truth").columns == frame.columns
    with pytest.raises(ValueError, match="label: want string, have int"):
        schemas.require(frame.withColumn("label", F.lit(1)), "ground_truth")


def _write_parts(frame, folder, parts):
    frame.repartition(parts).write.parquet(str(folder))


def _log(n=400, seed=9):
    rng = random.Random(seed)
    return [(f"s{rng.randrange(7) if i % 3 else 0}", rng.choice(["GOOD", "BAD"]), rng.choice(["AUTHENTICATED", "UNAUTHENTICATED"]),
             rng.random(), DAY0 + timedelta(hours=rng.randrange(900)), i) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 5])
def test_stream_reputation_equals_batch_in_any_arrival_order(spark, tmp_path, parts):
    log = spark.createDataFrame(_log(), "sender_key string, signal string, bucket string, weight double, occurred_at timestamp, id int")
    _write_parts(log.orderBy(F.rand(parts)), tmp_path / "in", parts)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_available(jobs.reputation_state(stream), str(tmp_path / "cp"), jobs.upsert_batches(str(tmp_path / "out"), ["sender_key"], ["folded_at"]), "update")
    end = DAY0 + timedelta(hours=900)
    stored = spark.read.parquet(str(tmp_path / "out"))
    rolled = {r["sender_key"]: r for r in reputation.roll_forward(stored, log.limit(0), end).collect()}
    batch = reputation.decayed_counts(log, end).collect()
    assert len(rolled) == len(batch)
    for want in batch:
        for name in reputation.COUNTS:
            assert rolled[want["sender_key"]][name] == pytest.approx(want[name], abs=1e-9)


def test_redelivery_leaves_one_row(spark, tmp_path):
    data = [(i % 40, i, DAY0 + timedelta(minutes=i)) for i in range(120)]
    frame = spark.createDataFrame(data, "message_key int, delivery int, at timestamp")
    _write_parts(frame.union(frame), tmp_path / "in", 4)
    stream = lambda: spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_available(stream(), str(tmp_path / "cp1"), jobs.insert_absent_batches(str(tmp_path / "ledger"), ["message_key"], ["delivery"]))
    assert spark.read.parquet(str(tmp_path / "ledger")).groupBy("message_key").count().filter("count > 1").count() == 0
    once = jobs.once_per_message(stream(), "at", ["message_key"], "7 days")
    jobs.run_available(once, str(tmp_path / "cp2"), jobs.append_batches(str(tmp_path / "once")))
    assert spark.read.parquet(str(tmp_path / "once")).count() == 40


def test_stream_near_duplicates_equal_batch_over_ordered_files(spark, tmp_path):
    texts = ["win a prize today", "quarterly report attached", "lunch on friday"]
    rng = random.Random(3)
    data = [(i, DAY0 + timedelta(seconds=7 * i), texts[0] if i % 3 == 0 else texts[rng.randrange(3)]) for i in range(90)]
    frame = spark.createDataFrame(data, "email_id int, at timestamp, text string")
    for part in range(3):
        frame.filter(c("email_id").between(30 * part, 30 * part + 29)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_available(stream, str(tmp_path / "cp"), jobs.near_duplicate_batches(str(tmp_path / "out"), str(tmp_path / "state"), "at", "text"))
    found = {r["email_id"]: r["cluster_size"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = similarity.recent_near_duplicates(similarity.fingerprints(frame, "text", keep=("at",)), "at")
    assert found == {r["email_id"]: r["cluster_size"] for r in batch.collect()}


def test_resolution_waits_for_the_sla(spark, tmp_path):
    at = lambda s: DAY0 + timedelta(seconds=s)
    pending = spark.createDataFrame([(1, at(0), "QUARANTINE", None), (2, at(10), "ALLOW", "BLOCK"), (3, at(20), "ALLOW", None), (9, at(9000), "ALLOW", None)],
                                    "email_id int, pending_at timestamp, fast_tier string, hard_rule_decision string")
    verdicts = spark.createDataFrame([(1, "LEGITIMATE", at(30)), (2, "LEGITIMATE", at(11)), (3, "SPAM", at(51)), (9, "SPAM", at(9000))], "email_id int, verdict string, verdict_at timestamp")
    pending.write.parquet(str(tmp_path / "p"))
    verdicts.write.parquet(str(tmp_path / "v"))
    read = lambda name, like: spark.readStream.schema(like.schema).parquet(str(tmp_path / name))
    jobs.run_available(jobs.resolutions(read("p", pending), read("v", verdicts)), str(tmp_path / "cp"), jobs.append_batches(str(tmp_path / "out")))
    found = {r["email_id"]: (r["resolved_tier"], r["resolution_state"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found[1] == ("ALLOW", "PROMOTED") and found[2] == ("BLOCK", "CONFIRMED") and found[3] == ("QUARANTINE", "DEGRADED")


def test_poison_lines_are_put_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"schemaVersion": 1, "emailId": "e", "senderKey": "s", "sender": None, "senderDomain": "d", "contentHashHex": "00", "ingestSource": "x"}
    (tmp_path / "in" / "a.txt").write_text(json.dumps(good) + "\nnot json\n" + json.dumps(good) + "\n")
    decoded = events.decode(events.file_lines(spark, str(tmp_path / "in"), 1), schemas.schema("raw_email_event"))
    jobs.run_available(decoded, str(tmp_path / "cp"), jobs.divert_poison(str(tmp_path / "good"), str(tmp_path / "bad")))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 2
    assert [r["_corrupt"] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["not json"]


def test_shadow_sink_skips_the_same_policy(spark, tmp_path):
    frame = spark.createDataFrame([(1, None, 0.9, 0.6, 0.0, 0.0)], "email_id int, hard_rule_decision string, calibrated_confidence double, posterior double, uncertainty_band double, sender_uncertainty double")
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    jobs.run_available(stream, str(tmp_path / "cp"), jobs.score_with_shadow(str(tmp_path / "live"), str(tmp_path / "shadow"), Policy("p"), Policy("p")))
    assert spark.read.parquet(str(tmp_path / "live")).count() == 1 and not (tmp_path / "shadow").exists()


def test_cards_from_a_replayed_feed(spark, tmp_path):
    data = [(i % 10, i, DAY0 + timedelta(seconds=i), "quarantine" if i < 10 else "allow", "llm") for i in range(15)]
    frame = spark.createDataFrame(data, "email_id int, classification_id int, at timestamp, tier string, route_used string")
    _write_parts(frame.union(frame), tmp_path / "in", 3)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.run_available(stream, str(tmp_path / "cp"), jobs.decision_log(str(tmp_path / "log")))
    cards = windows.decision_cards(spark.read.parquet(str(tmp_path / "log")), "email_id", "classification_id", "at")
    assert cards.filter("resolved").count() == 5 and cards.filter("pending").count() == 5


def test_kafka_shape(spark):
    frame = spark.createDataFrame([("k", 1)], "key string, v int").select("key", F.struct("v").alias("event"))
    assert tuple(events.encode(frame).first()) == ("k", '{"v":1}')


def test_golden_freeze_rows(spark):
    split = spark.createDataFrame([(1, "eval"), (2, "train")], "email_id int, split_side string")
    labels = spark.createDataFrame([(1, "ham"), (2, "spam")], "email_id int, label string")
    assert [tuple(r) for r in evalsplit.frozen_golden(split, labels, "g").collect()] == [("g", 1, "ham")]


def test_a_redelivered_signal_counts_once(spark, tmp_path):
    at = DAY0
    rows = [(i, f"s{i % 3}", "GOOD", 1.0, "AUTHENTICATED", at) for i in range(12)]
    frame = spark.createDataFrame(rows, "event_id int, sender_key string, signal string, weight double, bucket string, occurred_at timestamp")
    write = jobs.accrual_batches(str(tmp_path / "sums"), str(tmp_path / "claims"), ["event_id"])
    write(frame.filter("event_id < 8"), 0)
    write(frame.filter("event_id < 8"), 0)  # the same batch again
    write(frame.filter("event_id >= 4"), 1)  # half of it delivered before
    found = {r.sender_key: r.auth_good for r in jobs.accrued(spark.read.parquet(str(tmp_path / "sums"))).collect()}
    assert found == pytest.approx({"s0": 4.0, "s1": 4.0, "s2": 4.0})


def test_pending_rows_left_open_are_degraded(spark):
    pending = spark.createDataFrame(
        [(1, DAY0, "QUARANTINE", None), (2, DAY0, "QUARANTINE", None), (3, DAY0 + timedelta(hours=2), "QUARANTINE", None)],
        "email_id int, pending_at timestamp, fast_tier string, hard_rule_decision string",
    )
    done = spark.createDataFrame([(1,)], "email_id int")
    late = jobs.overdue(pending, done, F.lit(DAY0 + timedelta(hours=1))).collect()
    assert [(r.email_id, r.resolution_state) for r in late] == [(2, "DEGRADED")]
