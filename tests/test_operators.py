from datetime import datetime, timedelta
from decimal import Decimal
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.operators import (
    arena, calibration, campaigns, evalsplit, features, feedback, graph, lookups, metrics, ordered, privacy, quality,
    reputation, rules, scoring, similarity, training, windows,
)

c = F.col
DAY0 = datetime(2024, 1, 1)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_empty_and_null_bodies_give_zero_features(spark):
    frame = spark.createDataFrame([(1, ""), (2, None), (3, "Hi THERE!\n ok")], "id int, body string")
    found = {r["id"]: r["text"] for r in features.with_text_features(frame, "body").collect()}
    assert tuple(found[1]) == tuple(found[2]) == (0, 0, 0.0, 0, 0.0)
    assert tuple(found[3]) == (13, 3, 0.666667, 1, 3.333333)


def test_link_features(spark):
    body = "x http://10.0.0.1/a https://XN--E1afmkfd.example/p?q http://a.b/c http://A.B:80/d"
    found = features.with_link_features(spark.createDataFrame([(body,), (None,)], "b string"), "b").select("link").collect()
    assert tuple(found[0][0]) == (4, 3, True, True, 32)
    assert tuple(found[1][0]) == (0, 0, False, False, 0)


def test_auth_and_timing(one):
    assert tuple(one(features.auth_features(F.lit("mx; SPF = Pass; dkim=fail (x)")))) == ("pass", "fail", "unknown")
    assert tuple(one(features.auth_features(F.lit(None).cast("string")))) == ("unknown", "unknown", "unknown")
    assert tuple(one(features.timing_features(F.lit(datetime(2024, 1, 6, 23))))) == (True, 23, 6, True)
    assert tuple(one(features.timing_features(F.lit(None).cast("timestamp")))) == (False, None, None, False)


def test_header_features(spark):
    frame = spark.createDataFrame(
        [("WIN now!!", "a@x.org", "b@x, ,c@y", "Q <z@x.org>"), (None, " ", None, None)],
        "subject string, sender string, recipients string, reply_to string",
    )
    found = [tuple(r[0]) for r in features.with_header_features(frame).select("header").collect()]
    assert found == [(True, 9, 0.5, 2, True, 2, True), (False, 0, 0.0, 0, False, 0, False)]


def test_denylist_hits_subdomains_only(spark):
    mails = spark.createDataFrame(
        [(1, "go http://a.bad.test/x"), (2, "http://notbad.test"), (3, "http://u@bad.test:99"), (4, None)], "email_id int, body_raw string"
    )
    deny = spark.createDataFrame([("BAD.test",)], "host string")
    assert sorted(r[0] for r in rules.denylisted_ids(mails, deny).collect()) == [1, 3]


@pytest.mark.parametrize("domain,auth,spoof", [
    ("paypal.com", "x; dmarc=pass", False), ("paypal.com", None, True), ("paypal-login.test", "dmarc=pass", True),
    ("mail.paypal.com", "DMARC=PASS", False), ("example.org", None, False), (None, None, False),
])
def test_brand_spoof(spark, domain, auth, spoof):
    frame = spark.createDataFrame([(domain, auth)], "d string, a string")
    assert frame.select(rules.spoofs_brand(c("d"), c("a"))).first()[0] is spoof


def test_reputation_gate_and_unseen_sender(spark):
    at = datetime(2024, 1, 8)
    log = [("flood", "GOOD", 50.0, "UNAUTHENTICATED", at), ("s", "GOOD", 1.0, "AUTHENTICATED", DAY0), ("s", "BAD", 1.0, "AUTHENTICATED", at)]
    events = spark.createDataFrame(log, "sender_key string, signal string, weight double, bucket string, occurred_at timestamp")
    found = {r["sender_key"]: r for r in reputation.gated_reputation(events, at).collect()}
    assert found["flood"]["unauth_mean"] == 0.5 and found["flood"]["auth_mean"] == 0.5
    assert found["s"]["auth_good"] == pytest.approx(0.5) and found["s"]["auth_mean"] == pytest.approx(1.5 / 3.5)
    mail = spark.createDataFrame([(1, "new", "AUTHENTICATED")], "email_id int, sender_key string, bucket string")
    rated = reputation.with_sender_reputation(mail, reputation.gated_reputation(events, at)).first()
    assert (rated["reputation_mean"], rated["reputation_evidence"]) == (0.5, 0.0)


def _scored(spark, data):
    schema = "email_id int, hard_rule_decision string, calibrated_confidence double, posterior double, uncertainty_band double, sender_uncertainty double"
    return spark.createDataFrame(data, schema)


def test_routing_boundaries(spark):
    policy = scoring.Policy("p")
    data = [
        (1, None, 0.7, 0.1, 0.0, 0.0),     # confidence 0.4 exactly: not routed
        (2, None, 0.95, 0.1, 0.0, 0.05),   # uncertainty exactly at the band: routed
        (3, None, 0.95, 0.45, 0.0, 0.0),   # on the edge of the warn threshold
        (4, "BLOCK", None, None, None, None),
        (5, None, None, None, None, None),
    ]
    out = {r["email_id"]: r for r in scoring.score_policies(_scored(spark, data), [policy]).collect()}
    assert abs(2 * abs(0.7 - 0.5) - 0.4) < 1e-12
    assert "NEW_SENDER_UNCERTAINTY" in out[2]["routing_reasons"]
    assert out[3]["route_used"] == "LLM"
    assert (out[4]["decision"], out[4]["route_used"]) == ("BLOCK", "HARD_RULE")
    assert (out[5]["decision"], out[5]["route_used"], out[5]["routing_reasons"]) == ("ALLOW", "MODEL", [])


def test_policy_checks_its_ladder():
    with pytest.raises(ValueError):
        scoring.Policy("x", warn=0.9, quarantine=0.5)
    with pytest.raises(ValueError):
        scoring.Policy("x", burst=0)


def test_shadow_is_empty_without_a_second_policy(spark):
    data = _scored(spark, [(1, None, 0.9, 0.6, 0.0, 0.0)])
    assert scoring.shadow_decisions(data, scoring.Policy("p"), None).count() == 0
    found = scoring.shadow_decisions(data, scoring.Policy("p"), scoring.Policy("q", warn=0.7)).first()
    assert (found["agreement"], found["direction"]) == ("DISAGREE", "SHADOW_LESS_SEVERE")


def test_burst_reason_only_when_the_tier_changes(spark):
    frame = spark.createDataFrame([(1, "ALLOW", 21, 0), (2, "BLOCK", 30, 0), (3, "ALLOW", 20, 21), (4, "ALLOW", 20, 20)],
                                  "email_id int, decision string, sender_count int, duplicate_count int")
    out = scoring.escalate_bursts(frame.withColumn("reason_codes", F.array().cast("array<string>")), F.lit(20))
    assert [(r["decision"], r["reason_codes"], r["burst_trigger"]) for r in out.orderBy("email_id").collect()] == [
        ("QUARANTINE", ["BURST_OVERRIDE"], "SENDER_VELOCITY"), ("BLOCK", [], "SENDER_VELOCITY"),
        ("QUARANTINE", ["BURST_OVERRIDE"], "CONTENT_NEAR_DUP"), ("ALLOW", [], None),
    ]


def test_policy_metrics(spark):
    data = [("BLOCK", "spam"), ("QUARANTINE", "phish"), ("WARN", "spam"), ("BLOCK", "ham"), ("ALLOW", "ham"), ("ALLOW", "ham"), ("WARN", "ham")]
    frame = spark.createDataFrame(data, "decision string, label string").withColumn("route_used", F.lit("MODEL")).withColumn("policy_version", F.lit("p"))
    found = metrics.policy_metrics(frame).first()
    assert (found["precision"], found["recall"], found["bypass_rate"]) == pytest.approx((2 / 3, 2 / 3, 1 / 3))
    assert metrics.policy_metrics(frame.filter("label = 'none'")).count() == 0
    gate = metrics.precision_gate(metrics.policy_metrics(frame)).first()
    assert not gate["passed"] and gate["reason"] == "golden set too small to judge precision: 7 < 50 minimum samples"
    only_ham = metrics.policy_metrics(frame.filter("label = 'ham' and decision = 'ALLOW'")).first()
    assert (only_ham["precision"], only_ham["recall"]) == (0.0, 0.0)


def _items(spark, data):
    return spark.createDataFrame(
        [(i, g, datetime(1970, 1, 1) + timedelta(days=d), "spam") for i, (g, d) in enumerate(data)],
        "email_id int, group_id string, event_time timestamp, label string",
    )


def _sides(split):
    return {r["email_id"]: r["split_side"] for r in split.collect()}


def test_split_keeps_families_whole_and_counts_forced_inversions(spark):
    split = evalsplit.time_forward_split(_items(spark, [("old", 20), ("mix", 5), ("mix", 90), ("new", 100)]), 0.5, 1)
    assert _sides(split) == {0: "train", 1: "eval", 2: "eval", 3: "eval"}
    audit = evalsplit.split_audit(split).first()
    assert (audit["cross_boundary_groups"], audit["temporal_inversions"], audit["leakage_free"]) == (0, 1, False)


def test_split_holds_out_the_newest(spark):
    sides = _sides(evalsplit.time_forward_split(_items(spark, [("a", 1), ("b", 50), ("c", 100)]), 0.34, 7))
    assert (sides[0], sides[2]) == ("train", "eval")


def test_lone_family_trains_and_blank_groups_are_alone(spark):
    assert set(_sides(evalsplit.time_forward_split(_items(spark, [("s", 1), ("s", 2), ("s", 3)]), 0.5)).values()) == {"train"}
    audit = evalsplit.split_audit(evalsplit.time_forward_split(_items(spark, [(None, 1), ("  ", 2), (None, 3)]), 0.34)).first()
    assert audit["group_count"] == 3 and audit["cross_boundary_groups"] == 0
    assert evalsplit.time_forward_split(_items(spark, []), 0.2).count() == 0
    with pytest.raises(ValueError):
        evalsplit.time_forward_split(_items(spark, []), 1.0)


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_split_does_not_depend_on_partitions_or_seed(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        items = _items(spark, [(f"f{i}", i + 1) for i in range(40)])
        for seed in (1, 999):
            sides = _sides(evalsplit.time_forward_split(items.repartition(partitions), 0.25, seed))
            assert {i for i, s in sides.items() if s == "eval"} == set(range(30, 40))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_families_bridge_through_outsiders(spark):
    members = spark.createDataFrame([("l1", 5), ("l1", 1), ("l2", 6), ("l2", 1), ("d", 6), ("d", 9), ("solo", 20)], "relation_id string, email_id long")
    universe = spark.createDataFrame([(5,), (6,), (9,), (20,), (30,)], "email_id long")
    found = dict(rows(graph.resolve_families(universe, members)))
    assert found == {5: "fam:1", 6: "fam:1", 9: "fam:1", 20: "fam:20", 30: None}


def test_a_long_chain_is_one_family(spark):
    order = list(range(60))
    random.Random(3).shuffle(order)
    members = [(f"r{i}", n) for i in range(59) for n in (order[i], order[i + 1])]
    found = graph.component_labels(spark.createDataFrame(members, "relation_id string, email_id long")).collect()
    assert {r["component"] for r in found} == {0} and len(found) == 60


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_running_totals_over_a_period_that_holds_most_rows(spark, partitions):
    rng = random.Random(5)
    data = [(i, "hot" if i % 3 else f"p{i % 5}", rng.randrange(40), rng.randrange(9)) for i in range(900)]
    frame = spark.createDataFrame(data, "id int, period string, t int, v int")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r["id"]: r["total"] for r in ordered.running_totals(frame, {"total": c("v")}, ["t", "id"], ["period"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    sums, want = {}, {}
    for i, period, t, v in sorted(data, key=lambda r: (r[2], r[0])):
        sums[period] = want[i] = sums.get(period, 0) + v
    assert found == want


def _admit(calls, reservation, daily, monthly):
    day, month, out = {}, {}, {}
    for i, at, cost in sorted(calls, key=lambda r: (r[1], r[0])):
        d, m = at.strftime("%Y-%m-%d"), at.strftime("%Y-%m")
        if day.get(d, Decimal(0)) + reservation > daily:
            out[i] = "daily"
        elif month.get(m, Decimal(0)) + reservation > monthly:
            out[i] = "monthly"
        else:
            out[i] = "granted"
            day[d], month[m] = day.get(d, Decimal(0)) + cost, month.get(m, Decimal(0)) + cost
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budget_admission_equals_one_call_after_another(spark, seed):
    rng = random.Random(seed)
    calls = [(i, DAY0 + timedelta(minutes=rng.randrange(60 * 24 * 45)), Decimal(rng.randrange(0, 30)) / 1000) for i in range(400)]
    frame = spark.createDataFrame(calls, "id int, at timestamp, cost decimal(12,6)")
    found = {r["id"]: r["outcome"] for r in windows.admit_calls(frame, "at", "cost", "id", 0.01, 0.10, 1.2).collect()}
    assert found == _admit(calls, Decimal("0.01"), Decimal("0.10"), Decimal("1.2"))


def test_trailing_counts_have_a_half_open_edge(spark):
    at = lambda ms: DAY0 + timedelta(milliseconds=ms)
    data = [(1, "a", at(0)), (2, "a", at(59_999)), (3, "a", at(60_000)), (4, "b", at(60_000)), (5, "a", at(60_000)), (1, "a", at(0))]
    frame = spark.createDataFrame(data, "id int, s string, at timestamp")
    assert dict((r["id"], r["sender_count"]) for r in windows.trailing_sender_counts(frame, "s", "id", "at").collect()) == {1: 1, 2: 2, 3: 3, 4: 1, 5: 3}


def test_near_duplicates_on_arrival_equal_brute_force(spark):
    rng = random.Random(11)
    base = [rng.getrandbits(64) for _ in range(6)]
    data = []
    for i in range(700):
        fp = base[rng.randrange(6)] if i % 3 else base[0]
        for _ in range(rng.randrange(6)):
            fp ^= 1 << rng.randrange(64)
        data.append((i, DAY0 + timedelta(seconds=rng.randrange(500)), 0 if i % 50 == 0 else fp - 2**64 if fp >= 2**63 else fp))
    frame = spark.createDataFrame(data, "email_id int, at timestamp, fingerprint long")
    found = dict((r["email_id"], r["cluster_size"]) for r in similarity.recent_near_duplicates(frame, "at", 60_000, 6, recent=40, block=50).collect())
    ordered_rows = sorted((d for d in data if d[2] != 0), key=lambda d: (d[1], d[0]))
    want = {d[0]: 0 for d in data if d[2] == 0}
    for pos, (i, at, fp) in enumerate(ordered_rows):
        before = ordered_rows[max(0, pos - 40):pos]
        want[i] = 1 + sum((at - t).total_seconds() < 60 and bin((fp ^ g) & (2**64 - 1)).count("1") <= 6 for _, t, g in before)
    assert found == want
    found = dict((r["email_id"], r["cluster_size"]) for r in similarity.recent_near_duplicates(frame, "at", 60_000, 6).collect())
    for i, at, fp in ordered_rows:
        want[i] = sum(0 <= (at - t).total_seconds() < 60 and bin((fp ^ g) & (2**64 - 1)).count("1") <= 6 for _, t, g in ordered_rows)
    assert found == want


def test_a_burst_of_many_copies_is_counted_whole(spark):
    data = [(i, DAY0 + timedelta(milliseconds=i), 12345 if i % 2 else 12344) for i in range(1500)]
    frame = spark.createDataFrame(data, "email_id int, at timestamp, fingerprint long")
    found = dict((r["email_id"], r["cluster_size"]) for r in similarity.recent_near_duplicates(frame, "at", 60_000, 6).collect())
    assert found == {i: i + 1 for i in range(1500)}


def test_more_queries_than_a_block(spark):
    corpus = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = corpus.selectExpr("vec_id AS query_id", "embedding")
    whole = sorted(tuple(r) for r in similarity.nearest_vectors(corpus, asked, 4).collect())
    tiled = sorted(tuple(r) for r in similarity.nearest_vectors(corpus, asked, 4, query_block=7, block=11).collect())
    assert whole == tiled and len(whole) == 240


@pytest.mark.parametrize("hot_bucket", [4096, 3])
def test_close_fingerprints_equal_brute_force(spark, hot_bucket):
    rng = random.Random(4)
    seeds = [rng.getrandbits(63) for _ in range(12)]
    values = [s ^ sum(1 << b for b in rng.sample(range(63), rng.randrange(8))) for s in seeds for _ in range(15)]
    frame = spark.createDataFrame(list(enumerate(values)), "email_id int, fingerprint long")
    found = [(r["fingerprint_a"], r["fingerprint_b"]) for r in similarity.close_fingerprints(frame, 6, hot_bucket).collect()]
    want = {(a, b) for a in set(values) for b in set(values) if a != b and bin(a ^ b).count("1") <= 6}
    assert len(found) == len(set(found)) and set(found) == want


def test_nearest_vectors_in_blocks(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((300, 8))
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, [float(x) for x in data[i]]) for i in range(9)], "query_id long, embedding array<float>")
    found = similarity.nearest_vectors(frame, asked, 4, query_block=3, block=100).collect()
    unit = data.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    scores = unit[:9] @ unit.T
    want = {(q, int(i)) for q in range(9) for i in np.argsort(-scores[q])[:4]}
    assert {(r["query_id"], r["vec_id"]) for r in found} == want


@pytest.mark.parametrize("batch", [3, 4096])
def test_campaign_leaders_do_not_depend_on_batch_or_order(spark, batch):
    rng = np.random.default_rng(7)
    data = rng.standard_normal((5, 6))[rng.integers(0, 5, 60)] + 0.25 * rng.standard_normal((60, 6))
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    leaders, want = [], {}
    for i in range(60):
        best = max(((round(float(unit[i] @ unit[l]), 9), -l) for l in leaders), default=(-2, 0))
        if best[0] >= 0.8:
            want[i] = -best[1]
        else:
            leaders.append(i)
            want[i] = i
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "email_id long, embedding array<double>").orderBy(F.rand(1))
    assigned = campaigns.campaign_leaders(frame, 0.8, batch=batch)
    assert {r["email_id"]: r["cluster_id"] for r in assigned.collect()} == want
    clusters, members = campaigns.campaign_clusters(assigned)
    assert clusters.agg(F.sum("size")).first()[0] == 60 and members.filter("similarity < 0.5").count() == 0


def test_shipping_variants_form_one_campaign(spark):
    shipping = [f"Your parcel number {n} is held at the depot, pay the shipping fee today to release your parcel" for n in ("one", "two", "three", "four", "five")]
    other = ["Team lunch is moved to Friday noon", "Quarterly budget figures attached for review", "Happy birthday and best wishes to you"]
    frame = spark.createDataFrame(list(enumerate(shipping + other)), "email_id long, text string")
    hashed = training.hashed_vectors(frame, "text")
    vectors = training.encode(hashed, training.fit_encoder(hashed, dimension=8))
    found = {}
    for r in campaigns.campaign_leaders(vectors, 0.80).collect():
        found.setdefault(r["cluster_id"], set()).add(r["email_id"])
    assert sorted(map(sorted, found.values())) == [[0, 1, 2, 3, 4], [5], [6], [7]]


def test_corroboration(spark):
    def group(data):
        frame = spark.createDataFrame([("r", "s", "BAD", "AUTHENTICATED", p, w, "spam", 1, w, 1.0) for p, w in data],
            "run_id string, sender_key string, signal string, bucket string, persona_id int, weight double, ground_truth string, email_id int, action_confidence double, trust double")
        return frame, feedback.corroborate(frame)

    assert group([(1, 5.0), (1, 5.0)])[1].first()["trusted"] is False
    assert group([(1, 0.1), (2, 0.1), (3, 0.1)])[1].first()["trusted"] is False
    frame, groups = group([(1, 3.0), (2, 3.0), (3, 0.0)])
    assert groups.first()["trusted"] is True
    assert feedback.reputation_emissions(groups).first()["weight"] == 5.0
    assert feedback.label_emissions(frame, groups).count() == 2


def test_isotonic_fit_and_clamping(spark):
    points = [(0.1, False), (0.1, False), (0.4, True), (0.6, False), (0.9, True), (0.9, True)]
    model = calibration.fit_isotonic(spark.createDataFrame(points, "x double, y boolean"), "x", "y")
    asked = spark.createDataFrame([(0.0,), (0.1,), (0.25,), (0.5,), (1.0,)], "x double")
    found = [r[1] for r in calibration.apply_isotonic(model, asked, "x", "z").collect()]
    assert found == pytest.approx([0.0, 0.0, 0.25, 0.5, 1.0])


def test_calibration_needs_samples_and_keeps_empty_bins(spark):
    few = spark.createDataFrame([(0.2, True, "train"), (0.3, False, "eval")], "raw double, positive boolean, split_side string")
    with pytest.raises(ValueError, match="too few samples"):
        calibration.calibrate(few, "raw", "m")
    curve = calibration.reliability_curve(few.withColumn("raw", F.lit(1.0)), "raw", "positive").orderBy("bin").collect()
    assert [r["n"] for r in curve] == [0] * 9 + [2]


def test_calibrate_fits_train_and_measures_eval(spark):
    rng = random.Random(1)
    data = [(x, rng.random() < x * x, "train" if i % 2 else "eval") for i, x in enumerate(rng.random() for _ in range(2000))]
    model, report = calibration.calibrate(spark.createDataFrame(data, "raw double, positive boolean, split_side string"), "raw", "m1")
    found = report.first()
    assert found["passed"] and found["ece_calibrated"] < found["ece_raw"] and "within ceiling 0.1000" in found["reason"]


def test_sweep_breakdown(spark):
    sweep = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 0.1, 0.4, 0.5), (2, 0.2, 0.6, 0.1), (3, 0.3, 0.0, 0.9)],
                                  "sweep_index int, malicious_fraction double, ham_drift double, spam_promotion double")
    found = feedback.breakdown(sweep).first()
    assert (found["points"], found["blunted_points"], found["observed_breakdown_fraction"], found["breakdown_bomber_count"]) == (4, 2, 0.2, 15)


def test_bypass_rates_are_null_without_a_track(spark):
    frame = spark.createDataFrame([("r", "spam", True), ("r", "phish", False)], "run_id string, label string, defender_delivered boolean")
    found = arena.bypass_rates(frame).first()
    assert (found["bypass_rate"], found["false_positive_rate"]) == (0.5, None)


def test_training_validation_and_version(spark):
    good = spark.createDataFrame([(i, "ham" if i % 2 else "spam", 1.0, [0.0] * 24) for i in range(40)], "email_id int, label string, weight double, features array<double>")
    assert training.training_problems(good).first()["trainable"]
    assert not training.training_problems(good.filter("label = 'ham'"), 1).first()["trainable"]
    name = lambda df: training.dataset_version(df).first()[0]
    assert name(good) == name(good.orderBy(F.rand(3)).repartition(5)) != name(good.filter("email_id > 0"))


def test_classifier_learns_and_is_a_distribution(spark):
    rng = random.Random(2)
    data = [(i, ["ham", "spam", "phish"][i % 3], 1.0, [float(i % 3 == k) + rng.gauss(0, 0.3) for k in range(3)]) for i in range(300)]
    from pyspark.ml.functions import array_to_vector

    frame = spark.createDataFrame(data, "email_id int, label string, weight double, f array<double>").withColumn("feature_vector", array_to_vector("f"))
    scored = training.score_classes(training.fit_classifier(frame), frame)
    total = c("ham_score") + c("spam_score") + c("phishing_score")
    assert scored.filter(F.abs(total - 1) > 1e-9).count() == 0
    best = F.when(c("ham_score") == F.greatest("ham_score", "spam_score", "phishing_score"), "ham").when(c("spam_score") > c("phishing_score"), "spam").otherwise("phish")
    assert scored.filter(best == c("label")).count() > 270


def test_stratified_split_is_exact(spark):
    frame = spark.createDataFrame([(i, "ham" if i % 10 else "spam") for i in range(200)], "email_id int, label string")
    counts = {(r["label"], r["split_side"]): r["count"] for r in windows.stratified_split(frame, "label", "email_id").groupBy("label", "split_side").count().collect()}
    assert counts == {("ham", "eval"): 45, ("ham", "train"): 135, ("spam", "eval"): 5, ("spam", "train"): 15}


def test_cards_flip_once_and_ignore_replays(spark):
    data = [("m", "c1", 1, "quarantine", "llm"), ("m", "c2", 2, "allow", "llm"), ("m", "c1", 3, "quarantine", "llm"), ("n", "c3", 2, "quarantine", "llm")]
    frame = spark.createDataFrame(data, "e string, k string, t int, tier string, route_used string")
    found = {r["e"]: (r["tier"], r["resolved"], r["pending"]) for r in windows.decision_cards(frame, "e", "k", "t").collect()}
    assert found == {"m": ("allow", True, False), "n": ("quarantine", False, True)}


def test_seal_rotate_and_erase(spark):
    from mailsift.session import cut_lineage

    masters = {"v1": b"1" * 32, "v2": b"2" * 32}
    mail = spark.createDataFrame([(1, b"hello"), (2, b"world")], "email_id int, raw_content binary")
    stored = cut_lineage(privacy.seal(mail, masters, "v1"))
    keys = stored.select("email_id", "wrapped_key", "key_version", F.lit(None).cast("timestamp").alias("erased_at"))
    opened = lambda k, m: {r[0]: r[1] if r[1] is None else bytes(r[1]) for r in privacy.open_sealed(stored, k, m).collect()}
    assert opened(keys, masters) == {1: b"hello", 2: b"world"}
    assert opened(keys, {"v1": b"9" * 32}) == {1: None, 2: None}
    asked = spark.createDataFrame([(2,), (7,)], "email_id int")
    erased = privacy.erase_keys(keys, asked, F.lit(DAY0))
    rotated = cut_lineage(privacy.rotate_keys(erased, masters, "v2"))
    assert opened(rotated, {"v2": masters["v2"]}) == {1: b"hello", 2: b""}
    assert dict(rows(privacy.erasure_outcomes(asked, erased.filter("email_id = 1"), mail))) == {2: "NO_KEY", 7: "NOT_FOUND"}
    assert "_key" not in stored.columns


def test_provenance_scrub(spark):
    frame = spark.createDataFrame([('{"senderKey":"a@b.c","note":"ask bob@x.org","deep":[{"sender":"q"},7]}',), (None,)], "p string")
    found = [r[0] for r in frame.select(privacy.scrub_json(b"k")("p")).collect()]
    assert "a@b.c" not in found[0] and "b***@x.org" in found[0] and found[0].count("snd_") == 2 and found[1] is None
    flat = spark.createDataFrame([('{"runId":"r","senderKey":"a@b.c","corroborators":3}',)], "p string")
    assert '"corroborators":3' in flat.select(privacy.deidentified_provenance(c("p"), b"k")).first()[0]


def test_quality_rules(spark):
    frame = spark.createDataFrame([("s", "GOOD", "AUTHENTICATED", 1.0, 1.0), ("", "X", "AUTHENTICATED", -1.0, 0.0)],
                                  "sender_key string, signal string, bucket string, weight double, decay_factor double")
    good, bad = quality.split_valid(frame, quality.reputation_event_rules())
    assert good.count() == 1
    assert bad.first()["violations"] == ["sender_key present", "signal known", "weight positive", "decay_factor in (0,1]"]
    assert quality.duplicate_keys(frame.union(frame), ["sender_key"]).count() == 2


def test_lookup_reaches_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = lookups.by_id(stored, "id", 7)
    assert found.count() == 1
    assert "EqualTo(id,7)" in found._jdf.queryExecution().executedPlan().toString()
