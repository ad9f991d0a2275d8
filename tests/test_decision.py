from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mailsift.operators import decision, reputation, rules
from mailsift.operators.scoring import Policy

c = F.col
DAY0 = datetime(2024, 1, 1)

MAIL = (
    "email_id int, sender string, sender_domain string, recipients string, subject string, received_at timestamp, "
    "auth_results string, reply_to string, body_raw string, body_display string"
)


def _mail(spark):
    row = lambda i, sender, auth, body: (i, sender, sender.split("@")[1] if sender else None, "a@x.org", "hi", DAY0, auth, None, body, body)
    return spark.createDataFrame([
        row(1, "a@good.org", "dmarc=pass", "hello"), row(2, "b@new.org", None, "see http://x.bad.test/1"),
        row(3, "c@paypal-help.test", "dmarc=pass", "verify"), row(4, None, None, "unknown sender"), row(5, "a@good.org", "dmarc=pass", "ping"),
    ], MAIL)


def _classify(df):
    """Stands in for a model: every message looks fairly abusive."""
    return df.withColumns({"spam_score": F.lit(0.6), "phishing_score": F.lit(0.1), "raw_malicious": F.lit(0.7)})


@pytest.fixture
def scored(spark):
    log = spark.createDataFrame([("a@good.org", "GOOD", 40.0, "AUTHENTICATED", DAY0)], "sender_key string, signal string, weight double, bucket string, occurred_at timestamp")
    deny = spark.createDataFrame([("bad.test",)], "host string")
    short = lambda: rules.match(F.length("sender_domain") > 90, "WARN", "UNSOLICITED_BULK")
    return decision.score_messages(
        _mail(spark), deny, _classify, decision.raw_as_confidence, reputation.gated_reputation(log, DAY0), 0.5, more_rules=[short]
    )


def test_rules_mask_scores_and_reputation_moves_the_posterior(scored):
    found = {r["email_id"]: r for r in scored.collect()}
    assert found[2]["hard_rule_decision"] == "BLOCK" and found[2]["reason_codes"] == ["KNOWN_BAD_URL"]
    assert found[3]["hard_rule_decision"] == "QUARANTINE" and found[3]["posterior"] is None and found[3]["spam_score"] is None
    assert found[1]["posterior"] < 0.1 < 0.69 < found[4]["posterior"] < 0.71
    assert found[1]["sender_uncertainty"] < found[4]["sender_uncertainty"]


def test_decide_with_bursts_keeps_the_floor(spark, scored):
    bursts = spark.createDataFrame([(1, 50, 0), (2, 50, 50)], "email_id int, sender_count int, duplicate_count int")
    found = {r["email_id"]: r for r in decision.decide(scored, Policy("p"), bursts).collect()}
    assert (found[1]["decision"], found[1]["reason_codes"]) == ("QUARANTINE", ["BURST_OVERRIDE"])
    assert found[2]["decision"] == "BLOCK" and found[2]["route_used"] == "HARD_RULE"
    assert found[2]["explanation"] == "Blocked: a link resolves to a known-malicious host."
    assert found[5]["decision"] == "ALLOW" and found[5]["explanation"].startswith("No hard rule fired")
    assert found[4]["decision"] == "WARN" and found[4]["route_used"] == "LLM"
    plain = {r["email_id"]: r["decision"] for r in decision.decide(scored, Policy("p")).collect()}
    assert plain[1] == "ALLOW"


def test_bodies_do_not_cross_a_shuffle(scored):
    plan = decision.decide(scored, Policy("p"))._jdf.queryExecution().optimizedPlan().toString()
    joined = [line for line in plan.split("\n") if "Join" in line]
    assert joined and not any("body_" in line for line in joined)


def test_quality_report_measures_change(spark):
    data = [(i, None, 0.9, p, 0.0, 0.0) for i, p in enumerate([0.9, 0.9, 0.6, 0.2])]
    frame = spark.createDataFrame(data, "email_id int, hard_rule_decision string, calibrated_confidence double, posterior double, uncertainty_band double, sender_uncertainty double")
    labels = spark.createDataFrame([(0, "spam"), (1, "ham"), (2, "phish"), (3, "ham")], "email_id int, label string")
    report = {r["policy_version"]: r for r in decision.quality_report(frame, labels, [Policy("a"), Policy("b", quarantine=0.55)], "a").collect()}
    assert report["a"]["recall"] == 0.5 and report["b"]["recall"] == 1.0 and report["b"]["recall_delta"] == 0.5
    assert report["b"]["passed"] is False and "too small" in report["b"]["reason"]
