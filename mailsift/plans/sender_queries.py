"""Queries over sender reputation, user feedback and adversarial runs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mailsift.operators import arena, feedback, metrics, reputation
from mailsift.plans import roles as R
from mailsift.plans.common import R6, r6
from mailsift.plans.registry import query
from mailsift.session import ensure_checkpoint_dir
from mailsift.sources import ledger

c = F.col
HALF_LIFE = 604800.0
_VIEWS = ("auth_mean", "auth_variance", "auth_evidence", "unauth_mean", "unauth_variance", "unauth_evidence")

_COUNTS = f"""
    SELECT sender_key, {', '.join(
        f"coalesce(sum(weight * power(0.5e0, greatest(0, epoch_us(TIMESTAMP '{R.READ_AT}') - epoch_us(occurred_at)) / 1e6 / {HALF_LIFE}e0)) FILTER (bucket = '{b}' AND signal = '{s}'), 0) AS {name}"
        for b, s, name in (("AUTHENTICATED", "GOOD", "auth_good"), ("AUTHENTICATED", "BAD", "auth_bad"),
                           ("UNAUTHENTICATED", "GOOD", "unauth_good"), ("UNAUTHENTICATED", "BAD", "unauth_bad")))}
    FROM rep GROUP BY sender_key"""
_GATED = f"""counts AS ({_COUNTS}), capped AS (SELECT *, least(unauth_good, unauth_bad) AS ug FROM counts),
    gated AS (SELECT sender_key, (auth_good + 1) / (auth_good + auth_bad + 2) AS auth_mean,
        (auth_good + 1) * (auth_bad + 1) / (power(auth_good + auth_bad + 2, 2) * (auth_good + auth_bad + 3)) AS auth_variance,
        auth_good + auth_bad AS auth_evidence, (ug + 1) / (ug + unauth_bad + 2) AS unauth_mean,
        (ug + 1) * (unauth_bad + 1) / (power(ug + unauth_bad + 2, 2) * (ug + unauth_bad + 3)) AS unauth_variance,
        ug + unauth_bad AS unauth_evidence FROM capped)"""


@query("gated_reputation", f"WITH {_GATED} SELECT sender_key, {', '.join(f'{r6(n)} AS {n}' for n in _VIEWS)} FROM gated", ("rep",))
def gated_reputation(spark, folder):
    found = reputation.gated_reputation(R.reputation_events(spark, folder), R.READ_AT)
    return found.select("sender_key", *[R6(c(n)).alias(n) for n in _VIEWS])


@query("sender_scores", f"WITH {_GATED} SELECT sender_key, {r6('auth_mean')} AS current_reputation_score FROM gated", ("rep",))
def sender_scores(spark, folder):
    return reputation.sender_scores(R.reputation_events(spark, folder), R.READ_AT).withColumn(
        "current_reputation_score", R6(c("current_reputation_score"))
    )


@query("reputation_rollforward", f"""
    WITH counts AS ({_COUNTS}) SELECT sender_key, {', '.join(f'{r6(n)} AS {n}' for n in reputation.COUNTS)} FROM counts""", ("rep",))
def reputation_rollforward(spark, folder):
    """A snapshot folded mid-month, rolled forward with the rest of the log; SQL recounts the whole log."""
    log = R.reputation_events(spark, folder)
    folded_at = F.lit(R.FOLDED_AT).cast("timestamp")
    snapshot = reputation.decayed_counts(log.filter(c("occurred_at") <= folded_at), folded_at).withColumn("folded_at", folded_at)
    rolled = reputation.roll_forward(snapshot, log.filter(c("occurred_at") > folded_at), R.READ_AT)
    return rolled.select("sender_key", *[R6(c(n)).alias(n) for n in reputation.COUNTS])


@query("sender_enrichment", f"""
    WITH {_GATED}, m AS (SELECT email_id, CASE WHEN email_id % 3 = 0 THEN 'nobody' ELSE 'u' || user_id END AS sender_key, bucket
                         FROM keyed JOIN ev ON email_id = event_id)
    SELECT email_id, {r6("coalesce(CASE WHEN bucket = 'AUTHENTICATED' THEN auth_mean ELSE unauth_mean END, 0.5)")} AS reputation_mean,
           {r6("coalesce(CASE WHEN bucket = 'AUTHENTICATED' THEN auth_variance ELSE unauth_variance END, 1 / 12.0e0)")} AS reputation_variance,
           {r6("coalesce(CASE WHEN bucket = 'AUTHENTICATED' THEN auth_evidence ELSE unauth_evidence END, 0)")} AS reputation_evidence
    FROM m LEFT JOIN gated USING (sender_key)""", ("rep", "keyed"))
def sender_enrichment(spark, folder):
    """Messages with their sender's standing; a third of them come from senders never seen."""
    users = R.events(spark, folder).select(c("event_id").alias("email_id"), "user_id")
    known = F.concat(F.lit("u"), c("user_id").cast("string"))
    sent = R.keyed_messages(spark, folder).join(users, "email_id").select(
        "email_id", "bucket", F.when(c("email_id") % 3 == 0, F.lit("nobody")).otherwise(known).alias("sender_key")
    )
    standing = reputation.gated_reputation(R.reputation_events(spark, folder), R.READ_AT)
    rated = reputation.with_sender_reputation(sent, standing)
    names = ("reputation_mean", "reputation_variance", "reputation_evidence")
    return rated.select("email_id", *[R6(c(n)).alias(n) for n in names])


@query("partition_skew", f"""
    SELECT count(*) AS partitions, CAST(sum(n) AS BIGINT) AS events, {r6('max(n) / avg(n)')} AS skew
    FROM (SELECT user_id % 6 AS p, count(*) AS n FROM ev GROUP BY 1)""", ("ev",))
def partition_skew(spark, folder):
    return metrics.partition_skew(R.events(spark, folder), "user_id", 6).withColumn("skew", R6(c("skew")))


@query("distinct_senders", "SELECT DISTINCT sender_key FROM rep", ("rep",))
def distinct_senders(spark, folder):
    return R.reputation_events(spark, folder).select("sender_key").distinct()


def _weighted(spark, folder):
    return feedback.weigh(R.feedback(spark, folder), R.keyed_messages(spark, folder), R.personas(spark, folder))


@query("feedback_weights", f"""
    SELECT feedback_id, sender_key, signal, bucket, trust, {r6('weight')} AS weight FROM weighted""", ("weighted",))
def feedback_weights(spark, folder):
    return _weighted(spark, folder).select("feedback_id", "sender_key", "signal", "bucket", "trust", R6(c("weight")).alias("weight"))


@query("corroboration_gate", f"""
    SELECT run_id, sender_key, signal, bucket, corroborators, {r6('aggregate_weight')} AS aggregate_weight, signals, trusted FROM groups""",
       ("groups",))
def corroboration_gate(spark, folder):
    return feedback.corroborate(_weighted(spark, folder)).withColumn("aggregate_weight", R6(c("aggregate_weight")))


@query("reputation_emissions", f"""
    SELECT run_id || '|' || sender_key || '|' || signal || '|' || bucket AS claim_key, sender_key, signal, bucket,
           {r6('least(aggregate_weight, 5.0e0)')} AS weight, 'feedback' AS source FROM groups WHERE trusted""", ("groups",))
def reputation_emissions(spark, folder):
    emitted = feedback.reputation_emissions(feedback.corroborate(_weighted(spark, folder)))
    return emitted.withColumn("weight", R6(c("weight")))


@query("emitted_once", f"""
    SELECT run_id || '|' || sender_key || '|' || signal || '|' || bucket AS claim_key, sender_key, signal, bucket,
           {r6('least(aggregate_weight, 5.0e0)')} AS weight, 'feedback' AS source FROM groups WHERE trusted""", ("groups",))
def emitted_once(spark, folder):
    """The gate run twice into one ledger of claims: the second run stores nothing."""
    path = f"{ensure_checkpoint_dir(spark)}/emissions-{uuid.uuid4().hex}"
    emitted = feedback.reputation_emissions(feedback.corroborate(_weighted(spark, folder)))
    for _ in range(2):
        ledger.insert(emitted, path, ["claim_key"], ["claim_key"], parts=8)
    return ledger.rows(spark, path, emitted).withColumn("weight", R6(c("weight")))


@query("retrain_emissions", f"""
    SELECT feedback_id, w.email_id, ground_truth AS label, {r6('weight')} AS weight, run_id || '|' || sender_key AS origin,
           corroborators FROM weighted w JOIN groups USING (run_id, sender_key, signal, bucket) WHERE trusted AND weight > 0""", ("groups",))
def retrain_emissions(spark, folder):
    weighted = _weighted(spark, folder)
    groups = feedback.corroborate(weighted)
    # The feedback id rides along as the reporter so that each label can be matched to its event.
    marked = weighted.withColumn("persona_id", c("feedback_id"))
    emitted = feedback.label_emissions(marked, groups)
    told = lambda name: F.get_json_object("provenance", f"$.{name}")
    return emitted.select(
        told("personaId").cast("bigint").alias("feedback_id"), "email_id", "label", R6(c("weight")).alias("weight"),
        F.concat_ws("|", told("runId"), told("senderKey")).alias("origin"), told("corroborators").cast("bigint").alias("corroborators"),
    )


@query("gate_outcome", """
    WITH g AS (SELECT run_id, CAST(sum(signals) AS BIGINT) AS signal_events, count(*) AS groups_considered, count_if(trusted)::BIGINT AS groups_trusted
               FROM groups GROUP BY run_id),
    l AS (SELECT run_id, count(*) AS labels FROM weighted JOIN groups USING (run_id, sender_key, signal, bucket) WHERE trusted AND weight > 0 GROUP BY run_id),
    e AS (SELECT run_id, count(*) AS feedback_events FROM fb GROUP BY run_id)
    SELECT run_id, feedback_events, coalesce(signal_events, 0) AS signal_events, coalesce(groups_considered, 0) AS groups_considered,
           coalesce(groups_trusted, 0) AS groups_trusted, coalesce(groups_considered - groups_trusted, 0) AS groups_blocked,
           coalesce(groups_trusted, 0) AS reputation_events_emitted, coalesce(labels, 0) AS retrain_labels_emitted
    FROM e LEFT JOIN g USING (run_id) LEFT JOIN l USING (run_id)""", ("groups",))
def gate_outcome(spark, folder):
    weighted = _weighted(spark, folder)
    return feedback.gate_outcome(R.feedback(spark, folder), weighted, feedback.corroborate(weighted))


@query("action_counts", "SELECT run_id, action, count(*) AS n FROM fb GROUP BY ALL", ("fb",))
def action_counts(spark, folder):
    return feedback.action_counts(R.feedback(spark, folder))


@query("feedback_drift", f"""
    SELECT sender_key, signal, {r6('sum(weight)')} AS total_weight FROM rep WHERE source = 'feedback' GROUP BY ALL""", ("rep",))
def feedback_drift(spark, folder):
    return feedback.drift(R.reputation_events(spark, folder)).withColumn("total_weight", R6(c("total_weight")))


_SWEEP = """sweep AS (SELECT k AS sweep_index, k / 100.0 AS malicious_fraction,
        coalesce(sum(value) FILTER (event_type = 'error'), 0) / 10000.0 AS ham_drift,
        coalesce(sum(value) FILTER (event_type = 'purchase'), 0) / 10000.0 AS spam_promotion FROM ev GROUP BY k)"""


@query("sensitivity_breakdown", f"""
    WITH {_SWEEP}, b AS (SELECT *, ham_drift <= 0.1 AND spam_promotion <= 0.1 AS blunted FROM sweep)
    SELECT count(*) AS points, count_if(blunted)::BIGINT AS blunted_points,
           min_by(malicious_fraction, sweep_index) FILTER (NOT blunted) AS observed_breakdown_fraction, 15::BIGINT AS breakdown_bomber_count FROM b""",
       ("ev",))
def sensitivity_breakdown(spark, folder):
    drifted = lambda kind: F.coalesce(F.sum(F.when(c("event_type") == kind, c("value"))), F.lit(0.0)) / 10000.0
    sweep = R.events(spark, folder).groupBy(c("k").alias("sweep_index")).agg(
        drifted("error").alias("ham_drift"), drifted("purchase").alias("spam_promotion")
    ).withColumn("malicious_fraction", c("sweep_index") / 100.0)
    return feedback.breakdown(sweep, tolerance=0.1)


@query("delivery_duplicates", """
    SELECT event_type AS consumer_group, count(*) AS deliveries, count(DISTINCT user_id) AS messages,
           count(*) - count(DISTINCT user_id) AS duplicates FROM ev GROUP BY event_type""", ("ev",))
def delivery_duplicates(spark, folder):
    deliveries = R.events(spark, folder).select(c("event_type").alias("consumer_group"), c("user_id").alias("message_key"))
    return metrics.delivery_duplicates(deliveries)


@query("variant_tracks", """
    SELECT variant_id, CASE WHEN label = 'ham' THEN 'LEGIT' ELSE 'SPAM' END AS track,
           CASE WHEN label = 'ham' THEN NOT defender_delivered ELSE defender_delivered END AS attacker_won FROM variants""", ("variants",))
def variant_tracks(spark, folder):
    return arena.with_track(R.variants(spark, folder)).select("variant_id", "track", "attacker_won")


@query("bypass_rates", f"""
    SELECT run_id, {r6("avg(CAST(defender_delivered AS DOUBLE)) FILTER (label <> 'ham')")} AS bypass_rate,
           {r6("avg(1 - CAST(defender_delivered AS DOUBLE)) FILTER (label = 'ham')")} AS false_positive_rate FROM variants GROUP BY run_id""",
       ("variants",))
def bypass_rates(spark, folder):
    return arena.bypass_rates(R.variants(spark, folder)).withColumns(
        {n: R6(c(n)) for n in ("bypass_rate", "false_positive_rate")}
    )


_OUTCOME = "CASE WHEN label <> 'ham' AND defender_delivered THEN 'bypass' WHEN label = 'ham' AND NOT defender_delivered THEN 'false_positive' END"


@query("wronged_variants", f"""
    SELECT variant_id, run_id, {_OUTCOME} AS outcome FROM variants WHERE {_OUTCOME} IS NOT NULL""", ("variants",))
def wronged_variants(spark, folder):
    return arena.wronged(R.variants(spark, folder)).select("variant_id", "run_id", "outcome")


def _scored_variants(spark, folder):
    none = F.lit(None)
    return R.variants(spark, folder).withColumns({
        "hard_rule_decision": none.cast("string"), "calibrated_confidence": c("posterior"),
        "uncertainty_band": F.lit(0.0), "sender_uncertainty": F.lit(0.0), "email_id": c("variant_email_id"),
    })


@query("baseline_bypass", f"""
    SELECT run_id, 'strict' AS policy_version, {r6("avg(CASE WHEN posterior < 0.55e0 THEN 1.0e0 ELSE 0.0e0 END)")} AS baseline_bypass_rate
    FROM variants WHERE label <> 'ham' GROUP BY run_id""", ("variants",))
def baseline_bypass(spark, folder):
    return arena.baseline_bypass(_scored_variants(spark, folder), R.STRICT).withColumn(
        "baseline_bypass_rate", R6(c("baseline_bypass_rate"))
    )


@query("baseline_policy", """
    SELECT 'customer ' || c_custkey AS version FROM customer ORDER BY c_custkey = -1 DESC, c_acctbal, c_custkey LIMIT 1""")
def baseline_policy(spark, folder):
    """Customers as policy rows aged by balance; the named version is missing, so the oldest is chosen."""
    stored = R.table(spark, folder, "customer").select(
        F.concat(F.lit("customer "), c("c_custkey").cast("string")).alias("version"), c("c_acctbal").alias("created_at")
    )
    return arena.resolve_baseline(stored, "customer -1").select("version")


def _runs(spark, folder):
    rates = arena.bypass_rates(R.variants(spark, folder))
    baseline = arena.baseline_bypass(_scored_variants(spark, folder), R.STRICT).select("run_id", "baseline_bypass_rate")
    started = R.variants(spark, folder).groupBy("run_id").agg(F.max("created_at").cast("timestamp").alias("run_at"))
    return rates.join(baseline, "run_id", "left").join(started, "run_id")


_RUNS = """runs AS (SELECT run_id, max(created_at) AS run_at, avg(CAST(defender_delivered AS DOUBLE)) FILTER (label <> 'ham') AS bypass_rate,
        avg(CASE WHEN posterior < 0.55e0 THEN 1.0e0 ELSE 0.0e0 END) FILTER (label <> 'ham') AS baseline_bypass_rate FROM variants GROUP BY run_id)"""


@query("baseline_misses", f"""
    WITH {_RUNS} SELECT run_id, {r6('bypass_rate')} AS bypass_rate, {r6('baseline_bypass_rate')} AS baseline_bypass_rate,
           {r6('baseline_bypass_rate - bypass_rate')} AS delta FROM runs WHERE abs(baseline_bypass_rate - bypass_rate) > 1e-6""", ("variants",))
def baseline_misses(spark, folder):
    return arena.baseline_misses(_runs(spark, folder)).select(
        "run_id", *[R6(c(n)).alias(n) for n in ("bypass_rate", "baseline_bypass_rate", "delta")]
    )


@query("bypass_trend", f"""
    WITH {_RUNS}, recent AS (SELECT * FROM runs),
    ends AS (SELECT min_by(bypass_rate, run_at) AS a, max_by(bypass_rate, run_at) AS b FROM recent WHERE bypass_rate IS NOT NULL)
    SELECT {r6('a')} AS first_value, {r6('b')} AS latest_value, b < a AS improved FROM ends""", ("variants",))
def bypass_trend(spark, folder):
    return arena.bypass_trend(_runs(spark, folder)).withColumns({n: R6(c(n)) for n in ("first_value", "latest_value")})


@query("arena_labels", f"""
    WITH {_RUNS} SELECT variant_id AS email_id, label, 1.0e0 AS weight, 'arena' AS source, {_OUTCOME} AS outcome,
           CASE WHEN label = 'ham' THEN 'LEGIT' ELSE 'SPAM' END AS track, generation, strategy, {r6('bypass_rate')} AS actual_bypass_rate
    FROM variants JOIN runs USING (run_id) WHERE {_OUTCOME} IS NOT NULL""", ("variants",))
def arena_labels(spark, folder):
    runs = _runs(spark, folder).select("run_id", F.lit(0.3).alias("target_bypass_rate"), c("bypass_rate").alias("actual_bypass_rate"))
    labels = arena.corpus_labels(R.variants(spark, folder), runs)
    told = lambda name: F.get_json_object("provenance", f"$.{name}")
    return labels.select(
        "email_id", "label", "weight", "source", told("outcome").alias("outcome"), told("track").alias("track"),
        told("generation").cast("int").alias("generation"), told("strategy").alias("strategy"),
        R6(told("actualBypassRate").cast("double")).alias("actual_bypass_rate"),
    )
