"""The whole decision of a message table, and the whole quality report of a set of policies."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from mailsift import vocabulary as V
from mailsift.functions.text import sender_key
from mailsift.functions.tiers import explanation
from mailsift.operators import metrics, rules, scoring
from mailsift.operators.features import extract_features, feature_array, reputation_bucket
from mailsift.operators.reputation import with_sender_reputation
from mailsift.operators.training import score_classes

# Turns rows with ``raw_malicious`` into rows with ``calibrated_confidence``; any Transformer's ``transform`` fits.
Calibrator = Callable[[DataFrame], DataFrame]
# Turns rows with ``feature_vector`` into rows with spam_score, phishing_score and raw_malicious.
Classifier = Callable[[DataFrame], DataFrame]


def raw_as_confidence(df: DataFrame) -> DataFrame:
    return df.withColumn("calibrated_confidence", F.col("raw_malicious"))


def classifier(model: PipelineModel) -> Classifier:
    return lambda df: score_classes(model, df)


def score_messages(
    messages: DataFrame, denylist: DataFrame, classify: Classifier, calibrate: Calibrator, reputation: DataFrame,
    training_base_rate: float, brands: Sequence[tuple[str, str]] = V.DEFAULT_BRANDS,
    more_rules: Sequence[rules.Rule] = (),
) -> DataFrame:
    """Rules, model, calibration, reputation and fusion of every message, one row each.

    Bodies are read by the features (twice), the link hosts and the fingerprints, each in a projection of its own; the joins move ids,
    tokens and numbers only.
    A message a rule decided gets no model scores, so it is neither fused nor routed.
    """
    extracted = extract_features(messages, keep=["sender", "sender_domain", "auth_results"])
    narrow = extracted.select(
        "email_id", "sender_domain", "auth_results",
        sender_key(F.col("sender"), F.col("sender_domain")).alias("sender_key"),
        reputation_bucket(F.col("features.auth")).alias("bucket"),
        array_to_vector(feature_array(F.col("features")).cast("array<double>")).alias("feature_vector"),
    )
    hits = rules.denylisted_ids(messages, denylist).withColumn("_hit", F.lit(True))
    flagged = narrow.join(hits, "email_id", "left").withColumn("links_to_denylist", F.coalesce("_hit", F.lit(False)))
    ruled = rules.apply_rules(flagged.drop("_hit"), [*rules.default_rules(brands), *more_rules])
    modelled = calibrate(classify(ruled))
    open_only = F.col("hard_rule_decision").isNull()
    masked = modelled.withColumns(
        {n: F.when(open_only, F.col(n)) for n in ("spam_score", "phishing_score", "raw_malicious", "calibrated_confidence")}
    ).withColumn("reason_codes", F.col("rule_reasons")).drop("rule_reasons", "feature_vector")
    return scoring.fuse(with_sender_reputation(masked, reputation), training_base_rate)


def decide(scored: DataFrame, policy: scoring.Policy, bursts: DataFrame | None = None) -> DataFrame:
    """Final decision of scored messages: tier, burst escalation, slow-path routing, rule floor, sentence.

    ``bursts`` holds sender_count and duplicate_count per message; replays and shadow runs leave it out.
    """
    tiered = scoring.score_policies(scored, [policy])
    if bursts is not None:
        counted = tiered.join(bursts.select("email_id", "sender_count", "duplicate_count"), "email_id", "left")
        tiered = scoring.escalate_bursts(counted, F.lit(policy.burst)).drop("sender_count", "duplicate_count")
    final: Column = rules.floor_at_rule(F.col("hard_rule_decision"), F.col("decision"))
    return tiered.withColumn("decision", final).withColumn(
        "explanation", explanation(F.col("decision"), F.col("reason_codes"))
    )


def quality_report(
    scored: DataFrame, labels: DataFrame, policies: Sequence[scoring.Policy], baseline: str,
    golden: DataFrame | None = None, golden_version: str | None = None,
) -> DataFrame:
    """Replay under every policy, metrics on the judging set, gate, and change against a baseline policy.

    Only judged messages are replayed: they are found first, then scored once per policy.
    """
    judged = scoring.score_policies(metrics.labelled_decisions(scored, labels, golden, golden_version), policies)
    gated = metrics.precision_gate(metrics.policy_metrics(judged))
    reference = gated.filter(F.col("policy_version") == baseline)
    return gated.withColumns(
        {f"{name}_delta": F.col(name) - reference.select(name).scalar() for name in metrics.COMPARED}
    )
