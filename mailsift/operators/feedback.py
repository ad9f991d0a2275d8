"""User feedback: weighting, corroboration, emission, drift and breakdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import vocabulary as V
from mailsift.functions.tiers import feedback_signal, feedback_trust

GROUP = ("run_id", "sender_key", "signal", "bucket")


def weigh(feedback: DataFrame, messages: DataFrame, personas: DataFrame, malicious_trust: float = V.MALICIOUS_TRUST) -> DataFrame:
    """Signal-bearing feedback with its sender, bucket, trust and weight; unknown mail or reporter drops out.

    Catalyst decides from table sizes whether a side is broadcast.
    """
    signalled = feedback.withColumn("signal", feedback_signal(F.col("action"))).filter(F.col("signal").isNotNull())
    return (
        signalled.join(messages.select("email_id", "sender_key", "bucket"), "email_id")
        .join(personas.select("persona_id", "malicious"), "persona_id")
        .withColumn("trust", feedback_trust(F.col("malicious"), malicious_trust))
        .withColumn("weight", F.col("trust") * F.col("action_confidence"))
    )


def corroborate(
    weighted: DataFrame, min_reporters: int = V.MIN_CORROBORATORS, min_weight: float = V.MIN_GROUP_WEIGHT
) -> DataFrame:
    """Reporters, weight and trust of each (run, sender, signal, bucket) group.

    Folds per reporter first, so a group that holds a third of all feedback is spread by reporter.
    """
    per_reporter = weighted.groupBy(*GROUP, "persona_id").agg(
        F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")
    )
    groups = per_reporter.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("corroborators"), F.sum("w").alias("aggregate_weight"), F.sum("n").alias("signals")
    )
    # Sums of decimals such as 0.1 must not fail the floor by a rounding error of the last bit.
    heavy = F.round("aggregate_weight", 9) >= min_weight
    return groups.withColumn("trusted", (F.col("corroborators") >= min_reporters) & heavy)


def reputation_emissions(groups: DataFrame, cap: float = V.MAX_REPUTATION_WEIGHT) -> DataFrame:
    """One reputation event per trusted group, its weight capped; the claim key makes a re-run a no-op."""
    return groups.filter("trusted").select(
        F.concat_ws("|", *GROUP).alias("claim_key"), "sender_key", "signal", "bucket",
        F.least("aggregate_weight", F.lit(float(cap))).alias("weight"), F.lit("feedback").alias("source"),
    )


def provenance(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def label_emissions(weighted: DataFrame, groups: DataFrame) -> DataFrame:
    """One retrain label per member of a trusted group that carries weight."""
    trusted = groups.filter("trusted").select(*GROUP, "corroborators", "aggregate_weight")
    c = F.col
    return weighted.filter("weight > 0").join(trusted, list(GROUP)).select(
        "email_id", c("ground_truth").alias("label"), "weight", F.lit("feedback").alias("source"),
        provenance(
            runId=c("run_id"), senderKey=c("sender_key"), signal=c("signal"), bucket=c("bucket"),
            corroborators=c("corroborators"), aggregateWeight=c("aggregate_weight"), personaId=c("persona_id"),
            confidence=c("action_confidence"), trust=c("trust"), itemWeight=c("weight"),
        ).alias("provenance"),
    )


def gate_outcome(feedback: DataFrame, weighted: DataFrame, groups: DataFrame) -> DataFrame:
    """Events, signals, groups and emissions per run. Each group carries its own counts into one aggregate."""
    positive = weighted.filter("weight > 0").groupBy(*GROUP).agg(F.count(F.lit(1)).alias("labels"))
    trusted = F.col("trusted")
    per_run = groups.join(positive, list(GROUP), "left").groupBy("run_id").agg(
        F.sum("signals").alias("signal_events"),
        F.count(F.lit(1)).alias("groups_considered"),
        F.count_if(trusted).alias("groups_trusted"),
        F.count_if(~trusted).alias("groups_blocked"),
        F.count_if(trusted).alias("reputation_events_emitted"),
        F.sum(F.when(trusted, F.coalesce("labels", F.lit(0))).otherwise(F.lit(0))).alias("retrain_labels_emitted"),
    )
    events = feedback.groupBy("run_id").agg(F.count(F.lit(1)).alias("feedback_events"))
    names = [c for c in per_run.columns if c != "run_id"]
    return events.join(per_run, "run_id", "left").select(
        "run_id", "feedback_events", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def action_counts(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("run_id", "action").agg(F.count(F.lit(1)).alias("n"))


def drift(reputation_events: DataFrame) -> DataFrame:
    """Undecayed weight feedback pushed onto each sender, by signal."""
    return reputation_events.filter("source = 'feedback'").groupBy("sender_key", "signal").agg(
        F.sum("weight").alias("total_weight")
    )


def breakdown(sweep: DataFrame, tolerance: float = V.DRIFT_TOLERANCE, malicious_trust: float = V.MALICIOUS_TRUST,
              min_weight: float = V.MIN_GROUP_WEIGHT) -> DataFrame:
    """First malicious share whose drift exceeds the tolerance, and how many bombers the weight floor takes.

    Reads sweep_index, malicious_fraction, ham_drift and spam_promotion.
    """
    blunted = (F.col("ham_drift") <= tolerance) & (F.col("spam_promotion") <= tolerance)
    bombers = F.ceil(F.round(F.lit(min_weight) / F.lit(malicious_trust), 9))
    return sweep.agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if(blunted).alias("blunted_points"),
        F.min_by(F.when(~blunted, F.col("malicious_fraction")), F.when(~blunted, F.col("sweep_index"))).alias(
            "observed_breakdown_fraction"
        ),
    ).withColumn("breakdown_bomber_count", bombers)
