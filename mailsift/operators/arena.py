"""Measurements of adversarial runs: bypass rates, baselines, trends and the labels they feed back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsift.functions.tiers import attacker_won, delivered, track
from mailsift.operators.feedback import provenance
from mailsift.operators.scoring import Policy, score_policies
from mailsift.operators.windows import first_and_latest, recent_then_oldest_first


def with_track(variants: DataFrame) -> DataFrame:
    side = track(F.col("label"))
    return variants.withColumn("track", side).withColumn(
        "attacker_won", attacker_won(side, F.col("defender_delivered"))
    )


def bypass_rates(variants: DataFrame) -> DataFrame:
    """Share of abuse let through and of ham withheld, per run; null when a track has no variant."""
    passed = F.col("defender_delivered").cast("double")
    return variants.groupBy("run_id").agg(
        F.avg(F.when(F.col("label") != "ham", passed)).alias("bypass_rate"),
        F.avg(F.when(F.col("label") == "ham", 1.0 - passed)).alias("false_positive_rate"),
    )


def wronged(variants: DataFrame) -> DataFrame:
    """Variants the defender got wrong: abuse delivered, or ham withheld."""
    abuse = F.col("label") != "ham"
    outcome = F.when(abuse & F.col("defender_delivered"), F.lit("bypass")).when(
        ~abuse & ~F.col("defender_delivered"), F.lit("false_positive")
    )
    return variants.withColumn("outcome", outcome).filter(F.col("outcome").isNotNull())


def resolve_baseline(policies: DataFrame, configured: str | None = None) -> DataFrame:
    """The configured policy version if it exists, else the oldest, as one row."""
    preferred = F.col("version").eqNullSafe(F.lit(configured))
    return policies.orderBy(F.desc(preferred), "created_at", "version").limit(1)


def baseline_bypass(scored_variants: DataFrame, baseline: Policy) -> DataFrame:
    """Bypass rate of each run's abuse variants had the baseline policy decided them."""
    return (
        score_policies(scored_variants.filter("label <> 'ham'"), [baseline])
        .groupBy("run_id", "policy_version")
        .agg(F.avg(delivered(F.col("decision")).cast("double")).alias("baseline_bypass_rate"))
    )


def corpus_labels(variants: DataFrame, runs: DataFrame, weight: float = 1.0) -> DataFrame:
    """Retrain labels from variants that beat the defender, with where they came from."""
    c = F.col
    joined = wronged(with_track(variants)).join(runs.select("run_id", "target_bypass_rate", "actual_bypass_rate"), "run_id")
    return joined.select(
        c("variant_email_id").alias("email_id"), "label", F.lit(float(weight)).alias("weight"),
        F.lit("arena").alias("source"),
        provenance(
            runId=c("run_id"), variantId=c("variant_id"), seedEmailId=c("seed_email_id"), generation=c("generation"),
            track=c("track"), strategy=c("strategy"), attackerModel=c("attacker_model"), outcome=c("outcome"),
            targetBypassRate=c("target_bypass_rate"), actualBypassRate=c("actual_bypass_rate"),
        ).alias("provenance"),
    )


def baseline_misses(runs: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Runs where baseline and current defender measurably differ; positive delta: the baseline missed more."""
    delta = F.col("baseline_bypass_rate") - F.col("bypass_rate")
    return runs.filter(F.abs(delta) > epsilon).select(
        "run_id", "run_at", "bypass_rate", "baseline_bypass_rate", delta.alias("delta")
    ).orderBy(F.desc("run_at"), F.desc("run_id"))


def bypass_trend(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """First and latest known rate of all finished runs, or of the newest ``limit``."""
    recent = runs if limit is None else recent_then_oldest_first(runs, "run_at", "run_id", limit)
    return first_and_latest(recent.withColumn("_at", F.struct("run_at", "run_id")), "_at", "bypass_rate")
