"""Fusion, policy tiers, slow-path routing, burst escalation and resolution of pending rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import vocabulary as V
from mailsift.functions import numeric
from mailsift.functions.tiers import lookup, most_severe, severity
from mailsift.operators.rules import floor_at_rule

@dataclass(frozen=True)
class Policy:
    """Thresholds of one policy version; the ladder must not decrease."""

    version: str
    warn: float = 0.50
    quarantine: float = 0.80
    block: float = 0.95
    slow_path: float = 0.40
    band: float = 0.05
    burst: int = 20
    model_version: str = "m1"

    def __post_init__(self) -> None:
        for name in ("warn", "quarantine", "block", "slow_path", "band"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must be in [0, 1]")
        if not self.warn <= self.quarantine <= self.block:
            raise ValueError("tier thresholds must not decrease")
        if self.burst < 1:
            raise ValueError("the burst threshold must be at least 1")

    def as_column(self) -> Column:
        return F.struct(*[F.lit(value).alias(name) for name, value in asdict(self).items()])


POLICY_FIELDS = ", ".join(f"{f.name}: {dict(str='string', float='double', int='int')[str(f.type)]}" for f in fields(Policy))


def under_policies(scored: DataFrame, policies: Sequence[Policy], out: str = "policy") -> DataFrame:
    """Every row once per policy. The policies are one folded literal, whatever their number: no join, no shuffle."""
    listed = F.from_json(F.lit(json.dumps([asdict(p) for p in policies])), f"array<struct<{POLICY_FIELDS}>>")
    return scored.withColumn(out, F.explode(listed))


def fuse(scored: DataFrame, training_base_rate: float) -> DataFrame:
    """Adds posterior, uncertainty_band and sender_uncertainty from reputation and model confidence.

    Rows without model scores (a hard rule decided) keep nulls.
    """
    prior = F.lit(1.0) - F.col("reputation_mean")
    base = F.lit(float(training_base_rate))
    has_model = F.col("calibrated_confidence").isNotNull()
    fused_logit = numeric.fused_logit(prior, F.col("calibrated_confidence"), base)
    return (
        scored.withColumn("posterior_logit", F.when(has_model, fused_logit))
        .withColumn("posterior", numeric.sigmoid(F.col("posterior_logit")))
        .withColumn(
            "uncertainty_band",
            F.when(has_model, numeric.uncertainty_band(prior, F.col("posterior"), F.col("reputation_variance"))),
        )
        .withColumn("sender_uncertainty", F.when(has_model, F.sqrt("reputation_variance")))
    )


def tier_for(policy: Column, posterior: Column) -> Column:
    return (
        F.when(posterior >= policy["block"], F.lit("BLOCK"))
        .when(posterior >= policy["quarantine"], F.lit("QUARANTINE"))
        .when(posterior >= policy["warn"], F.lit("WARN"))
        .otherwise(F.lit("ALLOW"))
    )


def base_tier(policy: Column, rule_tier: Column, posterior: Column) -> Column:
    """A rule's tier stands; without a fused score the model's own ALLOW stands."""
    return F.coalesce(
        rule_tier, F.when(posterior.isNotNull(), tier_for(policy, posterior)), F.lit("ALLOW")
    )


def routing_reasons(
    policy: Column, confidence: Column, posterior: Column, band: Column, sender_uncertainty: Column
) -> Column:
    """Every reason to escalate, in fixed order; empty when the fast path is enough."""
    margin = F.lit(2.0) * F.abs(confidence - 0.5)
    nearest = F.least(*[F.abs(posterior - policy[t]) for t in ("warn", "quarantine", "block")])
    tests = (
        margin < policy["slow_path"],
        sender_uncertainty >= policy["band"],
        nearest <= policy["band"] + band,
    )
    return F.filter(
        F.array(*[F.when(t, F.lit(name)) for t, name in zip(tests, V.ROUTING_REASONS)]), lambda r: r.isNotNull()
    )


def scored_under(policy: Column) -> Column:
    """Decision, route and reasons of a scored row under one policy, as a struct.

    Reads hard_rule_decision, calibrated_confidence, posterior, uncertainty_band and sender_uncertainty.
    """
    c = F.col
    ruled = c("hard_rule_decision").isNotNull()
    reasons = F.when(
        ~ruled & c("posterior").isNotNull(),
        routing_reasons(
            policy, c("calibrated_confidence"), c("posterior"), c("uncertainty_band"), c("sender_uncertainty")
        ),
    ).otherwise(F.array().cast("array<string>"))
    route = F.when(ruled, F.lit("HARD_RULE")).when(F.size(reasons) > 0, F.lit("LLM")).otherwise(F.lit("MODEL"))
    return F.struct(
        base_tier(policy, c("hard_rule_decision"), c("posterior")).alias("decision"),
        route.alias("route_used"),
        reasons.alias("routing_reasons"),
        policy["version"].alias("policy_version"),
    )


def score_policies(scored: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Tier, route and reasons of every message under every policy, without bursts or side effects."""
    return (
        under_policies(scored, policies)
        .withColumn("_outcome", scored_under(F.col("policy")))
        .select(*scored.columns, "_outcome.*")
    )


def burst_trigger(sender_count: Column, duplicate_count: Column, threshold: Column) -> Column:
    """Sender velocity is tested before content."""
    return F.when(sender_count > threshold, F.lit("SENDER_VELOCITY")).when(
        duplicate_count > threshold, F.lit("CONTENT_NEAR_DUP")
    )


def escalate_bursts(decided: DataFrame, threshold: Column) -> DataFrame:
    """Raises a bursting row to the burst tier; the reason is added only when the tier changed."""
    raised = most_severe(F.col("decision"), F.lit(V.BURST_TIER))
    changed = F.col("burst_trigger").isNotNull() & (raised != F.col("decision"))
    return (
        decided.withColumn(
            "burst_trigger",
            burst_trigger(
                F.coalesce("sender_count", F.lit(0)), F.coalesce("duplicate_count", F.lit(0)), threshold
            ),
        )
        .withColumn(
            "reason_codes",
            F.when(changed, F.array_append("reason_codes", "BURST_OVERRIDE")).otherwise(F.col("reason_codes")),
        )
        .withColumn("decision", F.when(changed, raised).otherwise(F.col("decision")))
    )


def resolve_pending(pending: DataFrame) -> DataFrame:
    """Final tier and state of rows that carry ``verdict`` (null: the slow path did not answer).

    Reads fast_tier, hard_rule_decision and verdict.
    """
    degraded = F.col("verdict").isNull()
    conservative = most_severe(F.col("fast_tier"), F.lit("QUARANTINE"))
    candidate = F.when(degraded, conservative).otherwise(lookup(F.col("verdict"), V.VERDICT_TIERS))
    held = floor_at_rule(F.col("hard_rule_decision"), candidate)
    return pending.withColumn("resolved_tier", held).withColumn(
        "resolution_state",
        F.when(degraded, F.lit("DEGRADED"))
        .when(F.col("resolved_tier").isin(*V.DELIVERED_TIERS), F.lit("PROMOTED"))
        .otherwise(F.lit("CONFIRMED")),
    )


def decision_diff(active: Column, shadow: Column) -> Column:
    """Agreement of two tiers and the direction of a disagreement."""
    a, s = severity(active), severity(shadow)
    direction = (
        F.when(s > a, F.lit("SHADOW_MORE_SEVERE")).when(s < a, F.lit("SHADOW_LESS_SEVERE")).otherwise(F.lit("SAME"))
    )
    return F.struct(
        F.when(s == a, F.lit("AGREE")).otherwise(F.lit("DISAGREE")).alias("agreement"), direction.alias("direction")
    )


def shadow_decisions(scored: DataFrame, active: Policy, shadow: Policy | None) -> DataFrame:
    """The same scores tiered under both policies in one projection; empty when there is nothing to compare."""
    other = shadow or active
    live, tried = F.col("_live"), F.col("_tried")
    diff = decision_diff(live["decision"], tried["decision"])
    paired = (
        scored.withColumn("_live", scored_under(active.as_column()))
        .withColumn("_tried", scored_under(other.as_column()))
        .select(
            "email_id", "posterior",
            F.lit(active.version).alias("active_version"), F.lit(other.version).alias("shadow_version"),
            live["decision"].alias("active_decision"), tried["decision"].alias("shadow_decision"),
            live["route_used"].alias("active_route"), tried["route_used"].alias("shadow_route"),
            diff["agreement"].alias("agreement"), diff["direction"].alias("direction"),
        )
    )
    return paired if other.version != active.version else paired.limit(0)
