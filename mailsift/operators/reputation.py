"""Sender reputation: decayed evidence, Beta posteriors, the authentication gate and roll-forward."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import vocabulary as V
from mailsift.functions.numeric import age_seconds, surviving_fraction

COUNTS = ("auth_good", "auth_bad", "unauth_good", "unauth_bad")


def as_timestamp(moment: datetime | str | Column) -> Column:
    if isinstance(moment, Column):
        return moment
    return F.lit(moment).cast("timestamp")


def decayed_counts(
    events: DataFrame, read_at: datetime | str | Column, half_life_seconds: float = V.HALF_LIFE_SECONDS,
    key: str = "sender_key",
) -> DataFrame:
    """Decayed weight per sender, split by bucket and signal.

    One hash aggregate with partial sums: a sender holding a third of the log shuffles one row per task.
    """
    weight = F.col("weight") * surviving_fraction(
        age_seconds(F.col("occurred_at"), as_timestamp(read_at)), half_life_seconds
    )

    def side(bucket: str, signal: str) -> Column:
        wanted = (F.col("bucket") == bucket) & (F.col("signal") == signal)
        return F.coalesce(F.sum(F.when(wanted, weight)), F.lit(0.0))

    return events.groupBy(key).agg(
        side("AUTHENTICATED", "GOOD").alias("auth_good"),
        side("AUTHENTICATED", "BAD").alias("auth_bad"),
        side("UNAUTHENTICATED", "GOOD").alias("unauth_good"),
        side("UNAUTHENTICATED", "BAD").alias("unauth_bad"),
    )


def beta_mean(good: Column, bad: Column, alpha: float = V.PRIOR_ALPHA, beta: float = V.PRIOR_BETA) -> Column:
    return (good + alpha) / (good + bad + (alpha + beta))


def beta_variance(good: Column, bad: Column, alpha: float = V.PRIOR_ALPHA, beta: float = V.PRIOR_BETA) -> Column:
    a, b = good + alpha, bad + beta
    total = a + b
    return a * b / (total * total * (total + 1.0))


def gated(counts: DataFrame, alpha: float = V.PRIOR_ALPHA, beta: float = V.PRIOR_BETA) -> DataFrame:
    """Both views of each sender: unauthenticated praise may not outweigh unauthenticated complaints."""
    if alpha <= 0 or beta <= 0:
        raise ValueError("the prior must be positive")
    c = F.col
    capped = F.least(c("unauth_good"), F.lit(alpha / beta) * c("unauth_bad"))
    return (
        counts.withColumn("unauth_good_capped", capped)
        .withColumn("auth_mean", beta_mean(c("auth_good"), c("auth_bad"), alpha, beta))
        .withColumn("auth_variance", beta_variance(c("auth_good"), c("auth_bad"), alpha, beta))
        .withColumn("auth_evidence", c("auth_good") + c("auth_bad"))
        .withColumn("unauth_mean", beta_mean(c("unauth_good_capped"), c("unauth_bad"), alpha, beta))
        .withColumn("unauth_variance", beta_variance(c("unauth_good_capped"), c("unauth_bad"), alpha, beta))
        .withColumn("unauth_evidence", c("unauth_good_capped") + c("unauth_bad"))
    )


def gated_reputation(events: DataFrame, read_at: datetime | str | Column, **options) -> DataFrame:
    return gated(decayed_counts(events, read_at, **options))


def sender_scores(events: DataFrame, read_at: datetime | str | Column, **options) -> DataFrame:
    """The score table rebuilt from the whole log: the authenticated mean per sender."""
    return gated_reputation(events, read_at, **options).select(
        "sender_key", F.col("auth_mean").alias("current_reputation_score")
    )


def roll_forward(
    snapshot: DataFrame, newer_events: DataFrame, read_at: datetime | str | Column,
    half_life_seconds: float = V.HALF_LIFE_SECONDS,
) -> DataFrame:
    """Scale a folded snapshot (counts, folded_at) to ``read_at`` and add only what happened since.

    Decay composes, so this equals a recount of the whole log.
    """
    kept = surviving_fraction(age_seconds(F.col("folded_at"), as_timestamp(read_at)), half_life_seconds)
    scaled = snapshot.select("sender_key", *[(F.col(c) * kept).alias(c) for c in COUNTS])
    fresh = decayed_counts(newer_events, read_at, half_life_seconds).select("sender_key", *COUNTS)
    return scaled.unionByName(fresh).groupBy("sender_key").agg(*[F.sum(c).alias(c) for c in COUNTS])


def with_sender_reputation(messages: DataFrame, reputation: DataFrame) -> DataFrame:
    """Adds the view of each sender that fits the message's bucket; unseen senders get the prior."""
    empty = F.lit(0.0)
    aligned = F.col("bucket") == "AUTHENTICATED"

    def view(name: str, default: Column) -> Column:
        return F.coalesce(F.when(aligned, F.col(f"auth_{name}")).otherwise(F.col(f"unauth_{name}")), default)

    columns = [f"{side}_{name}" for side in ("auth", "unauth") for name in ("mean", "variance", "evidence")]
    joined = messages.join(reputation.select("sender_key", *columns), "sender_key", "left")
    return (
        joined.withColumn("reputation_mean", view("mean", beta_mean(empty, empty)))
        .withColumn("reputation_variance", view("variance", beta_variance(empty, empty)))
        .withColumn("reputation_evidence", view("evidence", empty))
        .drop(*columns)
    )
