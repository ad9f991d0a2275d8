"""Leak-free evaluation: time-forward family split, its audits, and frozen sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import vocabulary as V
from mailsift.operators.ordered import running_totals


def corpus(labels: DataFrame, messages: DataFrame) -> DataFrame:
    """Labelled messages with the moment they count from."""
    return labels.join(messages, "email_id").select(
        "email_id", "sender_domain", F.coalesce("received_at", "ingested_at").alias("event_time"), "label"
    )


def time_forward_split(
    items: DataFrame, fraction: float = V.EVAL_FRACTION, seed: int = V.EVAL_SEED,
    tie_hash: Column | None = None,
) -> DataFrame:
    """Sends whole families, newest first, to eval until ``round(fraction * N)`` members are there.

    Reads email_id, group_id, event_time and label. A message without a group is its own family. The
    oldest family always trains. Families are ordered over range chunks, never in one task, so a
    corpus of singletons splits as well as a corpus of a few huge families.
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError("the eval fraction must be inside (0, 1)")
    blank = F.coalesce(F.length(F.trim("group_id")) == 0, F.lit(True))
    own = F.concat(F.lit("own:"), F.col("email_id").cast("string"))
    keyed = items.withColumn("group_key", F.when(blank, own).otherwise(F.col("group_id")))
    families = keyed.groupBy("group_key").agg(
        F.max("event_time").alias("newest"), F.count(F.lit(1)).alias("members")
    )
    tie = tie_hash if tie_hash is not None else F.xxhash64("group_key", F.lit(seed))
    ranked = running_totals(
        families.withColumn("tie", tie).withColumn("age_rank", -F.unix_micros("newest")),
        {"through": F.col("members"), "families_through": F.lit(1).cast("bigint")},
        ["age_rank", "tie", "group_key"],
    )
    # One-row aggregate, read as a scalar subquery: the last place in the order is the oldest family.
    totals = ranked.agg(
        F.floor(F.sum("members") * F.lit(float(fraction)) + 0.5).alias("target"), F.count(F.lit(1)).alias("families")
    )
    before = F.col("through") - F.col("members")
    sides = ranked.select(
        "group_key",
        F.when(
            (before < totals.select("target").scalar())
            & (F.col("families_through") < totals.select("families").scalar()),
            F.lit("eval"),
        ).otherwise(F.lit("train")).alias("split_side"),
    )
    return keyed.join(sides, "group_key").select("email_id", "group_key", "event_time", "label", "split_side")


def counts_by_side_and_label(split: DataFrame) -> DataFrame:
    return split.groupBy("split_side", "label").agg(F.count(F.lit(1)).alias("n"))


def group_sides(split: DataFrame) -> DataFrame:
    """Per family: members and time range on each side."""
    train, held = F.col("split_side") == "train", F.col("split_side") == "eval"
    return split.groupBy("group_key").agg(
        F.count_if(train).alias("train"), F.count_if(held).alias("held"),
        F.max(F.when(train, F.col("event_time"))).alias("latest_train"),
        F.min(F.when(held, F.col("event_time"))).alias("earliest_eval"),
    )


def crossing_groups(split: DataFrame) -> DataFrame:
    """Families found on both sides."""
    return group_sides(split).filter("train > 0 and held > 0").select("group_key")


def split_audit(split: DataFrame) -> DataFrame:
    """Sizes, boundaries and leakage of a split, as one row: one pass over families, one over the eval side."""
    totals = group_sides(split).agg(
        F.sum(F.col("train") + F.col("held")).alias("total"),
        F.coalesce(F.sum("train"), F.lit(0)).alias("train_count"),
        F.coalesce(F.sum("held"), F.lit(0)).alias("eval_count"),
        F.max("latest_train").alias("latest_train_time"),
        F.min("earliest_eval").alias("earliest_eval_time"),
        F.count(F.lit(1)).alias("group_count"),
        F.count_if((F.col("train") > 0) & (F.col("held") > 0)).alias("cross_boundary_groups"),
    )
    newest_train = split.filter("split_side = 'train'").agg(F.max("event_time")).scalar()
    inverted = split.filter("split_side = 'eval'").filter(F.col("event_time") < newest_train).agg(F.count(F.lit(1)))
    return (
        totals.withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("temporal_inversions", inverted.scalar())
        .withColumn("leakage_free", (F.col("cross_boundary_groups") == 0) & (F.col("temporal_inversions") == 0))
    )


def judging_sources(split: DataFrame, golden: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every id any evaluation set judges by."""
    return (
        split.filter("split_side = 'eval'").select("email_id")
        .union(golden.select("email_id")).union(fresh.select("email_id")).distinct()
    )


def judging_audit(judging: DataFrame, ground_truth: DataFrame, retrain_labels: DataFrame) -> DataFrame:
    """Whether anything judged rests on feedback alone."""
    feedback = retrain_labels.filter("source = 'feedback'").select("email_id").distinct()
    truth = ground_truth.select("email_id", F.lit(True).alias("has_truth"))
    marked = judging.join(truth, "email_id", "left").join(
        feedback.withColumn("has_feedback", F.lit(True)), "email_id", "left"
    )
    no_truth = F.col("has_truth").isNull()
    return (
        marked.agg(
            F.count(F.lit(1)).alias("judging_total"),
            F.count_if(no_truth).alias("without_ground_truth"),
            F.count_if(no_truth & F.col("has_feedback").isNotNull()).alias("feedback_only_in_judging"),
        )
        .withColumn("feedback_labeled_total", feedback.agg(F.count(F.lit(1))).scalar())
        .withColumn("clean", (F.col("feedback_only_in_judging") == 0) & (F.col("without_ground_truth") == 0))
    )


def labelled_split(split: DataFrame, labels: DataFrame) -> DataFrame:
    """Side and polarity of every labelled message, for calibration."""
    return split.select("email_id", "split_side").join(labels.select("email_id", "label"), "email_id").select(
        "email_id", "split_side", (F.col("label") != "ham").alias("positive")
    )


def frozen_golden(split: DataFrame, labels: DataFrame, version: str) -> DataFrame:
    """The eval side with its labels under an immutable version name."""
    return (
        split.filter("split_side = 'eval'").select("email_id").join(labels.select("email_id", "label"), "email_id")
        .select(F.lit(version).alias("version"), "email_id", "label")
    )


def golden_counts(golden: DataFrame) -> DataFrame:
    return golden.groupBy("version", "label").agg(F.count(F.lit(1)).alias("n"))
