"""Run metrics, comparisons, gates and live-report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import vocabulary as V
from mailsift.functions.numeric import clamp_unit, ratio
from mailsift.functions.tiers import delivered, is_abuse, lookup, route_bucket

COMPARED = ("precision", "recall", "bypass_rate", "escalation_rate", "mean_latency_ms")


def labelled_decisions(
    decisions: DataFrame, labels: DataFrame, golden: DataFrame | None = None, golden_version: str | None = None
) -> DataFrame:
    """Decisions with their truth, optionally only those in a judging set (a given frozen version of it)."""
    joined = decisions.join(labels.select("email_id", "label"), "email_id")
    if golden is None:
        return joined
    if golden_version is not None:
        golden = golden.filter(F.col("version") == golden_version)
    return joined.join(golden.select("email_id"), "email_id", "left_semi")


def policy_metrics(labelled: DataFrame, by: tuple[str, ...] = ("policy_version",)) -> DataFrame:
    """Confusion counts and rates per run; withheld is the positive prediction. Empty denominators give 0."""
    abuse, passed = is_abuse(F.col("label")), delivered(F.col("decision"))
    llm = F.col("route_used") == "LLM"
    cost = lookup(F.col("route_used"), V.NOMINAL_ROUTE_MS)
    counted = labelled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(abuse).alias("abuse_total"),
        F.count_if(~abuse).alias("ham_total"),
        F.count_if(abuse & ~passed).alias("true_positives"),
        F.count_if(~abuse & ~passed).alias("false_positives"),
        F.count_if(abuse & passed).alias("false_negatives"),
        F.count_if(llm).alias("escalations"),
        F.sum(cost).alias("_latency"),
    )
    c = F.col
    return counted.select(
        *by, "total", "abuse_total", "ham_total", "true_positives", "false_positives", "false_negatives",
        "escalations",
        ratio(c("true_positives"), c("true_positives") + c("false_positives")).alias("precision"),
        ratio(c("true_positives"), c("abuse_total")).alias("recall"),
        ratio(c("false_negatives"), c("abuse_total")).alias("bypass_rate"),
        ratio(c("escalations"), c("total")).alias("escalation_rate"),
        ratio(c("_latency"), c("total")).alias("mean_latency_ms"),
    )


def compare_runs(metrics: DataFrame, a: str, b: str, key: str = "policy_version") -> DataFrame:
    """Metrics of run ``b`` minus run ``a``, as one row; no row when either run is empty."""
    value = lambda run, name: F.max(F.when(F.col(key) == run, F.col(name)))
    pair = metrics.filter(F.col(key).isin(a, b)).agg(
        *[value(run, name).alias(f"{name}_{tag}") for name in COMPARED for run, tag in ((a, "a"), (b, "b"))]
    )
    return pair.select(
        F.lit(a).alias("run_a"), F.lit(b).alias("run_b"), "*",
        *[(F.col(f"{n}_b") - F.col(f"{n}_a")).alias(f"{n}_delta") for n in COMPARED],
    ).filter(F.col("precision_a").isNotNull() & F.col("precision_b").isNotNull())


def precision_gate(metrics: DataFrame, floor: float = V.PRECISION_FLOOR, min_samples: int = V.MIN_GOLDEN_SAMPLES) -> DataFrame:
    """Pass or fail per run, with the reason spelled out."""
    small = F.col("total") < min_samples
    passed = ~small & (F.col("precision") >= floor)
    sign = F.when(F.col("precision") >= floor, F.lit(">=")).otherwise(F.lit("<"))
    # The wording of both messages.
    reason = F.when(
        small,
        F.format_string(
            "golden set too small to judge precision: %d < %d minimum samples", F.col("total"), F.lit(min_samples)
        ),
    ).otherwise(
        F.format_string(
            "precision %.4f %s floor %.4f on %d golden emails", F.col("precision"), sign, F.lit(floor), F.col("total")
        )
    )
    return metrics.withColumn("passed", passed).withColumn("reason", reason)


def agreement_stats(shadow: DataFrame) -> DataFrame:
    """Agreement of every (active, shadow) pair at once."""
    agree, direction = F.col("agreement") == "AGREE", F.col("direction")
    return (
        shadow.groupBy("active_version", "shadow_version")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(agree).alias("agree"),
            F.count_if(~agree).alias("disagree"),
            F.count_if(direction == "SHADOW_MORE_SEVERE").alias("more_severe"),
            F.count_if(direction == "SHADOW_LESS_SEVERE").alias("less_severe"),
        )
        .withColumn("agreement_rate", ratio(F.col("agree"), F.col("total")))
    )


def route_mix(decisions: DataFrame) -> DataFrame:
    """Decisions and share per route bucket; every bucket is present."""
    counts = decisions.groupBy(route_bucket(F.col("route_used")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    names = F.array(*[F.lit(b) for b in ("rules", "reputation", "llm")])
    buckets = decisions.sparkSession.range(1).select(F.explode(names).alias("bucket"))
    filled = buckets.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    return filled.withColumn("share", ratio(F.col("n"), total))


def tier_mix(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("route_used") == "LLM").alias("escalated")
    )


def reason_counts(decisions: DataFrame, reasons: str = "routing_reasons") -> DataFrame:
    return decisions.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(decisions: DataFrame, budget_ms: float = 100.0) -> DataFrame:
    """Exact p50/p95/p99 of fast-path latency.

    Latencies are whole milliseconds, so each route first folds to one row per distinct value and the
    percentile works on those frequencies.
    """
    folded = (
        decisions.filter("route_used <> 'LLM'").groupBy("route_used", "latency_ms").agg(F.count(F.lit(1)).alias("n"))
    )
    at = lambda p: F.percentile("latency_ms", p, F.col("n"))
    return folded.groupBy("route_used").agg(
        F.sum("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99")
    ).withColumn("within_budget", F.col("p95") <= budget_ms)


def spend_meter(decisions: DataFrame, cap: float, by: Column) -> DataFrame:
    """Spend per period against its cap."""
    cost = F.coalesce(F.sum("cost_usd").cast("double"), F.lit(0.0))
    share = F.lit(0.0) if cap <= 0 else clamp_unit(F.col("cost_usd") / cap)
    full = F.lit(False) if cap <= 0 else F.col("cost_usd") >= cap - 1e-9
    return (
        decisions.groupBy(by.alias("period")).agg(cost.alias("cost_usd"))
        .withColumn("cost_ratio", share).withColumn("at_cap", full)
    )


def partition_skew(events: DataFrame, key: str, partitions: int) -> DataFrame:
    """Largest over mean load of the used hash partitions of ``key``; 1.0 without events."""
    counts = events.groupBy(F.pmod(F.col(key), F.lit(partitions)).alias("partition")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.count(F.lit(1)).alias("partitions"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("events"),
        F.coalesce(F.max("n") / F.avg("n"), F.lit(1.0)).alias("skew"),
    )


def delivery_duplicates(deliveries: DataFrame) -> DataFrame:
    """Deliveries, distinct messages and duplicates per consumer group; two aggregates, no distinct expand."""
    per_key = deliveries.groupBy("consumer_group", "message_key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("consumer_group").agg(
        F.sum("n").alias("deliveries"), F.count(F.lit(1)).alias("messages"),
        F.sum(F.col("n") - 1).alias("duplicates"),
    )


def interval_rates(decisions: DataFrame, moment: str, by: str, interval: str = "1 minute") -> DataFrame:
    """Decisions per second in tumbling intervals."""
    seconds = (F.unix_micros(F.col("window.end")) - F.unix_micros(F.col("window.start"))) / 1e6
    return (
        decisions.groupBy(F.window(moment, interval), by).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("interval_start"), by, "n", (F.col("n") / seconds).alias("per_second"))
    )
