"""Row validity rules and good/quarantined splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import vocabulary as V


def unit_interval(name: str) -> tuple[str, Column]:
    return f"{name} in [0,1]", F.col(name).isNull() | F.col(name).between(0.0, 1.0)


def one_of(name: str, values: tuple[str, ...]) -> tuple[str, Column]:
    return f"{name} known", F.coalesce(F.col(name).isin(*values), F.lit(False))


def positive(name: str) -> tuple[str, Column]:
    return f"{name} positive", F.coalesce(F.col(name) > 0, F.lit(False))


def not_blank(name: str) -> tuple[str, Column]:
    return f"{name} present", F.coalesce(F.length(F.trim(name)) > 0, F.lit(False))


def reputation_event_rules() -> list[tuple[str, Column]]:
    factor = F.col("decay_factor")
    return [
        not_blank("sender_key"), one_of("signal", V.SIGNALS), one_of("bucket", V.BUCKETS), positive("weight"),
        ("decay_factor in (0,1]", F.coalesce((factor > 0) & (factor <= 1), F.lit(False))),
    ]


def policy_rules() -> list[tuple[str, Column]]:
    names = ("warn_threshold", "quarantine_threshold", "block_threshold", "llm_threshold", "routing_band_width")
    ladder = (F.col("warn_threshold") <= F.col("quarantine_threshold")) & (
        F.col("quarantine_threshold") <= F.col("block_threshold")
    )
    return [*map(unit_interval, names), ("ladder", F.coalesce(ladder, F.lit(False))), positive("burst_threshold")]


def with_violations(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Adds the names of the rules each row breaks."""
    broken = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules])
    return df.withColumn("violations", F.filter(broken, lambda v: v.isNotNull()))


def split_valid(df: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with what they break)."""
    marked = with_violations(df, rules)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def flag_conflicts(policies: DataFrame) -> DataFrame:
    """How many policies claim to be active or shadow; more than one of either is a conflict."""
    return policies.agg(
        F.count_if("active").alias("active"), F.count_if("shadow").alias("shadow")
    ).withColumn("conflict", F.greatest("active", "shadow") > 1)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
