"""Point and id-list reads, event projection and replay fan-out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mailsift.functions.text import from_display_name, preview, sender_key
from mailsift.operators.scoring import Policy, under_policies

EVENT_SCHEMA_VERSION = 1


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """One row by its key; the predicate reaches the Parquet scan."""
    return df.filter(F.col(key) == F.lit(value))


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of an id list that is itself a table."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def raw_events(messages: DataFrame) -> DataFrame:
    """What is published for each newly stored message, keyed by sender."""
    return messages.select(
        sender_key(F.col("sender"), F.col("sender_domain")).alias("key"),
        F.struct(
            F.lit(EVENT_SCHEMA_VERSION).alias("schemaVersion"), F.col("email_id").cast("string").alias("emailId"),
            sender_key(F.col("sender"), F.col("sender_domain")).alias("senderKey"), F.col("sender"),
            F.col("sender_domain").alias("senderDomain"), F.col("content_hash").alias("contentHashHex"),
            F.col("ingest_source").alias("ingestSource"),
        ).alias("event"),
    )


def replay_events(messages: DataFrame, policies: Sequence[Policy], run_id: str) -> DataFrame:
    """Every stored message once per policy of the run; ordered only when written."""
    return under_policies(messages.select("email_id", "ingested_at"), policies).select(
        F.lit(run_id).alias("run_id"), F.col("policy.version").alias("policy_version"), "email_id", "ingested_at"
    )


def stream_cards(messages: DataFrame, raw: Column, display: Column, prefixes: Sequence[str]) -> DataFrame:
    """Display card of each message whose source starts with one of ``prefixes``."""
    wanted = F.lit(False)
    for prefix in prefixes:
        wanted = wanted | F.col("ingest_source").startswith(prefix)
    return messages.filter(F.coalesce(wanted, F.lit(False))).select(
        "email_id", from_display_name(raw, F.col("sender")).alias("sender_display"), "subject",
        preview(display).alias("preview"),
    )
