"""Streaming twins of the batch operators: dedupe, features, reputation state, bursts, scoring, resolution, counters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from mailsift import vocabulary as V
from mailsift.functions.hashing import simhash64
from mailsift.functions.numeric import age_seconds, month_key
from mailsift.operators.features import extract_features
from mailsift.operators.reputation import COUNTS
from mailsift.operators.scoring import Policy, resolve_pending, score_policies, shadow_decisions
from mailsift.operators.similarity import recent_near_duplicates
from mailsift.sources import ledger, sinks
from mailsift.sources.events import good_records, poison_records


def run_available(df: DataFrame, checkpoint: str, each_batch: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Processes everything that is there and stops; the checkpoint makes a restart continue."""
    query = (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(each_batch).start()
    )
    query.awaitTermination()
    return query


def once_per_message(events: DataFrame, moment: str, keys: Sequence[str], horizon: str) -> DataFrame:
    """First delivery of every key within the horizon; state older than the watermark is dropped."""
    return events.withWatermark(moment, horizon).dropDuplicatesWithinWatermark(list(keys))


def insert_absent_batches(path: str, keys: list[str], order: list[str], parts: int = ledger.PARTS) -> Callable[[DataFrame, int], None]:
    """Sink with an unbounded duplicate horizon: a key already stored is never stored again; ``ledger.rows`` reads it.

    A batch reads only the ledger's parts in which one of its keys may lie.
    """

    def write(batch: DataFrame, _: int) -> None:
        ledger.insert(batch, path, keys, order, parts)

    return write


def upsert_batches(path: str, keys: list[str], version: list[str], prepare: Callable[[DataFrame], DataFrame] = lambda b: b) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, _: int) -> None:
        # The merge looks at its updates twice, and a streaming batch is computed again each time it is read.
        updates = prepare(batch).persist()
        try:
            sinks.upsert(updates, path, keys, version)
        finally:
            updates.unpersist()

    return write


def feature_stream(events: DataFrame, messages: DataFrame) -> DataFrame:
    """Features of every announced message: the event stream joined to the stored messages."""
    return extract_features(events.select("email_id", "arrived_at").join(messages, "email_id"), keep=["arrived_at"])


def embedding_stream(events: DataFrame, messages: DataFrame, encoder: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Vectors of every announced message, encoded from subject and displayed text."""
    text = F.concat_ws("\n", F.coalesce("subject", F.lit("")), "body_display")
    stored = messages.select("email_id", text.alias("text"))
    return encoder(events.select("email_id").join(stored, "email_id"))


def reputation_state(
    events: DataFrame, half_life_seconds: float = V.HALF_LIFE_SECONDS, epoch: str = "2020-01-01 00:00:00"
) -> DataFrame:
    """Decayed counts per sender, folded to the sender's latest event; run in update mode over events without repeats.

    Decay composes, so a weight can be kept as what it would have been at a fixed ``epoch`` and plain sums
    of those are the whole state: events may arrive in any order, a busy sender is summed in
    every map task first, and no row leaves the JVM. The scale doubles once per half-life, so move
    ``epoch`` forward before a thousand half-lives have passed.
    """
    return _decayed(_sums_at_epoch(events, half_life_seconds, epoch), half_life_seconds, epoch)


def _halvings(moment: str, half_life_seconds: float, epoch: str) -> Column:
    return age_seconds(F.lit(epoch).cast("timestamp"), F.col(moment)) / F.lit(float(half_life_seconds))


def _sums_at_epoch(events: DataFrame, half_life_seconds: float, epoch: str) -> DataFrame:
    scaled = F.col("weight") * F.pow(F.lit(2.0), _halvings("occurred_at", half_life_seconds, epoch))
    sides = [(b, s) for b in V.BUCKETS for s in V.SIGNALS]
    return events.groupBy("sender_key").agg(
        *[
            F.coalesce(F.sum(F.when((F.col("bucket") == b) & (F.col("signal") == s), scaled)), F.lit(0.0)).alias(name)
            for name, (b, s) in zip(COUNTS, sides)
        ],
        F.max("occurred_at").alias("folded_at"),
    )


def _decayed(sums: DataFrame, half_life_seconds: float, epoch: str) -> DataFrame:
    back = F.pow(F.lit(0.5), _halvings("folded_at", half_life_seconds, epoch))
    return sums.select("sender_key", *[(F.col(n) * back).alias(n) for n in COUNTS], "folded_at")


def accrual_batches(
    path: str, claims_path: str, keys: list[str], half_life_seconds: float = V.HALF_LIFE_SECONDS, epoch: str = "2020-01-01 00:00:00",
    parts: int = ledger.PARTS,
) -> Callable[[DataFrame, int], None]:
    """Sink that counts each signal once: a batch first claims the keys no other batch has claimed.

    Claims and sums lie in one folder per batch, so a replayed batch replaces itself and a redelivered signal, in
    whatever batch, finds its key claimed. Claims are a ledger: a batch reads only the parts of it in which one of its keys
    may lie. ``accrued`` reads the standing.
    """

    def write(batch: DataFrame, number: int) -> None:
        signals = batch.persist()
        try:
            fresh = ledger.unseen(signals, claims_path, keys, ["occurred_at"], parts, number).persist()
            try:
                _sums_at_epoch(fresh, half_life_seconds, epoch).write.mode("overwrite").parquet(f"{path}/batch={number}")
                ledger.record(fresh.select(*keys), claims_path, keys, parts, number)
            finally:
                fresh.unpersist()
        finally:
            signals.unpersist()

    return write


def accrued(stored: DataFrame, half_life_seconds: float = V.HALF_LIFE_SECONDS, epoch: str = "2020-01-01 00:00:00") -> DataFrame:
    """Standing per sender from the sums that ``accrual_batches`` stored."""
    sums = stored.groupBy("sender_key").agg(*[F.sum(n).alias(n) for n in COUNTS], F.max("folded_at").alias("folded_at"))
    return _decayed(sums, half_life_seconds, epoch)


def sender_velocity(events: DataFrame, moment: str, sender: str, window: str = "60 seconds", slide: str = "1 second", lateness: str = "60 seconds") -> DataFrame:
    """Messages per sender in sliding windows; in update mode every window is out as soon as it has a message."""
    return (
        events.withWatermark(moment, lateness).groupBy(F.window(moment, window, slide), F.col(sender))
        .agg(F.count(F.lit(1)).alias("sender_count"))
        .select(F.col("window.end").alias("window_end"), sender, "sender_count")
    )


def near_duplicate_batches(
    path: str, state_path: str, moment: str, text: str, window_ms: int = V.BURST_WINDOW_MS,
    radius: int = V.NEAR_DUPLICATE_RADIUS, recent: int | None = None,
) -> Callable[[DataFrame, int], None]:
    """Sink that stores each message's near-duplicate count on arrival.

    Between batches the fingerprints younger than the window are kept, in one folder per batch: a replayed batch
    reads the newest state before it, the one it read before, and writes the same rows again.
    """

    def write(batch: DataFrame, number: int) -> None:
        prints = batch.select("email_id", moment, simhash64(F.col(text)).alias("fingerprint")).persist()
        try:
            kept = sinks.read_or_empty(batch.sparkSession, state_path, prints.withColumn("batch", F.lit(number)))
            kept = kept.filter(F.col("batch") < number)
            before = kept.filter(F.col("batch") == kept.agg(F.max("batch")).scalar()).select(*prints.columns)
            together = before.unionByName(prints)
            counted = recent_near_duplicates(together, moment, window_ms, radius, recent)
            fresh = counted.join(prints.select("email_id"), "email_id", "left_semi")
            fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")
            latest = together.agg(F.max(F.unix_millis(moment))).scalar()
            young = together.filter("fingerprint <> 0").filter(F.unix_millis(moment) > latest - window_ms)
            young.write.mode("overwrite").parquet(f"{state_path}/batch={number}")
        finally:
            prints.unpersist()

    return write


def replay_scoring(replay: DataFrame, scored: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """Decisions for a stream of (run_id, email_id); sink it with ``insert_absent_batches``."""
    return score_policies(replay.select("run_id", "email_id").join(scored, "email_id"), policies)


def score_with_shadow(path: str, shadow_path: str, active: Policy, shadow: Policy | None) -> Callable[[DataFrame, int], None]:
    """Sink that decides a batch under the live policy and stores the shadow comparison beside it."""

    def write(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            decided = score_policies(batch, [active])
            sinks.insert_if_absent(decided, path, ["email_id", "policy_version"], ["posterior"])
            if shadow is not None and shadow.version != active.version:
                compared = shadow_decisions(batch, active, shadow)
                sinks.insert_if_absent(compared, shadow_path, ["email_id", "active_version", "shadow_version"], ["posterior"])
        finally:
            batch.unpersist()

    return write


def live_counters(decisions: DataFrame, by: str = "route_used") -> DataFrame:
    """Running decisions and spend; run in update or complete mode."""
    return decisions.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("cost_usd")
    )


def rate_series(decisions: DataFrame, moment: str, by: str, interval: str = "1 minute", lateness: str = "1 minute") -> DataFrame:
    """Decisions per tumbling interval; in update mode the open ones too."""
    return (
        decisions.withWatermark(moment, lateness).groupBy(F.window(moment, interval), by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("interval_start"), by, "n")
    )


def spend_series(decisions: DataFrame, moment: str, lateness: str = "1 hour") -> DataFrame:
    """Spend per UTC day with its month; in update mode the open day too."""
    return (
        decisions.withWatermark(moment, lateness).groupBy(F.window(moment, "1 day"))
        .agg(F.sum("cost_usd").alias("cost_usd"), F.count(F.lit(1)).alias("calls"))
        .select(F.col("window.start").alias("day"), month_key(F.col("window.start")).alias("month"), "cost_usd", "calls")
    )


def with_month_total(days: DataFrame) -> DataFrame:
    """Stored days with the spend of their month."""
    months = days.groupBy("month").agg(F.sum("cost_usd").alias("month_cost_usd"))
    return days.join(months, "month")


def resolutions(pending: DataFrame, verdicts: DataFrame, sla_seconds: int = V.SLA_SECONDS, lateness: str = "1 minute") -> DataFrame:
    """Each pending row with the verdict that came within the SLA, else degraded.

    A row is emitted unanswered only once the watermark is past its SLA.
    """
    p = pending.withWatermark("pending_at", lateness)
    v = verdicts.select(F.col("email_id").alias("verdict_email"), "verdict", "verdict_at").withWatermark("verdict_at", lateness)
    limit = F.expr(f"interval {int(sla_seconds)} seconds")
    on_time: Column = (
        (F.col("email_id") == F.col("verdict_email"))
        & (F.col("verdict_at") >= F.col("pending_at"))
        & (F.col("verdict_at") <= F.col("pending_at") + limit)
    )
    return resolve_pending(p.join(v, on_time, "left_outer")).drop("verdict_email")


def overdue(pending: DataFrame, resolved: DataFrame, now: Column, sla_seconds: int = V.SLA_SECONDS) -> DataFrame:
    """Stored pending rows whose SLA has passed and that the stream left open, degraded; for when input has ended."""
    late = pending.filter(F.col("pending_at") + F.expr(f"interval {int(sla_seconds)} seconds") <= now)
    left = late.join(resolved.select("email_id"), "email_id", "left_anti")
    return resolve_pending(left.withColumns({"verdict": F.lit(None).cast("string"), "verdict_at": F.lit(None).cast("timestamp")}))


def overwrite_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for complete-mode results: the last batch is the whole table."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write


def append_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for append-mode results: one folder per batch, so a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def divert_poison(path: str, poison_path: str) -> Callable[[DataFrame, int], None]:
    """Sink that stores parsed records and puts lines that are none aside; the stream goes on."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            good_records(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
            poison_records(batch).write.mode("overwrite").parquet(f"{poison_path}/batch={number}")
        finally:
            batch.unpersist()

    return write


def decision_log(path: str, parts: int = ledger.PARTS) -> Callable[[DataFrame, int], None]:
    """Sink behind the live cards: every classification once, however often it is delivered.

    ``windows.decision_cards`` folds the stored log to cards, so a replay can neither double nor retract one.
    """
    return insert_absent_batches(path, ["email_id", "classification_id"], ["at"], parts)
