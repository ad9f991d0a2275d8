"""Trailing windows, budgets, latest rows and heads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift import vocabulary as V
from mailsift.functions.numeric import clamp_unit, day_key, month_key
from mailsift.operators.ordered import CHUNK, ordered_chunks, positions, running_totals
from mailsift.session import cut_lineage


def trailing_sender_counts(
    events: DataFrame, sender: str, message: str, moment: str, window_ms: int = V.BURST_WINDOW_MS
) -> DataFrame:
    """Distinct messages of the same sender in ``(t - window, t]`` for every message.

    Messages fold to one row per sender and millisecond, and each fold is placed in its own window-long
    slot and the next. A task then holds at most two windows of milliseconds however busy a sender is.
    Messages in the same millisecond count each other.
    """
    once = events.groupBy(F.col(sender).alias("sender"), F.col(message).alias("message")).agg(
        F.unix_millis(F.min(moment)).alias("ms")
    )
    slot = F.floor(F.col("ms") / window_ms)
    folded = once.groupBy("sender", "ms").agg(F.count(F.lit(1)).alias("n")).withColumn("home", slot)
    spread = folded.withColumn("slot", F.explode(F.array("home", F.col("home") + 1)))
    back = Window.partitionBy("sender", "slot").orderBy("ms").rangeBetween(-(window_ms - 1), 0)
    counts = (
        spread.withColumn("sender_count", F.sum("n").over(back)).filter("home = slot")
        .select("sender", "ms", "sender_count")
    )
    return once.join(counts, ["sender", "ms"]).select(
        F.col("message").alias(message), F.col("sender").alias(sender), "sender_count"
    )


def spend_so_far(calls: DataFrame, moment: str, cost: str, key: str) -> DataFrame:
    """Running day and month spend at every call, with the scope a cap would deny it under."""
    periods = calls.withColumn("day", day_key(F.col(moment))).withColumn("month", month_key(F.col(moment)))
    amount = F.col(cost)
    order = [moment, key]
    chunks = ordered_chunks(periods, order)
    by_day = running_totals(chunks, {"day_spend": amount}, order, ["day"])
    return running_totals(cut_lineage(by_day), {"month_spend": amount}, order, ["month"]).drop(CHUNK)


def denial_scope(day_total: Column, month_total: Column, daily: float, monthly: float) -> Column:
    """Which cap denies a call; the day is checked first."""
    return F.when(day_total > daily, F.lit("daily")).when(month_total > monthly, F.lit("monthly"))


def admit_calls(
    calls: DataFrame, moment: str, cost: str, key: str, reservation: float = V.RESERVATION_USD,
    daily: float = V.DAILY_CAP_USD, monthly: float = V.MONTHLY_CAP_USD,
) -> DataFrame:
    """Which calls fit the budget when each reserves a fixed amount and settles to its cost at once.

    A denied call spends nothing, every reservation is equal and spend never falls, so the calls
    a cap admits are a prefix of the day and, of those, a prefix of the month. Two running sums over range
    chunks therefore give the same answer as one call after another. ``cost`` is a non-negative decimal.
    """
    money = "decimal(20,6)"
    lit = lambda v: F.lit(str(v)).cast(money)
    spent = F.col(cost).cast(money)
    periods = (
        calls.select(key, moment, cost)
        .withColumn("day", day_key(F.col(moment))).withColumn("month", month_key(F.col(moment)))
    )
    order = [moment, key]
    by_day = running_totals(ordered_chunks(periods, order), {"day_before": spent}, order, ["day"], inclusive=False)
    # Each result is used twice below, so it is written out instead of being derived twice.
    day_ok = cut_lineage(by_day.withColumn("in_day", F.col("day_before") + lit(reservation) <= lit(daily)))
    charged = F.when(F.col("in_day"), spent).otherwise(lit(0))
    by_month = running_totals(day_ok, {"month_before": charged}, order, ["month"], inclusive=False)
    granted = F.col("in_day") & (F.col("month_before") + lit(reservation) <= lit(monthly))
    marked = cut_lineage(by_month.select(key, moment, cost, "day", "month", granted.alias("granted")))
    # What a day really spent decides the scope of its denials: its own cap, or a month already used up.
    spent_by_day = marked.groupBy("day").agg(
        F.coalesce(F.sum(F.when(F.col("granted"), spent)), lit(0)).alias("day_granted")
    )
    scope = F.when(F.col("day_granted") + lit(reservation) > lit(daily), F.lit("daily")).otherwise(F.lit("monthly"))
    return marked.join(spent_by_day, "day").select(
        key, moment, cost, "day", "month", F.when(F.col("granted"), F.lit("granted")).otherwise(scope).alias("outcome")
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest whole row per key, as one mergeable aggregate instead of a window over every version."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def latest_for(wanted: DataFrame, history: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest history row of each wanted key; keys without history drop out."""
    return wanted.join(latest_per_key(history, [key], order), key)


def stratified_head(df: DataFrame, strata: str, order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of each stratum. Spark keeps ``n`` per stratum and task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(strata).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def trust_series(decisions: DataFrame, moment: str, key: str, points: int = 60) -> DataFrame:
    """The last ``points`` trust samples, oldest first, numbered over the whole session."""
    scored = decisions.filter(F.col("posterior").isNotNull())
    total = scored.agg(F.count(F.lit(1))).scalar()
    newest = scored.select(moment, key, "posterior").orderBy(F.desc(moment), F.desc(key)).limit(points)
    back = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(moment), F.desc(key)))
    return newest.withColumn("seq", total - back + 1).select(
        "seq", key, clamp_unit(F.lit(1.0) - F.col("posterior")).alias("trust")
    )


def decision_cards(
    decisions: DataFrame, email: str, classification: str, moment: str, cap: int | None = None
) -> DataFrame:
    """One card per message: newest decision, whether it was resolved, newest-first by first sighting.

    Repeated deliveries of one classification fold away first; both steps are mergeable aggregates. Tier and route
    come from one row, at equal times from the smaller pair. ``cap`` asks for that many of the newest cards.
    """
    once = decisions.groupBy(email, classification).agg(
        F.min(F.struct(F.col(moment).alias("at"), "tier", "route_used")).alias("first")
    ).select(email, classification, "first.*")
    newest = F.max_by(F.struct("tier", "route_used"), F.struct("at", classification))
    cards = once.groupBy(email).agg(
        newest.alias("_latest"), F.count(F.lit(1)).alias("folded"), F.min("at").alias("first_seen")
    ).select(email, "_latest.*", (F.col("folded") > 1).alias("resolved"), "first_seen")
    pending = ~F.col("resolved") & (F.lower("route_used") == "llm") & (F.lower("tier") == "quarantine")
    cards = cards.withColumn("pending", pending)
    return cards if cap is None else cards.orderBy(F.desc("first_seen"), F.desc(email)).limit(cap)


def newest(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """Top rows of an order; planned as a distributed take, not a full sort."""
    return df.orderBy(*order).limit(n)


def recent_then_oldest_first(df: DataFrame, moment: str, key: str, n: int) -> DataFrame:
    """The newest ``n`` rows, handed out oldest first."""
    return df.orderBy(F.desc(moment), F.desc(key)).limit(n).orderBy(moment, key)


def first_and_latest(points: DataFrame, moment: str, value: str) -> DataFrame:
    """First and latest non-null value in time order, and whether it fell."""
    known = F.col(value).isNotNull()
    return points.filter(known).agg(
        F.min_by(value, moment).alias("first_value"), F.max_by(value, moment).alias("latest_value")
    ).withColumn("improved", F.coalesce(F.col("latest_value") < F.col("first_value"), F.lit(False)))


def stratified_split(
    df: DataFrame, label: str, key: str, fraction: float = 0.25, seed: int = V.EVAL_SEED, order_hash: Column | None = None
) -> DataFrame:
    """Exactly ``round(fraction * n)`` of each label to eval, picked by a seeded hash.

    Places are counted over range chunks, so a label holding most rows does not sit in one task.
    """
    hashed = df.withColumn("_h", order_hash if order_hash is not None else F.xxhash64(key, F.lit(seed)))
    placed = positions(hashed, ["_h", key], [label], out="_place")
    sizes = df.groupBy(label).agg(F.floor(F.count(F.lit(1)) * F.lit(fraction) + 0.5).alias("_take"))
    side = F.when(F.col("_place") <= F.col("_take"), F.lit("eval")).otherwise(F.lit("train"))
    return placed.join(sizes, label).withColumn("split_side", side).drop("_h", "_place", "_take")


