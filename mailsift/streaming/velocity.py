"""Exact trailing counts per message inside a stream, as keyed state with expiry.

A message is handed to its own window-long slot and to the next. Senders are dealt over a fixed number of lanes and a key is
one lane in one slot, so its state holds at most two windows of its senders and is read and written once a batch, however
many senders and messages. A redelivered message counts nothing. Counts go out when a message arrives, and again when a
later arrival of an earlier moment raises them; they only grow, so the sink keeps the largest. Once the watermark is past a
slot no message can change its counts, and a timer drops the key. Rows behind the watermark on arrival change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailsift import vocabulary as V
from mailsift.sources import sinks

#: Keyed state with timers needs this state store.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Senders share that many keys a slot: a sender of few messages costs no calls to the state store of its own.
LANES = 16


class TrailingCounts(StatefulProcessor):
    """State of one (lane, slot): the messages of all senders of the lane, as three arrays that are read and written once a batch."""

    def __init__(self, window_ms: int) -> None:
        self.window_ms = window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "senders array<string>, messages array<string>, moments array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slot = int(key[1])
        arrived = pd.concat([frame[["sender", "message", "ms"]] for frame in rows], ignore_index=True)
        arrived = arrived[arrived["ms"] >= timerValues.getCurrentWatermarkInMs()]
        if arrived.empty:
            return
        stored = self.seen.get()
        known = pd.DataFrame({name: list(values) for name, values in zip(("sender", "message", "ms"), stored or ([], [], []))})
        # A stored message stands before all deliveries; of new ones the earliest counts.
        arrived = arrived.sort_values("ms", kind="stable")
        both = pd.concat([known.assign(fresh=False), arrived.assign(fresh=True)], ignore_index=True).drop_duplicates(
            ["sender", "message"], ignore_index=True
        )
        if not both["fresh"].any():
            return
        if stored is None:
            self.handle.registerTimer((slot + 1) * self.window_ms + 1)
        self.seen.update((both["sender"].tolist(), both["message"].tolist(), [int(ms) for ms in both["ms"]]))
        # Only messages of this slot whose window reaches back to a fresh moment have a new count.
        ms, fresh = both["ms"].to_numpy(np.int64), both["fresh"].to_numpy(bool)
        sender = pd.factorize(both["sender"], use_na_sentinel=False)[0]
        first = np.full(sender.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, sender[fresh], ms[fresh])
        # Senders lie more than a window apart on one line, so one search answers all of them.
        line = sender * (ms.max() - ms.min() + 2 * self.window_ms) + (ms - ms.min())
        ordered = np.sort(line)
        total = np.searchsorted(ordered, line, "right") - np.searchsorted(ordered, line - self.window_ms, "right")
        asked = (ms >= slot * self.window_ms) & (ms >= first[sender])
        if asked.any():
            yield both.loc[asked, ["message", "sender"]].assign(sender_count=total[asked])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame({"message": pd.Series(dtype=str), "sender": pd.Series(dtype=str), "sender_count": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def trailing_counts(
    events: DataFrame, moment: str, sender: str, message: str, window_ms: int = V.BURST_WINDOW_MS, lateness: str = "60 seconds",
    lanes: int = LANES,
) -> DataFrame:
    """message, sender and sender_count: messages of the sender in ``(t - window, t]``, in update mode.

    Messages in the same millisecond count each other, as in ``windows.trailing_sender_counts``. Senders are dealt over
    ``lanes``; a query that has state must keep the number it began with.
    """
    home = F.floor(F.col("ms") / window_ms)
    rows = events.select(F.col(moment).alias("moment"), F.col(sender).cast("string").alias("sender"), F.col(message).cast("string").alias("message"))
    spread = rows.withWatermark("moment", lateness).withColumn("ms", F.unix_millis("moment")).withColumn(
        "slot", F.explode(F.array(home, home + 1))
    ).withColumn("lane", F.pmod(F.xxhash64("sender"), F.lit(lanes)).cast("int"))
    return spread.groupBy("lane", "slot").transformWithStateInPandas(
        TrailingCounts(window_ms), "message string, sender string, sender_count long", "Update", "EventTime"
    )


def largest_counts(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps the largest count of every message; a replayed batch changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        top = batch.groupBy("message", "sender").agg(F.max("sender_count").alias("sender_count")).persist()
        try:
            sinks.upsert(top, path, ["message", "sender"], ["sender_count"])
        finally:
            top.unpersist()

    return write
