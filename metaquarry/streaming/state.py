"""Keyed streaming state: the message ring and the slot values of a thread.

Rows of a key reach the handlers in no fixed order and in several frames; only the rows
that can matter are kept, so memory stays bounded whatever a thread receives.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from metaquarry.schemas import STATE_TTL_SECONDS, SUMMARY_WINDOW

# The process that starts a stateful stream does not see files added to the session, so the
# handlers travel whole instead of by module name.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RING_SCHEMA = "turn bigint, role string, content string"
THREAD_OUTPUT = "thread_id bigint, n_messages bigint, turns array<bigint>, roles array<string>, contents array<string>"
SLOT_STATE = "slots array<string>, vals array<string>, ats array<bigint>, seqs array<bigint>"
SLOT_OUTPUT = "thread_id bigint, slots array<string>, vals array<string>"


class ThreadRing(StatefulProcessor):
    """Counts a thread's messages and keeps the last ``keep`` of them by turn."""

    def __init__(self, keep: int, ttl_ms: int):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint", self.ttl_ms)
        self.ring = handle.getListState("ring", RING_SCHEMA, self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        ring = sorted(zip(row["turns"], row["roles"], row["contents"], strict=True), key=lambda r: r[0])
        self.count.update((int(row["n_messages"]),))
        self.ring.put([(int(t), r, c) for t, r, c in ring[-self.keep :]])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        ring = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        for pdf in rows:
            n += len(pdf)
            newest = pdf.nlargest(self.keep, "turn")
            ring += list(newest[["turn", "role", "content"]].itertuples(index=False, name=None))
            ring = sorted(ring, key=lambda r: r[0])[-self.keep :]
        ring = [(int(t), r, c) for t, r, c in ring]
        self.count.update((n,))
        self.ring.put(ring)
        yield pd.DataFrame(
            {
                "thread_id": [key[0]],
                "n_messages": [n],
                "turns": [[r[0] for r in ring]],
                "roles": [[r[1] for r in ring]],
                "contents": [[r[2] for r in ring]],
            }
        )

    def close(self) -> None:
        pass


class SlotValues(StatefulProcessor):
    """The last value of every slot of a thread, by (at, seq) whatever the arrival order.

    All slots are one value of the state: they are read and written at once, not one by one, and
    writing renews the time to live of all.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getValueState("values", SLOT_STATE, self.ttl_ms)

    def _write(self, current: dict) -> None:
        rows = [(slot, *current[slot]) for slot in sorted(current)]
        self.values.update(tuple([r[i] for r in rows] for i in range(4)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        held = zip(row["slots"], row["vals"], row["ats"], row["seqs"], strict=True)
        self._write({slot: (value, int(at), int(seq)) for slot, value, at, seq in held})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.values.get()
        current = {slot: (value, at, seq) for slot, value, at, seq in zip(*held)} if held else {}
        for pdf in rows:
            for slot, value, at, seq in zip(pdf["slot"], pdf["value"], pdf["at"], pdf["seq"]):
                if slot not in current or (at, seq) >= current[slot][1:]:
                    current[slot] = (value, int(at), int(seq))
        self._write(current)
        slots = sorted(current)
        yield pd.DataFrame(
            {"thread_id": [key[0]], "slots": [slots], "vals": [[current[s][0] for s in slots]]}
        )

    def close(self) -> None:
        pass


class ThreadExpiry(StatefulProcessor):
    """A thread's number of messages and last time, until it has been silent for ``ttl_ms``.

    A timer in event time gives the thread up: it is reported once and forgotten, so state is
    bounded by the threads that are alive, and a thread that comes back starts anew.
    """

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n bigint, last_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, before = self.seen.get() or (0, None)
        last = before or 0
        for pdf in rows:
            n += len(pdf)
            last = max(last, int(pdf["at"].max().value // 1_000))
        self.seen.update((n, last))
        if last != before:  # the only timer there can be is the one of the time held before
            if before is not None:
                self.handle.deleteTimer(before // 1_000 + self.ttl_ms)
            self.handle.registerTimer(last // 1_000 + self.ttl_ms)
        yield pd.DataFrame({"thread_id": [], "n_messages": [], "last_us": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, last = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"thread_id": [key[0]], "n_messages": [n], "last_us": [last]})

    def close(self) -> None:
        pass


def stream_expired(messages: DataFrame, ttl_seconds: int = STATE_TTL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """messages: thread_id, at. One row for every thread that is given up, once the watermark,
    ``late`` behind the newest message, has passed its last message by ``ttl_seconds``."""
    return (
        messages.select("thread_id", "at")
        .withWatermark("at", late)
        .groupBy("thread_id")
        .transformWithStateInPandas(
            statefulProcessor=ThreadExpiry(ttl_seconds * 1000),
            outputStructType="thread_id bigint, n_messages bigint, last_us bigint",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def living_threads(spark: SparkSession, checkpoint: str) -> DataFrame:
    """thread_id, n_messages, last_us of the threads that a stopped or running
    ``stream_expired`` still holds, read from its state store."""
    state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    return state.select(
        F.col("key.thread_id").alias("thread_id"), F.col("value.n").alias("n_messages"), F.col("value.last_us").alias("last_us")
    )


def thread_snapshot(messages: DataFrame, keep: int = SUMMARY_WINDOW) -> DataFrame:
    """The state of threads after a table of messages, as ``stream_thread_state`` would have it."""
    newest = Window.partitionBy("thread_id").orderBy(F.col("turn").desc())
    last = messages.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep)
    ring = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("bigint").alias("turn"), "role", "content")))
    rings = last.groupBy("thread_id").agg(ring.alias("_ring"))  # at most ``keep`` messages
    counts = messages.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return counts.join(rings, "thread_id").select(
        "thread_id", "n_messages", F.col("_ring.turn").alias("turns"), F.col("_ring.role").alias("roles"),
        F.col("_ring.content").alias("contents"),
    )


def slot_snapshot(params: DataFrame) -> DataFrame:
    """The slots of threads after a table of values: the last value of every slot."""
    last = F.max_by(F.struct("value", "at", "seq"), F.struct("at", "seq")).alias("_v")
    entry = F.struct("slot", "_v.value", "_v.at", "_v.seq")
    held = params.groupBy("thread_id", "slot").agg(last).groupBy("thread_id").agg(F.collect_list(entry).alias("_s"))
    return held.select(
        "thread_id", F.col("_s.slot").alias("slots"), F.col("_s.value").alias("vals"), F.col("_s.at").alias("ats"),
        F.col("_s.seq").alias("seqs"),
    )


def stream_thread_state(
    messages: DataFrame,
    keep: int = SUMMARY_WINDOW,
    ttl_seconds: int = STATE_TTL_SECONDS,
    start: DataFrame | None = None,
) -> DataFrame:
    """messages: thread_id, turn, role, content. One row per changed thread and batch:
    its message count and its last ``keep`` messages in turn order.

    ``start`` holds what is known before the stream begins, with the columns of the result: a
    ``thread_snapshot``, or what an earlier stream wrote. A thread it holds and the stream
    never touches gives no row.
    """
    return (
        messages.select("thread_id", "turn", "role", "content")
        .groupBy("thread_id")
        .transformWithStateInPandas(
            statefulProcessor=ThreadRing(keep, ttl_seconds * 1000),
            outputStructType=THREAD_OUTPUT,
            outputMode="Update",
            timeMode="ProcessingTime",
            initialState=None if start is None else start.groupBy("thread_id"),
        )
    )


def stream_slot_fill(
    params: DataFrame, ttl_seconds: int = STATE_TTL_SECONDS, start: DataFrame | None = None
) -> DataFrame:
    """params: thread_id, slot, value, at, seq. One row per changed thread and batch with
    the collected slots as a map. ``start`` is a ``slot_snapshot`` of what came before."""
    out = (
        params.select("thread_id", "slot", "value", "at", "seq")
        .groupBy("thread_id")
        .transformWithStateInPandas(
            statefulProcessor=SlotValues(ttl_seconds * 1000),
            outputStructType=SLOT_OUTPUT,
            outputMode="Update",
            timeMode="ProcessingTime",
            initialState=None if start is None else start.groupBy("thread_id"),
        )
    )
    return out.select("thread_id", F.map_from_arrays("slots", "vals").alias("collected"))
