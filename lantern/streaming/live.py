"""Live assessment: debounce, changes only, latest wins, timeouts; as a stateful stream, and over recorded events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

TEXT_DEBOUNCE_MS, FILE_DEBOUNCE_MS, TIMEOUT_MS, RETRY_MS = 300, 500, 12_000, 3_000
RECONNECT_MS, MOST_RECONNECT_MS = 400, 5_000


def debounced(events: DataFrame, key: str, ts: str, gap_seconds: float, tie: str) -> DataFrame:
    """Events of a key that no other follows within the gap."""
    following = F.lead(ts).over(W.partitionBy(key).orderBy(ts, tie))
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    late = (seconds("_next") - seconds(ts)) >= gap_seconds
    return events.withColumn("_next", following).where(F.col("_next").isNull() | late).drop("_next")


def changed(events: DataFrame, key: str, ts: str, value: str, tie: str) -> DataFrame:
    """Events whose value isn't that of the event before."""
    before = F.lag(value).over(W.partitionBy(key).orderBy(ts, tie))
    first = F.row_number().over(W.partitionBy(key).orderBy(ts, tie))
    return events.withColumn("_before", before).withColumn("_n", first).where((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_n")


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The event with the highest request of each key; what it supersedes is dropped. A partial aggregation, no window."""
    return events.groupBy(key).agg(F.max_by(F.struct(*[c for c in events.columns if c != key]), order).alias("e")).select(key, "e.*")


def answered(requests: DataFrame, responses: DataFrame, key: str, request: str) -> DataFrame:
    """Responses to the latest request of each key; stale ones are dropped."""
    newest = requests.groupBy(key).agg(F.max(request).alias(request))
    return responses.join(newest, [key, request])


def status(asked_ms: Column, now_ms: Column, answered_: Column, assessor_up: Column) -> Column:
    """ok, pending, offline, or error after the timeout."""
    return F.when(answered_, "ok").when(~assessor_up, "offline").when(now_ms - asked_ms >= TIMEOUT_MS, "error").otherwise("pending")


def to_send(text: Column, last_sent: Column, state: Column, since_probe_ms: Column) -> Column:
    """send if the text isn't what was sent last, probe if it is but the assessor was away and hasn't been tried for a while, else skip."""
    probe = (F.trim(text) != "") & state.isin("offline", "error") & (since_probe_ms >= RETRY_MS)
    return F.when(F.coalesce(probe, F.lit(False)), "probe").when(~text.eqNullSafe(last_sent), "send").otherwise("skip")


def reconnect_delay_ms(attempt: Column, again: Column) -> Column:
    """Wait before the attempt (1, 2, ...) to connect; again: the lost connection was itself a reconnection, which doubles the start.

    The delay is doubled after an attempt's failure has already planned the next one, so the first two waits are equal.
    """
    start = F.when(again, 2 * RECONNECT_MS).otherwise(RECONNECT_MS)
    # the limit is reached after five attempts; more doublings would only run out of bits
    doublings = F.least(F.greatest(attempt - 2, F.lit(0)), F.lit(8)).cast("int")
    return F.least(F.lit(MOST_RECONNECT_MS), (start * F.pow(F.lit(2), doublings)).cast("int"))


class Timeout(StatefulProcessor):
    """Gives out ok when the latest request of a key is answered, error when it isn't in time; stale answers give nothing."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", StructType([StructField("request_id", LongType()), StructField("status", StringType())]))

    def _forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        asked, answers = [], set()
        for frame in rows:
            for kind, request in zip(frame["kind"].tolist(), frame["request_id"].tolist()):
                asked.append(int(request)) if kind == "request" else answers.add(int(request))
        newest, state = self.latest.get() if self.latest.exists() else (None, None)
        if asked and (newest is None or max(asked) > newest):
            newest, state = max(asked), "pending"
            self._forget_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            self.latest.update((newest, state))
        if state == "pending" and newest in answers:
            self._forget_timers()
            self.latest.update((newest, "ok"))
            yield pd.DataFrame({"key": [key[0]], "request_id": [newest], "status": ["ok"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.latest.exists():
            request, state = self.latest.get()
            if state == "pending":
                self.latest.update((request, "error"))
                yield pd.DataFrame({"key": [key[0]], "request_id": [request], "status": ["error"]})

    def close(self) -> None:
        pass


def timeout_stream(messages: DataFrame, wait_ms: int = TIMEOUT_MS) -> DataFrame:
    """messages: key long, request_id long, kind string (request or answer). Needs the RocksDB state store."""
    return (
        messages.select(F.col("key").cast("long"), F.col("request_id").cast("long"), F.col("kind").cast("string"))
        .groupBy("key")
        .transformWithStateInPandas(Timeout(wait_ms), "key long, request_id long, status string", "Update", "ProcessingTime")
    )


class Debounce(StatefulProcessor):
    """Keeps the latest text of a key and gives it out when it has been left alone for a while and isn't what was given out before."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", StructType([StructField("request_id", LongType()), StructField("text", StringType())]))
        self.sent = handle.getValueState("sent", StructType([StructField("text", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = self.waiting.get() if self.waiting.exists() else None
        for frame in rows:
            for request, text in zip(frame["request_id"].tolist(), frame["text"].tolist()):
                if newest is None or request >= newest[0]:
                    newest = (int(request), text)
        if newest is not None:
            self.waiting.update(newest)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.waiting.exists():
            request, text = self.waiting.get()
            self.waiting.clear()
            if not self.sent.exists() or self.sent.get()[0] != text:
                self.sent.update((text,))
                yield pd.DataFrame({"key": [key[0]], "request_id": [request], "text": [text]})

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame, key: str = "key", wait_ms: int = TEXT_DEBOUNCE_MS) -> DataFrame:
    """events: key long, request_id long, text string. Needs the RocksDB state store."""
    return (
        events.select(F.col(key).cast("long").alias("key"), F.col("request_id").cast("long"), F.col("text").cast("string"))
        .groupBy("key")
        .transformWithStateInPandas(Debounce(wait_ms), "key long, request_id long, text string", "Update", "ProcessingTime")
    )


def assess_stream(events: DataFrame, assess: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a query that hands each micro-batch's latest texts, assessed, to the sink."""
    return events.writeStream.foreachBatch(lambda df, n: sink(assess(latest(df, "key", "request_id")), n)).option("checkpointLocation", checkpoint).start()
