"""Live state of documents: a stopwatch of stages, and subscriptions that get a snapshot first and events from then on.

Both keep one value and one timer a document in a state store on disk. State goes when a status is final, or when nothing has
come for ``idle`` (in processing time), so documents that never end keep nothing for ever. A restart from the checkpoint goes
on where it stopped. A session that runs them for ever needs the settings ``STATE``, and then looks for expired state in
batches without rows as well; ``progress.run_available`` needs ``STATE_ONCE``, as those batches would never end.

Edge cases: rows without a document are for nobody and make no row; rows without a time or a status make none either; rows of
one batch are handled in order of time, then of place, repeated ones each. Of a document, the rows of one batch are sorted in
memory: a trigger bounds them (``maxFilesPerTrigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions.display import TERMINAL

#: Settings of the session that keyed state needs.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: The same for a run that ends: state expires in batches that have rows.
STATE_ONCE = STATE | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}
#: Codes that close a subscription, and what is said.
CLOSE_REASONS = {1000: "Document reached terminal state", 4404: "Document not found"}
#: Statuses that begin a stage.
BEGINNINGS = ("parsing", "extracting", "resolving", "reconciling")
#: State that nothing has touched for this many milliseconds goes.
IDLE_MS = 24 * 60 * 60 * 1000


class Keyed(StatefulProcessor):
    """One value a document (``VALUE``: its schema) with a timer that each batch of the document sets anew."""

    VALUE = ""
    OUT: tuple[str, ...] = ()
    ORDER: tuple[str, ...] = ()

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.VALUE)

    def step(self, value: tuple | None, row: tuple) -> tuple[tuple | None, tuple | None]:
        """The value after a row (None: gone), and what the row gives (None: nothing)."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        value = self.value.get() if self.value.exists() else None
        out = []
        for row in pd.concat(list(rows)).sort_values(list(self.ORDER), kind="stable").drop(columns="document_id").itertuples(index=False, name=None):
            value, given = self.step(value, row)
            if given is not None:
                out.append((key[0], *given))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if value is None:
            self.value.clear()
        else:
            self.value.update(value)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["document_id", *self.OUT])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.value.clear()
        yield pd.DataFrame([], columns=["document_id", *self.OUT])

    def close(self) -> None:
        pass


class Stopwatch(Keyed):
    VALUE = "begun bigint, status string"
    OUT = ("status", "elapsed_ms")
    ORDER = ("ms",)

    def step(self, value, row):
        ms, status = int(row[0]), row[1]
        if value is None or (status in BEGINNINGS and status != value[1]):
            value = (ms, status)
        elapsed = max(0, ms - int(value[0]))
        return (None if status in TERMINAL else (int(value[0]), status)), (status, elapsed)


def stopwatch(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """(document_id, status, elapsed_ms) for every event (document_id, ts, status) of a stream, in order of time: the time
    since the document's stage began. A stage begins with its first status (:data:`BEGINNINGS`)."""
    kind = events.schema["document_id"].dataType.simpleString()
    rows = events.select("document_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "status").dropna()
    return rows.groupBy("document_id").transformWithStateInPandas(Stopwatch(idle_ms), f"document_id {kind}, status string, elapsed_ms bigint", "append", "processingTime")


class Subscriptions(Keyed):
    VALUE = "subscribers bigint"
    OUT = ("kind", "status", "event", "subscribers", "close_code", "close_reason")
    ORDER = ("ms", "place")

    def step(self, value, row):
        _, place, status, event, found = row
        end = (1000, CLOSE_REASONS[1000]) if status in TERMINAL else (None, None)
        if place == 0:  # someone subscribes: the snapshot is theirs alone
            if not found:
                return value, ("snapshot", None, None, 1, 4404, CLOSE_REASONS[4404])
            after = value if end[0] else ((int(value[0]) if value else 0) + 1,)
            return after, ("snapshot", status, event, 1, *end)
        if value is None:
            return None, None  # nobody listens
        return (None if end[0] else value), ("event", status, event, int(value[0]), *end)


def deliveries(subscriptions: DataFrame, events: DataFrame, documents: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """What subscribers get, as a stream: (document_id, kind, status, event, subscribers, close_code, close_reason).

    ``subscriptions`` (document_id, ts) and ``events`` (document_id, ts, status, event) are streams, ``documents`` (id, status)
    a table whose rows are the snapshots: a row for every subscription with the document's present status (close code 4404
    where there is no such document), then a row for every event with the number of those who still listen. An event that
    comes at the moment of a subscription is delivered after its snapshot, so none is lost between the two. A final status
    closes (1000) all who listen; what comes later reaches those who subscribe later. Events that nobody listens to make no
    row. Repeated ids of ``documents`` count once (the largest status)."""
    kind = events.schema["document_id"].dataType.simpleString()
    ms = F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")
    present = documents.where("id is not null").groupBy(F.col("id").alias("document_id")).agg(F.max("status").alias("status"), F.lit(True).alias("found"))
    asked = subscriptions.select("document_id", ms).dropna().join(present, "document_id", "left")
    asked = asked.select("document_id", "ms", F.lit(0).alias("place"), "status", F.to_json(F.struct("status")).alias("event"), F.coalesce("found", F.lit(False)).alias("found"))
    told = events.where("document_id is not null and ts is not null and status is not null").select("document_id", ms, F.lit(1).alias("place"), "status", F.col("event").cast("string").alias("event"), F.lit(True).alias("found"))
    out = f"document_id {kind}, kind string, status string, event string, subscribers bigint, close_code int, close_reason string"
    return asked.unionByName(told).groupBy("document_id").transformWithStateInPandas(Subscriptions(idle_ms), out, "append", "processingTime")
