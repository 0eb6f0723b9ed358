"""Progress events: validation, latest status, stage times, time left; the chain of stages as a stream.

State of documents that lives between batches is in :mod:`live`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.display import STAGES, STATUSES, TERMINAL, is_terminal
from ..functions.text import is_number, kind_of

EVENT = "status string, stage string, progress struct<current:double,total:double>, elapsedMs double, errorMessage string"


def parsed_event(json: Column) -> Column:
    return F.from_json(json, EVENT)


def is_valid_event(json: Column) -> Column:
    """A known status and progress of two finite numbers; if there is a stage, a known one; an error message of text or
    null; if there is a time, a finite number from 0 on."""
    v = F.try_parse_json(json)
    has = lambda key: kind_of(v, f"$.{key}").isNotNull()
    number = lambda path: F.when(is_number(v, path), F.try_variant_get(v, path, "double"))
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    known = lambda key, values: (kind_of(v, f"$.{key}") == "STRING") & F.try_variant_get(v, f"$.{key}", "string").isin(*values)
    stage = ~has("stage") | known("stage", STAGES)
    message = ~has("errorMessage") | kind_of(v, "$.errorMessage").isin("STRING", "VOID")
    elapsed = ~has("elapsedMs") | (finite(number("$.elapsedMs")) & (number("$.elapsedMs") >= 0))
    ok = known("status", STATUSES) & finite(number("$.progress.current")) & finite(number("$.progress.total")) & stage & message & elapsed
    return F.coalesce(ok, F.lit(False))


def is_terminal_payload(json: Column) -> Column:
    return is_terminal(parsed_event(json)["status"])


def latest_status(events: DataFrame, key: str, ts: str, order: str, *columns: str) -> DataFrame:
    """The last event of each key; the same for a stream, in update mode."""
    last = F.max(F.struct(ts, order, *columns))
    return events.groupBy(key).agg(last.alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in (ts, order, *columns)])


def stage_times(events: DataFrame, key: str, stage: str, ts: str) -> DataFrame:
    """(key, stage, n_events, elapsed_ms) from the first to the last event of a stage."""
    ms = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return events.groupBy(key, stage).agg(F.count("*").alias("n_events"), F.greatest(F.lit(0), F.max(ms(ts)) - F.min(ms(ts))).alias("us")).select(key, stage, "n_events", F.floor(F.col("us") / 1000).alias("elapsed_ms"))


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", settings: dict[str, str] | None = None) -> StreamingQuery:
    """Handles what has landed, once, and ends. ``handle`` may see a batch again after a failure: it must be idempotent.
    ``settings`` of the session hold while the stream runs."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        conf.set(k, v)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return query


def chain(*stages: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Stages one after another, as one function of a batch."""

    def run(batch: DataFrame) -> DataFrame:
        for stage in stages:
            batch = stage(batch)
        return batch

    return run


def snapshot_and_live(snapshot: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Live events of keys in the snapshot table (stream-static join), until each key's status is final."""
    return live.join(snapshot.where(~is_terminal(F.col("status"))).select(key), key, "left_semi")


def progress_event(status: str, stage: str, current: Column, total: Column, elapsed: Column, error: Column | None = None) -> Column:
    """The JSON of a progress event."""
    message = F.lit(None).cast("string") if error is None else error
    return F.to_json(F.struct(F.lit(status).alias("status"), F.lit(stage).alias("stage"), F.struct(current.cast("double").alias("current"), total.cast("double").alias("total")).alias("progress"), F.greatest(elapsed, F.lit(0)).alias("elapsedMs"), message.alias("errorMessage")))


def publish(rows: DataFrame, path: str) -> None:
    """Appends progress rows (document_id, event): nothing waits for who reads them."""
    rows.write.mode("append").parquet(path)


def until_final(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Events (document_id, order, status) that a subscriber gets: those up to the first final status of a document."""
    first = events.where(is_terminal(F.col("status"))).groupBy("document_id").agg(F.min(order).alias("__last"))
    return events.join(first, "document_id", "left").where(F.col("__last").isNull() | (F.col(order) <= F.col("__last"))).drop("__last")
