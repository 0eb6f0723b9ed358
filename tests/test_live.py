"""Live state: what is kept between batches, when it goes, and that a restart goes on."""

import time

from pyspark.sql import functions as F

from factloom.streaming import live, progress

EVENT = "document_id string, ts timestamp, status string, event string"


def landed(spark, folder, rows):
    df = spark.createDataFrame(rows, "document_id string, ms long, status string, event string")
    df.select("document_id", F.timestamp_millis("ms").alias("ts"), "status", "event").coalesce(1).write.mode("append").parquet(folder)


def kept(spark, checkpoint):
    """Documents with state."""
    got = spark.read.format("statestore").option("stateVarName", "value").load(checkpoint)
    return {r[0] for r in got.select("key.document_id").collect()}


def run(spark, make, checkpoint, got):
    progress.run_available(make(), lambda out, n: got.extend(map(tuple, out.collect())), checkpoint, settings=live.STATE_ONCE)


def test_stopwatch_keeps_drops_and_forgets(spark, tmp_path):
    folder, checkpoint, got = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    landed(spark, folder, [("a", 1000, "parsing", None), ("a", 1500, "parsing", None), ("a", 3000, "extracting", None), ("a", 3700, "done", None), ("b", 2000, "parsing", None), ("b", 2200, "failed", None), ("c", 5000, "parsing", None), (None, 1, "parsing", None), ("n", None, "parsing", None), ("n", 1, None, None)])
    make = lambda idle: lambda: live.stopwatch(spark.readStream.schema(EVENT).parquet(folder), idle)
    run(spark, make(10**8), checkpoint, got)
    assert [g for g in got if g[0] == "a"] == [("a", "parsing", 0), ("a", "parsing", 500), ("a", "extracting", 0), ("a", "done", 700)]
    assert [g for g in got if g[0] == "b"] == [("b", "parsing", 0), ("b", "failed", 200)] and {g[0] for g in got} == {"a", "b", "c"}
    assert kept(spark, checkpoint) == {"c"}
    got.clear()  # a restart goes on with c, and b begins anew
    landed(spark, folder, [("b", 9000, "parsing", None), ("b", 9100, "parsing", None), ("c", 5600, "parsing", None)])
    run(spark, make(1), checkpoint, got)
    assert sorted(got) == [("b", "parsing", 0), ("b", "parsing", 100), ("c", "parsing", 600)]
    time.sleep(0.1)
    got.clear()  # nothing came for b and c: their time is over when the next batch runs
    landed(spark, folder, [("a", 20000, "parsing", None)])
    run(spark, make(10**8), checkpoint, got)
    landed(spark, folder, [("c", 99000, "parsed", None)])
    run(spark, make(10**8), checkpoint, got)
    assert got == [("a", "parsing", 0), ("c", "parsed", 0)]
    assert kept(spark, checkpoint) == {"a", "c"}


def test_snapshot_then_live_then_closed(spark, tmp_path):
    asked, told, checkpoint, got = str(tmp_path / "asked"), str(tmp_path / "told"), str(tmp_path / "checkpoint"), []
    documents = spark.createDataFrame([("d", "parsing"), ("e", "done"), ("d", "parsing")], "id string, status string")
    make = lambda: live.deliveries(spark.readStream.schema(EVENT).parquet(asked), spark.readStream.schema(EVENT).parquet(told), documents)
    landed(spark, asked, [("d", 100, None, None), ("d", 300, None, None), ("e", 100, None, None), ("none", 100, None, None), (None, 1, None, None)])
    landed(spark, told, [("d", 50, "parsing", "early"), ("d", 100, "parsed", "same"), ("d", 400, "extracting", "later"), ("x", 1, "parsing", "nobody")])
    run(spark, make, checkpoint, got)
    of = lambda d: [g[1:] for g in got if g[0] == d]
    snapshot = '{"status":"parsing"}'
    assert of("d") == [("snapshot", "parsing", snapshot, 1, None, None), ("event", "parsed", "same", 1, None, None), ("snapshot", "parsing", snapshot, 1, None, None), ("event", "extracting", "later", 2, None, None)]
    assert of("e") == [("snapshot", "done", '{"status":"done"}', 1, 1000, "Document reached terminal state")]
    assert of("none") == [("snapshot", None, None, 1, 4404, "Document not found")]
    assert len(got) == 6 and kept(spark, checkpoint) == {"d"}
    got.clear()
    landed(spark, asked, [("e", 900, None, None)])
    landed(spark, told, [("d", 1000, "failed", "end"), ("d", 1001, "parsing", "after"), ("e", 2000, "parsing", "again")])
    run(spark, make, checkpoint, got)
    assert of("d") == [("event", "failed", "end", 2, 1000, "Document reached terminal state")]
    assert [g[1] for g in got if g[0] == "e"] == ["snapshot"] and kept(spark, checkpoint) == set()
