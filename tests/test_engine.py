"""The engine over landed files, in two calls."""

import json

from pyspark.sql import functions as F

from factloom.streaming import engine, progress, snapshots


def hooks():
    def read_pages(batch):
        words = [(n, t.split()) for n, t in batch]
        facts = [{"confidence": 0.9, "entity": {"name": w[0], "type": "company", "context": ""}, "factTypeDescription": "sales", "predicate": "revenue", "value": w[-1], "rawValue": w[-1], "sourceQuote": " ".join(w), "timeScope": "FY2024", "pageNumber": n} for n, w in words]
        return facts, (1, 1)

    one = lambda c: F.when(c.isNotNull(), F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>"))
    return engine.Hooks(read_pages, one, one, lambda a, ca, b, cb: F.lower(a) == F.lower(b), vision=read_pages)


def land(spark, path, document, page_texts):
    run = lambda t: [("f", 10.0, w, [1.0, 0.0, 0.0, 1.0, 5.0, 700.0], 40.0) for w in t.split()]
    rows = [(document, f"{document}.pdf", i, run(t), 600.0, None) for i, t in enumerate(page_texts, 1)]
    spark.createDataFrame(rows, engine.PAGES).coalesce(1).write.mode("append").parquet(path)


def test_two_calls(spark, tmp_path):
    landing, folder = str(tmp_path / "landing"), str(tmp_path / "tables")
    engine.begin(spark, folder)
    land(spark, landing, "d1", ["Acme sold 5M", "Globex sold 7"])
    assert engine.run_landed(spark, landing, folder, hooks()) == 1
    land(spark, landing, "d2", ["ACME sold 5000000"])
    land(spark, landing, "d3", ["Initech sold 1"])
    assert engine.run_landed(spark, landing, folder, hooks()) == 3
    got = engine.snapshot(spark, folder, 3)
    assert {(r["id"], r["status"], r["page_count"]) for r in got["documents"].collect()} == {("d1", "done", 2), ("d2", "done", 1), ("d3", "done", 1)}
    assert got["facts"].count() == 4 and got["facts"].where("entity_id is null").count() == 0
    assert sorted(r["canonical_name"] for r in got["entities"].collect()) == ["Acme", "Globex", "Initech"]
    assert [(r["relation_type"], r["method"]) for r in got["relationships"].collect()] == [("corroborates", "rule")]
    assert {r["extraction_status"] for r in got["page_chunks"].collect()} == {"extracted"}
    before = {name: df.count() for name, df in got.items()}
    engine.handler(folder, hooks())(spark.read.schema(engine.PAGES).parquet(landing).where("document_id = 'd3'"), 2)  # the last batch again
    assert {name: df.count() for name, df in engine.snapshot(spark, folder, 3).items()} == before


def size_of(folder, version):
    return sum(p.stat().st_size for name in snapshots.TABLES for p in (folder / name / f"v={version}").rglob("*.parquet"))


def test_versions_grow_by_what_changed(spark, tmp_path, monkeypatch):
    folder, landing = tmp_path / "tables", str(tmp_path / "landing")
    engine.begin(spark, str(folder))
    land(spark, landing, "big", [f"Company{i} sold {i}" for i in range(300)])
    land(spark, landing, "other", ["Acme sold 5M"])
    assert engine.run_landed(spark, landing, str(folder), hooks(), files_a_batch=2) == 1
    land(spark, landing, "small", ["Acme sold 5M"])
    assert engine.run_landed(spark, landing, str(folder), hooks()) == 2
    assert size_of(folder, 2) < 0.5 * size_of(folder, 1)
    got = engine.snapshot(spark, str(folder), 2)
    assert got["facts"].count() == 302 and got["documents"].count() == 3 and got["relationships"].count() == 1
    events = spark.read.parquet(f"{folder}/progress/v=2").orderBy("place")
    assert events.where(~progress.is_valid_event(F.col("event"))).count() == 0
    said = [(e["status"], e["progress"]["current"], e["progress"]["total"]) for e in (json.loads(r["event"]) for r in events.collect())]
    assert said == [("parsing", 0, 1), ("parsed", 1, 1), ("extracting", 0, 1), ("extracted", 1, 1), ("resolving", 0, 1), ("resolved", 1, 1), ("reconciling", 0, 1), ("done", 1, 1)]

    # a document that comes again with other facts: its bucket is written anew, what pointed at lost facts goes
    land(spark, landing, "small", ["Acme bought 7"])
    assert engine.run_landed(spark, landing, str(folder), hooks()) == 3
    got = engine.snapshot(spark, str(folder), 3)
    assert sorted(r["value"] for r in got["facts"].where("document_id <> 'big'").collect()) == ["5M", "7"]
    assert got["relationships"].join(got["facts"].select(F.col("id").alias("fact_a_id")), "fact_a_id", "left_anti").count() == 0
    assert got["documents"].count() == 3 and got["page_chunks"].where("document_id = 'small'").count() == 1
    assert not (folder / "manifest" / "v=1").exists() and (folder / "manifest" / "v=2").exists()


def test_pieces_are_joined_and_old_ones_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "PIECES", 3)
    monkeypatch.setattr(snapshots, "BUCKETS", 1)
    folder = tmp_path / "tables"
    snapshots.begin(spark, str(folder))
    row = lambda i: spark.createDataFrame([(f"f{i}", f"d{i % 4}")], "id string, document_id string")
    full = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in spark.createDataFrame([], snapshots.TABLES["facts"]).dtypes])
    for n in range(6):
        gone = row(n).select("document_id") if n >= 4 else None
        snapshots.apply(spark, str(folder), n, {"facts": snapshots.Change(full(row(n)), gone)})
        snapshots.apply(spark, str(folder), n, {"facts": snapshots.Change(full(row(n)), gone)})  # again
    got = snapshots.snapshot(spark, str(folder), 6)
    assert sorted(r["id"] for r in got["facts"].collect()) == ["f2", "f3", "f4", "f5"] and got["entities"].count() == 0
    left = {p.parent.name for p in (folder / "facts").glob("v=*/b=0")}
    assert left == {f"v={v}" for n in (5, 6) for v in snapshots.manifest(spark, str(folder), n)["facts"][0]}
