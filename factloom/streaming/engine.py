"""The engine as a stream: landed pages go through the four jobs, micro-batch by micro-batch.

Each batch reads one snapshot of the tables and writes the next (:mod:`snapshots`): batch n reads version n and writes what
changes in version n + 1. A batch that runs again after a failure reads the same snapshot and writes the same folders anew,
so nothing is counted twice. Only the batch's documents are matched against what is stored. While a batch runs, its jobs
publish the progress of its documents.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs
from ..plans.schemas import TABLES
from .progress import progress_event, run_available
from .snapshots import Change, apply, begin, rows_of_keys, snapshot

PAGES = "document_id string, filename string, page_number int, items array<struct<fontName:string,height:double,str:string,transform:array<double>,width:double>>, width double, error string"


__all__ = ["Hooks", "PAGES", "begin", "handler", "run_landed", "snapshot"]

#: Publishes a status of documents (document_id, ...) with a current and a total number: a column or a value each.
Publish = Callable[[str, DataFrame, "str | int", "str | int"], None]
STAGE_OF = {"parsing": "parse", "parsed": "parse", "extracting": "extract", "extracted": "extract", "resolving": "resolve", "resolved": "resolve", "reconciling": "reconcile", "done": "reconcile"}


@dataclass(frozen=True)
class Hooks:
    """The models that the jobs call."""

    extractor: jobs.Extractor
    embed: Callable[[Column], Column]
    embed_query: Callable[[Column], Column]
    confirm: Callable[[Column, Column, Column, Column], Column]
    vision: jobs.Extractor | None = None
    judge: Callable[[DataFrame], DataFrame] | None = None


def changes_of(pages: DataFrame, folder: str, version: int, hooks: Hooks, publish: Publish) -> dict[str, Change]:
    """What parse, extract, resolve and reconcile change of a snapshot for the documents of ``pages`` (PAGES). Tables that
    belong to documents are read in the buckets of these documents alone, but for the stored facts, which are matched."""
    spark = pages.sparkSession
    named = pages.groupBy(F.col("document_id").alias("id")).agg(F.max("filename").alias("filename"), F.lit("pending").alias("status"), F.current_timestamp().alias("uploaded_at"))
    named = jobs.written(named, "batch")
    ours = named.select(F.col("id").alias("document_id"))
    stored = snapshot(spark, folder, version)
    own = lambda name, key: rows_of_keys(spark, folder, version, name, ours.withColumnRenamed("document_id", key))
    came = jobs.written(own("documents", "id").select("id"), "came-again")
    again = came.limit(1).count() > 0
    none = lambda name: spark.createDataFrame([], TABLES[name])
    old = {name: own(name, "document_id") if again else none(name) for name in ("page_chunks", "facts")}
    shaped = lambda df, name: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in stored[name].dtypes])

    publish("parsing", ours, 0, 1)
    parsed = jobs.parse_pages(pages, old["page_chunks"], shaped(named, "documents"))
    chunks, documents = jobs.written(parsed["chunks"], "chunks"), jobs.written(parsed["documents"], "documents")
    n_pages = documents.select(F.col("id").alias("document_id"), F.coalesce("page_count", F.lit(0)).alias("n"))
    publish("parsed", n_pages, "n", "n")
    publish("extracting", n_pages, 0, "n")
    extracted = jobs.extract_documents(chunks, none("facts"), stored["fact_types"], hooks.extractor, hooks.embed, hooks.vision)
    facts = jobs.written(extracted["facts"], "facts")
    publish("extracted", n_pages, "n", "n")
    publish("resolving", ours, 0, 1)
    resolved = jobs.resolve_documents(facts, ours, stored["entities"], none("entity_aliases"), hooks.embed, hooks.confirm)
    facts, fresh = jobs.written(shaped(resolved["facts"], "facts"), "facts"), jobs.written(resolved["new_entities"], "new-entities")
    publish("resolved", resolved["results"].select("document_id", F.col("entities_resolved").alias("n")), "n", "n")
    publish("reconciling", ours, 0, 1)
    others = stored["facts"].join(came.withColumnRenamed("id", "document_id"), "document_id", "left_anti") if again else stored["facts"]
    entities = stored["entities"].unionByName(shaped(fresh, "entities"))
    files = stored["documents"].select(F.col("id").alias("document_id"), "filename").join(ours, "document_id", "left_anti").unionByName(named.select(F.col("id").alias("document_id"), "filename"))
    kept, lost = stored["relationships"], None
    if again:  # facts of a document that came again have new rows; what pointed at lost ones goes
        gone = old["facts"].select("id").join(facts.select("id"), "id", "left_anti")
        lost = jobs.written(kept.join(gone.withColumnRenamed("id", "fact_a_id"), "fact_a_id", "left_semi").select("id").unionByName(kept.join(gone.withColumnRenamed("id", "fact_b_id"), "fact_b_id", "left_semi").select("id")).distinct(), "lost")
        kept = kept.join(lost, "id", "left_anti")
    related = jobs.reconcile_documents(others.unionByName(facts), ours, entities, kept, hooks.embed_query, hooks.judge, files=files)
    done = documents.withColumn("status", F.when(F.col("status") == "parsed", "done").otherwise(F.col("status")))
    publish("done", related["counters"].crossJoin(F.broadcast(ours)).select("document_id", F.col("pairs_evaluated").alias("n")), "n", "n")  # one row of counters
    types = jobs.written(extracted["types"].join(stored["fact_types"].select("id", F.col("example_predicates").alias("was"), F.lit(True).alias("old")), "id", "left").where("old is null or not (example_predicates <=> was)"), "changed-types")
    by_document = came.select(F.col("id").alias("document_id")) if again else None
    return {
        "documents": Change(done, came if again else None),
        "page_chunks": Change(extracted["chunks"], by_document),
        "facts": Change(facts, by_document),
        "fact_types": Change(types.drop("was", "old"), types.where("old").select("id")),
        "entities": Change(shaped(fresh, "entities")),
        "entity_aliases": Change(shaped(resolved["aliases"], "entity_aliases"), by_document),
        "relationships": Change(shaped(related["new_relationships"], "relationships"), lost),
    }


def publisher(folder: str, version: int) -> Publish:
    """Progress of a batch as rows (document_id, place, at, event) below ``<folder>/progress/v=<version>``, a folder a step:
    a batch that runs again overwrites its own."""
    began: dict[str, float] = {}
    place = [0]

    def publish(status: str, rows: DataFrame, current: str | int, total: str | int) -> None:
        stage = STAGE_OF[status]
        began.setdefault(stage, time.monotonic())
        number = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
        event = progress_event(status, stage, number(current), number(total), F.lit(int(1000 * (time.monotonic() - began[stage]))))
        out = rows.select("document_id", F.lit(place[0]).alias("place"), F.current_timestamp().alias("at"), event.alias("event"))
        out.write.mode("overwrite").parquet(f"{folder}/progress/v={version}/s={place[0]:02d}")
        place[0] += 1

    return publish


def handler(folder: str, hooks: Hooks) -> Callable[[DataFrame, int], None]:
    """The function of a micro-batch of pages."""

    def run(pages: DataFrame, number: int) -> None:
        landed = jobs.written(pages, "landed")
        apply(pages.sparkSession, folder, number, changes_of(landed, folder, number, hooks, publisher(folder, number + 1)))

    return run


def run_landed(spark: SparkSession, landing: str, folder: str, hooks: Hooks, files_a_batch: int = 1) -> int:
    """Handles the files of pages that have landed since the last call; the number of the newest snapshot."""
    stream = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_a_batch).parquet(landing)
    query = run_available(stream, handler(folder, hooks), f"{folder}/checkpoint")
    last = query.lastProgress
    return -1 if last is None else last["batchId"] + 1
