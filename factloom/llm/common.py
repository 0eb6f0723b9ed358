"""Shared plumbing of the corpus operators: inputs, the shared scratch folder, Arrow mapping."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id bigint, text string, *more); a null text becomes the empty text. Other columns are left behind, so that
    columns of any name in the input cannot clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_key(text: str = "text"):
    """128 bits that stand for a whole text: with the doc_id, the name of a row."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session that names none (a test on one machine) gets a folder of its own; it is then also set as the
    checkpoint folder. On a cluster the setting is needed."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="factloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts lineage, survives lost executors, computed once."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of :func:`scratch_dir` whose rows nothing needs any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches``; then the worker, which goes on to other tasks, hands its free memory back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """``fn`` over Arrow batches; a result of None adds nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(lambda batches: released(run(batches)), schema)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a bigint, b bigint): the smallest id reachable.

    First, each id's smaller neighbours are linked to the smallest of them instead of to the id, which leaves few distinct
    edges of a dense group; an id has at most as many of them as there are blocks that it is linked in. Min-label rounds with pointer jumping; labels and edges stay in Spark tables. Every round is written to the shared
    folder. Joins and sums only: a hub's rows are summed on the map side or split by the skew join."""
    down = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    least = down.withColumn("least", F.min("a").over(Window.partitionBy("b")))
    edges = stored(least.select("least", F.explode(F.array("a", "b")).alias("b")).where("least <> b").select(F.col("least").alias("a"), "b").distinct(), "contracted")
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("upper"))
        new = stored(lower.join(up, "component").select("id", F.least("component", "upper").alias("component"), "was"), "labels")
        moved = new.where("component <> was").limit(1).count()
        labels = new.select("id", "component")
        if not moved:
            return labels


def least_frequent(counted: DataFrame, most: int) -> int | None:
    """The least count ``a`` that at most ``most`` rows of ``counted`` reach; None if there is none."""
    # counts by sixteenths of their binary logarithm: at most 1,024 rows
    by = counted.where("a > 1").groupBy(F.floor(F.log2("a") * 16).alias("size")).agg(F.count("*").alias("n"), F.min("a").alias("a"))
    total, least = 0, None
    for r in by.orderBy(F.desc("size")).collect():
        total += r["n"]
        if total > most:
            break
        least = r["a"]
    return least


#: Rows of (id, key of the text) pairs, 24 bytes each, that may be broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose (doc_id, key of the text) ``decided`` (doc_id, x, kept) drops."""
    d = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))
    dropped = stored(decided.where("not kept").select(d.alias("__d"), F.col("x").alias("__x")).distinct(), "dropped")
    small = F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped
    return docs.join(small, (d == F.col("__d")) & (text_key() == F.col("__x")), "left_anti")
