"""Snapshots that grow by what changed.

A table's rows are in buckets by a key (the document, or the row's id). A version adds pieces: folders
``<table>/v=<version>/b=<bucket>`` with new rows. A manifest for each version lists the pieces of every bucket. Rows of keys
that were not there before are only added, so a batch writes about as many bytes as it brings; a bucket is written anew
where rows in it are removed, or once it has ``PIECES`` pieces. Pieces that neither of the two newest manifests lists are
removed. A version that is written again after a failure overwrites its own folders from the version before, and nothing else.

The driver holds the names of pieces: at most ``BUCKETS`` * ``PIECES`` a table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.schemas import TABLES

BUCKETS, PIECES = 64, 16
#: The column whose rows are replaced together.
KEYS = {"documents": "id", "page_chunks": "document_id", "entities": "id", "entity_aliases": "document_id", "fact_types": "id", "facts": "document_id", "relationships": "id"}

Manifest = dict[str, dict[int, list[int]]]
MANIFEST = "name string, bucket int, place int, version bigint"


@dataclass(frozen=True)
class Change:
    """Rows to add to a table, and the keys (a column named like the table's key) whose stored rows go first, if any."""

    rows: DataFrame
    removed: DataFrame | None = None


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def manifest(spark: SparkSession, folder: str, version: int) -> Manifest:
    found: Manifest = {name: {} for name in TABLES}
    for r in sorted(spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/v={version}").collect()):
        found[r["name"]].setdefault(r["bucket"], []).append(r["version"])
    return found


def write_manifest(spark: SparkSession, folder: str, version: int, found: Manifest) -> None:
    rows = [(name, b, i, v) for name, of in found.items() for b, vs in of.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/v={version}")


def read_pieces(spark: SparkSession, folder: str, name: str, pieces: dict[int, list[int]]) -> DataFrame:
    paths = [f"{folder}/{name}/v={v}/b={b}" for b, vs in pieces.items() for v in vs]
    schema = TABLES[name]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def snapshot(spark: SparkSession, folder: str, version: int) -> dict[str, DataFrame]:
    found = manifest(spark, folder, version)
    return {name: read_pieces(spark, folder, name, found[name]) for name in TABLES}


def rows_of_keys(spark: SparkSession, folder: str, version: int, name: str, keys: DataFrame) -> DataFrame:
    """The stored rows of keys (a column named like the table's key); only their buckets are read."""
    key = KEYS[name]
    touched = [r["b"] for r in keys.select(bucket_of(key).alias("b")).distinct().collect()]  # at most BUCKETS
    of = manifest(spark, folder, version)[name]
    return read_pieces(spark, folder, name, {b: of[b] for b in touched if b in of}).join(keys.select(key).distinct(), key, "left_semi")


def begin(spark: SparkSession, folder: str) -> None:
    """Empty tables, as the snapshot that the first batch reads."""
    write_manifest(spark, folder, 0, {name: {} for name in TABLES})


def apply(spark: SparkSession, folder: str, version: int, changes: dict[str, Change]) -> None:
    """Writes version + 1 from version."""
    was = manifest(spark, folder, version)
    now: Manifest = {}
    for name, of in was.items():
        now[name] = dict(of)
        if name not in changes:
            continue
        key, change = KEYS[name], changes[name]
        columns = [F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(TABLES[name])]
        new = change.rows.select(*columns).withColumn("b", bucket_of(key))
        gone = set() if change.removed is None else {r["b"] for r in change.removed.select(bucket_of(key).alias("b")).distinct().collect()} & set(of)
        again = gone | {b for b, vs in of.items() if len(vs) >= PIECES}
        if again:
            old = read_pieces(spark, folder, name, {b: of[b] for b in again}).withColumn("b", bucket_of(key))
            if change.removed is not None:
                old = old.join(change.removed.select(key).distinct(), key, "left_anti")
            new = old.select(*new.columns).unionByName(new)
        path = f"{folder}/{name}/v={version + 1}"
        new.repartition(F.col("b")).write.mode("overwrite").partitionBy("b").parquet(path)
        there = {int(n[2:]) for n in names_in(spark, path) if n.startswith("b=")}
        for b in again | there:
            now[name][b] = ([] if b in again else of.get(b, [])) + ([version + 1] if b in there else [])
    write_manifest(spark, folder, version + 1, {name: {b: vs for b, vs in of.items() if vs} for name, of in now.items()})
    if version:
        clean(spark, folder, version)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]


def clean(spark: SparkSession, folder: str, version: int) -> None:
    """Removes what only the version before ``version`` needed."""
    before = f"{folder}/manifest/v={version - 1}"
    path = spark._jvm.org.apache.hadoop.fs.Path(before)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return
    old, kept = manifest(spark, folder, version - 1), manifest(spark, folder, version)
    for name, of in old.items():
        for b, vs in of.items():
            for v in set(vs) - set(kept[name].get(b, [])):
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/v={v}/b={b}"), True)
    files.delete(path, True)
