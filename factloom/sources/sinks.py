"""Sinks for tables without transactions: each returns the next snapshot or the rows to append, so that writing it again
changes nothing."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """The snapshot after an upsert: of equal keys the new row, with the old row's values of ``keep`` columns."""
    kept = keep or []
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys)
    for c in kept:
        was = F.min_by(F.struct(F.col(c)), "__new").over(w)
        both = both.withColumn(c, was[c])
    return both.withColumn("__n", F.row_number().over(w.orderBy(F.desc("__new")))).where("__n = 1").drop("__new", "__n")


def rows_to_insert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows whose keys are not there yet; of equal new keys the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return new.join(old.select(*keys), keys, "left_anti").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def without_documents(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows that are left when the documents (document_id) are deleted with what belongs to them."""
    return rows.join(documents.select("document_id"), "document_id", "left_anti")


def detached(rows: DataFrame, gone: DataFrame, key: str, gone_key: str = "id") -> DataFrame:
    """Rows with their key set to null where what it names is gone."""
    lost = gone.select(F.col(gone_key).alias(key)).distinct().withColumn("__gone", F.lit(True))
    return rows.join(lost, key, "left").withColumn(key, F.when(F.col("__gone").isNull(), F.col(key))).drop("__gone")


def updated(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with a column's new value from changes (key, column); null changes count as well."""
    new = changes.select(key, F.struct(F.col(column)).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.when(F.col("__new").isNotNull(), F.col(f"__new.{column}")).otherwise(F.col(column))).drop("__new")


def append(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    rows.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def replace_documents(rows: DataFrame, path: str) -> None:
    """Overwrites the partitions of the documents in ``rows`` alone: a rerun of a document replaces its rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row table as a JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row.first().asDict(recursive=True), f, indent=2, ensure_ascii=False)
