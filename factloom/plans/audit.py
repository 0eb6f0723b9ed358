"""The spot check as a program: ``python -m factloom.plans.audit sample|score|all TABLES OUT``.

TABLES is a folder of facts and page_chunks tables (Parquet), OUT a folder for sample.jsonl and summary.json.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from ..operators import quality
from ..sources.readers import read_json_lines
from ..sources.sinks import write_json_lines, write_summary

COLUMNS = ["id", "document_id", "source_page", "predicate", "value", "raw_value", "source_quote", "source_quote_valid", "snippet", "verdict"]


def main(action: str, tables: str, out: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    sample = f"{out}/sample.jsonl"
    if action in ("sample", "all"):
        checked = quality.spot_check(spark.read.parquet(f"{tables}/facts"), spark.read.parquet(f"{tables}/page_chunks"))
        write_json_lines(checked.select(*COLUMNS), sample)
    if action in ("score", "all"):
        write_summary(quality.score(read_json_lines(spark, sample, "id string, verdict string")), f"{out}/summary.json")


if __name__ == "__main__":
    main(*sys.argv[1:4])
