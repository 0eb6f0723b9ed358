"""Sources: folders of files, JSON lines, tables by key. PDF decoding is an adapter that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def find_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, modificationTime and content of matching files at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def decode_pages(files: DataFrame, decode: Callable[[bytes], list[tuple[int, str, float, float]]]) -> DataFrame:
    """(path, page_number, raw_text, width, height, error) of files: ``decode`` lists a file's pages. A file that cannot
    be decoded is one row with its error; no other file is touched."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows += [(path, n, text, float(w), float(h), None) for n, text, w, h in decode(bytes(content))]
                except Exception as e:  # noqa: BLE001 - whatever a decoder raises becomes the file's error
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_number", "raw_text", "width", "height", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, raw_text string, width double, height double, error string")


def data_url(content, mime: str = "image/png"):
    """An image as a data URL."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are no rows."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", schema).alias("x")).select("x.*")


def by_key(rows: DataFrame, **key) -> DataFrame:
    """The row of a key, if any."""
    for k, v in key.items():
        rows = rows.where(F.col(k) == v)
    return rows.limit(1)


def healthy(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1 AS ok").first()["ok"] == 1
