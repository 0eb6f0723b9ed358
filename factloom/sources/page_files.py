"""Pages as a source: ``spark.read.format("page_files")`` for a folder, :func:`landed_pages` for files as they land.

A file is dealt to tasks in parts of about ``bytes_a_part`` bytes, so that no file is one row and no task holds all pages of a
large one; small files share a task. A part reads the pages of its share of the file. Which decoder opens files is said by
name (``module:attribute``), as options are texts: called with an open binary file, it gives an object with a length (the
number of pages), whose item i is page i from 0 as (items, width, height), items being dicts of :data:`ITEM`'s fields. Only
the pages of a part are decoded.

Edge cases: a page that cannot be decoded is a row with its number and its error, a file that cannot be opened one row with
its error and no number; neither touches other pages. A file without pages, and an empty folder, give no rows. Widths and
heights that are missing or zero are those of a letter page (612 by 792). Pages are numbered from 1.
"""

from __future__ import annotations

import fnmatch
import importlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ITEM = "struct<fontName:string,height:double,str:string,transform:array<double>,width:double>"
FIELDS = ("fontName", "height", "str", "transform", "width")
PAGE = f"path string, page_number int, total_pages int, items array<{ITEM}>, width double, height double, error string"
BYTES_A_PART = 4 * 1024 * 1024
TEXT_PAGES = "factloom.sources.page_files:TextPages"


class TextPages:
    """Plain text whose pages end with a form feed, as converters of documents write it: a line is an item."""

    def __init__(self, file):
        self.file, self.starts = file, [0]
        at = 0
        while block := file.read(1 << 20):
            k = block.find(b"\f")
            while k >= 0:
                self.starts.append(at + k + 1)
                k = block.find(b"\f", k + 1)
            at += len(block)
        if self.starts[-1] != at:
            self.starts.append(at)

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, i: int) -> tuple[list[dict], float, float]:
        self.file.seek(self.starts[i])
        text = self.file.read(self.starts[i + 1] - self.starts[i]).decode().removesuffix("\f")
        lines = [(n, s) for n, s in enumerate(text.split("\n")) if s.strip()]
        return [{"fontName": "text", "height": 10.0, "str": s, "transform": [10.0, 0.0, 0.0, 10.0, 36.0, 756.0 - 12.0 * n], "width": 5.0 * len(s)} for n, s in lines], 612.0, 792.0


def decoder_of(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def filesystem(path: str):
    """The file system of a path or an address, and the path in it. As in Spark, nothing in an address is escaped."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe="/:@?&=+,")) if "://" in path else (fs.LocalFileSystem(), path)


def files_below(folder: str, pattern: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder whose names match; an address stays one."""
    from pyarrow import fs

    system, base = filesystem(folder)
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((folder.rstrip("/") + i.path[len(base.rstrip("/")) :], i.size) for i in found if i.is_file and fnmatch.fnmatchcase(i.base_name, pattern))


def pages_of(path: str, part: int, parts: int, decoder: str) -> Iterator[tuple]:
    """Rows of PAGE of one part of a file."""
    message = lambda e: f"{type(e).__name__}: {e}"
    opened = decoder_of(decoder)  # a decoder that is not there fails the task: no file is to blame
    try:
        system, inner = filesystem(path)
        file = system.open_input_file(inner)
    except OSError as e:
        if part == 0:
            yield path, None, None, None, None, None, message(e)
        return
    with file:
        try:
            document = opened(file)
            n = len(document)
        except Exception as e:  # noqa: BLE001 - whatever a decoder raises becomes the file's error
            if part == 0:
                yield path, None, None, None, None, None, message(e)
            return
        for i in range(n * part // parts, n * (part + 1) // parts):
            try:
                items, width, height = document[i]
                yield path, i + 1, n, [tuple(x.get(f) for f in FIELDS) for x in items], float(width or 612), float(height or 792), None
            except Exception as e:  # noqa: BLE001 - the page's error
                yield path, i + 1, n, None, None, None, message(e)


class Parts(InputPartition):
    """Parts (path, part, parts) that one task reads."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(None)
        self.parts = parts


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.bytes_a_part, self.decoder = int(options.get("bytes_a_part", BYTES_A_PART)), options.get("decoder", TEXT_PAGES)

    def partitions(self) -> list[Parts]:
        out, open_parts, held = [], [], 0
        for path, size in files_below(self.folder, self.pattern):
            n = max(1, -(-size // self.bytes_a_part))
            if n > 1:
                out += [Parts([(path, i, n)]) for i in range(n)]
                continue
            if open_parts and held + size > self.bytes_a_part:
                out.append(Parts(open_parts))
                open_parts, held = [], 0
            open_parts.append((path, 0, 1))
            held += size
        return out + ([Parts(open_parts)] if open_parts else []) or [Parts([])]

    def read(self, partition: Parts) -> Iterator[tuple]:
        for path, part, parts in partition.parts:
            yield from pages_of(path, part, parts, self.decoder)


class PageFiles(DataSource):
    """Options: ``path`` (folder), ``pattern`` (of file names), ``decoder`` (module:attribute), ``bytes_a_part``."""

    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


def read_pages(spark: SparkSession, folder: str, pattern: str = "*", decoder: str = TEXT_PAGES, bytes_a_part: int = BYTES_A_PART) -> DataFrame:
    """Rows of PAGE of the files below a folder."""
    spark.dataSource.register(PageFiles)
    return spark.read.format("page_files").options(pattern=pattern, decoder=decoder, bytes_a_part=bytes_a_part).load(folder)


def landed_pages(spark: SparkSession, folder: str, pattern: str = "*", decoder: str = TEXT_PAGES, bytes_a_part: int = BYTES_A_PART, files_a_batch: int = 100) -> DataFrame:
    """The same as a stream over the files that land in a folder. Spark's file stream keeps what it has seen in the checkpoint,
    each file once; only names and sizes go through it, and the parts of a batch are dealt anew to tasks. Files must land
    whole (written elsewhere and renamed)."""
    file = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").schema(file).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(folder)
    n = F.greatest(F.lit(1), F.ceil(F.col("length") / bytes_a_part)).cast("int")
    parts = found.select("path", n.alias("parts")).select("path", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "page_number", "total_pages", "items", "width", "height", "error"]
        for frame in frames:
            for path, k, total in zip(frame["path"], frame["part"], frame["parts"], strict=True):
                rows = []
                for row in pages_of(path, k, total, decoder):
                    rows.append((*row[:3], row[3] and [dict(zip(FIELDS, x, strict=True)) for x in row[3]], *row[4:]))
                    if len(rows) == 64:
                        yield typed(pd.DataFrame(rows, columns=names))
                        rows = []
                yield typed(pd.DataFrame(rows, columns=names))

    return parts.repartition("path", "part").mapInPandas(run, PAGE)


def typed(rows: pd.DataFrame) -> pd.DataFrame:
    """Whole numbers that may be missing."""
    return rows.astype({"page_number": "Int32", "total_pages": "Int32"})


def engine_pages(pages: DataFrame) -> DataFrame:
    """Rows of PAGE as the engine's pages: the document's id is the hash of its path, its file name the last part of it."""
    return pages.select(F.sha2("path", 256).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "page_number", "items", "width", "error")
