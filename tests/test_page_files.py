"""Pages as a source: parts of files over tasks, errors as rows, the same as a stream."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import jobs
from factloom.plans.schemas import TABLES
from factloom.sources import page_files
from factloom.streaming import progress


class Fragile(page_files.TextPages):
    """Fails on one page, and on files that say so."""

    def __init__(self, file):
        super().__init__(file)
        file.seek(0)
        if file.read(6) == b"broken":
            raise ValueError("not a document")

    def __getitem__(self, i):
        items, _, _ = super().__getitem__(i)
        if any("torn" in x["str"] for x in items):
            raise ValueError("torn page")
        return items, None, 0


def brute(folder):
    out = set()
    for f in folder.rglob("*.txt"):
        text = f.read_text()
        pages = text.split("\f")
        pages = pages[:-1] if pages[-1] == "" else pages
        out |= {(f.name, i, len(pages), " / ".join(line for line in p.split("\n") if line.strip())) for i, p in enumerate(pages, 1)}
    return out


def shape(df):
    text = F.array_join(F.transform("items", lambda x: x["str"]), " / ")
    return [tuple(r) for r in df.select(F.element_at(F.split("path", "/"), -1), "page_number", "total_pages", text).collect()]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("pages of files")
    (base / "deep").mkdir()
    (base / "big.txt").write_text("".join(f"page {i}\nrow é {i * 7}\f" for i in range(10_000)))
    (base / "deep" / "small.txt").write_text("one\fzwei\n\n  \nlast line")
    (base / "empty.txt").write_text("")
    (base / "other.bin").write_text("no")
    return base


def test_one_file_over_many_tasks(spark, folder):
    df = page_files.read_pages(spark, str(folder), "*.txt", bytes_a_part=20_000)
    got = shape(df)
    assert len(got) == len(set(got)) and set(got) == brute(folder)
    tasks = df.where("path like '%big.txt'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 8 and max(r["count"] for r in tasks) < 2_000
    assert set(shape(page_files.read_pages(spark, f"file://{folder}", "*.txt"))) == brute(folder)
    assert page_files.read_pages(spark, str(folder), "*.none").count() == 0


def test_errors_are_rows(spark, tmp_path):
    spark.sparkContext.addPyFile(__file__)
    (tmp_path / "a.txt").write_text("good\ftorn\fgood too\f")
    (tmp_path / "b.txt").write_text("broken\fx\f" + "y" * 200)
    df = page_files.read_pages(spark, str(tmp_path), decoder="test_page_files:Fragile", bytes_a_part=50)
    rows = sorted((r["path"][-5:], r["page_number"], r["width"], r["height"], r["error"]) for r in df.collect())
    assert rows == [("a.txt", 1, 612.0, 792.0, None), ("a.txt", 2, None, None, "ValueError: torn page"), ("a.txt", 3, 612.0, 792.0, None), ("b.txt", None, None, None, "ValueError: not a document")]


def test_landing_files_are_pages_of_jobs(spark, folder, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "x.txt").write_bytes((folder / "big.txt").read_bytes())

    def land():
        out = []
        stream = page_files.landed_pages(spark, f"file://{landing}", "*.txt", bytes_a_part=50_000)
        progress.run_available(stream, lambda df, n: out.extend(shape(df)), str(tmp_path / "checkpoint"))
        return out

    got = land()
    assert len(got) == 10_000 and set(got) == brute(landing)
    (landing / "y z.txt").write_text("first\f\fthird")
    assert sorted(land()) == [("y z.txt", 1, 3, "first"), ("y z.txt", 2, 3, ""), ("y z.txt", 3, 3, "third")]
    pages = page_files.engine_pages(page_files.read_pages(spark, str(folder / "deep")))
    none = lambda name: spark.createDataFrame([], TABLES[name])
    named = pages.groupBy(F.col("document_id").alias("id")).agg(F.max("filename").alias("filename"), F.lit("pending").alias("status"))
    documents = named.select(*[(F.col(c) if c in named.columns else F.lit(None)).cast(t).alias(c) for c, t in none("documents").dtypes])
    parsed = jobs.parse_pages(pages, none("page_chunks"), documents)
    assert [(r["filename"], r["status"], r["page_count"]) for r in parsed["documents"].collect()] == [("small.txt", "parsed", 2)]
    assert {(r["page_number"], r["raw_text"]) for r in parsed["chunks"].collect()} == {(1, "one"), (2, "zwei last line")}
