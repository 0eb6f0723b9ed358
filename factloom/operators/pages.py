"""Pages: classification, splitting, grouping, boilerplate, duplicates, packing and routing."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, page_hash, squeezed, trimmed
from .nearest import kept
from .packing import pack_long, pack_short

#: Thresholds of pages and batches, and what counts as a numeric run.
CHUNK_TOKENS, LOW_CHARS, LOW_RUNS, NUMERIC_RATIO, NARROW_RATIO = 6000, 1000, 15, 0.4, 0.25
TARGET_TOKENS, MIN_COST, LONG_PAGE = 42_000, 400, 100_000
#: Bytes of repeated lines that are shared with all tasks; pages of a document that are packed in one task.
SHARED_BYTES, LONG_SCOPE = 32_000_000, 50_000
NUMERIC_RUN = "^[0-9.,%$€£₹+-]+$"


def text_runs(items: Column) -> Column:
    """Runs array<struct<text, x, y, width, height, fontName>> of text items; blank items go, heights fall back to the
    first entry of the transform."""
    made = F.transform(items, lambda i: F.struct(trimmed(i["str"]).alias("text"), i["transform"][4].alias("x"), i["transform"][5].alias("y"), i["width"].alias("width"), F.when(i["height"] != 0, i["height"]).otherwise(F.abs(i["transform"][0])).alias("height"), i["fontName"].alias("fontName")))
    return F.filter(made, lambda r: r["text"] != "")


def raw_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), " ")


def classify_page(runs: Column, text: Column, width: Column) -> Column:
    """struct<is_low_text, is_table_heavy, numeric_ratio, avg_width, vision_flagged>."""
    n = F.size(runs)
    numeric = F.size(F.filter(runs, lambda r: r["text"].rlike(NUMERIC_RUN))) / n
    avg = F.aggregate(runs, F.lit(0.0), lambda s, r: s + r["width"].cast("double")) / n
    table = (n >= 5) & (numeric >= NUMERIC_RATIO) & (avg < NARROW_RATIO * width)
    low = (F.length(trimmed(text)) < LOW_CHARS) | (n < LOW_RUNS)
    none = n == 0
    pick = lambda empty, c: F.when(none, F.lit(empty)).otherwise(c)
    return F.struct(pick(True, low).alias("is_low_text"), pick(False, table).alias("is_table_heavy"), pick(0.0, numeric).alias("numeric_ratio"), pick(0.0, avg).alias("avg_width"), pick(True, low | table).alias("vision_flagged"))


def median_height(runs: Column) -> Column:
    """The upper median of positive heights, 10 if there is none."""
    up = F.array_sort(F.filter(F.transform(runs, lambda r: r["height"].cast("double")), lambda h: h > 0))
    return F.coalesce(F.get(up, F.floor(F.size(up) / 2).cast("int")), F.lit(10.0))


def split_oversize(runs: Column, limit: int = CHUNK_TOKENS) -> Column:
    """Chunks array<array<run>> of a page: cut after a run where the gap to the next is over 1.5 median heights and a
    quarter of the limit (250 at least) is full, or where the limit is."""
    tokens = lambda t: F.ceil(F.length(t) / 4)
    gap = 1.5 * median_height(runs)
    least = max(250, limit // 4)
    indexed = F.transform(runs, lambda r, i: F.struct(r.alias("r"), F.abs(F.get(runs, i + 1)["y"].cast("double") - r["y"].cast("double")).alias("gap")))
    start = F.struct(F.array().cast("array<array<int>>").alias("done"), F.array().cast("array<int>").alias("open"), F.lit(0).cast("bigint").alias("chars"))

    def step(acc: Column, x: Column) -> Column:
        i = F.size(F.flatten(acc["done"])) + F.size(acc["open"])
        chars = acc["chars"] + F.length(x["r"]["text"]) + F.when(F.size(acc["open"]) > 0, 1).otherwise(0)
        own, full = F.concat(acc["open"], F.array(i)), F.ceil(chars / 4)
        cut = ((x["gap"] > gap) & (full >= least)) | (full >= limit)
        return F.when(F.coalesce(cut, F.lit(False)), F.struct(F.concat(acc["done"], F.array(own)).alias("done"), F.array().cast("array<int>").alias("open"), F.lit(0).cast("bigint").alias("chars"))).otherwise(F.struct(acc["done"].alias("done"), own.alias("open"), chars.alias("chars")))

    folded = F.aggregate(indexed, start, step, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    whole = (tokens(raw_text(runs)) <= limit) | (F.size(runs) <= 4)
    return F.when(whole, F.array(runs)).otherwise(F.transform(folded, lambda c: F.transform(c, lambda i: F.get(runs, i))))


def group_chunks(chunks: DataFrame) -> DataFrame:
    """One row a page (document_id, page_number) of its chunks: texts in order joined by a blank line; low text if all
    are, table-heavy or in need of vision if any is."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "raw_text", "id")))
    got = chunks.groupBy("document_id", "page_number").agg(
        ordered.alias("x"), F.bool_and("is_low_text").alias("is_low_text"), F.bool_or("is_table_heavy").alias("is_table_heavy"), F.bool_or("needs_vision").alias("needs_vision"), F.min("chunk_index").alias("first_chunk_index")
    )
    return got.select("document_id", "page_number", F.array_join(F.col("x.raw_text"), "\n\n").alias("raw_text"), "is_low_text", "is_table_heavy", "needs_vision", "first_chunk_index", F.col("x.id").alias("chunk_ids"))


def repeated_lines(pages: DataFrame, scope: str = "document_id", least: int | None = None, min_length: int = 6, ordered: bool = False) -> DataFrame:
    """(scope, line, n_pages) of lines that stand on more than half of a document's pages, or on ``least`` pages.
    Single pages have none. A line counts once a page. ``ordered`` adds where a line stands first: first_page, first_place."""
    lines = pages.select(scope, "page_number", F.posexplode(F.array_distinct(F.transform(F.split("text", "\n"), trimmed))).alias("place", "line")).where(F.length("line") >= min_length)
    where = [F.min("page_number").alias("first_page"), F.min_by("place", "page_number").alias("first_place")] if ordered else []
    counted = lines.groupBy(scope, "line").agg(F.count("*").alias("n_pages"), *where)
    if least is not None:
        return counted.where(F.col("n_pages") >= least)
    totals = pages.groupBy(scope).agg(F.count("*").alias("total"))
    return counted.where("n_pages > 1").join(totals, scope).where((F.col("total") > 1) & (F.col("n_pages") >= F.floor(F.col("total") / 2) + 1)).drop("total")


class Remover:
    """Takes strings out of texts, one after another in the order given, as if each were replaced everywhere in turn. An
    automaton over all of them says which one is next, so a text costs a pass for each string that is there, not for each
    that there is."""

    def __init__(self, strings: list[str]):
        self.strings, self.automaton = strings, ahocorasick.Automaton()
        for i, s in enumerate(strings):
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        done = -1
        while True:
            done = min((i for _, i in self.automaton.iter(text) if i > done), default=None)
            if done is None:
                return text
            text = text.replace(self.strings[done], "")


def without_lines(pages: DataFrame, lines: DataFrame, scope: str) -> DataFrame | None:
    """``pages`` with ``bare``: the text without the lines of its scope; null where the scope has none. None if no scope has
    any. lines (scope, lines: array in order). A document has at most twice as many lines on more than half of its pages as a page has on average.
    Lines of up to ``SHARED_BYTES`` are shared with all tasks; more of them come with the pages in a join."""
    size = lines.agg(F.coalesce(F.sum(F.length(F.array_join("lines", "\n"))), F.lit(0)).alias("n")).first()["n"]
    if not size:
        return None
    shared = None
    if size <= SHARED_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r[scope]: r["lines"] for r in lines.collect()})
        pages = pages.withColumn("__lines", F.lit(None).cast("array<string>"))
    else:
        pages = pages.join(lines.withColumnRenamed("lines", "__lines"), scope, "left")
    at = {c: pages.columns.index(c) for c in (scope, "text", "__lines")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, remove = None, None
        for batch in batches:
            out = []
            for key, text, lines in zip(*(batch.column(at[c]).to_pylist() for c in (scope, "text", "__lines")), strict=True):
                lines = shared.value.get(key) if shared else lines
                if lines is None or text is None:
                    out.append(None)
                    continue
                if lines != own:
                    own, remove = lines, Remover(lines)
                out.append(remove(text))
            yield pa.record_batch([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "bare"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("bare", T.StringType())])).drop("__lines")


def deduplicate_pages(pages: DataFrame, scope: str = "document_id", enabled: bool = True) -> DataFrame:
    """Pages (scope, page_number, text, ...) with compacted_text and canonical_page: the first page of the same compacted
    text, itself if there is none before or if it is blank. Lines go in the order in which they first stand in the document."""
    if not enabled:
        return pages.withColumn("compacted_text", F.col("text")).withColumn("canonical_page", F.col("page_number"))
    order = F.array_sort(F.collect_list(F.struct("first_page", "first_place", "line")))
    lines = kept(repeated_lines(pages, scope, ordered=True).groupBy(scope).agg(order.alias("x")).select(scope, F.col("x.line").alias("lines")), "repeated-lines")
    bare = without_lines(pages, lines, scope)
    got = pages.withColumn("compacted_text", F.col("text")) if bare is None else bare.withColumn("compacted_text", F.coalesce(squeezed(F.col("bare")), F.col("text"))).drop("bare")
    got = got.withColumn("__h", F.when(~is_blank(F.col("compacted_text")), page_hash(F.col("compacted_text"))))
    if bare is not None:
        got = kept(got, "compacted-pages")
    firsts = got.where("__h is not null").groupBy(scope, "__h").agg(F.min("page_number").alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return got.join(firsts, [scope, "__h"], "left").withColumn("canonical_page", F.coalesce("__first", "page_number")).select(*pages.columns, "compacted_text", "canonical_page")


def page_cost(tokens: Column) -> Column:
    return F.greatest(F.lit(MIN_COST), F.floor(1.5 * tokens + 0.5).cast("int"))


def pack_pages(pages: DataFrame, scope: str = "document_id", target: int = TARGET_TOKENS, most: int | None = None, long_scope: int = LONG_SCOPE) -> DataFrame:
    """(scope, page_number, batch) in page order: a page of the target's cost or more stands alone, else a batch ends
    before it would cost over the target or hold over ``most`` pages. A document of up to ``long_scope`` pages is
    packed in one task; longer ones are cut to blocks (:mod:`packing`)."""
    rows = kept(pages.select(scope, "page_number", page_cost(F.col("token_estimate")).alias("cost")), "page-costs")
    sizes, limit = rows.groupBy(scope).agg(F.count("*").alias("__n")).where(F.col("__n") > long_scope).select(scope), most or 2**31 - 1
    if not sizes.limit(1).count():
        return pack_short(rows, scope, target, limit)
    long = kept(sizes, "long-scopes")
    return pack_short(rows.join(long, scope, "left_anti"), scope, target, limit).unionByName(pack_long(rows.join(long, scope, "left_semi"), scope, target, limit, MIN_COST))


def fixed_groups(rows: DataFrame, scope: str, order: str, size: int) -> DataFrame:
    """Rows with ``group``: runs of ``size`` in order."""
    w = Window.partitionBy(scope).orderBy(order)
    return rows.withColumn("group", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


def halves(batch: Column) -> Column:
    """array of the two halves, the first the longer."""
    n = F.ceil(F.size(batch) / 2).cast("int")
    return F.array(F.slice(batch, F.lit(1), n), F.when(F.size(batch) > n, F.slice(batch, n + 1, F.greatest(F.size(batch) - n, F.lit(1)))).otherwise(F.slice(batch, 1, 0)))


def route(text: Column, n_runs: Column, low_text: Column, table_heavy: Column, vision: bool) -> Column:
    """What to do with a chunk: skip, extract-vision, defer-vision-disabled, extract-text-table or extract-text."""
    return (
        F.when(is_blank(text) & (n_runs == 0), "skip")
        .when(low_text, "extract-vision" if vision else "defer-vision-disabled")
        .when(table_heavy, "extract-text-table")
        .otherwise("extract-text")
    )
