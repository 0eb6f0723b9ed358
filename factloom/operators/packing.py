"""Batches of pages, by successors and pointer doubling.

If a batch starts at a page, prefix sums say where the next one starts: its successor. The batches of a document are the
orbit of its first page. Short documents stream through tasks, and the orbits of all documents in a batch of rows are
followed at once. The pages of a very long document are dealt to blocks of ``BLOCK``, each with as many pages after it as a batch can hold, so
that a block knows the successors of all its pages. For each page of a block that a batch can enter it at, the block says
where its last batch leaves it and after how many batches: a pointer from (block, entry) to (next block, entry). Pointers
are doubled to 2, 4, 8... blocks, and the entries that are on the orbit are found from the far jumps to the near ones; so
no task sees more than a block, and the number of rounds is the logarithm of the number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .nearest import kept

BLOCK = 8192


def successors(cost: np.ndarray, target: int, most: int, ends: np.ndarray | None = None) -> np.ndarray:
    """For each page the first page of the batch after the one that starts at it; at the latest the end of its document
    (``ends``, for each page), if several documents follow each other."""
    n, total = len(cost), np.cumsum(cost)
    big = np.append(np.flatnonzero(cost >= target), n)
    at = np.arange(n)
    full = np.searchsorted(total, total - cost + target, side="right")
    after = np.minimum(np.minimum(full, at + most), big[np.searchsorted(big, at, side="left")])
    after = np.where(cost >= target, at + 1, np.maximum(after, at + 1))
    return after if ends is None else np.minimum(after, ends)


def batches_of_documents(key: np.ndarray, cost: np.ndarray, target: int, most: int) -> np.ndarray:
    """The batch of each page; documents follow each other, and ``key`` changes between them."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(key)))
    ends = np.repeat(starts + sizes, sizes)
    after = successors(cost, target, most, ends)
    first, at = np.zeros(len(key), np.int64), starts
    while len(at):
        first[at] = 1
        last, at = at, after[at]
        at = at[at < ends[last]]
    number = np.cumsum(first)
    return number - np.repeat(number[starts], sizes)


def pack_short(rows: DataFrame, scope: str, target: int, most: int) -> DataFrame:
    """(scope, page_number, batch) of rows (scope, page_number, cost); a task holds one document at a time besides a batch
    of rows."""
    kinds = dict(rows.dtypes)
    dealt = rows.select(scope, "page_number", "cost").repartition(scope).sortWithinPartitions(scope, "page_number")

    def packed(table: pa.Table) -> pa.RecordBatch:
        key = pc.dictionary_encode(table.column(0), null_encoding="encode").combine_chunks().indices.to_numpy()
        batch = batches_of_documents(key, table.column(2).to_numpy().astype(np.int64), target, most)
        return pa.table([table.column(0), table.column(1), pa.array(batch, pa.int32())], [scope, "page_number", "batch"]).combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0)
            last = key[len(key) - 1]
            same = np.asarray(pc.equal(key, last).fill_null(False).to_numpy(zero_copy_only=False)) if last.is_valid else np.asarray(key.is_null())
            tail = len(key) - int(same.sum())  # rows are sorted, so the last document's are at the end
            if tail:
                yield packed(pa.Table.from_batches([*held, batch.slice(0, tail)]))
                held = []
            elif held and held[-1].column(0)[0] != last:
                yield packed(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(tail))
        if held:
            yield packed(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, f"{scope} {kinds[scope]}, page_number {kinds['page_number']}, batch int")


def positions(rows: DataFrame, scope: str) -> DataFrame:
    """``rows`` (scope, page_number, cost) with ``at``: the place of a page in its scope, from 0. Pages are sorted by range
    over all tasks; each task numbers its own, and the counts of the tasks before give the rest."""
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = rows.repartitionByRange(int(parts), scope, "page_number").sortWithinPartitions(scope, "page_number")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            at = []
            for key in batch.column(0).to_pylist():
                own, n = (own, n + 1) if key == own else (key, 0)
                at.append(n)
            yield pa.record_batch([*batch.columns, pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())], [*batch.schema.names, "part", "place"])

    numbered = kept(ordered.mapInArrow(run, f"{scope} {kinds[scope]}, page_number {kinds['page_number']}, cost int, part int, place bigint"), "places")
    counts = numbered.groupBy(scope, "part").agg(F.count("*").alias("n"))
    w = Window.partitionBy(scope).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(scope, "part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))  # a row a task and scope
    return numbered.join(before, [scope, "part"]).select(scope, "page_number", "cost", (F.col("place") + F.col("before")).alias("at"))


def pack_long(rows: DataFrame, scope: str, target: int, most: int, least_cost: int) -> DataFrame:
    """(scope, page_number, batch) of rows (scope, page_number, cost); ``least_cost`` is the least cost of a page."""
    reach = max(1, min(most, target // least_cost + 1))  # pages of a batch, at most
    block = max(BLOCK, reach)
    kinds = dict(rows.dtypes)
    placed = positions(rows, scope)
    own = placed.withColumn("block", F.floor(F.col("at") / block))
    halo = own.where((F.col("block") > 0) & (F.col("at") % block < reach)).withColumn("block", F.col("block") - 1)
    blocks = kept(own.unionByName(halo), "blocks")

    def read(table: pa.Table) -> tuple[pa.Table, int, np.ndarray]:
        table = table.sort_by("at").combine_chunks()
        first = table.column("block")[0].as_py() * block
        after = successors(np.asarray(table.column("cost").to_numpy(), dtype=np.int64), target, most)
        return table, int((np.asarray(table.column("at").to_numpy()) < first + block).sum()), after

    def jumps(table: pa.Table) -> pa.Table:
        table, n, after = read(table)
        leave, batches = np.empty(n, np.int64), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                leave[i], batches[i] = leave[after[i]], batches[after[i]] + 1
            else:
                leave[i] = after[i] - n
        m = min(reach, n)
        key, number = table.column(scope)[0], table.column("block")[0].as_py()
        cols = [pa.array([key.as_py()] * m, key.type), pa.array([number] * m, pa.int64()), pa.array(range(m), pa.int64()), pa.array([number + 1] * m, pa.int64()), pa.array(leave[:m]), pa.array(batches[:m])]
        return pa.table(cols, [scope, "block", "entry", "to_block", "to_entry", "n"])

    pointer = f"{scope} {kinds[scope]}, block bigint, entry bigint, to_block bigint, to_entry bigint, n bigint"
    jump = kept(blocks.groupBy(scope, "block").applyInArrow(jumps, pointer), "jumps")
    last = jump.agg(F.max("block")).first()[0]
    tables = [jump]
    while 2 ** len(tables) <= last:
        far = tables[-1]
        onward = far.select(scope, F.col("block").alias("to_block"), F.col("entry").alias("to_entry"), F.col("to_block").alias("b"), F.col("to_entry").alias("e"), F.col("n").alias("m"))
        tables.append(kept(far.join(onward, [scope, "to_block", "to_entry"]).select(scope, "block", "entry", F.col("b").alias("to_block"), F.col("e").alias("to_entry"), (F.col("n") + F.col("m")).alias("n")), "jumps"))
    found = jump.where("block = 0 and entry = 0").select(scope, "block", "entry", F.lit(0).cast("bigint").alias("before"))
    for far in reversed(tables):
        step = found.join(far, [scope, "block", "entry"]).select(scope, F.col("to_block").alias("block"), F.col("to_entry").alias("entry"), (F.col("before") + F.col("n")).alias("before"))
        found = kept(found.unionByName(step), "entries")

    def batches_of(table: pa.Table) -> pa.Table:
        entry, before = table.column("entry")[0].as_py(), table.column("before")[0].as_py()
        table, n, after = read(table)
        starts, at = [], entry
        while at < n:
            starts.append(at)
            at = int(after[at])
        batch = np.searchsorted(np.array(starts), np.arange(n), side="right") + before - 1
        return pa.table([table.column(scope).slice(0, n), table.column("page_number").slice(0, n), pa.array(batch, pa.int32())], [scope, "page_number", "batch"])

    with_entry = blocks.join(found, [scope, "block"])
    return with_entry.groupBy(scope, "block").applyInArrow(batches_of, f"{scope} {kinds[scope]}, page_number {kinds['page_number']}, batch int")
