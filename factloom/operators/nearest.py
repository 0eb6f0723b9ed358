"""Exact nearest neighbours by cosine distance, without all pairs.

Vectors are taken to the unit sphere, where a cosine distance c is a length sqrt(2c), so the triangle inequality holds.
Every row belongs to its nearest pivot and, by its distance from it, to a ring; a pivot's ring is a cell. A query at
distance D of a pivot can have a row of a ring [low, high] no nearer than max(D - high, low - D), nor, if another pivot is
nearer to it, than the plane between the two. A query visits only the cells whose bound is within reach. Cells and queries
meet in blocks of at most about ``BLOCK`` rows by ``BLOCK`` queries, whatever their key, and a block passes on no more
than k rows a query: a cell with a third of all rows (copies of one vector) is many blocks. Rows that one block holds are
sent to the queries instead.

Pivots come from a sample of at most ``SAMPLE`` rows. They decide the speed and nothing else: bounds and distances are
exact. Vectors that lie evenly in many dimensions leave nothing to prune, then every cell is visited.

A row whose vector is null, empty, of length zero or of other dimensions than the pivots has no distance and is left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir

BLOCK, MOST_PIVOTS, KEYED_PIVOTS, SAMPLE = 2048, 512, 32, 4096
#: Rows by queries of a block of a key: they are compared in parts of ``BLOCK``, so only that grows which a task holds once.
WIDE = 16_384
#: More than the rounding of a length or a distance: bounds are wider by this much.
SLACK, TIE = 1e-6, 1e-9
FEWEST_RINGS, MOST_RINGS = 4, 100  # of the lengths 0 to 2


class Largest(AccumulatorParam):
    """Keeps the pairs of the largest block, where a plain accumulator adds up those of all."""

    def zero(self, value: int) -> int:
        return 0

    def addInPlace(self, value1: int, value2: int) -> int:
        return max(value1, value2)


def kept(df: DataFrame, name: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a column (array<double>, all of ``dims``) as rows."""
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def distances(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosine distances of rows ``i`` of q and ``j`` of v as the column expression takes them, sums from left to right."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1]
    parts = [slice(o, o + 65_536) for o in range(0, max(1, len(i)), 65_536)]
    return np.concatenate([1.0 - total(q[i[s]] * v[j[s]]) / (np.sqrt(total(q[i[s]] ** 2)) * np.sqrt(total(v[j[s]] ** 2))) for s in parts])


def choose_pivots(rows: DataFrame, n: int, m: int | None = None) -> np.ndarray:
    """``m``, or about sqrt(n) / 4, unit vectors, the centres of a few k-means rounds over a sample that a hash of the id chooses."""
    sample = rows.orderBy(F.xxhash64("rid")).limit(SAMPLE).select("v").toArrow().column(0).to_pylist()
    dims = Counter(map(len, sample)).most_common(1)[0][0]
    x = unit(np.array([v for v in sample if len(v) == dims]))
    at = x[: m or min(MOST_PIVOTS, math.ceil(math.sqrt(n) / 4))]
    for _ in range(4):
        of = (x @ at.T).argmax(axis=1)
        sums = np.zeros_like(at)
        np.add.at(sums, of, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        at = np.where(size > SLACK, sums / np.maximum(size, SLACK), at)
    return at


def fitting(df: DataFrame, vector: str, dims: int | None = None) -> DataFrame:
    """Rows whose vector has a direction, as array<double>."""
    v = F.col(vector).cast("array<double>")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    good = (F.size(v) > 0 if dims is None else F.size(v) == dims) & F.coalesce(square > 0, F.lit(False))
    return df.withColumn(vector, v).where(F.col(vector).isNotNull() & good)


def in_cells(rows: DataFrame, pivots: np.ndarray, n: int) -> DataFrame:
    """The ``n`` ``rows`` with pivot, ring and far: the distance from the pivot. Cells are about sqrt(n) at most."""
    dims, place = pivots.shape[1], rows.columns.index("v")
    rings = min(MOST_RINGS, max(FEWEST_RINGS, math.ceil(math.sqrt(n) / len(pivots))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = lengths(unit(matrix(batch.column(place), dims)), pivots)
            of = far.argmin(axis=1)
            far = far[np.arange(len(of)), of]
            ring = np.minimum((far * rings / 2).astype(np.int32), rings - 1)
            yield pa.record_batch([*batch.columns, pa.array(of, pa.int32()), pa.array(ring), pa.array(far)], [*batch.schema.names, "pivot", "ring", "far"])

    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, pivot int, ring int, far double")


class Cells:
    """The cells of one set of rows, as arrays on the driver: at most ``MOST_PIVOTS`` * ``MOST_RINGS``."""

    def __init__(self, pivots: np.ndarray, stats: list[tuple[int, int, int, float, float]]):
        self.pivots = pivots
        self.of, self.ring, self.n, low, high = (np.array(c) for c in zip(*stats, strict=True))
        self.low, self.high = low - SLACK, high + SLACK
        self.between = np.maximum(lengths(pivots, pivots), SLACK)

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """No row of a cell is nearer to a query (a unit vector) than this."""
        d = lengths(x, self.pivots)
        home = d.argmin(axis=1)
        plane = (d**2 - d[np.arange(len(d)), home][:, None] ** 2) / (2 * self.between[home])
        plane = np.where(self.between[home] <= 10 * SLACK, 0.0, plane)
        own = d[:, self.of]
        return np.maximum(np.maximum(own - self.high, self.low - own), plane[:, self.of] - SLACK)


def visits(queries: DataFrame, cells: Cells, k: int | None, reach: float, first: bool) -> DataFrame:
    """``queries`` with each cell (pivot, ring) to visit. At first, the nearest cells that hold more than k rows together;
    then, with the distance ``kth`` that was found there (null: none), the others within reach of it. Without k, all cells
    within reach at once."""
    dims, place = cells.pivots.shape[1], queries.columns.index("q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                bound = cells.bounds(unit(matrix(batch.column(place), dims)))
                order = bound.argsort(axis=1, kind="stable")
                sorted_n = cells.n[order]
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, order, True if k is None else sorted_n.cumsum(axis=1) - sorted_n <= k, axis=1)
                if first:
                    row, cell = np.nonzero(early & (bound <= reach))
                else:
                    kth = np.asarray(batch.column("kth").to_numpy(zero_copy_only=False), dtype=np.float64)
                    far = np.minimum(np.sqrt(np.maximum(0.0, 2 * np.where(np.isnan(kth), 2.0, kth))) + SLACK, reach)
                    row, cell = np.nonzero(~early & (bound <= far[:, None]))
                if len(row):
                    part = batch.take(pa.array(row))
                    yield pa.record_batch([*part.columns, pa.array(cells.of[cell], pa.int32()), pa.array(cells.ring[cell], pa.int32())], [*part.schema.names, "pivot", "ring"])

    return queries.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in queries.dtypes) + ", pivot int, ring int")


def meet(visiting: DataFrame, rows: DataFrame, units: list[str], k: int | None, max_distance: float | None, compared: Accumulator | None = None, block: int | None = None) -> DataFrame:
    """(qid, rid, distance) of the k nearest rows (units, rid, rx, v) of each query (units, qid, qx, q) within each block of
    the units; rows whose rx is the query's qx do not count. Blocks are of about ``block`` rows and queries (``BLOCK``, if not given); ``compared``
    counts the pairs."""
    blocks = lambda n: F.ceil(F.col(n) / (block or BLOCK)).cast("int")
    both = visiting.groupBy(*units).agg(F.count("*").alias("nq")).join(rows.groupBy(*units).agg(F.count("*").alias("nr")), units)
    both = kept(both.select(*units, blocks("nq").alias("nq"), blocks("nr").alias("nr")), "units")
    both = F.broadcast(both) if both.count() <= MOST_PIVOTS * MOST_RINGS else both
    spread = lambda own, other, key, name, side: [F.pmod(F.xxhash64(key), F.col(own)).cast("int").alias(name), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(side)]
    left = visiting.join(both, units).select(*units, "qid", "qx", "q", *spread("nq", "nr", "qid", "qb", "rb"))
    right = rows.join(both, units).select(*units, "rid", "rx", "v", *spread("nr", "nq", "rid", "rb", "qb"))
    kind, row_kind = dict(visiting.dtypes)["qid"], dict(rows.dtypes)["rid"]
    keys = [*units, "qb", "rb"]
    run = lambda a, b: nearest_in_block(a, b, k, max_distance, compared)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"qid {kind}, rid {row_kind}, distance double")


def nearest_in_block(a: pa.Table, b: pa.Table, k: int | None, max_distance: float | None, compared: Accumulator | None = None) -> pa.Table:
    """(qid, rid, distance) of the k nearest rows of ``b`` (rid, rx, v) to each query of ``a`` (qid, qx, q), all of the same
    dimensions."""
    names = ["qid", "rid", "distance"]
    empty = pa.table([pa.array([], a.schema.field("qid").type), pa.array([], b.schema.field("rid").type), pa.array([], pa.float64())], names)
    if not a.num_rows or not b.num_rows:
        return empty
    if compared is not None:
        compared.add(a.num_rows * b.num_rows)
    q, v = (np.array(t.column(c).combine_chunks().flatten(), dtype=np.float64).reshape(t.num_rows, -1) for t, c in ((a, "q"), (b, "v")))
    qx, rx = a.column("qx").to_pylist(), b.column("rx").to_pylist()
    code = {x: i for i, x in enumerate(dict.fromkeys([*qx, *rx]))}
    qx, rx = np.array([code[x] for x in qx]), np.array([code[x] if x is not None else -1 for x in rx])
    place = np.empty(b.num_rows, np.int64)
    place[pc.array_sort_indices(b.column("rid").combine_chunks()).to_numpy()] = np.arange(b.num_rows)
    most, of_rows, found = np.inf if max_distance is None else max_distance, unit(v), []
    for s in range(0, len(q), BLOCK):
        of_queries, limit, best = unit(q[s : s + BLOCK]), np.full(len(q[s : s + BLOCK]), most + TIE), []
        for t in range(0, len(v), BLOCK):
            rough = 1.0 - of_queries @ of_rows[t : t + BLOCK].T
            rough[qx[s : s + BLOCK, None] == rx[None, t : t + BLOCK]] = np.inf
            if k is not None and not t and rough.shape[1] > k:  # what comes later is compared with what was found
                limit = np.fmin(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + TIE)
            i, j = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
            exact = distances(q, v, s + i, t + j) if len(i) else np.zeros(0)
            near = np.flatnonzero(np.isfinite(exact) & (exact < most))
            best.append((i[near], t + j[near], exact[near]))
            if k is None:
                continue
            i, j, exact = (np.concatenate(x) for x in zip(*best, strict=True))
            order = np.lexsort((place[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            at = np.arange(len(i)) - np.searchsorted(i, i)
            limit[i[at == k - 1]] = np.minimum(limit[i[at == k - 1]], exact[at == k - 1] + TIE)
            best = [(i[at < k], j[at < k], exact[at < k])]
        found += [(s + i, j, exact) for i, j, exact in best]
    i, j, exact = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.table([a.column("qid").take(pa.array(i)), b.column("rid").take(pa.array(j)), pa.array(exact, pa.float64())], names) if len(i) else empty


def in_one_block(queries: DataFrame, rows: pa.Table, row_kind: str, k: int | None, max_distance: float | None, compared: Accumulator | None) -> DataFrame:
    """As :func:`meet`, for rows that fit one block: every task has them."""
    sizes = Counter(map(len, rows.column("v").to_pylist()))
    dims = sizes.most_common(1)[0][0]
    rows = rows.filter(pa.array([len(v) == dims for v in rows.column("v").to_pylist()]))
    shared = queries.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield from nearest_in_block(pa.Table.from_batches([batch.slice(at, BLOCK)]), shared.value, k, max_distance, compared).combine_chunks().to_batches()

    return fitting(queries, "q", dims).select("qid", "qx", "q").mapInArrow(run, f"qid {dict(queries.dtypes)['qid']}, rid {row_kind}, distance double")


def no_rows(spark: SparkSession, queries: DataFrame, rows: DataFrame) -> DataFrame:
    return spark.createDataFrame([], f"qid {dict(queries.dtypes)['qid']}, rid {dict(rows.dtypes)['rid']}, distance double")


def search(queries: DataFrame, rows: DataFrame, k: int | None, max_distance: float | None = None, compared: Accumulator | None = None) -> DataFrame:
    """(qid, rid, distance), a superset of the k nearest rows (rid, rx, v) of each query (qid, qx, q): at most k of each block
    that was visited. Null qx differ from everything. Without k, all rows within ``max_distance`` and no others."""
    spark, rows = rows.sparkSession, fitting(rows, "v")
    some = rows.select("rid", "rx", "v").limit(BLOCK + 1).toArrow()
    if not some.num_rows:
        return no_rows(spark, queries, rows)
    if some.num_rows <= BLOCK:
        return in_one_block(queries, some, dict(rows.dtypes)["rid"], k, max_distance, compared)
    n = rows.count()
    pivots = choose_pivots(rows, n)
    dims = pivots.shape[1]
    rows = kept(in_cells(fitting(rows, "v", dims), pivots, n), "cells")
    queries = kept(fitting(queries, "q", dims), "queries")
    stats = rows.groupBy("pivot", "ring").agg(F.count("*"), F.min("far"), F.max("far")).collect()
    cells, reach = Cells(pivots, [tuple(r) for r in stats]), math.inf if max_distance is None else math.sqrt(2 * max_distance) + SLACK
    units = ["pivot", "ring"]
    near = meet(kept(visits(queries, cells, k, reach, True), "visits"), rows, units, k, max_distance, compared)
    if k is None:  # all pairs: they are not written here, so that what narrows them comes first
        return near
    near = kept(near, "near")
    kth = near.groupBy("qid").agg(F.array_sort(F.collect_list("distance")).alias("d")).select("qid", F.get("d", F.lit(k - 1)).alias("kth"))
    later = queries.join(kth, "qid", "left")
    return near.unionByName(meet(kept(visits(later, cells, k, reach, False), "visits"), rows, units, k, max_distance, compared))


def search_in_keys(queries: DataFrame, rows: DataFrame, k: int, max_distance: float, compared: Accumulator | None = None) -> DataFrame:
    """As :func:`search`, of rows (key, rid, rx, v) that share a query's key (key, qid, qx, q), within ``max_distance``. For
    keys of many rows: their cells are a table, and those out of reach are left out in a join."""
    spark, rows = rows.sparkSession, fitting(rows, "v")
    n = rows.count()
    if not n:
        return no_rows(spark, queries, rows)
    pivots = choose_pivots(rows, n, KEYED_PIVOTS)
    rows = kept(in_cells(fitting(rows, "v", pivots.shape[1]), pivots, n), "cells")
    queries, place = fitting(queries, "q", pivots.shape[1]), queries.columns.index("q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = lengths(unit(matrix(batch.column(place), pivots.shape[1])), pivots)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32()), pa.array(d.ravel()))
            yield pa.record_batch([*batch.columns, lists], [*batch.schema.names, "d"])

    queries = kept(queries.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in queries.dtypes) + ", d array<double>"), "queries")
    cells = kept(rows.groupBy("key", "pivot", "ring").agg(F.min("far").alias("low"), F.max("far").alias("high")), "rings")
    d = F.col("d")[F.col("pivot")]
    near: Column = F.greatest(d - F.col("high"), F.col("low") - d) <= math.sqrt(2 * max_distance) + SLACK
    visiting = kept(queries.join(cells, "key").where(near).drop("d", "low", "high"), "visits")
    return meet(visiting, rows, ["key", "pivot", "ring"], k, max_distance, compared)
