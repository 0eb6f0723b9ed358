"""Importance resampling towards a target text: hashed n-gram features, Gumbel scores, an exact draw of the highest.

Weights: every feature falls into one of ``buckets``; a bucket's gain is the logarithm of its share in the target against
its share in the corpus. The gains are one array, by which a task scores the words of a whole text at once.

Draw: tasks write their documents as sorted runs (at most ``RUN_ROWS`` rows each, best first). Bounds from a sample of
keys cut all runs into ranges of about ``RANGE_ROWS`` rows, exact counts of which say where the draw ends. Only the ranges
before that point are shuffled, as blocks of the runs; the blocks of a range come to its task in the order of their first
keys, from Spark's external sort, and a k-way tournament tree merges those that are open. The last range stops at the
exact count. Ranks are the counts of the ranges before plus the position, so no task sees more than its ranges.

The sample decides the sizes of ranges and nothing else. A key is score, doc_id, run and place in the run; so rows that
repeat an id are split between ranges as well, and each gets a rank of its own. Edge cases: a null text has no words, the
weight 0 and is not eligible below ``least`` words; a null doc_id is hashed as empty and comes last of its score; an empty
target counts as 0 of every bucket; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, read_documents, released, stored

#: Words of a text before A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RUN_ROWS, RANGE_ROWS = 200_000, 20_000
#: Ranges grow instead once there are so many; their bounds come from 4 to 40 sampled keys a range.
MOST_RANGES, MOST_SAMPLED = 100_000, 400_000
HELD = 300_000  # buckets of words that a task remembers, features that it holds before it counts them
NO_ID = 2**63 - 1  # where a null doc_id sorts

RUNS = "run bigint, place bigint, doc_id bigint, n_features bigint, weight bigint, score bigint, eligible boolean"


class Buckets(dict):
    """Bucket of a run of words, remembered."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: str) -> int:
        if len(self) >= HELD:
            self.clear()
        self[feature] = at = zlib.crc32(feature.encode().lower()) % self.n  # bytes are lower-cased in A-Z only
        return at

    def of(self, text: str, longest: int) -> tuple[np.ndarray, int]:
        """Buckets of all features of a text, and its number of words."""
        words = WORD.findall(text)
        features: Iterable[str] = words
        if longest > 1:
            features = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return np.fromiter(map(self.__getitem__, features), np.int64), len(words)


def bucket_counts(rows: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts by bucket: ``buckets`` numbers, summed by tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, held, size = Buckets(buckets), np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(of.of(text, longest)[0])
                size += len(held[-1])
                if size >= HELD:
                    n += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        n += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=buckets)
        found = np.flatnonzero(n)
        yield pa.record_batch([pa.array(found, pa.int32()), pa.array(n[found], pa.int64())], ["bucket", "n"])

    part = rows.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(lambda b: released(run(b)), "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the corpus, one added to every count."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def luck(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of a document, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored_runs(docs: DataFrame, gains: np.ndarray, longest: int, least: int, seed: int, run_rows: int) -> DataFrame:
    """RUNS of every document: within a run by score, best first, then by doc_id."""

    def flush(held: list[tuple], run: int) -> pa.RecordBatch:
        held.sort(key=lambda r: (-r[3], NO_ID if r[0] is None else r[0]))
        doc_id, n, weight, score, eligible = zip(*held, strict=True)
        size = len(held)
        cols = [pa.array([run] * size, pa.int64()), pa.array(range(size), pa.int64()), *[pa.array(c, pa.int64()) for c in (doc_id, n, weight, score)], pa.array(eligible, pa.bool_())]
        return pa.record_batch(cols, ["run", "place", "doc_id", "n_features", "weight", "score", "eligible"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, number = Buckets(len(gains)), [], TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, words = of.of(text, longest)
                weight = int(gains[at].sum())
                held.append((doc_id, len(at), weight, weight + luck(doc_id, seed), words >= least))
                if len(held) >= run_rows:
                    yield flush(held, number)
                    held, number = [], number + 1
        if held:
            yield flush(held, number)

    return id_and_text(docs).mapInArrow(lambda b: released(run(b)), RUNS)


Key = tuple[int, int, int, int]


def keys_of(batch: pa.RecordBatch) -> list[Key]:
    """Keys in the order of the draw, of the columns doc_id, score, run, place."""
    doc_id, score, run, place = (batch.column(c).to_pylist() for c in ("doc_id", "score", "run", "place"))
    return [(-s, NO_ID if d is None else d, r, p) for d, s, r, p in zip(doc_id, score, run, place, strict=True)]


def range_bounds(runs: DataFrame, n: int, range_rows: int) -> list[Key]:
    """First keys of all ranges but the first: quantiles of a sample of eligible keys that a hash of their place chooses,
    about ``MOST_SAMPLED`` at most."""
    ranges = min(MOST_RANGES, math.ceil(n / range_rows))
    if ranges < 2:
        return []
    chance = min(1.0, min(MOST_SAMPLED, 40 * ranges) / n)
    lucky = F.pmod(F.xxhash64("run", "place"), F.lit(1 << 40)) < int(chance * (1 << 40))
    drawn = runs.where("eligible").where(lucky).select("doc_id", "score", "run", "place")
    keys = sorted(k for b in drawn.toArrow().to_batches() for k in keys_of(b))
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def blocks(runs: DataFrame, bounds: list[Key], upto: int | None) -> DataFrame:
    """Stretches of the eligible rows of a run that are in one range, with their first key; those of ranges to ``upto``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys = keys_of(batch)
        of = [bisect_right(bounds, k) for k in keys]
        starts = [i for i in range(len(keys)) if i == 0 or of[i] != of[i - 1] or keys[i][2] != keys[i - 1][2]]
        picked = [(a, b) for a, b in zip(starts, [*starts[1:], len(keys)], strict=True) if upto is None or of[a] <= upto]
        if not picked:
            return None
        take = pa.array([i for a, b in picked for i in range(a, b)], pa.int64())
        sizes = pa.array(np.cumsum([0] + [b - a for a, b in picked]), pa.int32())
        lists = [pa.ListArray.from_arrays(sizes, batch.column(c).take(take)) for c in ("doc_id", "n_features", "weight", "score", "run", "place")]
        heads = [pa.array([keys[a][i] for a, _ in picked], pa.int64()) for i in range(4)]
        return pa.record_batch([pa.array([of[a] for a, _ in picked], pa.int32()), *heads, *lists], [c.split()[0] for c in BLOCKS.split(", ")])

    rows = runs.where("eligible").select("doc_id", "n_features", "weight", "score", "run", "place")
    return map_batches(rows, BLOCKS, run)


BLOCKS = "range int, h0 bigint, h1 bigint, h2 bigint, h3 bigint, doc_id array<bigint>, n_features array<bigint>, weight array<bigint>, score array<bigint>, run array<bigint>, place array<bigint>"
DRAWN = "doc_id bigint, n_features bigint, weight bigint, score bigint, run bigint, place bigint, rank bigint"


class Tournament:
    """A k-way merge of sorted streams of (key, row). Leaves hold the head of each open stream; every inner node names the
    leaf that wins below it, so that taking a row replays one path. An ended stream frees its leaf; a full tree doubles."""

    def __init__(self):
        self.size = 1
        self.streams, self.heads, self.winner, self.free = [iter(())], [None], [0], [0]

    def replay(self, leaf: int) -> None:
        node = (leaf + self.size) // 2
        while node:
            a, b = (n - self.size if n >= self.size else self.winner[n] for n in (2 * node, 2 * node + 1))
            x, y = self.heads[a], self.heads[b]
            self.winner[node] = a if y is None or (x is not None and x < y) else b
            node //= 2

    def advance(self, leaf: int) -> None:
        self.heads[leaf] = next(self.streams[leaf], None)
        if self.heads[leaf] is None:
            self.free.append(leaf)
        self.replay(leaf)

    def open(self, stream: Iterator[tuple[Key, tuple]]) -> None:
        if not self.free:
            self.free = list(range(self.size, 2 * self.size))
            self.streams += [iter(())] * self.size
            self.heads += [None] * self.size
            self.size *= 2
            self.winner = [0] * self.size
            for leaf in range(0, self.size, 2):
                self.replay(leaf)
        leaf = self.free.pop()
        self.streams[leaf] = stream
        self.advance(leaf)

    def best(self) -> int:
        return self.winner[1] if self.size > 1 else 0

    def first(self) -> Key | None:
        """The least key of all open streams."""
        head = self.heads[self.best()]
        return head and head[0]

    def take(self) -> tuple:
        leaf = self.best()
        row = self.heads[leaf][1]
        self.advance(leaf)
        return row


def merged(blocks_in_order: Iterator[tuple[Key, Iterator[tuple[Key, tuple]]]]) -> Iterator[tuple]:
    """Rows of all blocks in order of their keys. Blocks come by their first key, and each is opened when it is its turn,
    so that no more are held than overlap."""
    tree, waiting = Tournament(), next(blocks_in_order, None)
    while waiting or tree.first() is not None:
        while waiting and (tree.first() is None or waiting[0] < tree.first()):
            tree.open(waiting[1])
            waiting = next(blocks_in_order, None)
        yield tree.take()


def stream(row: dict) -> tuple[Key, Iterator[tuple[Key, tuple]]]:
    """A block as its first key and its rows with their keys."""
    parts = zip(row["doc_id"], row["n_features"], row["weight"], row["score"], row["run"], row["place"], strict=True)
    return (row["h0"], row["h1"], row["h2"], row["h3"]), (((-p[3], NO_ID if p[0] is None else p[0], p[4], p[5]), p) for p in parts)


def drawn_rows(parts: DataFrame, before: dict[int, int], draw: int) -> DataFrame:
    """DRAWN of the blocks: each range merged in one task, from the rank after what is ``before`` it, up to rank ``draw``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def out(held: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in DRAWN.split(", ")]
        return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, held = rows(batches), []
        row = next(source, None)
        while row:
            at, rank = row["range"], before[row["range"]]

            def of_range(first=row, at=at):
                nonlocal row
                row = first
                while row and row["range"] == at:
                    yield stream(row)
                    row = next(source, None)

            for got in merged(of_range()):
                if rank >= draw:
                    break
                rank += 1
                held.append((*got, rank))
                if len(held) >= 10_000:
                    yield out(held)
                    held = []
            while row and row["range"] == at:  # the draw has ended within this range
                row = next(source, None)
        if held:
            yield out(held)

    dealt = parts.repartition(max(1, len(before)), "range").sortWithinPartitions("range", "h0", "h1", "h2", "h3")
    return dealt.mapInArrow(lambda b: released(run(b)), DRAWN)


def resample(docs: DataFrame, target: DataFrame, buckets: int, longest: int, least: int, percent: int, seed: int, run_rows: int = RUN_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text): of the rows with at least ``least``
    words, floor(percent / 100) get ranks 1, 2, 3... by score. ``target`` has a column text."""
    gains = gains_of(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    runs = stored(scored_runs(docs, gains, longest, least, seed, run_rows), "runs")
    n = runs.where("eligible").count()
    draw = percent * n // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not draw:
        return runs.select(*columns, F.lit(None).cast("bigint").alias("rank"))
    bounds = range_bounds(runs, n, range_rows)
    counts = {0: n}
    if bounds:
        counts = {r["range"]: r["n"] for r in blocks(runs, bounds, None).groupBy("range").agg(F.sum(F.size("run")).alias("n")).collect()}
    before, total, upto = {}, 0, 0
    for at in sorted(counts):
        if total >= draw:
            break
        before[at], upto = total, at
        total += counts[at]
    ranked = stored(drawn_rows(blocks(runs, bounds, upto), before, draw), "drawn")
    last = ranked.where(F.col("rank") == draw).first()
    # the others: what is not eligible, and what comes after the last drawn key
    d, cut = F.coalesce("doc_id", F.lit(NO_ID)), NO_ID if last["doc_id"] is None else last["doc_id"]
    key = [(-F.col("score"), -last["score"]), (d, cut), (F.col("run"), last["run"]), (F.col("place"), last["place"])]
    after, same = F.lit(False), F.lit(True)
    for column, value in key:
        after, same = after | (same & (column > F.lit(value))), same & (column == F.lit(value))
    rest = runs.where(~F.col("eligible") | after).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*columns, "rank").unionByName(rest)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), buckets=10_000, longest=1, least=20, percent=10, seed=2024)
