"""Near duplicates by the Jaccard coefficient of five-word shingle sets: candidates from SimHash blocks, then from MinHash
bands, exact verification.

Texts of equal sets are one class. First the SimHash operator works on the five-word fingerprints of the classes: its
pigeonhole blocks give all pairs at most ``RADIUS`` bits apart, as links that span their components, and the exact
coefficient verifies these. A coefficient of 0.8 means about 10 of 64 bits, so pairs lie beyond; bands find those that are
not in one component by then. A pair of coefficient j shares one of ``BANDS`` bands of ``ROWS`` minima with the
probability 1 - (1 - j^ROWS)^BANDS, whatever the size of the table: at 0.8 a pair is missed with 1.3e-7, above it with
less. In a bucket the members of other components are verified against the smallest one first; then, in buckets that still
hold several components, all members meet in a task, which counts the shingles that each two share by matrix products and passes on
links that span the components, not the pairs. A bucket over ``TILE`` members is cut into chunks, each pair of which is a
cell of its own, so no group grows without bound and no link is lost. Buckets of the same members are one.

Edge cases: texts without words are one class; fewer words than a shingle make one shingle; a null doc_id takes part in
no link; repeated rows repeat; shingles are their 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import components, id_and_text, map_batches, stored, text_key
from .simhash import by_cell, majority, shingle_hashes, words_of

SHINGLE, BANDS, ROWS = 5, 40, 5
#: Members of a bucket that meet in one task, and shingles that a matrix product takes at once.
TILE, COLUMNS = 1000, 4096
MULTIPLIERS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def hashes_of(text: str) -> np.ndarray:
    """The hashes of all shingles, repeats included; none if there is no word."""
    words = words_of(text)
    return shingle_hashes(words, SHINGLE) if words else np.zeros(0, dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """Distinct shingle hashes in ascending order."""
    return np.unique(hashes_of(text))


def class_of(found: np.ndarray) -> int:
    """64 signed bits that stand for a set."""
    return xxhash.xxh64_intdigest(found.tobytes(), 7) - 2**63


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for k in range(0, len(found), 512):
        x = found[k : k + 512, None] * MULTIPLIERS
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * MIX
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def prints_of(docs: DataFrame) -> DataFrame:
    """(doc_id, x: key of the text, c: class, fp: its five-word SimHash, bands)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, fp, keys = [], [], []
        for text in batch.column(1).to_pylist():
            h = hashes_of(text)
            found = np.unique(h)
            c.append(class_of(found))
            fp.append(majority(h))
            keys.append(band_keys(found))
        bands = pa.ListArray.from_arrays(np.arange(len(c) + 1, dtype=np.int32) * BANDS, pa.array(np.concatenate(keys)))
        prints = pa.array(np.array(fp, dtype=np.uint64).view(np.int64))
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(c, pa.int64()), prints, bands], ["doc_id", "x", "c", "fp", "bands"])

    return map_batches(id_and_text(docs).select("doc_id", "text", text_key().alias("x")), "doc_id bigint, x binary, c bigint, fp bigint, bands array<bigint>", run)


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, s: sorted shingle hashes) of the classes that ``wanted`` (doc_id, x) names a text of."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.record_batch([pa.array([class_of(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))], ["c", "s"])

    texts = id_and_text(docs).withColumn("x", text_key()).join(wanted, ["doc_id", "x"]).select("text")
    return map_batches(texts, "c bigint, s array<bigint>", run).dropDuplicates(["c"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a coefficient of 0.8 or more."""
    met = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    small, both = F.least(F.size("sa"), F.size("sb")), F.size("sa") + F.size("sb")
    return met.where(9 * small >= 4 * both).where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * both).select("a", "b")


def spanning_pairs(values: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j) of sets at 0.8 or more that span the components of all such pairs. values: the shingles of all sets;
    ends: where each set ends."""
    size = np.diff(np.r_[0, ends])
    n = len(size)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(values, kind="stable")
    new = np.r_[True, np.diff(values[order]) != 0][: len(order)]
    times = np.diff(np.r_[np.flatnonzero(new), len(order)])
    shared = np.repeat(times > 1, times)  # a shingle of one set is in no intersection
    row, column = row[order][shared], (np.cumsum(np.repeat(times > 1, times) & new) - 1)[shared]
    both = np.zeros((n, n), dtype=np.float32)
    for base in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (base, base + COLUMNS))
        m = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - base)), dtype=np.float32)
        m[row[a:b], column[a:b] - base] = 1
        both += m @ m.T
    near = 9 * both.astype(np.int64) >= 4 * (size[:, None] + size)
    links, left = [], np.ones(n, dtype=bool)
    for first in range(n):
        found = [first] if left[first] else []
        left[first] = False
        for i in found:
            more = np.flatnonzero(near[i] & left)
            left[more] = False
            found.extend(more.tolist())
            links.extend((i, j) for j in more.tolist())
    return links


def cell_links(cells: DataFrame) -> DataFrame:
    """(a, b) links of each cell of rows (CELL, c, s)."""

    def work(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.RecordBatch:
        c, s, out = rows.column("c").to_numpy(), rows.column("s").combine_chunks(), []
        values, edge = s.values.to_numpy(), s.offsets.to_numpy()
        for a, b in groups:
            out += [(int(c[a + i]), int(c[a + j])) for i, j in spanning_pairs(values[edge[a] : edge[b]], edge[a + 1 : b + 1] - edge[a])]
        return pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return by_cell(cells, "a bigint, b bigint", work)


def hashed_pairs(classes: DataFrame) -> DataFrame:
    """(a, b) pairs of classes (c, fp) that the SimHash operator links: of one fingerprint, or near by its blocks."""
    prints = stored(classes.groupBy("fp").agg(F.min("c").alias("rep")), "fingerprints")
    equal = classes.join(prints, "fp").where("c <> rep").select(F.col("rep").alias("a"), F.col("c").alias("b"))
    return equal.union(simhash.near_links(prints).distinct())


def near_links(docs: DataFrame, classes: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, b) links between classes (c, doc_id, x, fp, bands) that span the components of the pairs at 0.8 or more."""
    hashed = stored(hashed_pairs(classes), "hashed")
    keyed = classes.select("c", F.explode("bands").alias("k"))
    buckets = keyed.groupBy("k").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.bit_xor(F.xxhash64("c")).alias("all")).where("n > 1")
    buckets = stored(buckets.groupBy("n", "lo", "hi", "all").agg(F.min("k").alias("k")), "buckets")
    members = stored(keyed.join(buckets.where("n > 2").select("k", "n", "lo"), "k").select("k", "n", "lo", "c"), "members")
    pairs = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    pairs = stored(pairs.union(members.where("c <> lo").select(F.col("lo").alias("a"), F.col("c").alias("b"))).distinct(), "pairs")
    wanted = pairs.union(hashed).select(F.explode(F.array("a", "b")).alias("c")).distinct()
    sets = stored(sets_of(docs, classes.join(wanted, "c").select("doc_id", "x").distinct()), "sets")
    links = stored(verified(hashed, sets), "links")
    part = components(links)
    for side in ("a", "b"):
        pairs = pairs.join(part.select(F.col("id").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
    pairs = pairs.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    links = links.union(stored(verified(pairs, sets), "links"))
    found = components(links)
    part = stored(members.join(found.withColumnRenamed("id", "c"), "c", "left").select("k", "n", "c", F.coalesce("component", "c").alias("part")), "parts")
    open_ = stored(part.groupBy("k").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q").select("k"), "open")
    left = part.join(open_, "k").withColumn("of", F.ceil(F.col("n") / tile).cast("int"))
    left = left.withColumn("chunk", F.pmod(F.xxhash64("c"), F.col("of")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    cells = left.select("k", F.lit(0).alias("m"), F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "c")
    return links.union(cell_links(cells.join(sets, "c")))


def near_groups(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """(doc_id, x, component_id: the smallest doc_id of the group) of every row."""
    prints = stored(prints_of(docs), "prints")
    classes = stored(prints.where("doc_id is not null").groupBy("c").agg(F.min_by(F.struct("doc_id", "x"), F.struct("doc_id", "x")).alias("d"), F.min("fp").alias("fp"), F.first("bands").alias("bands")).select("c", "d.doc_id", "d.x", "fp", "bands"), "classes")
    found = components(near_links(docs, classes, tile))
    named = classes.select("c", "doc_id").join(found.withColumnRenamed("id", "c"), "c")
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    grouped = found.join(least, "component").select(F.col("id").alias("c"), "component_id")
    named = classes.select("c", "doc_id").join(grouped, "c", "left").select("c", F.coalesce("component_id", "doc_id").alias("component_id"))
    return prints.join(named, "c", "left").select("doc_id", "x", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
