"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, components.

Equal fingerprints are one class. Two fingerprints at most ``radius`` bits apart agree in at least ``b - radius`` of
``b`` blocks of bits, so every choice of that many blocks is a table, and close classes share a key in one of them. The
number of blocks follows from the number of classes, so that chance meetings stay below one a class at any size; the
result does not depend on it. The sum that counts a bucket also tells the distance of a bucket of two; in a larger one
all distances are verified, and links that span the components leave, not every pair. Buckets over ``TILE`` classes are cut into chunks, and each pair of chunks is a task's group of
its own: no group grows without bound, no link is lost.

Edge cases: a text without words (null, empty, blank) has fingerprint 0 and links like any other; fewer words than a
shingle make one shingle; a null doc_id keeps its fingerprint and takes part in no link; repeated rows repeat.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, id_and_text, map_batches, read_documents, released, stored, text_key

SHINGLE, RADIUS, SEED, TILE = 3, 3, 42, 2000


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, repeats included; of all words if they are fewer."""
    flat, n = b" ".join(words), max(len(words) - shingle + 1, 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[: n - 1]].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65_536):
        ones += np.unpackbits(h[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def words_of(text: str) -> list[bytes]:
    """Words end at ASCII white space; A-Z are lower-cased."""
    return text.encode().lower().split()


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text."""
    words = words_of(text)
    return majority(shingle_hashes(words, shingle)) if words else 0


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, x: key of the text, fp bigint: the fingerprint's 64 bits as a signed number)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        # the words of one text at a time: those of a batch would be large
        fp = np.array([fingerprint(text, shingle) for text in batch.column(1).to_pylist()], dtype=np.uint64)
        return pa.record_batch([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], ["doc_id", "x", "fp"])

    return map_batches(id_and_text(docs).select("doc_id", "text", text_key().alias("x")), "doc_id bigint, x binary, fp bigint", run)


def blocks_for(classes: int, radius: int) -> int:
    """The fewest blocks for which a class meets few others by chance, 13 at most."""
    return next((b for b in range(radius + 1, 13) if classes * comb(b, b - radius) / 2.0 ** (64 * (b - radius) / b) < 16), 13)


def block_masks(blocks: int, radius: int) -> list[int]:
    """Masks of the blocks that must agree, one for each table, as signed 64-bit numbers."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [m - (1 << 64) if (m := sum(c)) >= 1 << 63 else m for c in combinations(parts, blocks - radius)]


def spanning_links(fp: np.ndarray, rep: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that span the components of the graph that joins fingerprints at most ``radius`` bits apart, each such a pair.
    A tree grows from the smallest rep of its component, so that a dense group gives the same links in all tables."""
    links, left = [], np.argsort(rep, kind="stable")
    while len(left):
        found, done, left = [left[0]], 0, left[1:]
        while done < len(found) and len(left):
            i, done = found[done], done + 1
            near = np.bitwise_count(fp[left] ^ fp[i]) <= radius
            if near.any():
                found.extend(left[near].tolist())
                links.extend((int(rep[i]), r) for r in rep[left[near]].tolist())
                left = left[~near]
    return links


CELL = ["k", "m", "ci", "cj"]


def by_cell(cells: DataFrame, schema: str, work: Callable[[pa.Table, list[tuple[int, int]]], pa.RecordBatch]) -> DataFrame:
    """``work`` over tables of whole groups of CELL, with the bounds of the groups of two rows or more."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        key = np.stack([rows.column(c).to_numpy() for c in CELL])
        cut = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0), True]).tolist()
        return work(rows, [(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > 1])

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of a group that may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([*held, batch])
                key = np.stack([rows.column(c).to_numpy() for c in CELL])
                other = np.flatnonzero((key != key[:, -1:]).any(axis=0))
                at = int(other[-1]) + 1 if len(other) else 0
                held = rows.slice(at).to_batches()
                if at:
                    yield flush(rows.slice(0, at))
        if held:
            yield flush(pa.Table.from_batches(held))

    return cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(lambda batches: released(run(batches)), schema)


def bucket_links(cells: DataFrame, radius: int) -> DataFrame:
    """(a, b) links of each group of cells (CELL, fp, rep)."""

    def work(rows: pa.Table, groups: list[tuple[int, int]]) -> pa.RecordBatch:
        fp, rep = rows.column("fp").to_numpy().view(np.uint64), rows.column("rep").to_numpy()
        out = [x for a, b in groups for x in spanning_links(fp[a:b], rep[a:b], radius)]
        return pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return by_cell(cells, "a bigint, b bigint", work)


def near_links(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between the reps of classes (fp, rep) whose fingerprints differ in at most ``radius`` bits; their
    components are those of all such pairs."""
    masks = block_masks(blocks_for(classes.count(), radius), radius)
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("m", "k"))
    buckets = keyed.groupBy("k", "m").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    # two classes in a bucket are its least and largest: most met by chance, and leave here
    buckets = stored(buckets.where((F.col("n") > 2) | ((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius))), "buckets")
    zero = F.lit(0)
    pairs = buckets.where("n = 2").select("k", "m", zero.alias("ci"), zero.alias("cj"), F.explode(F.array("lo", "hi")).alias("fp"))
    # a bucket over the tile gets chunks by fingerprint
    keyed = keyed.join(buckets.where("n > 2").select("k", "m", F.ceil(F.col("n") / tile).cast("int").alias("c")), ["k", "m"])
    chunk = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    cells = keyed.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    cells = cells.select("k", "m", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "fp")
    return bucket_links(cells.unionByName(pairs).join(classes.select("fp", "rep"), "fp"), radius)


def groups_of(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, x, fp, component_id) of every row."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    classes = stored(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    linked = components(near_links(classes, radius))
    found = classes.join(linked, classes.rep == linked.id, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(found, "fp", "left").select("doc_id", "x", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    return groups_of(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir))
