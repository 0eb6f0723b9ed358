"""Repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts elsewhere is removed.

1. Each start of a string belongs to one q-gram: the smallest-hashed q-gram inside the string (leftmost on ties). Equal
   strings have it at the same offset, so equal strings meet in the initial bucket of that q-gram. Starts in a row with
   the same q-gram occurrence make one record (bucket, hash of the bytes they span, place), about one in 75 bytes.
2. Buckets of one record are unique and leave. Records of a bucket that span the same bytes repeat as a whole.
3. Other records of a bucket are compared by bucket-pointer refinement: starts are sorted into buckets of 8 bytes, and a
   bucket of depth d is refined by sorting on the bucket identifiers d bytes later, whose updates each round reuses,
   until depth ``LENGTH``; buckets of one start leave in between. Strings are compared to the last byte.
4. Buckets of over ``TILE`` different records are split: each of their strings is counted by its 128-bit hash, summed on
   the map side, so that no bucket has to meet in one task.

Matches do not cross documents; the same document counts as elsewhere. Edge cases: null and empty texts, and texts
shorter than ``LENGTH`` bytes, lose nothing; repeated rows repeat each other; the key of a row is its doc_id and 128 bits
of its text, so a repeated or null doc_id does no harm; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, read_documents, stored, text_key

LENGTH, GRAM, TILE = 200, 48, 8192
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK, POSITION_BITS = 500_000, np.uint64(20)
BUFFER = 1_500_000


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


POWERS, INVERSES = powers(BASE, CHUNK + 2 * LENGTH), powers(BASE_INVERSE, CHUNK + 2 * LENGTH)


def records(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first start << 16 | further starts << 8 | offset of the q-gram) of a text's records, and their hashes."""
    buckets, places, hashes = [], [], []
    width = length - gram + 1
    for base in range(0, max(len(data) - length + 1, 0), CHUNK):
        part = np.frombuffer(data, dtype=np.uint8)[base : base + CHUNK + length - 1]
        n = len(part)
        if n < length:
            break
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(part.astype(np.uint64) * POWERS[:n] + POWERS[:n], out=prefix[1:])
        h = (prefix[gram:] - prefix[:-gram]) * INVERSES[: n - gram + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = ((h >> POSITION_BITS) << POSITION_BITS) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < width:
            low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
        at = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], len(at)] - 1
        at = at[first]
        buckets.append(h[at].view(np.int64))
        places.append(((first + base) << 16) | ((last - first) << 8) | (at - first))
        hash_of = xxhash.xxh3_64_intdigest
        hashes.append(np.fromiter((hash_of(data[a : b + length], o) for a, b, o in zip((first + base).tolist(), (last + base).tolist(), (at - first).tolist(), strict=True)), np.uint64, len(at)).view(np.int64))
    if not buckets:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(buckets), np.concatenate(places), np.concatenate(hashes)


def refine(data: np.ndarray, room: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket-pointer refinement. data: bytes of all records; room: bytes from each position to its record's end.
    Returns an identifier for each position: equal for two positions with ``room`` for ``length`` bytes exactly if those
    bytes are equal; negative and different for positions without room or with no equal."""
    n, q = len(data), 8
    wide = np.zeros(n, dtype=np.uint64)
    padded = np.r_[data, np.zeros(q, np.uint8)].astype(np.uint64)
    for k in range(q):
        wide = (wide << np.uint64(8)) | padded[k : k + n]
    ids = -1 - np.arange(n, dtype=np.int64)
    depth, live, key = q, np.flatnonzero(room >= q), None
    key = wide[live]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        size = np.diff(np.r_[np.flatnonzero(new), len(ordered)])
        alone = np.repeat(size == 1, size)
        ids = -1 - np.arange(n, dtype=np.int64)
        ids[live[order]] = np.where(alone, -1 - live[order], np.cumsum(new) - 1)
        live = np.sort(live[order[~alone]])
        if depth >= length or not len(live):
            return ids
        step = min(depth, length - depth)
        live = live[room[live] >= depth + step]
        key = ids[live].astype(np.int64) * np.int64(2 * n + 2) + (ids[live + step] + np.int64(n + 1))
        depth += step


def repeats(rows: list[tuple[int, int, int, bytes]], length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """(bucket, hash, first, last) runs of repeated starts in records (bucket, hash, copies, bytes), different ones."""
    data = np.frombuffer(b"".join([r[3] for r in rows]), dtype=np.uint8)
    size = np.fromiter((len(r[3]) for r in rows), np.int64, len(rows))
    ends = np.cumsum(size)
    room = np.repeat(ends, size) - np.arange(len(data))
    twice = refine(data, room, length) >= 0
    twice &= room >= length
    edge = np.diff(np.r_[False, twice, False].astype(np.int8))
    out = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True):
        i = int(np.searchsorted(ends, a, side="right"))
        while a <= b:  # a run may go on in the next record
            begin, end = int(ends[i] - size[i]), int(ends[i])
            if rows[i][2] == 1:
                out.append((rows[i][0], rows[i][1], a - begin, min(b, end - 1) - begin))
            a, i = end, i + 1
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """(d, x, doc_id, text): d and x name a row's document and text."""
    return id_and_text(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), text_key().alias("x"), "doc_id", "text")


def repeated_places(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, tile: int = TILE) -> DataFrame:
    """(d, x, spans array of first byte << 16 | bytes) of the documents with repeated strings."""

    def find(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [records(t.encode(), length, gram) for t in batch.column(2).to_pylist()]
        n = [len(g[0]) for g in got]
        row = pa.array(np.repeat(np.arange(len(n)), n))
        cols = [pa.array(np.concatenate([g[i] for g in got])) for i in range(3)]
        return pa.record_batch([cols[0], cols[2], batch.column(0).take(row), batch.column(1).take(row), cols[1]], ["h", "c", "d", "x", "place"])

    texts = keyed(docs)
    every = stored(map_batches(texts.select("d", "x", "text"), "h bigint, c bigint, d bigint, x binary, place bigint", find), "records")
    shared = every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    shared = stored(shared, "shared")  # a table of its own, so that the join can split a q-gram that very many records have
    every = stored(every.join(shared, "h"), "shared-records")
    groups = every.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("d", "x", "place")).alias("at"))
    groups = stored(groups.select("h", "c", "n", "at.d", "at.x", "at.place"), "groups")
    mixed = stored(groups.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "kinds")
    mixed = stored(groups.join(mixed, "h").select("h", "c", F.least("n", F.lit(2)).cast("int").alias("n"), "d", "x", "place", (F.col("kinds") > tile).alias("large")), "mixed")
    want = mixed.groupBy("d", "x").agg(F.collect_list(F.struct("h", "c", "n", "place", "large")).alias("want"))

    def spans_of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = text.encode()
            for w in want:
                at, more, off = w["place"] >> 16, (w["place"] >> 8) & 255, w["place"] & 255
                if not w["large"]:
                    out.append((w["h"], w["c"], w["n"], 0, None, raw[at : at + more + length]))
                else:
                    out += [(w["h"], w["c"], w["n"], i, xxhash.xxh3_128_digest(raw[at + i : at + i + length], off - i + 1000), None) for i in range(more + 1)]
        return pa.record_batch([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.int32()), pa.array([r[4] for r in out], pa.binary()), pa.array([r[5] for r in out], pa.binary())], ["h", "c", "n", "i", "w", "span"])

    spans = texts.select("d", "x", "text").join(want, ["d", "x"]).select("text", "want")
    spans = stored(map_batches(spans, "h bigint, c bigint, n int, i int, w binary, span binary", spans_of), "spans")

    def compare(batches):
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush():
            runs = repeats(held, length)
            return pa.record_batch([pa.array([r[i] for r in runs], pa.int64()) for i in range(4)], ["h", "c", "first", "last"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and size >= BUFFER and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                if held and row[:2] == held[-1][:2]:
                    continue  # the same record, found in a repeated row
                held.append(row)
                size += len(row[3])
        if held:
            yield flush()

    small = spans.where("span is not null").select("h", "c", "n", "span").repartition("h").sortWithinPartitions("h", "c")
    small = small.mapInArrow(compare, "h bigint, c bigint, first bigint, last bigint")
    strings = spans.where("w is not null").select("h", "c", "n", "i", "w").distinct()
    twice = strings.groupBy("w").agg(F.sum("n").alias("m")).where("m > 1").select("w")
    large = strings.where("n = 1").join(twice, "w").select("h", "c", F.col("i").cast("bigint").alias("first"), F.col("i").cast("bigint").alias("last"))
    # copies of a record repeat from its first to its last start; the others as far as the comparison says
    start, more = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    whole = groups.where("n > 1").select("h", "c", F.lit(0).cast("bigint").alias("first"), F.lit(-1).cast("bigint").alias("last"))
    runs = whole.unionByName(small).unionByName(large)
    found = every.join(runs, ["h", "c"])
    first, size = start + F.col("first"), F.when(F.col("last") < 0, more).otherwise(F.col("last") - F.col("first")) + length
    return found.select("d", "x", (F.shiftleft(first, 16) + size).alias("span")).groupBy("d", "x").agg(F.collect_list("span").alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, tile: int = TILE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw, kept, at, n_spans = text.encode(), [], 0, 0
            for s in sorted(spans or ()):
                first, end = s >> 16, (s >> 16) + (s & 0xFFFF)
                if first > at or not n_spans:
                    kept.append(raw[at:first])
                    n_spans += 1
                at = max(at, end)
            kept.append(raw[at:])
            kept = b"".join(kept)
            out.append((len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()))
        return pa.record_batch([batch.column(0), *(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = keyed(docs).join(repeated_places(docs, length, gram, tile), ["d", "x"], "left").select("doc_id", "text", "spans")
    return map_batches(joined, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", run)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir))
