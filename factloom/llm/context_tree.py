"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A document is its words (A-Z lower-cased), each closed by a space, and an end, a line feed. Each byte is eight binary
decisions; its context is the ``DEPTH`` bytes before it, spaces before the first. Every context of every depth has a
Krichevsky-Trofimov estimate for each binary node, and the weighting mixes the estimates of all depths: a node's weight
is its block probability against the product of its subtrees'. A context that was never seen leaves its share to the
longest that was.

Spark sums the counts of (context, byte) over all documents into one table, and the tree stays a table: contexts that
share their latest ``STEM`` bytes are a subtree of at most 256^3 pairs, and whole subtrees meet in a task, which weighs
them from the greatest depth upwards. Only the top of the tree (contexts of under ``STEM`` bytes, so at most 65,536 of
255 nodes, whatever the corpus) is gathered and shared; with it each subtree is spread downwards, and every distinct
(context, byte) of the corpus gets its log probability in a table. All contexts of all depths count, at any size.
Documents are scored where they are: the most frequent pairs (at most ``FREQUENT_PAIRS``) and words (at most ``FREQUENT``)
are shared with every task; the others of a document meet their table in a join, where no key is hot.

Edge cases: a null or empty text is one end token; a null doc_id is no held-out row, so it is learnt from; repeated rows
are learnt from each; without training rows every decision has probability 1/2, and the base score is that of N = V = 0;
texts of any length count whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, least_frequent, map_batches, read_documents, stored

DEPTH, STEM, FREQUENT, FREQUENT_PAIRS = 6, 3, 100_000, 3_000_000  # a pair takes 16 bytes: 48 MB at most
HELD = 300_000  # distinct words that a task sums before it passes them on
PAIRS_A_TASK = 200_000
SLICE = 1_000_000  # bytes handled at once


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """(w binary, c: occurrences in training rows, a: in all rows) of every distinct word."""

    def run(batches):
        learnt, other = Counter(), Counter()

        def flush():
            words = list(learnt.keys() | other.keys())
            out = pa.record_batch([pa.array(words, pa.binary()), pa.array([learnt[w] for w in words], pa.int64()), pa.array([learnt[w] + other[w] for w in words], pa.int64())], ["w", "c", "a"])
            learnt.clear()
            other.clear()
            return out

        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (other if held else learnt).update(text.encode().lower().split())
                if len(learnt) + len(other) > HELD:
                    yield flush()
        if learnt or other:
            yield flush()

    found = docs.select("text", "held_out").mapInArrow(run, "w binary, c bigint, a bigint")
    return found.groupBy("w").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))


def normal_bytes(text: str) -> bytes:
    words = text.encode().lower().split()
    return b" ".join([*words, b"\n"])


def pairs_of(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(context << 8 | byte for every byte of the texts, the context's latest byte lowest; bytes of each text)."""
    flat = np.frombuffer(b"".join([b" " * depth + t for t in texts]), dtype=np.uint8).astype(np.int64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    key = np.zeros(len(flat), dtype=np.int64)
    for d in range(depth, -1, -1):
        key <<= 8
        key[d:] |= flat[: len(flat) - d]
    inside = np.ones(len(flat), dtype=bool)  # without the blanks put before each text
    inside[((np.cumsum(size + depth) - size - depth)[:, None] + np.arange(depth)).ravel()] = False
    return key[inside] & ((1 << 8 * (depth + 1)) - 1), size


def text_bits(depth: int) -> int:
    """Bits of a 63-bit number that are left beside a pair for the number of its text."""
    return min(14, 63 - 8 * (depth + 1))


def sliced(texts: list[bytes], depth: int):
    """Runs of texts of about SLICE bytes, at most as many texts as text_bits() can number."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < SLICE and end - at < 1 << text_bits(depth):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[start], np.add.reduceat(counts[order], start)


def pair_counts(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(k: context << 8 | byte, n: times in training rows, a: in all rows) over the rows (text, held_out)."""

    def run(batches):
        keys, learnt, every, size = [], [], [], 0

        def merge():
            nonlocal keys, learnt, every, size
            order = np.argsort(k := np.concatenate(keys), kind="stable")
            k = k[order]
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            keys, learnt, every = [k[start]], *([np.add.reduceat(np.concatenate(x)[order], start)] for x in (learnt, every))
            size = len(start)

        def merged():
            nonlocal keys, learnt, every, size
            merge()
            k, n, a = keys[0], learnt[0], every[0]
            keys, learnt, every, size = [], [], [], 0
            for i in range(0, len(k), 50_000):
                yield pa.record_batch([pa.array(x[i : i + 50_000]) for x in (k, n, a)], ["k", "n", "a"])

        for batch in batches:
            held = np.array(batch.column(1).to_pylist(), dtype=bool)
            texts = batch.column(0).to_pylist()
            for part in (held, ~held):
                for some in sliced([normal_bytes(texts[i]) for i in np.flatnonzero(part)], depth):
                    k = np.sort(pairs_of(some, depth)[0])
                    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                    times = np.diff(np.r_[start, len(k)])
                    keys.append(k[start])
                    every.append(times)
                    learnt.append(times if part is not held else np.zeros_like(times))
                    size += len(start)
                    if size > 3_000_000:
                        merge()
                        if size > 2_000_000:
                            yield from merged()
        if size:
            yield from merged()

    found = rows.select("text", "held_out").mapInArrow(run, "k bigint, n bigint, a bigint")
    return found.groupBy("k").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    for k in range(0, len(x), 100_000):
        v = x[k : k + 100_000]
        y = v + 7
        out[k : k + 100_000] = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(v * (v + 1) * (v + 2)) - np.log((v + 3) * (v + 4) * (v + 5) * (v + 6))
    return out


def node_counts(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node: context << 8 | 1 and the bits so far, zeros, ones), ascending, of pairs (context << 8 | byte)."""
    keys, zeros, ones = [], [], []
    byte = pairs & 255
    for b in range(8):
        k, n = summed((((pairs - byte) | (1 << b) | (byte >> (8 - b))) << 1) | ((byte >> (7 - b)) & 1), counts)
        node = k >> 1
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]][: len(node)])
        keys.append(node[start])
        zeros.append(np.add.reduceat(np.where(k & 1, 0, n), start))
        ones.append(np.add.reduceat(np.where(k & 1, n, 0), start))
    keys, zeros, ones = np.concatenate(keys), np.concatenate(zeros), np.concatenate(ones)
    order = np.argsort(keys)
    return keys[order], zeros[order], ones[order]


def lookup(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the ascending ``known``, and whether they hold what is wanted."""
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


class ContextTree:
    """Levels of the tree. ``nodes[d]``: context of d bytes << 8 | 1 and the bits so far, ascending, with the counts of
    zeros and ones; ``weight[d]``: log of the weighted probability; ``one[d]``: the probability that the next bit is 1
    where this node is the deepest that is known. ``below``: for the deepest level, the sum of the log weights of what
    lies under each node; without it nothing does."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], below: np.ndarray | None = None):
        self.nodes, self.counts = {d: x[0] for d, x in levels.items()}, {d: x[1:] for d, x in levels.items()}
        self.share, self.weight, self.up, self.one = {}, {}, {}, {}
        for d in sorted(levels, reverse=True):
            n0, n1 = (x.astype(float) for x in self.counts[d])
            block = log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1)
            if d + 1 in levels:
                below = np.bincount(self.up[d + 1], weights=self.weight[d + 1], minlength=len(block))
            self.share[d] = np.ones(len(block)) if below is None else 1 / (1 + np.exp(-np.clip(block - below, -700, 700)))
            self.weight[d] = block if below is None else np.log(0.5) + np.logaddexp(block, below)
            if d - 1 in levels:
                self.up[d] = np.searchsorted(self.nodes[d - 1], self.nodes[d] & ((1 << 8 * d) - 1))

    @staticmethod
    def of_pairs(pairs: np.ndarray, counts: np.ndarray, depth: int, stem: int = 0) -> ContextTree:
        """The levels from ``stem`` to ``depth`` of pairs (context << 8 | byte)."""
        return ContextTree({d: node_counts(*summed(pairs & ((1 << 8 * (d + 1)) - 1), counts)) for d in range(stem, depth + 1)})

    def spread(self, mixed: np.ndarray | None = None, left: np.ndarray | None = None) -> ContextTree:
        """Predictions, from the shallowest level down. mixed, left: what its nodes get from above, and the share of it that
        is still to be given."""
        for d in sorted(self.nodes):
            if d in self.up:
                mixed, left = self.mixed[self.up[d]], self.left[self.up[d]]
            elif mixed is None:
                mixed, left = np.zeros(len(self.nodes[d])), np.ones(len(self.nodes[d]))
            n0, n1 = self.counts[d]
            estimate = (n1 + 0.5) / (n0 + n1 + 1.0)
            self.one[d] = mixed + left * estimate
            self.mixed, self.left = mixed + left * self.share[d] * estimate, left * (1 - self.share[d])
        return self

    def walk(self, pairs: np.ndarray, top: ContextTree | None = None) -> np.ndarray:
        """log10 probability of the byte of each pair after its context, bit by bit. top: the levels above this tree's."""
        byte, total = pairs & 255, np.zeros(len(pairs))
        nodes, one = (self.nodes, self.one) if top is None else (top.nodes | self.nodes, top.one | self.one)
        for b in range(8):
            prefix, bit = (1 << b) | (byte >> (8 - b)), (byte >> (7 - b)) & 1
            p, left = np.full(len(pairs), 0.5), np.arange(len(pairs))
            for d in sorted(nodes, reverse=True):
                at, hit = lookup(nodes[d], ((pairs[left] >> 8 & ((1 << 8 * d) - 1)) << 8) | prefix[left])
                p[left[hit]] = one[d][at[hit]]
                left = left[~hit]
            total += np.log10(np.where(bit == 1, p, 1 - p))
        return total


def gathered(batches) -> tuple[np.ndarray, np.ndarray]:
    """(k, n) of a task's pairs, ascending."""
    k, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        k.append(batch.column(0).to_numpy())
        n.append(batch.column(1).to_numpy())
    k, n = np.concatenate(k), np.concatenate(n)
    order = np.argsort(k)
    return k[order], n[order]


def top_of(dealt: DataFrame, depth: int, stem: int) -> ContextTree:
    """The levels of under ``stem`` bytes. dealt: (k, n), dealt by their latest ``stem`` bytes."""

    def roots(batches):
        k, n = gathered(batches)
        if len(k := k[n > 0]):
            tree = ContextTree.of_pairs(k, n[n > 0], depth, stem)
            nodes, (n0, n1), w = tree.nodes[stem], tree.counts[stem], tree.weight[stem]
            for i in range(0, len(nodes), 50_000):
                yield pa.record_batch([pa.array(x[i : i + 50_000].astype(kind)) for x, kind in ((nodes, np.int64), (n0, np.int64), (n1, np.int64), (w, float))], ["node", "n0", "n1", "w"])

    found = dealt.mapInArrow(roots, "node bigint, n0 bigint, n1 bigint, w double")
    up = F.col("node").bitwiseAND(F.lit((1 << 8 * stem) - 1))
    # at most 65,536 contexts of 255 nodes
    got = found.groupBy(up.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("w")).toArrow().sort_by("node")
    levels = {stem - 1: tuple(got[c].to_numpy() for c in ("node", "n0", "n1"))}
    for d in range(stem - 2, -1, -1):
        node, n0, n1 = levels[d + 1]
        own, at = np.unique(node & ((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels[d] = own, *(np.bincount(at, weights=x, minlength=len(own)).astype(np.int64) for x in (n0, n1))
    return ContextTree(levels, got["w"].to_numpy()).spread()


def pair_logs(pairs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(k, a, log: log10 probability of the byte after its context) of every pair of the stored table (k, n, a)."""
    stem = min(STEM, depth)
    parts = max(1, -(-pairs.count() // PAIRS_A_TASK))
    stem_of = F.shiftright("k", 8).bitwiseAND(F.lit((1 << 8 * stem) - 1))
    dealt = pairs.select("k", "n", "a").repartition(parts, stem_of)
    context = pairs.sparkSession.sparkContext
    top = context.broadcast(top_of(dealt, depth, stem) if stem else None)

    def logs(batches):
        every = [b for b in batches if b.num_rows]
        if every:
            k, n = gathered(every)
            a = np.concatenate([b.column(2).to_numpy() for b in every])[np.argsort(np.concatenate([b.column(0).to_numpy() for b in every]))]
            tree, above = ContextTree.of_pairs(k[n > 0], n[n > 0], depth, stem), top.value
            if above is None:
                tree.spread()
            else:
                at, _ = lookup(above.nodes[stem - 1], tree.nodes[stem] & ((1 << 8 * stem) - 1))
                tree.spread(above.mixed[at], above.left[at])
            for i in range(0, len(k), 50_000):
                part = slice(i, i + 50_000)
                yield pa.record_batch([pa.array(k[part]), pa.array(a[part]), pa.array(tree.walk(k[part], above))], ["k", "a", "log"])

    out = stored(dealt.mapInArrow(logs, "k bigint, a bigint, log double"), "logs")
    top.destroy()
    return out


class Frequent:
    """Training counts of frequent words, and log probabilities of frequent pairs in ascending order."""

    def __init__(self, words: dict[bytes, int], pairs: np.ndarray, logs: np.ndarray):
        self.words, self.pairs, self.logs = words, pairs, logs

    def score(self, texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of the frequent pairs of each text, a run of sliced() in normal form; the
        others, by text: number of the text, pair, times."""
        key, size = pairs_of(texts, depth)
        bits = text_bits(depth)
        # the pair and the number of the text below it: one sort of plain numbers brings equal pairs together
        both = np.sort((key << bits) | np.repeat(np.arange(len(texts)), size))
        start = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        times, both = np.diff(np.r_[start, len(both)]), both[start]
        key, text = both >> bits, both & ((1 << bits) - 1)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        at, hit = lookup(self.pairs, key[first])
        each = np.diff(np.r_[first, len(key)])
        logs = np.where(hit, self.logs[at] if len(self.logs) else 0.0, 0.0)
        score = np.bincount(text, weights=times * np.repeat(logs, each), minlength=len(texts))
        rare = np.flatnonzero(~np.repeat(hit, each))
        rare = rare[np.argsort(text[rare], kind="stable")]
        return score, text[rare], key[rare], times[rare]


def score_documents(docs: DataFrame, depth: int = DEPTH, frequent: int = FREQUENT, frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    rows = id_and_text(docs).select("doc_id", "text", held_out().alias("held_out"))
    words = stored(word_counts(rows), "words")
    ends = rows.where("not held_out").count()
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    whole = n + 0.5 * (v + 1)
    logs = pair_logs(stored(pair_counts(rows, depth), "pairs"), depth)
    least, least_pair = least_frequent(words, frequent), least_frequent(logs, frequent_pairs)
    some = words.where(F.lit(False) if least is None else F.col("a") >= least).select("w", "c").toArrow()
    pairs = logs.where(F.lit(False) if least_pair is None else F.col("a") >= least_pair).select("k", "log").toArrow().sort_by("k")
    shared = Frequent(dict(zip(some["w"].to_pylist(), some["c"].to_pylist(), strict=True)), pairs["k"].to_numpy(), pairs["log"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(shared)
    del some, pairs
    end = (int(ends > 0), float(np.log10((ends + 0.5) / whole)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        get, out, rare, rare_times, sizes = shared.value.words.get, [], [], [], [0]
        texts = [normal_bytes(t) for t in batch.column(1).to_pylist()]
        for text in texts:
            own = Counter(text.split())
            seen = np.fromiter((get(w, -1) for w in own), np.int64, len(own))
            times = np.fromiter(own.values(), np.int64, len(own))
            hit = seen >= 0
            c, t = seen[hit], times[hit]
            out.append((int(times.sum()) + 1, int(t[c > 0].sum()) + end[0], float(t @ np.log10((c + 0.5) / whole)) + end[1]))
            rare += [w for w, h in zip(own, hit.tolist(), strict=True) if not h]
            rare_times.append(times[~hit])
            sizes.append(len(rare))
        parts, at = [], 0
        for part in sliced(texts, depth):
            score, text, key, times = shared.value.score(part, depth)
            parts.append((score, text + at, key, times))
            at += len(part)
        score, text, key, pair_times = (np.concatenate([p[i] for p in parts]) for i in range(4))
        pair_lists = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32())
        lists, times = pa.array(sizes, pa.int32()), np.concatenate(rare_times)
        cols = [batch.column(0), batch.column(2), *(pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))), pa.array(score), pa.array(map(len, texts), pa.int64())]
        cols += [pa.ListArray.from_arrays(lists, pa.array(rare, pa.binary())), pa.ListArray.from_arrays(lists, pa.array(times, pa.int64()))]
        cols += [pa.ListArray.from_arrays(pair_lists, pa.array(key)), pa.ListArray.from_arrays(pair_lists, pa.array(pair_times))]
        return pa.record_batch(cols, ["doc_id", "held_out", "n_tokens", "k", "b", "score", "n_bytes", "words", "times", "pairs", "pair_times"])

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, k bigint, b double, score double, n_bytes bigint, words array<binary>, times array<bigint>, pairs array<bigint>, pair_times array<bigint>"
    part = map_batches(rows, schema, run).withColumn("row", F.monotonically_increasing_id())
    part = stored(part, "part-scores")
    shared.destroy()  # what follows reads the written table
    rare = part.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("w"), F.col("x.times").alias("t"))
    seldom = words if least is None else words.where(F.col("a") < least)
    base = F.log10((F.col("c") + 0.5) / whole)
    known = F.when(F.col("c") > 0, F.col("t")).otherwise(0)
    more = rare.join(seldom.select("w", "c"), "w").select("row", known.alias("k2"), (F.col("t") * base).alias("b2"), F.lit(0.0).alias("s2"))
    rare = part.select("row", F.explode(F.arrays_zip("pairs", "pair_times")).alias("x")).select("row", F.col("x.pairs").alias("k"), F.col("x.pair_times").alias("t"))
    seldom = logs if least_pair is None else logs.where(F.col("a") < least_pair)
    deep = rare.join(seldom.select("k", "log"), "k").select("row", F.lit(0).cast("bigint").alias("k2"), F.lit(0.0).alias("b2"), (F.col("t") * F.col("log")).alias("s2"))
    more = more.unionByName(deep).groupBy("row").agg(F.sum("k2").alias("k2"), F.sum("b2").alias("b2"), F.sum("s2").alias("s2"))
    both = part.drop("words", "times", "pairs", "pair_times").join(more, "row", "left").na.fill(0, ["k2"]).na.fill(0.0, ["b2", "s2"]).withColumn("score", F.col("score") + F.col("s2"))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("k") + F.col("k2")).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), (F.col("b") + F.col("b2")).alias("base_score"), "score", (-F.col("score") / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_documents(spark, sf_dir))
