"""Document fingerprints from closed syncmers, by DataFrame functions alone.

Tokens are the runs between spaces, cut after every ``PIECE`` characters. A window of ``K`` tokens is a closed syncmer if
the smallest hash of its inner ``S``-token substrings lies at its first or last one. That depends on the window alone, so
the same passage has the same anchors in any document, and their positions match up; of six inner substrings two count, so
about a third of all windows are anchors. Likeness is the Jaccard coefficient of two texts' distinct anchors, all of them;
``aligned_edited`` is the share of the anchors of either text that the other has at the same position. The printed
fingerprint is the SHA-256 of all distinct anchors in ascending order: it stands for the very set that likeness is taken
of, and differs as soon as one anchor does.

The next document is found by a window over buckets of the order (doc_id, hash of the text). Bounds of the buckets come
from a sample of at most ``BUCKETS`` x ``SAMPLES`` rows, so that far-off ids or rows without one do not fill a bucket; a
bucket also gets a copy of the first row of the one after it, so no row meets all others in one task.

Edge cases: a null or empty text has no anchors and is alike (1.0) to an empty text only; a text of fewer
tokens than ``K`` has one anchor, all of it; null doc_ids come first; rows of the same doc_id are in order of a hash of
their text; a table of one row is its own next; an empty table gives an empty one; ids may be any bigint.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text, read_documents

K, S, PIECE = 8, 3, 4
BUCKETS, ROWS_A_BUCKET, SAMPLES, FAN = 16_384, 500, 8, 128


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    return F.split(F.regexp_replace(text, f"([^ ]{{{PIECE}}})(?=[^ ])", "$1 "), " ")


def token_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def inner_hashes(h: Column) -> Column:
    """The hash of the S tokens from each token on; those at the end, which are fewer, have none."""
    return F.transform(h, lambda x, i: F.when(i + S <= F.size(h), F.xxhash64(x, *(F.get(h, i + j) for j in range(1, S)))))


def syncmer(s: Column, x: Column, i: Column) -> Column:
    """The anchor of the window whose first inner hash is ``x``, at i of ``s``, or null. Inner substrings S apart, with the
    first and last among them, cover the window."""
    last = F.get(s, i + K - S)
    between = F.least(*(F.get(s, i + j) for j in range(1, K - S)))
    cover = [F.get(s, i + j) for j in range(S, K - S, S)]
    # past the last window ``last`` is null
    return F.when(last.isNotNull() & (F.least(x, last) <= between), F.xxhash64(x, *cover, last).bitwiseAND(F.lit(0xFFFFFFFF)))


def anchors(text: Column) -> Column:
    """array<struct<position int, anchor bigint>>: closed syncmers of a text in order, for positional matching."""
    found = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(i.alias("position"), syncmer(s, x, i).alias("anchor"))), lambda a: a["anchor"].isNotNull())
    return let(inner_hashes(token_hashes(text)), found)


def placed_anchors(text: Column) -> Column:
    """array<bigint>: the anchors of a text in order, each as position << 32 | hash; empty for the empty text."""
    few = lambda h: F.array(F.xxhash64(h).bitwiseAND(F.lit(0xFFFFFFFF)))
    many = lambda s: F.array_compact(F.transform(s, lambda x, i: F.shiftleft(i.cast("bigint"), 32).bitwiseOR(syncmer(s, x, i))))
    made = let(token_hashes(text), lambda h: F.when(F.size(h) < K, few(h)).otherwise(let(inner_hashes(h), many)))
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(made)


def hashes(placed: Column) -> Column:
    """The distinct hashes of placed anchors."""
    return F.array_distinct(F.transform(placed, lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct values; of two empty ones, 1."""
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both)


def as_string(s: Column) -> Column:
    """The fingerprint of distinct hashes: SHA-256 of all of them, ascending, as decimal numbers joined by commas."""
    return F.sha2(F.array_join(F.array_sort(s).cast("array<string>"), ","), 256)


def order_of() -> Column:
    """What rows are ordered by: null ids first, then ids, then a hash of the text."""
    return F.struct(F.col("doc_id").isNotNull().cast("int").alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))


def bucket_of(docs: DataFrame) -> Column:
    """The number of a row's bucket, for a column ``key`` of order_of(): buckets follow the order and hold about as many
    rows each. Bounds are found in two steps of ``FAN`` comparisons at most."""
    n = docs.count()
    buckets = min(BUCKETS, max(1, n // ROWS_A_BUCKET))
    sample = docs.select(order_of().alias("key")).select("key", F.xxhash64("key").alias("luck")).orderBy("luck", "key").limit(buckets * SAMPLES)
    keys = sorted({tuple(r["key"]) for r in sample.select("key").collect()})
    bounds = keys[SAMPLES::SAMPLES]
    step = max(1, min(FAN, len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    kind = "array<struct<known int, id bigint, h bigint>>"
    at = lambda b: {"known": b[0], "id": b[1], "h": b[2]}
    constant = lambda value, schema: F.from_json(F.lit(json.dumps(value)), schema)
    reached = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col("key")))
    group = reached(constant([at(g[0]) for g in groups], kind))
    return let(group, lambda i: F.when(i == 0, F.lit(0)).otherwise((i - 1) * FAN + reached(F.get(constant([[at(b) for b in g] for g in groups], f"array<{kind}>"), i - 1))))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): the text of the row that follows in order; after the last, the first's. docs: (doc_id,
    text)."""
    own = docs.withColumn("key", order_of()).withColumn("bucket", bucket_of(docs))
    firsts = own.groupBy("bucket").agg(F.min("key").alias("first_key"))
    order = Window.orderBy("bucket")  # at most BUCKETS rows
    ends = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("bucket", F.coalesce(F.lead("first_key").over(order), F.first("first_key").over(ends)).alias("first_key"))
    extra = docs.withColumn("key", order_of()).join(F.broadcast(firsts), F.col("key") == F.col("first_key")).select("doc_id", "text", "key", "bucket", F.lit(1).alias("extra"))
    w = Window.partitionBy("bucket").orderBy("extra", "key")
    rows = own.withColumn("extra", F.lit(0)).unionByName(extra)
    return rows.select("doc_id", "text", "extra", F.lead("text").over(w).alias("next_text")).where("extra = 0").drop("extra")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, aligned_edited of every row."""
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.when(cut == 0, F.col("text")).otherwise(F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    made = with_next(id_and_text(docs)).select("doc_id", n.cast("bigint").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    made = made.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), placed_anchors(F.col("text")).alias("p"), placed_anchors(F.col("edited")).alias("q"), hashes(placed_anchors(F.col("next_text"))).alias("c"))
    made = made.withColumn("a", hashes(F.col("p"))).withColumn("b", hashes(F.col("q")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return made.select("doc_id", "n_chars", "edited_sha256", as_string(a).alias("fingerprint"), as_string(b).alias("edited_fingerprint"), likeness(a, b).alias("near_edited"), likeness(a, c).alias("near_next"), likeness(F.col("p"), F.col("q")).alias("aligned_edited"))


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_documents(spark, sf_dir))
