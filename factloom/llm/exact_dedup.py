"""Exact deduplication by a stateful stream.

A narrow table of digests is streamed through keyed state that lives on disk (RocksDB) and never expires: for each
digest it retains the stable identifier (largest doc_id), the number of rows and the content locator (the doc_id whose
text stands for the group and its length in bytes). A digest that is hit more than once is checked on full bytes: the
text of each hit is compared with the located content, and rows that differ in spite of an equal digest are grouped
anew by their bytes. The state keeps its checkpoint, so a later stream over new files goes on where it ended.

Hot groups: the state is a streaming aggregate, summed on the map side first, so a group that holds a third of all rows
reaches its key's task as one row from each task; the checks are joins that split at a skewed key.

Edge cases: null and empty texts are one group; rows that repeat a doc_id with the same text all say ``kept`` if that
id stays, as they are one document; a null doc_id never outranks another, and is kept only in a group of such rows; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, read_documents, scratch_dir, stored, text_key

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of hits (an id, a key and a digest each, about 100 bytes) that may be broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 50_000
DIGEST_BYTES = 32


def digests(docs: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """(doc_id, x: key of the text, text_sha256, digest, n_bytes) of every row's text with A-Z lower-cased."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [t.encode().lower() for t in batch.column(1).to_pylist()]  # bytes.lower() is for A-Z alone
        sha = [hashlib.sha256(b).digest() for b in raw]
        return pa.record_batch([batch.column(0), batch.column(2), pa.array([s.hex() for s in sha]), pa.array([s[:digest_bytes] for s in sha], pa.binary()), pa.array(map(len, raw), pa.int64())], ["doc_id", "x", "text_sha256", "digest", "n_bytes"])

    return map_batches(id_and_text(docs).select("doc_id", "text", text_key().alias("x")), "doc_id bigint, x binary, text_sha256 string, digest binary, n_bytes bigint", run)


def stream_state(spark: SparkSession, source: str, state_dir: str) -> DataFrame:
    """The state after all files below ``source``: (digest, keep_id, n_rows, n_bytes). Files that the checkpoint in
    ``state_dir`` has seen are not read again."""
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}  # many small stores: no space ahead
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema("doc_id bigint, x binary, text_sha256 string, digest binary, n_bytes bigint").parquet(source)
        best = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("rank"), "doc_id", "n_bytes"))
        state = rows.groupBy("digest").agg(best.alias("located"), F.count("*").alias("n_rows"))
        state = state.select("digest", F.col("located.doc_id").alias("keep_id"), "n_rows", F.col("located.n_bytes").alias("n_bytes"))
        out = f"{state_dir}/changes"

        def write(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{state_dir}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest binary, keep_id bigint, n_rows bigint, n_bytes bigint, batch int"
    try:
        changes = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*")
    except Exception as e:  # a stream without rows has no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema).drop("batch")
    last = changes.groupBy("digest").agg(F.max(F.struct("batch", "keep_id", "n_rows", "n_bytes")).alias("x"))
    return last.select("digest", "x.keep_id", "x.n_rows", "x.n_bytes")


def lowered():
    """The text with A-Z lower-cased."""
    return F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unlike(docs: DataFrame, rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests (digest) of which some row's bytes differ from those of the located content."""
    hits = state.where("n_rows > 1").select("digest", "keep_id")
    hit_rows = rows.join(hits, "digest").select("doc_id", "x", "digest", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("located"))
    hit_rows = stored(hit_rows.distinct(), "hits")
    texts = id_and_text(docs).withColumn("x", text_key())
    if hit_rows.count() <= BROADCAST_ROWS:
        hit_rows = F.broadcast(hit_rows)
    texts = texts.join(hit_rows, texts.doc_id.eqNullSafe(hit_rows.doc_id) & (texts.x == hit_rows.x)).select("digest", "located", lowered().alias("text"))
    texts = stored(texts, "hit-texts")
    # tables of their own, so that the join can split a digest that very many rows share
    content = stored(texts.where("located").groupBy("digest").agg(F.min("text").alias("content"), F.max("text").alias("other")), "content")
    bad = stored(texts.join(content, "digest").where("text <> content or content <> other").select("digest"), "unlike-rows")
    return stored(bad.distinct(), "unlike")


def exact_duplicates(docs: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, x (key of the text) of every row. Fewer ``digest_bytes`` make digests collide, which the
    check on full bytes puts right."""
    spark = docs.sparkSession
    source = scratch_dir(spark, "digests")
    digests(docs, digest_bytes).write.parquet(source)
    rows = spark.read.parquet(source)
    state = stored(stream_state(spark, source, scratch_dir(spark, "dedup-state")), "state")
    bad = unlike(docs, rows, state)
    groups = state.select("digest", F.lit(None).cast("string").alias("sha"), "keep_id", F.col("n_rows").alias("group_size"))
    if bad.limit(1).count():
        # equal digests, different bytes: these groups are told apart by an independent digest of 512 bits
        texts = id_and_text(docs).select("doc_id", text_key().alias("x"), F.sha2(lowered(), 512).alias("sha"))
        split = rows.join(bad, "digest")
        split = split.join(texts.dropDuplicates(["doc_id", "x"]), split.doc_id.eqNullSafe(texts.doc_id) & (split.x == texts.x)).select(*(split[c] for c in rows.columns), "sha")
        split = stored(split, "split")
        own = split.groupBy("digest", "sha").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        groups = groups.join(bad, "digest", "left_anti").unionByName(own)
        key = rows.join(bad, "digest", "left_anti").withColumn("sha", F.lit(None).cast("string")).unionByName(split)
    else:
        key = rows.withColumn("sha", F.lit(None).cast("string"))
    key = key.select("doc_id", "x", "text_sha256", "digest", F.coalesce("sha", F.lit("")).alias("sha"))
    groups = groups.withColumn("sha", F.coalesce("sha", F.lit("")))
    return key.join(groups, ["digest", "sha"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "x")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_documents(spark, sf_dir)).drop("x")


#: sha256 and the window functions run on whole texts in DuckDB.
OP10_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
