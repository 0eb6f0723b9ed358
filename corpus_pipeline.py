"""A training-corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents. Edge cases are those of the operators: documents whose text is null,
empty or without letters leave in the first stage; repeated rows of one document leave all but one in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import keep_rows, scratch_dir
from factloom.llm.exact_dedup import exact_duplicates
from factloom.llm.language_id import fit_languages, keep_documents
from factloom.llm.mixing import mix
from factloom.llm.near_sets import near_groups
from factloom.llm.piece_codec import encode_documents

#: A document needs a language with this share of its words.
MIN_SHARE = 0.3
#: Tokens of each domain that mixing aims at, as a factor of those that are there.
KEEP = {"good": 1.0, "plain": 1.0, "toxic": 0.05}


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no letter, or no language that holds MIN_SHARE of the words."""
    return keep_documents(docs, fit_languages(docs.select("doc_id", "text", "lang")), MIN_SHARE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest doc_id stays."""
    decided = exact_duplicates(docs)
    kept = keep_rows(docs, decided)
    repeated = decided.where("kept").groupBy("doc_id", "x").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the one with the smallest doc_id stays. Near are texts whose five-word shingle sets
    have a Jaccard coefficient of 0.8 or more; groups are the components of such pairs. The SimHash operator's blocks give the first
    candidates; MinHash bands find what lies beyond its radius, as most pairs at 0.8 do (README)."""
    groups = near_groups(docs)
    return keep_rows(docs, groups.select("doc_id", "x", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps a document with the probability of its rate (a hash of its id decides). Rates of clean documents are about 1,
    and those of 0.9 or more keep a document for sure. Nothing is repeated, so rates over 1 count as 1: what is kept comes
    close to the targets from below."""
    rates = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), KEEP, relative=True)
    luck = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1_000_000)) / 1_000_000
    return keep_rows(docs, rates.select("doc_id", "x", ((F.col("rate") >= 0.9) | (luck < F.col("rate"))).alias("kept")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("encoding", encoding_stage)]

#: No SQL: SQL cannot express the stages' models and fingerprints; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``, each table written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
