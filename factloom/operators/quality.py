"""Quality audits: a sample of the latest facts, verdicts, precision; profiles of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from .views import with_chunk

VERDICTS = ["correct", "quoteWrong", "valueWrong", "scopeWrong", "unverified"]
SAMPLE, SNIPPET, HEAD = 30, 50, 200


def latest(facts: DataFrame, n: int = SAMPLE) -> DataFrame:
    return facts.orderBy(F.col("extracted_at").desc_nulls_last(), F.col("id").asc()).limit(n)


def cleaned(c: Column) -> Column:
    return F.lower(trimmed(F.coalesce(c, F.lit(""))))


def verdict(valid: Column, quote: Column, chunk: Column, raw_value: Column) -> Column:
    """quoteWrong if the quote's flag or place says so, valueWrong if neither quote nor raw value contains the other."""
    q, v, text = cleaned(quote), cleaned(raw_value), F.lower(F.coalesce(chunk, F.lit("")))
    return F.when(~F.coalesce(valid, F.lit(True)), "quoteWrong").when((text != "") & ~F.contains(text, q), "quoteWrong").when(~F.contains(q, v) & ~F.contains(v, q), "valueWrong").otherwise("correct")


def snippet(quote: Column, chunk: Column) -> Column:
    """The chunk's text around the quote, else its head."""
    q = cleaned(quote)
    at = F.instr(F.lower(chunk), q)
    first = F.greatest(at - SNIPPET, F.lit(1))
    return F.when(at > 0, F.substring(chunk, first, at + F.length(q) + SNIPPET - first)).otherwise(F.substring(chunk, 1, HEAD))


def spot_check(facts: DataFrame, chunks: DataFrame, n: int = SAMPLE) -> DataFrame:
    got = with_chunk(latest(facts, n), chunks)
    return got.withColumns({"verdict": verdict(F.col("source_quote_valid"), F.col("source_quote"), F.col("chunk_text"), F.col("raw_value")), "snippet": snippet(F.col("source_quote"), F.col("chunk_text"))})


def score(checked: DataFrame) -> DataFrame:
    """One row: total, counts of each verdict, precision (4 places) and as per cent."""
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    got = checked.agg(F.count("*").alias("total"), *counts)
    p = F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0)
    return got.withColumns({"precision": F.round(p, 4), "precision_percent": F.format_string("%.1f%%", 100 * p)})


def page_profile(chunks: DataFrame, dense: int = 3000) -> DataFrame:
    """One row a document, from the first chunk of each page: mean tokens a page, lists of table-heavy, low-text and dense
    pages (table-heavy first)."""
    kind = F.when(F.col("is_table_heavy"), "table").when(F.col("is_low_text"), "low").when(F.col("token_estimate") > dense, "dense")
    listed = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("page_number"))))
    return chunks.where("chunk_index = 0").withColumn("kind", kind).groupBy("document_id").agg(F.avg("token_estimate").alias("avg_tokens"), listed("table").alias("table_heavy"), listed("low").alias("low_text"), listed("dense").alias("dense"))
