"""Read views: filters, joined pages of facts, counts, relationships with their facts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import Paging, is_live
from ..functions.text import escaped_like


#: Rows that a task should sort or hash at once.
TASK_ROWS = 1_000_000


def shares(rows: DataFrame) -> int:
    """How many tasks should share the rows: 1 (Spark's own way) up to TASK_ROWS, beyond so many that none has over about
    TASK_ROWS. Spark's number of shuffle partitions is the same for any input, so a task's part grows with the input."""
    n = math.ceil(rows.count() / TASK_ROWS)
    return n if n <= 1 else max(n, rows.sparkSession.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, key: str, parts: int) -> DataFrame:
    """The rows by a hash of their key in so many parts; as they are if it is one."""
    return rows.repartition(parts, key) if parts > 1 else rows


def filtered(rows: DataFrame, **equal) -> DataFrame:
    """Rows that meet all given equalities; None and '' mean no condition."""
    given = {k: v for k, v in equal.items() if v not in (None, "")}
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), given.items(), rows)


def page_of(rows: DataFrame, order: list[Column], paging: Paging) -> DataFrame:
    """One page; ``order`` ends with a unique key."""
    return rows.orderBy(*order).offset(paging.offset).limit(paging.limit)


def total(rows: DataFrame, **equal) -> int:
    """How many rows a filtered list has, for its pages."""
    return filtered(rows, **equal).count()


def count_by(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name))


def with_count(rows: DataFrame, others: DataFrame, key: str, other_key: str, name: str) -> DataFrame:
    """Rows with the number of others of their key, 0 if none."""
    counts = others.where(F.col(other_key).isNotNull()).groupBy(F.col(other_key).alias(key)).agg(F.count("*").alias(name))
    return rows.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def pair_counts(pairs: DataFrame, a: str, b: str, key: str, name: str) -> DataFrame:
    """(key, name): in how many pairs an id stands on either side; a pair of the same id counts once. Exploded, so that the
    join on it is an equality."""
    ids = pairs.select(F.explode(F.array_distinct(F.array(a, b))).alias(key))
    return ids.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(name))


def fact_list(facts: DataFrame, documents: DataFrame, fact_types: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Facts with file name, type name, entity name and number of relationships."""
    got = facts.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id", "left")
    got = got.join(fact_types.select(F.col("id").alias("fact_type_id"), F.col("name").alias("fact_type_name")), "fact_type_id", "left")
    got = got.join(entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name")), "entity_id", "left")
    counts = pair_counts(relationships, "fact_a_id", "fact_b_id", "id", "relationship_count")
    return got.join(counts, "id", "left").withColumn("relationship_count", F.coalesce("relationship_count", F.lit(0)))


def with_chunk(facts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts with the text of the chunk they come from, null if there is none."""
    keys = chunks.select("document_id", F.col("page_number").alias("source_page"), F.col("chunk_index").alias("source_chunk_index"), F.col("raw_text").alias("chunk_text"))
    return facts.join(keys, ["document_id", "source_page", "source_chunk_index"], "left")


def expanded(relationships: DataFrame, cards: DataFrame) -> DataFrame:
    """Relationships with both facts (cards: id and any columns) as structs fact_a and fact_b, null if missing."""
    card = F.struct(*cards.columns)
    a, b = cards.select(F.col("id").alias("fact_a_id"), card.alias("fact_a")), cards.select(F.col("id").alias("fact_b_id"), card.alias("fact_b"))
    return relationships.join(a, "fact_a_id", "left").join(b, "fact_b_id", "left")


def of_fact(relationships: DataFrame, fact_id) -> DataFrame:
    """The relationships of a fact, with the other fact's id and its role."""
    a = F.col("fact_a_id") == fact_id
    return relationships.where(a | (F.col("fact_b_id") == fact_id)).withColumns({"other_id": F.when(a, F.col("fact_b_id")).otherwise(F.col("fact_a_id")), "role": F.when(a, "factB").otherwise("factA")})


def search(rows: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column contains the text, ignoring case; % and _ stand for themselves; blank text keeps all."""
    like = escaped_like(text)
    return rows if like is None else rows.where(F.ilike(F.col(column), F.lit(like)))


def contains_any(rows: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows of which some column contains the text, ignoring case."""
    q = text.strip().lower()
    return rows if not q else rows.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c), F.lit(q)), F.lit(False)) for c in map(F.col, columns)]))


RECENT, RELATED = 50, 100


def recent_documents(documents: DataFrame) -> DataFrame:
    """The newest documents, without where their files lie."""
    return documents.orderBy(F.col("uploaded_at").desc_nulls_first(), F.col("id").asc()).limit(RECENT).drop("file_path")


def documents_with_status(documents: DataFrame, tracked: DataFrame) -> DataFrame:
    """Documents whose status is not final and that nothing follows yet (tracked: id)."""
    return documents.where(is_live(F.col("status"))).join(tracked.select("id"), "id", "left_anti")


def related_facts(relationships: DataFrame, fact_id, cards: DataFrame) -> DataFrame:
    """The newest relationships of a fact, with the other fact (cards: id and any columns) and its role."""
    latest = of_fact(relationships, fact_id).orderBy(F.col("created_at").desc_nulls_first(), F.col("id").asc()).limit(RELATED)
    other = cards.select(F.col("id").alias("other_id"), F.struct(*cards.columns).alias("other"))
    return latest.join(other, "other_id", "left")


def aliases_of(aliases: DataFrame, documents: DataFrame, entity_id) -> DataFrame:
    """The surface forms of an entity from the oldest on, with the file that each comes from, null if there is none."""
    names = documents.select(F.col("id").alias("document_id"), "filename")
    return aliases.where(F.col("entity_id") == entity_id).join(names, "document_id", "left").orderBy("created_at", "id")


def facts_of_documents(facts: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with their document's file name; facts without a document go."""
    return facts.join(documents.select(F.col("id").alias("document_id"), "filename"), "document_id")


def facts_in(relationships: DataFrame, parts: int = 1) -> DataFrame:
    """(id): every fact that stands on some side of a relationship, once. ``parts`` tasks share the ids (see :func:`shares`),
    which are dealt before they are hashed."""
    return dealt(relationships.select(F.explode(F.array("fact_a_id", "fact_b_id")).alias("id")), "id", parts).distinct()


def status_counts(chunks: DataFrame) -> DataFrame:
    """A row a document: chunks, those done (extracted, failed or deferred) and those failed."""
    s = F.col("extraction_status")
    return chunks.groupBy("document_id").agg(F.count("*").alias("total"), F.count_if(s.isin("extracted", "extraction_failed", "extraction_deferred")).alias("done"), F.count_if(s == "extraction_failed").alias("failed"))


def chunks_of(chunks: DataFrame, document_id) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("page_number", "chunk_index")
