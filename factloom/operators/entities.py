"""Entities: clusters of surface forms in a document, election of names, matching and links."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import forms_merge, name_forms, normalize_name, trimmed
from ..sources.scratch import written
from .similarity import merging_names

UNRESOLVED = "Unresolved Entity"
#: Forms of a document that are compared one by one; those of larger documents meet by their rare grams.
FEW = 64
#: Rows of a table that every task may hold.
SHARED = 100_000


def with_forms(mentions: DataFrame) -> DataFrame:
    """Mentions with the form (document_id, key) that they are of, a distinct name ignoring case: ``form``, the place of its
    first mention, ``form_name``, its longest variant (first on ties), and ``n``, the number of its mentions. All of a document
    stays where its rows are: nothing but the rows themselves is shuffled, and these once."""
    cleared = {c: F.nullif(trimmed(F.col(c)), F.lit("")) for c in ("type", "context")}
    named = mentions.withColumns(cleared | {"name": normalize_name(F.col("name"))}).withColumn("key", F.lower("name"))
    w = Window.partitionBy("document_id", "key")
    best = F.max_by("name", F.struct(F.length("name"), -F.col("idx"))).over(w)
    return named.withColumns({"form": F.min("idx").over(w).cast("bigint"), "form_name": best, "n": F.count("*").over(w)})


def form_pairs(formed: DataFrame) -> DataFrame:
    """(document_id, idx_a, idx_b) of the forms of a document that name one entity. Documents of at most ``FEW`` forms compare
    all of theirs, without grams; in larger ones each form is a row of its own and goes to :func:`merging_names`."""
    forms = formed.where("idx = form and document_id is not null").select("document_id", "idx", F.col("form_name").alias("name"), name_forms(F.col("form_name")).alias("f"))
    w = Window.partitionBy("document_id")
    held = F.when(F.row_number().over(w.orderBy("idx")) <= FEW + 1, F.struct("idx", "f"))
    forms = forms.withColumn("held", held).withColumn("m", F.collect_list("held").over(w)).withColumn("many", F.size("m") > FEW)
    both = forms.select("document_id", "idx", "name", "f", "many", F.explode(F.when(F.col("many"), F.slice("m", 1, 1)).otherwise(F.col("m"))).alias("b"))
    met = both.where(F.col("many") | ((F.col("idx") < F.col("b.idx")) & forms_merge(F.col("f"), F.col("b.f"))))
    met = written(met.select("document_id", F.col("idx").alias("idx_a"), F.col("b.idx").alias("idx_b"), F.when(F.col("many"), F.col("name")).alias("name")), "form-pairs")
    few, many = met.where("name is null").drop("name"), met.where("name is not null").select("document_id", F.col("idx_a").alias("idx"), "name")
    return few.unionByName(merging_names(many, "document_id")) if many.limit(1).count() else few


def linked_forms(pdf: pd.DataFrame) -> pd.DataFrame:
    """Labels the merged forms of one document (rows idx_a, idx_b) with their smallest idx."""
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in zip(pdf["idx_a"], pdf["idx_b"], strict=True):
        a, b = root(int(a)), root(int(b))
        parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"document_id": pdf["document_id"].iloc[0], "idx": list(parent), "cluster": [root(i) for i in parent]})


def form_labels(formed: DataFrame) -> DataFrame:
    """(document_id, form, cluster) of the forms that are merged with another; a cluster is its smallest form. Names of a
    document are few, so that its merged pairs and a union-find stay in one group."""
    kind = formed.schema["document_id"].dataType.simpleString()
    labels = form_pairs(formed).groupBy("document_id").applyInPandas(linked_forms, f"document_id {kind}, idx bigint, cluster bigint")
    return written(labels.withColumnRenamed("idx", "form"), "form-labels")


def shared(df: DataFrame) -> DataFrame:
    """A written table, sent to every task if it is small: then what it is joined to stays where it is."""
    return F.broadcast(df) if df.limit(SHARED + 1).count() <= SHARED else df


def with_clusters(formed: DataFrame, labels: DataFrame) -> DataFrame:
    """Forms with their ``cluster`` and its winner: ``canonical_name`` and ``winner``, its key. Most mentions win, then length
    without an article, then forms without one, then alphabet."""
    placed = formed.join(shared(labels), ["document_id", "form"], "left").withColumn("cluster", F.coalesce("cluster", "form"))
    the = F.lower("form_name").startswith("the ")
    order = F.struct(-F.col("n"), -F.length(F.regexp_replace("form_name", "(?i)^the\\s+", "")), the, F.collate(F.col("form_name"), "UNICODE"), "form")
    won = F.min_by(F.struct("form_name", "key"), order).over(Window.partitionBy("document_id", "cluster"))
    return placed.withColumn("won", won).withColumns({"canonical_name": F.col("won.form_name"), "winner": F.col("won.key")}).drop("won")


def elect(mentions: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """One row a cluster: canonical_name, entity_type (most frequent that is not blank, first on ties), context (the longest
    of the winner, else of all), surface_forms, n_mentions. placed: with_clusters() of the mentions, if there already."""
    if placed is None:
        formed = with_forms(mentions)
        placed = with_clusters(formed, form_labels(formed))
    w = Window.partitionBy("document_id", "cluster", "type")
    kind = F.when(F.col("type").isNotNull(), F.struct(F.count("*").over(w), -F.min("idx").over(w)))
    said = F.when(F.col("context").isNotNull(), F.struct(F.col("key") == F.col("winner"), F.length("context"), -F.col("idx")))
    rows = placed.withColumns({"kind": kind, "said": said})
    return rows.groupBy("document_id", "cluster").agg(F.first("canonical_name").alias("canonical_name"), F.array_sort(F.collect_set("form_name")).alias("surface_forms"), F.count("*").alias("n_mentions"), F.max_by("type", "kind").alias("entity_type"), F.max_by("context", "said").alias("context"))


def insert_or_get(names: DataFrame, entities: DataFrame) -> DataFrame:
    """names (canonical_name, new_id) with the id of the entity of that name, ignoring case, and whether it is new."""
    known = entities.groupBy(F.lower("canonical_name").alias("k")).agg(F.min("id").alias("old"))
    first = names.withColumn("k", F.lower("canonical_name")).withColumn("fresh", F.min("new_id").over(Window.partitionBy("k")))
    return first.join(known, "k", "left").select("canonical_name", F.coalesce("old", "fresh").alias("entity_id"), F.col("old").isNull().alias("is_new"))


def first_confirmed(candidates: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(query, entity_id) of the best-ranked candidate (query, entity_id, similarity, rank, same) that is confirmed."""
    return candidates.where((F.col("similarity") >= threshold) & F.col("same")).groupBy("query").agg(F.min_by("entity_id", "rank").alias("entity_id"))


def link_facts(facts: DataFrame, links: DataFrame, fallback_id: str) -> DataFrame:
    """Facts with entity_id of their link (fact_id, entity_id); without one, of the entity that stands for all such."""
    own = links.select(F.col("fact_id").alias("id"), F.col("entity_id").alias("__e"))
    return facts.join(own, "id", "left").withColumn("entity_id", F.coalesce("__e", "entity_id", F.lit(fallback_id))).drop("__e")
