"""Nearest neighbours and similarity joins. Exact: no index approximates a distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import forms_merge, name_forms
from . import nearest
from .nearest import fitting, kept, meet, search


def top_k(scored: DataFrame, query: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each query, with ``rank``; Spark keeps k a task before it shuffles."""
    w = Window.partitionBy(*query).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def without_distance(queries: DataFrame, rows: DataFrame, keys: list[str], query_id: str, row_id: str, k: int, differ: tuple[str, str]) -> DataFrame:
    """(keys, query_id, row_id, distance) of pairs that share their keys and have no distance, as many as k nearest rows need:
    NaN where a vector has no direction, null where there is none. Of each kind of rows the first k + 1 of a key are enough,
    as one at most is the query's own; rows with a direction are taken for queries without one only. Ids are unique."""

    def kind(vector: str) -> Column:
        v = F.col(vector).cast("array<double>")
        square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
        lost = v.isNull() | (F.size(v) == 0) | square.isNull()
        return F.when(lost, 2).when((square > 0) & (square < math.inf), 0).otherwise(1)

    first = top_k(rows.withColumn("kind", kind("v")).select(*keys, "kind", row_id, *({differ[1]} - {row_id})), [*keys, "kind"], [F.col(row_id).asc()], k + 1).drop("rank")
    asked = queries.withColumn("asks", kind("q")).drop("q")
    met = asked.join(first, keys).where("asks > 0 or kind > 0").where(F.col(differ[0]) != F.col(differ[1]))
    distance = F.when(F.greatest("asks", "kind") == 1, F.lit(math.nan)).cast("double")
    return met.select(*keys, query_id, row_id, distance.alias("distance"))


def knn_join(queries: DataFrame, rows: DataFrame, keys: list[str], query_id: str, row_id: str, k: int, max_distance: float | None = None, differ: tuple[str, str] | None = None, last: bool = False) -> DataFrame:
    """For each query (keys, query_id, q) the k nearest rows (keys, row_id, v) that share its keys: query_id, row_id,
    distance, rank. ``differ`` names a column of the queries and one of the rows whose values must not be equal. Without
    keys, a query meets the rows of the cells that can hold a nearer one (:mod:`nearest`); with keys, all of its keys, in
    blocks that pass on k rows a query. With ``last`` (keys and ``differ`` are needed) rows without a distance come after all
    others, NaN before null; else they are left out."""
    if not keys:
        null = F.lit(None).cast("string")
        asked = queries.select(F.col(query_id).alias("qid"), (F.col(differ[0]).cast("string") if differ else null).alias("qx"), "q")
        found = search(asked, rows.select(F.col(row_id).alias("rid"), (F.col(differ[1]).cast("string") if differ else null).alias("rx"), "v"), k, max_distance)
        met = found.select(F.col("qid").alias(query_id), F.col("rid").alias(row_id), "distance")
        return top_k(met, [query_id], [F.col("distance").asc(), F.col(row_id).asc()], k)
    kind, null = dict(queries.dtypes), F.lit(None).cast("string")
    asked = fitting(queries.withColumn("qx", F.col(differ[0]).cast("string") if differ else null), "q").select(*keys, F.size("q").alias("dims"), F.struct(*keys, query_id).alias("qid"), "qx", "q")
    near = fitting(rows.withColumn("rx", F.col(differ[1]).cast("string") if differ else null), "v").select(*keys, F.size("v").alias("dims"), F.col(row_id).alias("rid"), "rx", "v")
    met = meet(kept(asked, "queries"), kept(near, "rows"), [*keys, "dims"], k, max_distance, None, nearest.WIDE)
    met = met.select(*[F.col(f"qid.{c}").cast(kind[c]).alias(c) for c in [*keys, query_id]], F.col("rid").alias(row_id), "distance")
    if last:
        met = met.unionByName(without_distance(queries, rows, keys, query_id, row_id, k, differ))
    return top_k(met, [query_id], [F.col("distance").asc_nulls_last(), F.col(row_id).asc()], k)


def nearest_one(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, differ: tuple[str, str] | None = None) -> DataFrame:
    """query_id, row_id, similarity of the nearest row; ties go to the smallest id."""
    got = knn_join(queries, rows, [], query_id, row_id, 1, differ=differ)
    return got.select(query_id, row_id, (1 - F.col("distance")).alias("similarity"))


def edit_candidates(strings: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """(scope, idx_a, idx_b), idx_a < idx_b, with all pairs of strings (scope, idx, s) whose Levenshtein distance is at most
    1 - ``threshold`` of the longer length, and some others.

    Strings are padded and cut to q-grams. A string of length n differs from such a partner in at most (1 - t) / t * n
    edits, each of which breaks q grams; so two of them share one of their rarest q * edits + 1 grams, at about one
    place. Only those rarest ones are joined on."""
    ratio = (1 - threshold) / threshold
    q = min(3, math.floor(1 / ratio)) if ratio > 0 else 3
    if q < 1:
        raise ValueError("strings that share less than half of their characters have no common grams")
    edits = F.floor(F.length("s") * ratio + 1e-6).cast("int")
    some = strings.withColumn("edits", edits).where("edits > 0").withColumn("n", F.length("s"))
    padded = F.concat(F.lit("\u0001" * (q - 1)), F.col("s"), F.lit("\u0002" * (q - 1)))
    grams = F.transform(F.sequence(F.lit(1), F.length("s") + q - 1), lambda i: F.struct(F.substring(padded, i, F.lit(q)).alias("g"), i.alias("at")))
    every = some.select(*scope, "idx", "n", "edits", F.explode(grams).alias("x")).select(*scope, "idx", "n", "edits", "x.*")
    often = every.groupBy("g").agg(F.count("*").alias("often"))
    ranked = every.join(often, "g").groupBy(*scope, "idx", "n", "edits").agg(F.array_sort(F.collect_list(F.struct("often", "g", "at"))).alias("x"))
    rare = ranked.select(*scope, "idx", "n", "edits", F.explode(F.slice("x", F.lit(1), F.col("edits") * q + 1)).alias("x"))
    rare = kept(rare.select(*scope, "idx", "n", "edits", F.col("x.g").alias("g"), F.col("x.at").alias("at")), "rare-grams")
    a, b = (rare.select(*scope, "g", *[F.col(c).alias(f"{c}_{side}") for c in ("idx", "n", "edits", "at")]) for side in "ab")
    most = F.least("edits_a", "edits_b")
    met = a.join(b, [*scope, "g"]).where("idx_a < idx_b").where((F.abs(F.col("at_a") - F.col("at_b")) <= most) & (F.abs(F.col("n_a") - F.col("n_b")) <= most))
    return met.select(*scope, "idx_a", "idx_b").distinct()


#: Members of a class of equal names that stand in one row.
MEMBERS = 2048


def merging_names(names: DataFrame, scope: str = "document_id", threshold: float = 0.85) -> DataFrame:
    """Pairs (scope, idx_a, idx_b) of names (scope, idx, name) of one document that name one entity. Names of equal forms
    are one class; classes meet where a form is equal, or where forms share rare grams (:func:`edit_candidates`). Only then
    their members are paired, from rows of at most ``MEMBERS``, and pairs pass through no shuffle: copies of a name cost
    what they put out."""
    own = names.select(scope, "idx", name_forms(F.col("name")).alias("f")).where("f.low <> ''")
    own = kept(own.select(scope, "idx", F.concat_ws("\0", "f.low", "f.form").alias("c"), "f"), "name-forms")
    classes = kept(own.groupBy(scope, "c").agg(F.first("f").alias("f"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("rows")), "name-classes")
    strings = classes.select(scope, F.col("c").alias("idx"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"f.{k}").alias("s")) for k in ("low", "form")])).alias("x")).select(scope, "idx", "x.*")
    equal = strings.select(scope, "k", "s", F.col("idx").alias("idx_a")).join(strings.select(scope, "k", "s", F.col("idx").alias("idx_b")), [scope, "k", "s"]).where("idx_a < idx_b")
    near = edit_candidates(strings, [scope, "k"], threshold)
    met = equal.select(scope, "idx_a", "idx_b").unionByName(near.select(scope, "idx_a", "idx_b")).distinct()
    side = lambda x: classes.select(scope, F.col("c").alias(f"idx_{x}"), F.col("f").alias(f"f{x}"))
    alike = met.join(side("a"), [scope, "idx_a"]).join(side("b"), [scope, "idx_b"]).where(forms_merge(F.col("fa"), F.col("fb"), threshold)).select(scope, F.col("idx_a").alias("ca"), F.col("idx_b").alias("cb"))
    alike = alike.unionByName(classes.select(scope, F.col("c").alias("ca"), F.col("c").alias("cb")))
    dealt = own.join(classes.select(scope, "c", "rows"), [scope, "c"]).withColumn("row", F.pmod(F.xxhash64("idx"), F.col("rows")).cast("int"))
    dealt = kept(dealt.groupBy(scope, "c", "row").agg(F.collect_list("idx").alias("m")), "name-members")
    rows = lambda x: dealt.select(scope, F.col("c").alias(f"c{x}"), F.col("row").alias(f"r{x}"), F.col("m").alias(f"m{x}"))
    both = alike.join(rows("a"), [scope, "ca"]).join(rows("b"), [scope, "cb"]).where("ca < cb or ra <= rb")
    both = both.repartition(4 * names.sparkSession.sparkContext.defaultParallelism, scope, "ca", "cb", "ra", "rb")
    pairs = both.select(scope, (F.struct("ca", "ra") == F.struct("cb", "rb")).alias("own"), F.explode("ma").alias("x"), "mb").select(scope, "own", "x", F.explode("mb").alias("y"))
    pairs = pairs.where("x < y or (x > y and not own)")
    return pairs.select(scope, F.least("x", "y").alias("idx_a"), F.greatest("x", "y").alias("idx_b"))
