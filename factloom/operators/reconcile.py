"""Reconciliation of new facts against stored ones: candidates, pairs, decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import predicates_match
from ..functions.vectors import cosine_distance
from .nearest import BLOCK, SLACK, kept, search_in_keys
from .rules import parsed, rule_reconcile
from .similarity import top_k

MATCH_CANDIDATES, MATCH_DISTANCE = 10, 0.35
#: Pairs of an entity's facts beyond which they are dealt to blocks.
HEAVY_PAIRS = 4_000_000
DETAIL = ["id", "document_id", "predicate", "value", "raw_value", "unit", "currency", "time_scope", "qualifiers"]
#: What a judge sees beside; null where the facts have no such column.
CONTEXT = {"source_quote": "string", "source_page": "int", "filename": "string"}


def as_struct(prefix: str) -> Column:
    return F.struct(*[F.col(f"{prefix}_{c}").alias(c) for c in [*DETAIL, *CONTEXT, "parsed"]])


def side(facts: DataFrame, prefix: str, *more: str) -> DataFrame:
    """A side of the pairs. What the rules compare is parsed here, once a fact and not once a pair."""
    own = parsed(*map(F.col, ("value", "raw_value", "unit", "currency", "time_scope")))
    context = [(F.col(c) if c in facts.columns else F.lit(None)).cast(t).alias(f"{prefix}_{c}") for c, t in CONTEXT.items()]
    return facts.select("entity_id", *[F.col(c).alias(f"{prefix}_{c}") for c in [*DETAIL, *more]], *context, own.alias(f"{prefix}_parsed"))


def heavy_entities(new: DataFrame, stored: DataFrame, most: int) -> DataFrame:
    """(entity_id) of the entities with more than ``most`` pairs, written once."""
    n = lambda facts, c: facts.groupBy("entity_id").agg(F.count("*").alias(c))
    return kept(n(new, "a").join(n(stored, "b"), "entity_id").where(F.col("a") * F.col("b") > most).select("entity_id"), "heavy")


def near_in_blocks(new: DataFrame, stored: DataFrame, k: int, distance: Column, max_distance: float) -> DataFrame:
    """(a_id, b_id, distance) by any distance column: facts of an entity are dealt to blocks, each pair of which is a join
    key of its own."""
    size = lambda facts, c: facts.groupBy("entity_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(c))
    blocks = size(new, "na").join(size(stored, "nb"), "entity_id")
    deal = lambda side, own, other, x, y: [F.pmod(F.xxhash64(f"{side}_id"), F.col(own)).cast("int").alias(x), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(y)]
    a = side(new, "a", "vector").select("entity_id", "a_id", "a_document_id", "a_vector").join(blocks, "entity_id").select("entity_id", "a_id", "a_document_id", "a_vector", *deal("a", "na", "nb", "x", "y"))
    b = side(stored, "b", "vector").select("entity_id", "b_id", "b_document_id", "b_vector").join(blocks, "entity_id").select("entity_id", "b_id", "b_document_id", "b_vector", *deal("b", "nb", "na", "y", "x"))
    met = a.join(b, ["entity_id", "x", "y"]).where("a_document_id <> b_document_id and a_id <> b_id").withColumn("distance", distance)
    return met.where(F.col("distance") < max_distance).select("a_id", "b_id", "distance")


def first_of_others(docs: np.ndarray, start: np.ndarray, step: int, own: np.ndarray, k: int) -> np.ndarray:
    """Walks over rows in steps of one from ``start``, all walks at once: the places (walks, k) of the first k rows whose
    document is not the walk's ``own``, -1 where there are fewer. Runs of one document are left in one step."""
    n = len(docs)
    change = np.flatnonzero(docs[1:] != docs[:-1])  # a run ends here
    run = np.searchsorted(change, np.arange(n))
    after = (np.r_[change + 1, n] if step > 0 else np.r_[-1, change])[run]
    found, count, at = np.full((len(start), k), -1), np.zeros(len(start), int), start.copy()
    left = np.flatnonzero((at >= 0) & (at < n))
    while len(left):
        here = at[left]
        other = docs[here] != own[left]
        found[left[other], count[left[other]]] = here[other]
        count[left[other]] += 1
        at[left] = np.where(other, here + step, after[here])
        left = left[(at[left] >= 0) & (at[left] < n) & (count[left] < k)]
    return found


def nearest_on_a_line(a: pa.Table, b: pa.Table, k: int, max_distance: float) -> pa.Table:
    """(entity_id, v, doc, b_id, distance) of the k nearest rows of ``b`` (v, doc, b_id) to each query of ``a`` (entity_id, v,
    doc), ties to the smaller id: those of its own number and above to the right, those below to the left."""
    ids = b.column("b_id").combine_chunks()
    by_id = np.empty(len(ids), int)
    by_id[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
    code = {x: i for i, x in enumerate(dict.fromkeys([*a.column("doc").to_pylist(), *b.column("doc").to_pylist()]))}
    own, docs = (np.array([code[x] for x in t.column("doc").to_pylist()], int) for t in (a, b))
    q, v = a.column("v").to_numpy(), b.column("v").to_numpy()
    found = []
    for step, order in ((1, np.lexsort((by_id, v))), (-1, np.lexsort((-by_id, v)))):
        start = np.searchsorted(v[order], q) - (step < 0)
        at = first_of_others(docs[order], start, step, own, k + 1)
        i, place = np.nonzero(at >= 0)
        j = order[at[i, place]]
        d = np.abs(q[i] - v[j])
        kth = np.full(len(q), -1.0)
        kth[i[place == k - 1]] = d[place == k - 1]
        # numbers of one rounded distance are in order of id: where the next row is such a one, all rows are compared
        found.append((i, j, d, (place == k) & (d == kth[i]) & (d < max_distance)))
    i, j, d, odd = (np.concatenate(x) for x in zip(*found, strict=True))
    for x in np.unique(i[odd & (q[i] != v[j])]):
        y, keep = np.flatnonzero(docs != own[x]), i != x
        i, j, d = np.r_[i[keep], np.full(len(y), x)], np.r_[j[keep], y], np.r_[d[keep], np.abs(q[x] - v[y])]
    near = np.flatnonzero(d < max_distance)
    near = near[np.lexsort((by_id[j[near]], d[near], i[near]))]
    i, j, d = i[near], j[near], d[near]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    i, j, d = i[first], j[first], d[first]
    return pa.table([*[a.column(c).take(pa.array(i, pa.int64())) for c in ("entity_id", "v", "doc")], ids.take(pa.array(j, pa.int64())), pa.array(d, pa.float64())], ["entity_id", "v", "doc", "b_id", "distance"])


def near_on_a_line(new: DataFrame, stored: DataFrame, k: int, max_distance: float) -> DataFrame:
    """(a_id, b_id, distance) by the distance of two numbers (vector: a double): on a line the nearest rows are neighbours, so
    the work does not grow with the square of an entity. Ids are unique.

    Rows of one entity, number and document are one query. Of the rows of one number the k first of each of the k + 1
    documents that come first hold any document's first k; no others are passed on. Numbers meet in stretches of the
    limit's width, with both neighbours."""
    width = max_distance * (1 + SLACK)
    part = lambda facts, i: facts.where("document_id is not null and vector is not null").select("entity_id", F.col("vector").cast("double").alias("v"), F.col("document_id").alias("doc"), F.col("id").alias(i)).where("not isnan(v)").withColumn("cell", F.floor(F.col("v") / width))
    ask, rows = part(new, "a_id"), part(stored, "b_id")
    own = ["entity_id", "v", "doc"]
    rows = rows.withColumns({"n": F.row_number().over(Window.partitionBy(*own).orderBy("b_id")), "first": F.min("b_id").over(Window.partitionBy(*own))}).where(F.col("n") <= k)
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("entity_id", "v").orderBy("first", "doc"))).where(F.col("place") <= k + 1)
    rows = rows.select(*own, "b_id", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    a, b = dict(new.dtypes), dict(stored.dtypes)
    schema = f"entity_id {a['entity_id']}, v double, doc {a['document_id']}, b_id {b['id']}, distance double"
    run = lambda x, y: nearest_on_a_line(x, y, k, max_distance)
    asked = kept(ask.select(*own, "cell").distinct(), "line-queries")
    met = asked.groupBy("entity_id", "cell").cogroup(kept(rows, "line-rows").groupBy("entity_id", "cell")).applyInArrow(run, schema)
    return ask.select(*own, "a_id").join(met, own).select("a_id", "b_id", "distance")


def near_facts(new: DataFrame, stored: DataFrame, k: int, max_distance: float, compared: Accumulator | None = None) -> DataFrame:
    """(a_id, b_id, distance) by the cosine distance of vectors: within an entity, only cells in reach of the limit meet."""
    ask = new.where("document_id is not null").select(F.col("entity_id").alias("key"), F.col("id").alias("qid"), F.col("document_id").alias("qx"), F.col("vector").alias("q"))
    rows = stored.where("document_id is not null").select(F.col("entity_id").alias("key"), F.col("id").alias("rid"), F.col("document_id").alias("rx"), F.col("vector").alias("v"))
    found = search_in_keys(ask, rows, k, max_distance, compared).where("qid <> rid")
    return found.select(F.col("qid").alias("a_id"), F.col("rid").alias("b_id"), "distance")


def candidate_pairs(new: DataFrame, stored: DataFrame, k: int = MATCH_CANDIDATES, distance: Column | None = None, max_distance: float = MATCH_DISTANCE, heavy_pairs: int = HEAVY_PAIRS, line: bool = False) -> DataFrame:
    """(a, b, pair_a, pair_b): for each new fact its k nearest stored facts of the same entity in other documents, of
    which those with a matching predicate; pairs in order of id, each once (the first new fact's). The first k are taken
    before predicates are compared. Without ``distance``, that of the vectors' cosine counts; with ``line``, vectors are
    numbers and their distance is the difference (:func:`near_on_a_line`).

    Entities of more than ``heavy_pairs`` pairs are found first. Their facts meet in blocks, narrow, and details follow by
    id; so an entity that a third of all facts belong to (the one that stands for unresolved names, say) is many tasks."""
    by = F.abs(F.col("a_vector") - F.col("b_vector")) if line else cosine_distance(F.col("a_vector"), F.col("b_vector")) if distance is None else distance
    more = ["fact_type_id", "vector"]
    heavy = heavy_entities(new, stored, heavy_pairs)
    some = heavy.limit(1).count() > 0
    light = [facts.join(heavy, "entity_id", "left_anti") if some else facts for facts in (new, stored)]
    met = side(light[0], "a", *more).join(side(light[1], "b", *more), "entity_id").where("a_document_id <> b_document_id and a_id <> b_id")
    met = met.withColumn("distance", by).where(F.col("distance") < max_distance)
    met = top_k(met, ["a_id"], [F.col("distance").asc(), F.col("b_id").asc()], k)
    if some:
        own = [facts.join(heavy, "entity_id", "left_semi") for facts in (new, stored)]
        near = near_on_a_line(*own, k, max_distance) if line else near_facts(*own, k, max_distance) if distance is None else near_in_blocks(*own, k, by, max_distance)
        near = top_k(near, ["a_id"], [F.col("distance").asc(), F.col("b_id").asc()], k)
        full = near.join(side(own[0], "a", *more), "a_id").join(side(own[1], "b", *more).drop("entity_id"), "b_id")
        met = met.unionByName(full.select(*met.columns))
    met = met.where(predicates_match(F.col("a_predicate"), F.col("b_predicate"), F.col("a_fact_type_id"), F.col("b_fact_type_id")))
    pairs = met.select(as_struct("a").alias("a"), as_struct("b").alias("b"), F.least("a_id", "b_id").alias("pair_a"), F.greatest("a_id", "b_id").alias("pair_b"), "rank")
    w = Window.partitionBy("pair_a", "pair_b").orderBy(F.col("a.id"), "rank")
    return pairs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "rank")


def without_existing(pairs: DataFrame, relationships: DataFrame) -> DataFrame:
    have = relationships.select(F.col("fact_a_id").alias("pair_a"), F.col("fact_b_id").alias("pair_b"))
    return pairs.join(have, ["pair_a", "pair_b"], "left_anti")


NO_JUDGE = "no judge is configured"


def undecided(error: Column) -> dict[str, Column]:
    """The columns of a pair that no judge has decided: uncertain, with what went wrong."""
    return {"relation_type": F.lit("uncertain"), "confidence": F.lit(0.2), "method": F.lit("llm_judge"), "explanation": F.concat(F.lit("LLM judge call failed: "), error)}


def evaluate(pairs: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Rules decide what they can; the judge sees the escalated pairs only, and gives them relation_type, confidence and
    explanation. A pair without a type or a confidence is uncertain, with the judge's ``error`` of the pair, if it names one
    (:func:`judged_by` makes such a judge of a function over one pair). Without a judge the stand-in answers in the same
    pass; with one, the ruled pairs are written once, so that neither rules nor candidates run twice."""
    ruled = rule_reconcile(pairs)
    if judge is None:
        return ruled.withColumns({c: F.when(F.col("escalate"), x).otherwise(F.col(c)) for c, x in undecided(F.lit(NO_JUDGE)).items()})
    ruled = kept(ruled, "ruled")
    judged = judge(ruled.where("escalate").drop("relation_type", "confidence", "method", "explanation"))
    if "error" not in judged.columns:
        judged = judged.withColumn("error", F.lit(None).cast("string"))
    failed = F.col("relation_type").isNull() | F.col("confidence").isNull()
    answer = undecided(F.coalesce("error", F.lit("no answer")))
    judged = judged.withColumn("method", F.lit("llm_judge")).withColumns({c: F.when(failed, x).otherwise(F.col(c)) for c, x in answer.items() if c != "method"})
    return ruled.where("not escalate").unionByName(judged.select(*ruled.columns))


def judged_by(call: Callable[[dict, dict, dict], tuple[str, float, str]]) -> Callable[[DataFrame], DataFrame]:
    """A judge of pairs from a function of one: it gets both facts (id, predicate, value, raw_value, unit, currency,
    time_scope, qualifiers, source_quote, source_page) and the file names, and returns type, confidence and explanation. An
    exception is the error of its pair alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                docs = {"a": a.pop("filename", None) or "Document A", "b": b.pop("filename", None) or "Document B"}
                try:
                    kind, confidence, said = call(*({k: v for k, v in x.items() if k not in ("parsed", "document_id")} for x in (a, b)), docs)
                    rows.append((kind, float(confidence), said, None))
                except Exception as e:  # noqa: BLE001 - whatever a judge raises is the answer of its pair
                    rows.append((None, None, None, str(e) or type(e).__name__))
            kinds = (pa.string(), pa.float64(), pa.string(), pa.string())
            got = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.record_batch([*batch.columns, *got], [*batch.schema.names, "relation_type", "confidence", "explanation", "error"])

    def judge(pairs: DataFrame) -> DataFrame:
        kind = T.StructType([*pairs.schema.fields, *(T.StructField(c, t()) for c, t in (("relation_type", T.StringType), ("confidence", T.DoubleType), ("explanation", T.StringType), ("error", T.StringType)))])
        return pairs.mapInArrow(run, kind)

    return judge


def relationship_rows(decided: DataFrame) -> DataFrame:
    return decided.select(F.col("pair_a").alias("fact_a_id"), F.col("pair_b").alias("fact_b_id"), "relation_type", "explanation", "confidence", "method")
