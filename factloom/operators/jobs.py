"""The four jobs of the engine as batch functions: parse, extract, resolve, reconcile.

A job handles all documents that it is given at once and returns the next snapshots of the tables that it changes, so a
rerun of the same documents replaces what they had and changes nothing else. Models are injected functions. To let one
document's entities be matched by the next one's, run a job for each micro-batch of documents (``foreachBatch``).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.qualifiers import with_entry
from ..functions.text import batch_prompt, entity_embedding_input, fact_embedding_input, match_embedding_input, trimmed
from ..functions.vectors import cosine_distance
from ..sources.scratch import written
from ..sources.sinks import detached, upserted, without_documents
from . import entities as entity_ops
from . import facts as fact_ops
from . import pages as page_ops
from . import reconcile
from .in_order import leaders
from .nearest import TIE, search
from .similarity import knn_join

#: Expected output tokens and pages of a batch, pages of a vision call, neighbours and similarity of entities.
TARGET_TOKENS, MOST_PAGES, VISION_PAGES, NEIGHBOURS, ENTITY_MATCH = 14_000, 15, 3, 5, 0.80
#: A call of a model over pages (number, text): fact objects, and the tokens that it took (input, output).
Extractor = Callable[[list[tuple[int, str]]], tuple[list[dict], tuple[int, int]]]
REPLY = "batch bigint, pages array<int>, reply string, status string, calls bigint, input_tokens bigint, output_tokens bigint"


# -- parse


def parse_pages(pages: DataFrame, chunks: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    """pages (document_id, page_number, items, width, error; one row with an error for a file that cannot be read) as
    page chunks, upserted by (document, page, chunk): ``chunks`` and ``documents`` after the job. A page that failed does
    not stop the others; a document without any page has failed."""
    good = pages.where("error is null and page_number is not null").withColumn("runs", page_ops.text_runs(F.col("items")))
    whole = page_ops.classify_page(F.col("runs"), page_ops.raw_text(F.col("runs")), F.coalesce("width", F.lit(612.0)))
    cut = good.select("document_id", "page_number", whole.alias("c"), F.posexplode(page_ops.split_oversize(F.col("runs"))).alias("chunk_index", "position_data"))
    text = page_ops.raw_text(F.col("position_data"))
    made = cut.select(
        F.sha2(F.concat_ws("|", "document_id", "page_number", "chunk_index"), 256).alias("id"), "document_id", "page_number", "chunk_index", text.alias("raw_text"),
        F.col("c.is_table_heavy").alias("is_table_heavy"), F.col("c.is_low_text").alias("is_low_text"), F.col("c.vision_flagged").alias("needs_vision"),
        F.transform("position_data", lambda r: F.struct(r["fontName"].alias("fontName"), r["height"].alias("height"), F.col("page_number").alias("pageNumber"), r["text"].alias("text"), r["width"].alias("width"), r["x"].alias("x"), r["y"].alias("y"))).alias("position_data"), F.ceil(F.length(text) / 4).cast("int").alias("token_estimate"), F.lit("pending").alias("extraction_status"),
    )
    made = made.select(*[F.col(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in chunks.dtypes])
    found = pages.groupBy("document_id").agg(F.count_if(F.col("error").isNull() & F.col("page_number").isNotNull()).alias("__n"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("page_number")))).alias("__failed"), F.max("error").alias("__error"))
    lost = F.size("__failed")
    said = F.when(lost > 0, F.format_string("Failed to persist %d page(s): %s", lost, F.array_join(F.col("__failed").cast("array<string>"), ", "))).otherwise(F.col("__error"))
    done = documents.join(found.withColumnRenamed("document_id", "id"), "id", "left")
    own = F.col("__n").isNotNull()
    after = done.withColumns({
        "page_count": F.when(own, F.col("__n").cast("int")).otherwise(F.col("page_count")),
        "status": F.when(own, F.when(F.col("__n") == 0, "failed").otherwise("parsed")).otherwise(F.col("status")),
        "error_message": F.when(own, said).otherwise(F.col("error_message")),
    }).drop("__n", "__failed", "__error")
    return {"chunks": upserted(chunks, made, ["document_id", "page_number", "chunk_index"], keep=["id", "extraction_status"]), "documents": after.select(*documents.columns)}


# -- extract


def called(pages: DataFrame, extractor: Extractor, retry: bool, blame: Callable[[int, int], int | None] | None = None) -> DataFrame:
    """The extractor over each (document_id, batch) of pages (page_number, text): a row for each fact object (reply) and one
    for each call (status extracted or failed, with its tokens). With ``retry`` a failed batch of several pages is split once.
    blame: which page an object without one belongs to, given its number and the number of pages (None: none)."""
    kind = pages.schema["document_id"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []

        def call(batch: list[tuple[int, str]], depth: int) -> None:
            numbers = [n for n, _ in batch]
            try:
                found, (given, taken) = extractor(batch)
            except Exception:  # noqa: BLE001 - whatever a model's client raises fails the batch alone
                if retry and depth < 1 and len(batch) > 1:
                    half = -(-len(batch) // 2)
                    call(batch[:half], depth + 1)
                    call(batch[half:], depth + 1)
                else:
                    rows.append((numbers, None, "extraction_failed", 1, 0, 0))
                return
            rows.append((numbers, None, "extracted", 1, given, taken))
            for i, fact in enumerate(found):
                page = blame(i, len(batch)) if blame else None
                if not isinstance(fact.get("pageNumber"), int) and page is not None:
                    fact = fact | {"pageNumber": numbers[page]}
                rows.append((numbers, json.dumps({"facts": [fact]}), None, 0, 0, 0))

        listed = pdf.sort_values("page_number")
        call(list(zip(listed["page_number"].tolist(), listed["text"].tolist(), strict=True)), 0)
        return pd.DataFrame([(key[0], key[1], *r) for r in rows], columns=["document_id", *(c.split()[0] for c in REPLY.split(", "))])

    return pages.groupBy("document_id", "batch").applyInPandas(run, f"document_id {kind}, {REPLY}")


def read_calls(calls: DataFrame, via_vision: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of written calls: facts on the pages they were asked for, (document_id, page_number, status) of pages, and usage."""
    read = fact_ops.read_facts(calls.where("reply is not null").select("document_id", "pages", "reply"), via_vision=via_vision)
    facts = read.where(F.array_contains("pages", F.col("page_number"))).drop("pages", "error")
    done = calls.where("status is not null")
    return facts, done.select("document_id", F.explode("pages").alias("page_number"), "status"), done.select("document_id", "calls", "input_tokens", "output_tokens")


def usage_totals(usage: DataFrame) -> DataFrame:
    """(document_id, calls, input_tokens, output_tokens): sums over all calls of a document."""
    return usage.groupBy("document_id").agg(*[F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens")])


def in_groups(pages: DataFrame, size: int) -> DataFrame:
    w = Window.partitionBy("document_id").orderBy("page_number")
    return pages.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("bigint"))


def one_of(i: int, n: int) -> int | None:
    return i % n


def only_page(i: int, n: int) -> int | None:
    return 0 if n == 1 else None


def extract_documents(chunks: DataFrame, facts: DataFrame, types: DataFrame, extractor: Extractor, embed: Callable[[Column], Column], vision: Extractor | None = None, skip_boilerplate: bool = True, target: int = TARGET_TOKENS, most: int = MOST_PAGES) -> dict[str, DataFrame]:
    """``facts``, ``types`` and ``chunks`` after the job, and ``usage`` (a row a document). chunks: those of the documents to
    extract. Pages with few texts go to ``vision``, or are deferred without one; weak table pages are asked
    again there, and keep their own facts if that fails; duplicates get copies of their first page's facts."""
    pages = page_ops.group_chunks(chunks).join(chunks.groupBy("document_id", "page_number").agg(F.sum(F.coalesce(F.size("position_data"), F.lit(0))).alias("n_runs")), ["document_id", "page_number"])
    pages = page_ops.deduplicate_pages(pages.withColumn("text", F.col("raw_text")), enabled=skip_boilerplate)
    pages = written(pages.withColumn("route", page_ops.route(F.col("raw_text"), F.col("n_runs"), F.col("is_low_text"), F.col("is_table_heavy"), vision is not None)), "pages")
    own = pages.where("canonical_page = page_number").select("document_id", "page_number", F.col("compacted_text").alias("text"), "route", "is_table_heavy")

    texts = own.where(F.col("route").isin("extract-text", "extract-text-table"))
    packed = page_ops.pack_pages(texts.withColumn("token_estimate", F.ceil(F.length("text") / 4).cast("int")), "document_id", target, most)
    batches = texts.join(packed.select("document_id", "page_number", F.col("batch").cast("bigint").alias("batch")), ["document_id", "page_number"])
    found, states, usage = read_calls(written(called(batches, extractor, True, only_page), "text-calls"), False)
    if vision is not None:
        asked = texts.join(states.where("status = 'extracted'").drop("status"), ["document_id", "page_number"], "left_semi")
        weak = fact_ops.escalation_pages(asked, found, ["document_id", "page_number"])
        again, _, used = read_calls(written(called(in_groups(weak, VISION_PAGES), vision, False, only_page), "escalations"), True)
        seen, looked, paid = read_calls(written(called(in_groups(own.where("route = 'extract-vision'"), VISION_PAGES), vision, False, one_of), "vision-calls"), True)
        found, states, usage = found.unionByName(again).unionByName(seen), states.unionByName(looked), usage.unionByName(used).unionByName(paid)
    found = fact_ops.copy_to_duplicates(found.withColumnRenamed("page_number", "source_page"), pages.select("document_id", "page_number", "canonical_page"))

    fresh, types = fact_rows(found, pages, types, embed)
    other = F.when(F.col("canonical_page") != F.col("page_number"), "extracted").when(F.col("route") == "skip", "extracted").when(F.col("route") == "defer-vision-disabled", "extraction_deferred")
    states = pages.select("document_id", "page_number", other.alias("s")).join(states.groupBy("document_id", "page_number").agg(F.max("status").alias("status")), ["document_id", "page_number"], "left")
    states = states.select("document_id", "page_number", F.coalesce("s", "status").alias("__status"))
    chunks_after = chunks.join(states, ["document_id", "page_number"], "left").withColumn("extraction_status", F.coalesce("__status", "extraction_status")).drop("__status")
    kept = without_documents(facts, chunks.select("document_id").distinct())
    return {"facts": kept.unionByName(fresh, allowMissingColumns=True), "types": types, "chunks": chunks_after.select(*chunks.columns), "usage": usage_totals(usage)}


def fact_rows(found: DataFrame, pages: DataFrame, types: DataFrame, embed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """Fact rows of extracted facts, and the types after them: quotes are checked on the page's whole text, the entity is
    kept in the qualifiers, descriptions are linked to types. Ids are the same in every run."""
    texts = pages.select("document_id", F.col("page_number").alias("source_page"), F.col("raw_text").alias("page_text"), F.col("first_chunk_index").alias("source_chunk_index"))
    got = fact_ops.check_quotes(found.join(texts, ["document_id", "source_page"], "left"))
    entity = F.to_json(F.struct(F.col("entity_context").alias("context"), F.col("entity_name").alias("name"), F.col("entity_type").alias("type")))
    w = Window.partitionBy("document_id", "source_page").orderBy(F.xxhash64(*[c for c in got.columns if c != "page_text"]), "value", "source_quote")
    got = got.withColumn("qualifiers", with_entry(F.col("qualifiers"), "_entity", entity)).withColumn("id", F.sha2(F.concat_ws("|", "document_id", "source_page", F.row_number().over(w)), 256))
    got = written(got.withColumn("embedding", embed(fact_embedding_input(F.col("entity_name"), F.col("predicate"), F.col("value")))), "facts")
    key = lambda c: F.lower(trimmed(F.col(c)))
    first = got.groupBy("fact_type_description").agg(F.min_by("predicate", "id").alias("predicate"), F.min("id").alias("idx")).withColumnRenamed("fact_type_description", "description")
    linked = fact_ops.link_fact_types(first.withColumn("q", embed(F.concat(F.lit("category: "), F.col("description")))), types)
    linked = written(linked, "linked-types")
    names = linked.select(key("description").alias("__d"), F.coalesce("type_id", fact_ops.type_id_of(F.col("description"))).alias("fact_type_id"))
    rows = got.withColumn("__d", key("fact_type_description")).join(names, "__d", "left")
    rows = rows.withColumns({"entity_id": F.lit(None).cast("string"), "extracted_at": F.current_timestamp()})
    return rows.select("id", "document_id", "entity_id", "fact_type_id", "predicate", "value", "raw_value", "unit", "currency", "time_scope", "qualifiers", "embedding", "confidence", "source_page", "source_chunk_index", "source_quote", "source_quote_valid", "extracted_at"), fact_ops.types_after(types, linked)


# -- resolve


def entity_id_of(name: Column) -> Column:
    """The id of an entity that a name mints: the same in every run."""
    return F.sha2(F.lower(name), 256)


def stored_options(nodes: DataFrame, entities: DataFrame, same: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(node, distance, entity_id): the nearest stored entities that a node is near and confirmed to be."""
    rows = entities.where("embedding is not null").select(F.col("id").alias("entity_id"), F.col("embedding").alias("v"))
    near = knn_join(nodes.select("node", "q"), rows, [], "node", "entity_id", NEIGHBOURS).where(1 - F.col("distance") >= threshold)
    near = near.join(nodes.select("node", F.col("canonical_name").alias("name"), "context"), "node").join(entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("other"), F.col("context_sample").alias("other_context")), "entity_id")
    return written(same(near).select("node", "distance", "entity_id"), "stored-options")


def sibling_pairs(nodes: DataFrame, same: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(qid, rid, distance, v, u) of the nodes of one batch, of different names, that are near and confirmed to be the same."""
    side = lambda a, b: nodes.select(F.col("node").alias(a), F.lit(None).cast("bigint").alias(b), F.col("q").alias("q" if a == "qid" else "v"))
    pairs = search(side("qid", "qx"), side("rid", "rx"), None, 1 - threshold + TIE).where(1 - F.col("distance") >= threshold).where("qid <> rid")
    pairs = pairs.join(nodes.select(F.col("node").alias("qid"), F.col("canonical_name").alias("name"), "context", "v"), "qid")
    pairs = pairs.join(nodes.select(F.col("node").alias("rid"), F.col("canonical_name").alias("other"), F.col("context").alias("other_context"), F.col("v").alias("u")), "rid")
    return written(same(pairs.where(F.lower("name") != F.lower("other"))).select("qid", "rid", "distance", "v", "u"), "sibling-pairs")


def chosen_entities(clusters: DataFrame, nodes: DataFrame, stored: DataFrame, pairs: DataFrame, known: DataFrame, same: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(document_id, cluster, matched): the nearest entity that a cluster is confirmed to be, of the stored ones and those that
    earlier clusters of the batch lead; earlier by document_id, then cluster. A cluster leads if no stored entity is near and
    confirmed, none has its name, and neither an earlier leader; all siblings within the threshold count, not only the
    nearest ``NEIGHBOURS``."""
    named_nodes = nodes.withColumn("name", F.lower("canonical_name"))
    free = named_nodes.join(stored.select("node").distinct(), "node", "left_anti").join(known.select(F.col("__k").alias("name")), "name", "left_anti")
    free = written(free.select("v", "name"), "free")
    edges = pairs.select("v", "u").join(free.select("v"), "v", "left_semi").join(free.select(F.col("v").alias("u")), "u", "left_semi")
    lead = written(named_nodes.join(leaders(free, edges), "v", "left_semi").select(F.col("v").alias("u"), F.col("node").alias("rid"), "name", F.col("canonical_name").alias("other"), F.col("context").alias("other_context"), F.col("q").alias("w")), "leaders")
    of = nodes.select("node", F.col("canonical_name").alias("c"), F.col("context").alias("x"), "q")
    mine = clusters.select(F.struct("document_id", "cluster").alias("at"), "canonical_name", "context").join(of, F.col("canonical_name").eqNullSafe(F.col("c")) & F.col("context").eqNullSafe(F.col("x")))
    mine = mine.select("at", "node", F.lower("canonical_name").alias("name"), "canonical_name", "context", "q")
    others = mine.join(pairs.select(F.col("qid").alias("node"), "rid", "distance"), "node").join(lead.select("rid", "u", "other"), "rid").where("u < at")
    named = mine.join(lead, "name").where("u < at").withColumn("distance", cosine_distance(F.col("q"), F.col("w"))).where(1 - F.col("distance") >= threshold)
    named = same(named.drop("name").withColumnRenamed("canonical_name", "name"))
    option = lambda df, kind, entity: df.select("at", "distance", F.lit(kind).alias("kind"), entity.alias("entity_id"))
    options = option(mine.join(stored, "node"), 0, F.col("entity_id")).unionByName(option(others, 1, entity_id_of(F.col("other")))).unionByName(option(named, 1, entity_id_of(F.col("other"))))
    chosen = options.groupBy("at").agg(F.min_by("entity_id", F.struct("distance", "kind", "entity_id")).alias("matched"))
    return written(chosen.select("at.*", "matched"), "chosen")


def resolve_documents(facts: DataFrame, documents: DataFrame, entities: DataFrame, aliases: DataFrame, embed: Callable[[Column], Column], confirm: Callable[[Column, Column, Column, Column], Column], threshold: float = ENTITY_MATCH) -> dict[str, DataFrame]:
    """``facts``, ``entities`` and ``aliases`` after the job for the documents (document_id), and ``results`` (a row a
    document). Names of a document are clustered; clusters are matched as if one after another, by document and place: to
    the nearest stored entities and those that earlier clusters have led to. A cluster is the nearest one that ``confirm``
    (name, context, other name, other context) says is the same, else the entity of its name, old or new. Facts that nothing
    names belong to the entity that stands for all such.

    Facts are shuffled once, by document: what their names come to is found in windows over them and not written. Written are
    the merged forms of documents, the clusters of one name and context as one node, which lead or follow together, with the
    nodes' vectors and near pairs, and the clusters that are confirmed to be another entity."""
    ours = facts.join(documents.select("document_id"), "document_id", "left_semi")
    formed = entity_ops.with_forms(ours.withColumn("idx", F.row_number().over(Window.partitionBy("document_id").orderBy("id"))).withColumns(fact_ops.mentioned()))
    placed = entity_ops.with_clusters(formed, entity_ops.form_labels(formed))
    clusters = entity_ops.elect(formed, placed)
    own = clusters.select("canonical_name", "context", "entity_type", F.struct("document_id", "cluster").alias("v"))
    nodes = own.groupBy("canonical_name", "context").agg(F.min("v").alias("v"), F.min_by("entity_type", "v").alias("entity_type"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("q", embed(entity_embedding_input(F.col("canonical_name"), F.col("context")))), "nodes")

    same = lambda rows: rows.withColumn("same", confirm(F.col("name"), F.col("context"), F.col("other"), F.col("other_context"))).where("same")
    known = written(entities.groupBy(F.lower("canonical_name").alias("__k")).agg(F.min("id").alias("old")), "names")
    stored, pairs = stored_options(nodes, entities, same, threshold), sibling_pairs(nodes, same, threshold)
    fresh = nodes.withColumn("__k", F.lower("canonical_name")).join(known, "__k", "left_anti")
    placed = placed.withColumn("__k", F.lower("canonical_name")).join(entity_ops.shared(known), "__k", "left")
    if stored.limit(1).count() or pairs.limit(1).count():  # else each has the entity of its name, whoever leads
        chosen = chosen_entities(clusters, nodes, stored, pairs, known, same, threshold)
        fresh = fresh.join(chosen.select(F.struct("document_id", "cluster").alias("v")), "v", "left_anti")
        placed = placed.join(entity_ops.shared(chosen), ["document_id", "cluster"], "left")
    else:
        placed = placed.withColumn("matched", F.lit(None).cast("string"))
    placed = placed.withColumn("entity_id", F.coalesce("matched", "old", entity_id_of(F.col("canonical_name"))))

    # a node whose first cluster is another entity is so in all of its clusters
    fresh = fresh.groupBy("__k").agg(F.min_by(F.struct("canonical_name", "entity_type", F.col("context").alias("context_sample"), F.col("q").alias("embedding")), "v").alias("x"))
    fresh = fresh.select(entity_id_of(F.col("__k")).alias("id"), "x.*").join(entities.select("id"), "id", "left_anti")
    spare = entities.where(F.lower("canonical_name") == F.lower(F.lit(entity_ops.UNRESOLVED))).agg(F.min("id").alias("spare")).first().spare
    stand_in = ours.where("id is null").limit(1).select(entity_id_of(F.lit(entity_ops.UNRESOLVED)).alias("id"), F.lit(entity_ops.UNRESOLVED).alias("canonical_name"), F.lit("unknown").alias("entity_type"), F.lit("Fallback entity for unlinked facts").alias("context_sample"))
    fresh = fresh.unionByName(stand_in.where(F.lit(spare is None)), allowMissingColumns=True)
    linked = placed.withColumn("entity_id", F.coalesce(F.when(F.col("id").isNotNull(), F.col("entity_id")), entity_id_of(F.lit(entity_ops.UNRESOLVED)) if spare is None else F.lit(spare)))
    said = placed.groupBy("document_id", "cluster").agg(F.first("entity_id").alias("entity_id"), F.collect_set("form_name").alias("forms")).select("entity_id", F.explode("forms").alias("surface_form"), "document_id", F.lit(1.0).cast("float").alias("confidence"))
    said = said.withColumn("id", F.sha2(F.concat_ws("|", "entity_id", "surface_form", "document_id"), 256))
    counts = placed.groupBy("document_id").agg(F.count_distinct("cluster").alias("entities_resolved"), F.count("*").alias("facts_linked"))
    return {
        "facts": without_documents(facts, documents).unionByName(linked.select(*facts.columns)),
        "entities": entities.unionByName(fresh, allowMissingColumns=True),
        "new_entities": fresh,
        "aliases": without_documents(aliases, documents).unionByName(said, allowMissingColumns=True),
        "results": documents.select("document_id").join(counts, "document_id", "left").na.fill(0),
    }


# -- reconcile


def document_facts(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with the name of their entity."""
    return facts.join(entities.select(F.col("id").alias("entity_id"), F.col("canonical_name").alias("entity_name")), "entity_id", "left")


def reconcile_documents(facts: DataFrame, documents: DataFrame, entities: DataFrame, relationships: DataFrame, embed_query: Callable[[Column], Column], judge: Callable[[DataFrame], DataFrame] | None = None, k: int = reconcile.MATCH_CANDIDATES, max_distance: float = reconcile.MATCH_DISTANCE, files: DataFrame | None = None) -> dict[str, DataFrame]:
    """``relationships`` after the job for the documents (document_id), and ``counters`` (one row). Only facts of these
    documents are on the query side; pairs that have a relationship are left as they are. For a rerun of everything, give
    all documents. ``files`` (document_id, filename) names the documents of both sides for the judge."""
    if files is not None:
        facts = facts.join(files.select("document_id", "filename"), "document_id", "left")
    new = document_facts(facts.join(documents.select("document_id"), "document_id", "left_semi"), entities)
    no_entity = F.col("entity_id").isNull()
    seen = Observation("facts")
    vector = embed_query(match_embedding_input(F.col("entity_name"), F.col("predicate"), F.col("value")))
    new = new.observe(seen, F.count_if(no_entity).alias("skipped_no_entity"), F.count_if(~no_entity & F.col("embedding").isNull()).alias("skipped_no_embedding"))
    asked = written(new.where("entity_id is not null and embedding is not null").withColumn("vector", vector), "asked")
    pairs = reconcile.candidate_pairs(asked, facts.where("embedding is not null").withColumn("vector", F.col("embedding")), k, None, max_distance)
    judged = Observation("pairs")
    decided = reconcile.evaluate(reconcile.without_existing(pairs, relationships), judge)
    decided = written(decided.observe(judged, F.count("*").alias("pairs_evaluated"), F.count_if(~F.col("escalate")).alias("rule_resolved"), F.count_if(F.col("escalate")).alias("judge_calls")), "decided")
    rows = reconcile.relationship_rows(decided).withColumn("id", F.sha2(F.concat_ws("|", "fact_a_id", "fact_b_id"), 256))
    counted = seen.get | judged.get
    counted["relationships_created"] = counted["pairs_evaluated"]
    one = facts.sparkSession.createDataFrame([tuple(counted[c] for c in COUNTERS)], ", ".join(f"{c} bigint" for c in COUNTERS))
    return {"relationships": relationships.unionByName(rows, allowMissingColumns=True), "new_relationships": rows, "counters": one}


#: The counters of a reconcile job, observed while its tables are written.
COUNTERS = ("skipped_no_entity", "skipped_no_embedding", "pairs_evaluated", "rule_resolved", "judge_calls", "relationships_created")


# -- documents


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the documents (document_id): chunks, facts and relationships of them go, aliases lose the link."""
    facts = without_documents(tables["facts"], gone)
    lost = tables["facts"].join(gone.select("document_id"), "document_id", "left_semi").select("id")
    pairs = tables["relationships"]
    for side in ("fact_a_id", "fact_b_id"):
        pairs = pairs.join(lost.select(F.col("id").alias(side)), side, "left_anti")
    own = gone.select(F.col("document_id").alias("id"))
    return tables | {"documents": tables["documents"].join(own, "id", "left_anti"), "chunks": without_documents(tables["chunks"], gone), "facts": facts, "relationships": pairs.select(*tables["relationships"].columns), "aliases": detached(tables["aliases"], gone, "document_id", "document_id")}


def extraction_prompt(pages: Column) -> Column:
    """The text of a batch of pages array<struct<page_number, text>> for an extractor."""
    return F.concat(F.lit(PROMPT), batch_prompt(pages))


#: What an extractor is asked for, in words of this engine.
PROMPT = """Read the pages below and list the facts they state as JSON: {"facts": [...]}.
A fact has entity {name, type, context}, predicate, value, rawValue, unit, currency, timeScope, qualifiers,
factTypeDescription, confidence (0 to 1), sourceQuote and pageNumber.
- Quote the page word for word; give the page that the quote stands on.
- Give one fact for each metric, scope and document; do not infer what is not written.
- Keep values as they are written in rawValue, and as plain numbers in value.

"""
