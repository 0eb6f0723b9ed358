"""Facts: reading loose records, checking quotes, fact types, copies for duplicate pages, escalation."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.qualifiers import with_entry
from ..functions.text import is_number, kind_of, quote_bucket, quote_is_valid, trimmed, unfenced
from .in_order import leaders
from .nearest import TIE, kept, search
from .similarity import nearest_one

#: Words that a quote and a page must share in a row to be compared.
ANCHOR = 4
#: Characters of short quotes that pages are searched for at once.
SHORT_CHARS = 4_000_000
STRONG = 0.7
BUCKETS = ["0-100", "101-400", "401-1000", "1000+"]


def read_facts(replies: DataFrame, column: str = "reply", default_page: Column | None = None, via_vision: bool | None = None) -> DataFrame:
    """One row a fact of JSON replies ({"facts": [...]}, fenced or not): typed fields with defaults for loose ones, and
    ``error`` for replies that cannot be read. Numbers and texts count only where they are such: other confidences are 0,
    other page numbers ``default_page``."""
    rows = replies.withColumn("__facts", F.from_json(unfenced(F.col(column)), "facts array<string>")["facts"])
    rows = rows.withColumn("error", F.when(F.col("__facts").isNull(), "unreadable reply")).withColumn("__f", F.explode_outer("__facts"))
    rows = rows.withColumn("__v", F.try_parse_json("__f")).drop("__facts", column)
    v = F.col("__v")
    value = lambda key, kind="string": F.try_variant_get(v, f"$.{key}", kind)
    text = lambda key: F.when(kind_of(v, f"$.{key}") == "STRING", value(key))
    said = lambda key: F.coalesce(value(key), F.lit(""))
    has_entity = kind_of(v, "$.entity").isNotNull() & (kind_of(v, "$.entity") != "VOID")
    entity = lambda key, other: F.when(has_entity, value(f"entity.{key}")).otherwise(other)
    qualifiers = F.when(kind_of(v, "$.qualifiers").rlike("^(OBJECT|ARRAY)"), merged_qualifiers(F.get_json_object("__f", "$.qualifiers")))
    page = F.lit(None).cast("int") if default_page is None else default_page
    fields = [
        F.when(is_number(v, "$.confidence"), value("confidence", "double")).otherwise(0.0).alias("confidence"), text("currency").alias("currency"),
        entity("name", "Unknown").alias("entity_name"), entity("type", "Unknown").alias("entity_type"), entity("context", "").alias("entity_context"),
        said("factTypeDescription").alias("fact_type_description"), said("predicate").alias("predicate"), F.coalesce(qualifiers, F.lit("{}")).alias("qualifiers"),
        said("rawValue").alias("raw_value"), said("sourceQuote").alias("source_quote"), text("timeScope").alias("time_scope"), text("unit").alias("unit"), said("value").alias("value"),
        F.when(is_number(v, "$.pageNumber"), value("pageNumber", "int")).otherwise(page).alias("page_number"),
        F.when(kind_of(v, "$.viaVision") == "BOOLEAN", value("viaVision", "boolean")).otherwise(F.lit(via_vision).cast("boolean")).alias("via_vision"),
    ]
    return rows.select(*[c for c in rows.columns if not c.startswith("__")], *fields)


def merged_qualifiers(q: Column) -> Column:
    """Qualifiers as one object: an array of {key, value} is folded, later keys win."""
    pairs = F.from_json(q, "array<struct<key: string, value: string>>")
    folded = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], p["value"])))
    return F.when(F.ltrim(q).startswith("["), F.to_json(folded)).otherwise(q)


def check_quotes(facts: DataFrame, page_text: str = "page_text") -> DataFrame:
    """Facts with source_quote_valid, confidence and qualifiers after the check of their quotes: vision facts are marked,
    wrong quotes halve the confidence."""
    vision = F.coalesce(F.col("via_vision"), F.lit(False))
    valid = quote_is_valid(F.col("source_quote"), F.col(page_text))
    halved = F.round(0.5 * F.col("confidence").cast("double"), 4)
    return facts.withColumns({
        "source_quote_valid": ~vision & valid,
        "confidence": F.when(vision | valid, F.col("confidence").cast("double")).otherwise(halved),
        "qualifiers": F.when(vision, with_entry(F.col("qualifiers"), "visionOnly", "true")).when(valid, F.col("qualifiers")).otherwise(with_entry(F.col("qualifiers"), "quoteMismatch", "true")),
    })


def quotes_in_pages(quotes: DataFrame, pages: DataFrame, quote_id: str, page_id: str) -> DataFrame:
    """(quote_id, page_id) of every page (page_id, page_text) that contains a quote (quote_id, source_quote) word for word.
    Candidates share the first ``ANCHOR`` words inside the quote (its first and last word may be parts of words); pages are
    searched for all quotes of fewer words at once (:func:`short_quotes_in_pages`)."""
    words = lambda c: F.filter(F.split(c, "\\s+"), lambda w: w != "")
    inner = quotes.where("source_quote <> ''").withColumn("__w", words(F.col("source_quote")))
    long = F.size("__w") >= ANCHOR + 2
    run = lambda w, i: F.xxhash64(F.slice(w, i, F.lit(ANCHOR)))
    keyed = inner.where(long).select(quote_id, "source_quote", run(F.col("__w"), F.lit(2)).alias("__k"))
    listed = pages.select(page_id, "page_text", words(F.col("page_text")).alias("__w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("__w") - ANCHOR + 1, F.lit(1)))
    anchored = listed.select(page_id, "__w").select(page_id, F.explode(F.array_distinct(F.transform(starts, lambda i: run(F.col("__w"), i)))).alias("__k"))
    near = anchored.join(keyed.select(quote_id, "__k"), "__k").select(quote_id, page_id).distinct()
    met = near.join(quotes.select(quote_id, "source_quote"), quote_id).join(pages.select(page_id, "page_text"), page_id)
    found = met.where(F.contains("page_text", "source_quote")).select(quote_id, page_id)
    return found.unionByName(short_quotes_in_pages(inner.where(~long).select(quote_id, "source_quote"), pages, quote_id, page_id))


def short_quotes_in_pages(quotes: DataFrame, pages: DataFrame, quote_id: str, page_id: str, block: int = SHORT_CHARS) -> DataFrame:
    """(quote_id, page_id) as above, by an automaton over the distinct quotes, which goes through each page once. Quotes of
    over ``block`` characters together are dealt to blocks of about that size, one after another."""
    spark = pages.sparkSession
    texts = kept(quotes.select("source_quote").distinct(), "short-quotes")
    size = texts.agg(F.sum(F.length("source_quote")).alias("n")).first()["n"] or 0
    n = -(-size // block)
    kind = dict(pages.dtypes)[page_id]
    found = spark.createDataFrame([], f"{page_id} {kind}, source_quote string")

    def searched(words: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for i, w in enumerate(words.value):
                automaton.add_word(w, i)
            automaton.make_automaton()
            for batch in batches:
                hits = [(i, q) for i, t in enumerate(batch.column(1).to_pylist()) if t for q in {q for _, q in automaton.iter(t)}]
                if hits:
                    rows, which = zip(*hits, strict=True)
                    yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([words.value[q] for q in which])], [page_id, "source_quote"])

        return pages.select(page_id, "page_text").mapInArrow(run, f"{page_id} {kind}, source_quote string")

    for i in range(n):
        own = texts if n == 1 else texts.where(F.pmod(F.xxhash64("source_quote"), F.lit(n)) == i)
        listed = own.toArrow().column(0).to_pylist()
        if not listed:
            continue
        words = spark.sparkContext.broadcast(listed)
        found = found.unionByName(kept(searched(words), "short-hits"))
        words.destroy()
    return found.join(quotes, "source_quote").select(quote_id, page_id)


def allowed_only(facts: DataFrame, allowed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts of allowed pages, and how many were dropped (one row)."""
    return facts.join(allowed.select(*keys).distinct(), keys, "left_semi"), facts.join(allowed.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("dropped"))


def escalation_pages(pages: DataFrame, facts: DataFrame, keys: list[str], strong: float = STRONG) -> DataFrame:
    """Table-heavy pages without a fact, or with none of ``strong`` confidence."""
    best = facts.groupBy(*keys).agg(F.max("confidence").alias("best"))
    return pages.where("is_table_heavy").join(best, keys, "left").where(F.col("best").isNull() | (F.col("best") < strong)).drop("best")


def copy_to_duplicates(facts: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Facts, and a copy of each for every duplicate (document_id, page_number, canonical_page) of its page."""
    copies = facts.join(duplicates.where("page_number <> canonical_page").select("document_id", F.col("page_number").alias("__copy"), F.col("canonical_page").alias("source_page")), ["document_id", "source_page"])
    return facts.unionByName(copies.withColumn("source_page", F.col("__copy")).select(*facts.columns))


def mentioned() -> dict[str, Column]:
    """name, type and context of a fact: the entity that its qualifiers carry, trimmed. A missing name is Unknown Entity, a
    missing type null, and a missing context the quote."""
    entity = F.coalesce(F.get_json_object("qualifiers", "$._entity"), F.get_json_object("qualifiers", "$.entity"))
    part = lambda key: F.nullif(trimmed(F.get_json_object(entity, f"$.{key}")), F.lit(""))
    return {"name": F.coalesce(part("name"), F.lit("Unknown Entity")), "type": part("type"), "context": F.coalesce(part("context"), F.nullif("source_quote", F.lit("")))}


def mentions(facts: DataFrame) -> DataFrame:
    """(document_id, fact_id, idx, name, type, context) of facts, as :func:`mentioned` has them."""
    return facts.select("document_id", F.col("id").alias("fact_id"), "idx", *[c.alias(k) for k, c in mentioned().items()])


def quote_lengths(facts: DataFrame) -> DataFrame:
    """(bucket, n) of source quotes; every bucket has a row."""
    spark = facts.sparkSession
    every = spark.range(len(BUCKETS)).select(F.get(F.array(*map(F.lit, BUCKETS)), F.col("id").cast("int")).alias("bucket"))
    counted = facts.groupBy(quote_bucket(F.col("source_quote")).alias("bucket")).agg(F.count("*").alias("n"))
    return every.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def duplicate_rate(facts: DataFrame) -> DataFrame:
    """One row (total, duplicates, rate) of repeated (predicate, value, period) triples."""
    per = facts.groupBy("predicate", "value", F.coalesce("time_scope", F.lit("")).alias("t")).agg(F.count("*").alias("n"))
    got = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return got.select("total", "duplicates", F.when(F.col("total") > 0, F.col("duplicates") / F.col("total")).otherwise(0.0).alias("rate"))


def link_fact_types(descriptions: DataFrame, types: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Each distinct description (description, predicate, q: vector, idx) with type_id, or minted, as if they were handled in
    order of idx: the exact description first, else the nearest type from ``threshold`` on, of those stored and those that
    earlier descriptions have minted. The first predicate of a description counts; of types of one description the one
    of the smallest id. A minted type's id is :func:`type_id_of`; minted rows have none yet."""
    first = descriptions.withColumn("__n", F.row_number().over(Window.partitionBy(F.lower(trimmed(F.col("description")))).orderBy("idx"))).where("__n = 1").drop("__n")
    exact = kept(first.join(types.groupBy("description").agg(F.min("id").alias("exact_id")), "description", "left"), "descriptions")
    rest = exact.where("exact_id is null").select(F.col("idx").alias("query"), "q")
    stored = nearest_one(rest, types.where("embedding is not null").select(F.col("id").alias("near_id"), F.col("embedding").alias("v")), "query", "near_id").where(F.col("similarity") >= threshold)
    stored = kept(stored, "near-types")
    mine = lambda c: F.col("query").cast("string").alias(c)
    near = search(rest.select(F.col("query").alias("qid"), mine("qx"), "q"), rest.select(F.col("query").alias("rid"), mine("rx"), F.col("q").alias("v")), None, 1 - threshold + TIE)
    near = kept(near.where((1 - F.col("distance") >= threshold) & (F.col("rid") < F.col("qid"))), "near-descriptions")
    open_ = rest.join(stored, "query", "left_anti").select(F.col("query").alias("v"), F.lit(None).cast("string").alias("name"))
    edges = near.select(F.col("qid").alias("v"), F.col("rid").alias("u"))
    lead = leaders(open_, edges.join(open_, "v", "left_semi").join(open_.select(F.col("v").alias("u")), "u", "left_semi"))
    minted = lead.join(exact.select(F.col("idx").alias("v"), "description"), "v").select(F.col("v").alias("rid"), type_id_of(F.col("description")).alias("id"))
    options = stored.select("query", (1 - F.col("similarity")).alias("d"), F.lit(0).alias("k"), F.col("near_id").alias("id"))
    options = options.unionByName(near.join(minted, "rid").select(F.col("qid").alias("query"), F.col("distance").alias("d"), F.lit(1).alias("k"), "id"))
    best = options.groupBy("query").agg(F.min_by("id", F.struct("d", "k", "id")).alias("near_id"))
    got = exact.join(best, exact.idx == best.query, "left").join(lead.select(F.col("v").alias("idx"), F.lit(True).alias("minted")), "idx", "left")
    return got.select("idx", "description", "predicate", "q", F.coalesce("exact_id", "near_id").alias("type_id"), F.coalesce("minted", F.lit(False)).alias("minted"))


def type_id_of(description: Column) -> Column:
    """The id of a type that a description mints: the same in every run."""
    return F.sha2(F.lower(trimmed(description)), 256)


def types_after(types: DataFrame, linked: DataFrame) -> DataFrame:
    """Types (id, name, description, example_predicates, embedding) after the links of link_fact_types(): minted ones are
    named after their predicates, and each linked type, stored or minted, has the predicates that it did not have yet."""
    more = linked.where("not minted").groupBy(F.col("type_id").alias("id")).agg(F.array_sort(F.collect_set("predicate")).alias("__more"))
    none = F.array().cast("array<string>")
    fresh = linked.where("minted").select(type_id_of(F.col("description")).alias("id"), F.col("predicate").alias("name"), "description", F.array("predicate").alias("example_predicates"), F.col("q").alias("embedding"))
    every = types.unionByName(fresh, allowMissingColumns=True)
    return every.join(more, "id", "left").withColumn("example_predicates", F.array_union(F.coalesce("example_predicates", none), F.coalesce("__more", none))).select(*every.columns)
