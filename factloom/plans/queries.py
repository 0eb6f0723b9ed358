"""Queries over the driver's tables, each with SQL that says the same for a second engine.

Facts are derived from order lines: a supplier is a document, a part an entity, a line's quantity a value of the fiscal
year it was shipped in. Lines that follow each other in an order are related.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display, numbers, periods, text
from ..functions.vectors import cosine_similarity
from ..operators import facts as fact_ops
from ..operators import in_order, jobs, pages, quality, reconcile, rules, similarity, views
from ..sources import sinks
from ..sources.scratch import written
from ..streaming import progress
from .schemas import TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Functions of queries over texts, with the columns that they make.
STEPS: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {}

FACTS = """facts AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS document_id, l_partkey AS entity_id, l_returnflag AS fact_type_id,
  'quantity' AS predicate, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS value, 'FY' || CAST(year(l_shipdate) AS VARCHAR) AS time_scope,
  l_linenumber AS source_page, l_shipdate AS extracted_at, round(1 - l_discount, 2) AS confidence FROM lineitem)"""
RELATED = "rels AS (SELECT a.id AS fact_a_id, b.id AS fact_b_id FROM facts a JOIN facts b ON b.id = a.id + 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def over(t: str, number: str, inputs: dict[str, str], outputs: list[str], sql: str):
    """A query over all rows of a table: columns made of its own (SQL expressions) go through the decorated function, which
    names ``outputs``; ``number`` is a row's id. The function alone is a step (tests hold steps against stated cases)."""

    def add(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            made = table(spark, d, t).selectExpr(f"{number} AS id", *[f"{e} AS {c}" for c, e in inputs.items()])
            return f(made).select("id", *outputs)

        run.__name__ = f.__name__
        STEPS[f.__name__] = (f, outputs)
        return query(sql)(run)

    return add


def derived_facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("document_id"), F.col("l_partkey").alias("entity_id"), F.col("l_returnflag").alias("fact_type_id"),
        F.lit("quantity").alias("predicate"), F.col("l_quantity").cast("bigint").cast("string").alias("value"), F.concat(F.lit("FY"), F.year("l_shipdate").cast("string")).alias("time_scope"),
        F.col("l_linenumber").alias("source_page"), F.col("l_shipdate").alias("extracted_at"), F.round(1 - F.col("l_discount"), 2).alias("confidence"),
    )


def derived_relationships(facts: DataFrame) -> DataFrame:
    parts = views.shares(facts)
    a, b = facts.select(F.col("id").alias("fact_a_id")), facts.select(F.col("id").alias("fact_b_id"), (F.col("id") - 1).alias("fact_a_id"))
    return views.dealt(b, "fact_a_id", parts).join(views.dealt(a, "fact_a_id", parts), "fact_a_id").select("fact_a_id", "fact_b_id")


@query(f"""WITH {FACTS}, {RELATED}, n AS (SELECT id, count(*) AS c FROM (SELECT fact_a_id AS id FROM rels UNION ALL SELECT fact_b_id FROM rels) GROUP BY id)
SELECT f.id, f.value, f.time_scope, f.confidence, s.s_name AS filename, p.p_name AS entity_name, coalesce(n.c, 0) AS relationship_count
FROM facts f LEFT JOIN supplier s ON f.document_id = s.s_suppkey LEFT JOIN part p ON f.entity_id = p.p_partkey LEFT JOIN n ON n.id = f.id
WHERE f.fact_type_id = 'R' ORDER BY f.source_page, f.extracted_at DESC, f.id LIMIT 50 OFFSET 100""")
def facts_page(spark, d):
    facts = derived_facts(spark, d)
    listed = views.fact_list(
        views.filtered(facts, fact_type_id="R", document_id=None), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("filename")),
        spark.sql("SELECT 'R' AS id, 'returned' AS name"), table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("canonical_name")), derived_relationships(facts),
    )
    order = [F.col("source_page").asc_nulls_last(), F.col("extracted_at").desc_nulls_first(), F.col("id").asc()]
    return views.page_of(listed, order, display.parse_paging("3", "50")).select("id", "value", "time_scope", "confidence", "filename", "entity_name", "relationship_count")


@query(f"WITH {FACTS} SELECT s_suppkey AS document_id, count(f.id) AS fact_count, count(DISTINCT f.source_page) AS page_count FROM supplier LEFT JOIN facts f ON f.document_id = s_suppkey GROUP BY s_suppkey")
def document_counts(spark, d):
    facts = derived_facts(spark, d)
    docs = table(spark, d, "supplier").select(F.col("s_suppkey").alias("document_id"))
    got = views.with_count(docs, facts, "document_id", "document_id", "fact_count")
    return views.with_count(got, facts.select("document_id", "source_page").distinct(), "document_id", "document_id", "page_count").select("document_id", "fact_count", "page_count")


@query("SELECT c_custkey AS entity_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS fact_count FROM customer")
def entity_counts(spark, d):
    got = table(spark, d, "customer").select(F.col("c_custkey").alias("entity_id"))
    return views.with_count(got, table(spark, d, "orders"), "entity_id", "o_custkey", "fact_count").select("entity_id", "fact_count")


@query(f"""WITH {FACTS}, {RELATED}, n AS (SELECT id, count(*) AS c FROM (SELECT fact_a_id AS id FROM rels UNION ALL SELECT fact_b_id FROM rels) GROUP BY id)
SELECT f.id, coalesce(n.c, 0) AS relationship_count FROM (SELECT DISTINCT id FROM facts) f LEFT JOIN n ON n.id = f.id""")
def relationship_counts(spark, d):
    facts = derived_facts(spark, d)
    counts = views.pair_counts(derived_relationships(facts), "fact_a_id", "fact_b_id", "id", "relationship_count")
    return facts.select("id").distinct().join(counts, "id", "left").select("id", F.coalesce("relationship_count", F.lit(0)).alias("relationship_count"))


@query(f"WITH {FACTS}, {RELATED} SELECT r.fact_a_id, r.fact_b_id, a.value AS value_a, b.value AS value_b FROM rels r LEFT JOIN facts a ON a.id = r.fact_a_id LEFT JOIN facts b ON b.id = r.fact_b_id")
def relationships_expanded(spark, d):
    facts = derived_facts(spark, d)
    got = views.expanded(derived_relationships(facts), facts.select("id", "value"))
    return got.select("fact_a_id", "fact_b_id", F.col("fact_a.value").alias("value_a"), F.col("fact_b.value").alias("value_b"))


@query(f"WITH {FACTS}, {RELATED} SELECT CASE WHEN fact_a_id = 72 THEN fact_b_id ELSE fact_a_id END AS other_id, CASE WHEN fact_a_id = 72 THEN 'factB' ELSE 'factA' END AS role FROM rels WHERE fact_a_id = 72 OR fact_b_id = 72")
def relationships_of_fact(spark, d):
    return views.of_fact(derived_relationships(derived_facts(spark, d)), 72).select("other_id", "role")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE lower(p_name) LIKE '%in%'")
def entity_search(spark, d):
    return views.search(table(spark, d, "part"), "p_name", " IN ").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("SELECT o_orderkey AS id FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' OR lower(o_orderstatus) LIKE '%urgent%'")
def text_filter(spark, d):
    return views.contains_any(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], "URGENT").select(F.col("o_orderkey").alias("id"))


@query("SELECT 'documents' AS name, (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'facts', (SELECT count(*) FROM lineitem) UNION ALL SELECT 'entities', (SELECT count(*) FROM part)")
def overview_totals(spark, d):
    parts = [table(spark, d, t).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in (("documents", "supplier"), ("facts", "lineitem"), ("entities", "part"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("name", "n")


KNN = """SELECT a.vec_id AS query, b.vec_id AS row, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id"""


@query(f"SELECT query, row, rank FROM ({KNN}) WHERE rank <= 10")
def knn_same_entity(spark, d):
    e = table(spark, d, "embeddings").where("vec_id is not null")
    queries = e.select("label", F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    rows = e.select("label", F.col("vec_id").alias("row"), F.col("embedding").alias("v"))
    got = similarity.knn_join(queries, rows, ["label"], "query", "row", 10, differ=("query", "row"), last=True)
    return got.select("query", "row", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT query, row, rank FROM (SELECT a.vec_id AS query, b.vec_id AS row, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 5""")
def knn_entities(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    got = similarity.knn_join(queries, e.select(F.col("vec_id").alias("row"), F.col("embedding").alias("v")), [], "query", "row", 5, differ=("query", "row"))
    return got.select("query", "row", F.col("rank").cast("bigint").alias("rank"))


@query("""SELECT query, row, similarity FROM (SELECT a.vec_id AS query, b.vec_id AS row, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS n FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE n = 1""")
def nearest_type(spark, d):
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    got = similarity.nearest_one(queries, e.select(F.col("vec_id").alias("row"), F.col("embedding").alias("v")), "query", "row", differ=("query", "row"))
    return got.select("query", "row", F.round("similarity", 6).alias("similarity"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_similarity(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    return e.join(b, e.vec_id == b.a).select("a", "b", F.round(cosine_similarity(F.col("embedding"), F.col("w")), 6).alias("similarity"))


@query("""SELECT id, CASE WHEN m = 0 THEN replace(CAST(k AS VARCHAR), ',', '') || '000' WHEN m = 1 THEN CAST(k AS VARCHAR) || '%' ELSE '$' || CAST(k AS VARCHAR) || ' million' END AS normal
FROM (SELECT o_orderkey AS id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS k, o_orderkey % 3 AS m FROM orders)""")
def normalize_values(spark, d):
    k, m = F.floor(F.col("o_totalprice") / 1000).cast("string"), F.col("o_orderkey") % 3
    raw = F.when(m == 0, F.concat(F.lit(' "'), k, F.lit(',000" '))).when(m == 1, F.concat(k, F.lit("  percent"))).otherwise(F.concat(F.lit("$"), k, F.lit("  Million")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.normalize_value(raw).alias("normal"))


@query("SELECT s_suppkey AS id, lower(replace(s_name, '#', ' ')) || ' corp' AS form FROM supplier")
def comparison_forms(spark, d):
    name = F.concat(F.lit("The "), F.col("s_name"), F.lit("  Corporation."))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.comparison_form(text.normalize_name(name)).alias("form"))


@over("lineitem", "l_orderkey * 10 + l_linenumber", {
    "v": "CASE l_linenumber % 5 WHEN 0 THEN concat('$', floor(l_extendedprice), 'K') WHEN 1 THEN concat(floor(l_extendedprice), '%') WHEN 2 THEN concat(cast(l_quantity AS bigint), ' Cr') WHEN 3 THEN cast(floor(l_extendedprice) AS string) ELSE concat(cast(l_quantity AS bigint), ' bps') END",
    "u": "CASE l_linenumber % 5 WHEN 2 THEN 'crores' WHEN 3 THEN 'units' END",
    "c": "CASE l_linenumber % 5 WHEN 3 THEN 'chf' END",
}, ["number", "currency", "unit", "physical_unit"], """SELECT l_orderkey * 10 + l_linenumber AS id, CAST(CASE m WHEN 0 THEN k * 1000 WHEN 1 THEN k WHEN 2 THEN q * 10000000 WHEN 3 THEN k ELSE q / 100.0 END AS DOUBLE) AS number, CASE m WHEN 0 THEN 'USD' WHEN 3 THEN 'CHF' END AS currency,
  CASE m WHEN 0 THEN 'k' WHEN 2 THEN 'cr' WHEN 3 THEN 'units' ELSE 'percent' END AS unit, CASE WHEN m IN (1, 4) THEN 'percent' WHEN m = 3 THEN 'units' END AS physical_unit FROM (SELECT *, l_linenumber % 5 AS m, floor(l_extendedprice) AS k, CAST(l_quantity AS BIGINT) AS q FROM lineitem)""")  # fmt: skip
def parsed_numbers(df):
    n = F.col("n")
    got = df.withColumn("n", numbers.parse_numeric(F.col("v"), F.col("u"), F.col("c")))
    return got.select("id", n["value"].alias("number"), n["currency"].alias("currency"), n["unit"].alias("unit"), n["physical_unit"].alias("physical_unit"))


@over("orders", "o_orderkey", {
    "v": "CASE o_orderkey % 4 WHEN 0 THEN concat(' “', replace(o_orderpriority, ' ', '  '), '”  ') WHEN 1 THEN concat('$', cast(floor(o_totalprice / 1000) AS bigint), ',', lpad(cast(floor(o_totalprice) % 1000 AS string), 3, '0')) WHEN 2 THEN concat(o_custkey, ' basis points') ELSE concat(o_custkey, '  pct') END",
}, ["normal"], """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN lower(o_orderpriority) WHEN 1 THEN '$' || CAST(floor(o_totalprice / 1000) AS BIGINT) || lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0')
  WHEN 2 THEN CAST(o_custkey // 100 AS VARCHAR) || rtrim(rtrim('.' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0'), '0'), '.') || '%' ELSE o_custkey || '%' END AS normal FROM orders""")  # fmt: skip
def normal_forms(df):
    return df.withColumn("normal", text.normalize_value(F.col("v")))


@over("orders", "o_orderkey", {
    "v": "CASE o_orderkey % 11 WHEN 0 THEN concat('Fiscal year ', year(o_orderdate)) WHEN 1 THEN concat('q', quarter(o_orderdate), '\\'', right(year(o_orderdate), 2)) WHEN 2 THEN concat(quarter(o_orderdate), 'Q', year(o_orderdate)) WHEN 3 THEN concat('in ', year(o_orderdate)) WHEN 4 THEN concat('FY', right(year(o_orderdate), 2)) WHEN 5 THEN concat(year(o_orderdate), '-', right(year(o_orderdate) + 1, 2)) WHEN 6 THEN concat('FY', right(year(o_orderdate), 2), '/', right(year(o_orderdate) + 1, 2)) WHEN 7 THEN concat('cy ', year(o_orderdate)) WHEN 8 THEN concat(year(o_orderdate), '-03-31') WHEN 9 THEN concat('Long  ', o_orderpriority) END",
}, ["period"], """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 IN (0, 4) THEN 'FY' || year(o_orderdate) WHEN o_orderkey % 11 IN (1, 2) THEN 'Q' || quarter(o_orderdate) || '-FY' || year(o_orderdate) WHEN o_orderkey % 11 IN (3, 8) THEN CAST(year(o_orderdate) AS VARCHAR)
  WHEN o_orderkey % 11 IN (5, 6) THEN 'FY' || left(CAST(year(o_orderdate) AS VARCHAR), 2) || right(CAST(year(o_orderdate) + 1 AS VARCHAR), 2) WHEN o_orderkey % 11 = 7 THEN 'CY' || year(o_orderdate) WHEN o_orderkey % 11 = 9 THEN 'long ' || lower(o_orderpriority) ELSE '' END AS period FROM orders""")  # fmt: skip
def period_forms(df):
    return df.withColumn("period", periods.normalize_period(F.col("v")))


@over("supplier", "s_suppkey", {
    "a": "CASE s_suppkey % 6 WHEN 3 THEN '' WHEN 4 THEN concat('“', s_name, ' Limited”') WHEN 5 THEN repeat('甲', 1 + cast(s_suppkey % 4 AS int)) ELSE concat('The ', s_name, ' Corp') END",
    "b": "CASE s_suppkey % 6 WHEN 0 THEN concat(s_name, ' Corporation') WHEN 1 THEN 'Quartz Holdings' WHEN 2 THEN '' WHEN 3 THEN s_name WHEN 4 THEN concat(lower(s_name), ' ltd') ELSE '乙' END",
}, ["merges", "form"], """SELECT s_suppkey AS id, s_suppkey % 6 IN (0, 4, 5) AS merges, CASE WHEN s_suppkey % 6 IN (3, 5) THEN '' ELSE lower(replace(s_name, '#', ' ')) || CASE s_suppkey % 6 WHEN 4 THEN ' ltd' ELSE ' corp' END END AS form FROM supplier""")
def name_pairs(df):
    return df.withColumns({"merges": text.names_merge(F.col("a"), F.col("b")), "form": text.comparison_form(text.normalize_name(F.col("a")))})


@over("part", "p_partkey", {
    "a": "p_name",
    "b": "CASE p_partkey % 3 WHEN 0 THEN upper(replace(p_name, ' ', '_')) ELSE 'director of operations' END",
    "ta": "p_brand",
    "tb": "CASE p_partkey % 3 WHEN 1 THEN p_brand ELSE 'Brand' END",
}, ["alike"], """SELECT p_partkey AS id, p_partkey % 3 < 2 AS alike FROM part""")
def predicate_pairs(df):
    return df.withColumn("alike", text.predicates_match(F.col("a"), F.col("b"), F.col("ta"), F.col("tb")))


SIDE = ("value", "unit", "currency", "time_scope", "qualifiers")


@over("lineitem", "l_orderkey * 10 + l_linenumber", {
    "a_value": "CASE WHEN l_linenumber % 7 > 3 THEN cast(cast(l_quantity AS bigint) AS string) WHEN l_linenumber % 7 = 0 THEN concat('$', cast(l_quantity AS bigint), 'K') ELSE concat(cast(l_quantity AS bigint), 'M') END",
    "a_unit": "cast(null AS string)",
    "a_currency": "CASE l_linenumber % 7 WHEN 3 THEN 'USD' END",
    "a_time_scope": "CASE WHEN l_linenumber % 7 <> 5 THEN concat('FY', year(l_shipdate)) END",
    "a_qualifiers": "CASE l_linenumber % 7 WHEN 4 THEN concat('{\"flag\":\"', l_returnflag, '\"}') END",
    "b_value": "CASE WHEN l_linenumber % 7 > 3 THEN cast(cast(l_quantity AS bigint) + 1 AS string) WHEN l_linenumber % 7 = 0 THEN concat(cast(l_quantity AS bigint), '000') WHEN l_linenumber % 7 = 3 THEN concat(cast(l_quantity AS bigint), ',000,000') ELSE concat(cast(l_quantity AS bigint), 'M') END",
    "b_unit": "cast(null AS string)",
    "b_currency": "CASE l_linenumber % 7 WHEN 3 THEN 'EUR' END",
    "b_time_scope": "concat('FY', year(l_shipdate) + if(l_linenumber % 7 = 2, 1, 0))",
    "b_qualifiers": "CASE l_linenumber % 7 WHEN 4 THEN concat('{\"flag\":\"', l_linestatus, '!\"}') END",
}, ["relation_type", "confidence", "escalate", "explanation", "reason"], """SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN m < 2 THEN 'corroborates' WHEN m < 5 THEN 'reconciled' END AS relation_type, CAST(CASE WHEN m < 2 THEN 0.95 WHEN m < 5 THEN 0.9 END AS DOUBLE) AS confidence, m > 4 AS escalate,
  CASE m WHEN 5 THEN 'Missing time scope on one of the facts prevents deterministic reconciliation' WHEN 6 THEN 'Values differ under matching time scope and qualifiers; requires LLM judge' END AS reason,
  CASE m WHEN 0 THEN 'Values are numerically equivalent after unit normalization: "$' || q || 'K" matches "' || q || '000" for revenue.' WHEN 1 THEN 'Both documents report identical values of "' || q || 'M" for revenue.'
  WHEN 2 THEN 'Values differ ("' || q || 'M" vs "' || q || 'M") because they cover different time periods: "FY' || y || '" vs "FY' || (y + 1) || '".' WHEN 3 THEN 'Values are numerically identical (' || q * 1000000 || ') but reported in different currencies: USD vs EUR.'
  WHEN 4 THEN 'Values differ ("' || q || '" vs "' || (q + 1) || '") due to different flag qualifier: "' || l_returnflag || '" vs "' || l_linestatus || '!".' END AS explanation
  FROM (SELECT *, l_linenumber % 7 AS m, CAST(l_quantity AS BIGINT) AS q, year(l_shipdate) AS y FROM lineitem)""")  # fmt: skip
def rule_ladder(df):
    side = lambda s: F.struct(F.lit("revenue").alias("predicate"), F.lit(None).cast("string").alias("raw_value"), *[F.col(f"{s}_{c}").alias(c) for c in SIDE])
    return rules.rule_reconcile(df.select("id", side("a").alias("a"), side("b").alias("b")))


@over("orders", "o_orderkey", {
    "ms": "floor(o_totalprice) * (o_orderkey % 23 - 1) * 1.0D",
}, ["eta"], """SELECT o_orderkey AS id, CASE WHEN s < 5 THEN 'almost done' WHEN s < 60 THEN '≈ ' || s || 's left' WHEN s < 3600 THEN '≈ ' || s // 60 || 'm' || CASE WHEN s % 60 > 0 THEN ' ' || s % 60 || 's' ELSE '' END || ' left' ELSE '≈ ' || s // 3600 || 'h ' || s % 3600 // 60 || 'm left' END AS eta
  FROM (SELECT o_orderkey, CAST(floor(floor(o_totalprice) * (o_orderkey % 23 - 1) / 1000 + 0.5) AS BIGINT) AS s FROM orders)""")  # fmt: skip
def eta_texts(df):
    return df.withColumn("eta", display.format_eta(F.col("ms")))


@over("orders", "o_orderkey", {
    "status": "CASE WHEN o_orderkey % 6 = 3 THEN 'resolving' WHEN o_orderkey % 6 = 4 THEN 'pending' WHEN o_orderkey % 6 = 5 OR o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'extracting' ELSE 'done' END",
    "stage": "CASE WHEN o_orderkey % 6 = 3 THEN 'resolve' WHEN o_orderkey % 6 > 3 THEN NULL WHEN o_orderstatus = 'P' THEN 'reconcile' ELSE 'extract' END",
}, ["parse", "extract", "reconcile", "line"], """SELECT o_orderkey AS id, CASE k WHEN 4 THEN 'active' WHEN 5 THEN 'pending' ELSE 'done' END AS parse, CASE WHEN k = 3 THEN 'done' WHEN k > 3 THEN 'pending' WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'active' ELSE 'done' END AS extract,
  CASE WHEN k < 3 AND o_orderstatus = 'P' THEN 'done' ELSE 'pending' END AS reconcile, CASE WHEN k = 3 THEN 'Complete' WHEN k > 3 THEN 'Waiting' WHEN o_orderstatus = 'F' THEN 'Stage failed' WHEN o_orderstatus = 'O' THEN 'Reading facts' ELSE 'Complete' END AS line FROM (SELECT *, o_orderkey % 6 AS k FROM orders)""")  # fmt: skip
def stage_states(df):
    got = df.withColumns({s: display.stage_state(F.col("status"), F.col("stage"), s) for s in ("parse", "extract", "reconcile")})
    return got.withColumn("line", display.stage_line(F.col("extract"), "extract", F.lit(None).cast("string"), "Reading facts", F.lit(None).cast("string")))


@over("orders", "o_orderkey", {
    "qualifiers": "CASE o_orderkey % 5 WHEN 0 THEN to_json(named_struct('_entity', named_struct('name', concat(' ', o_orderpriority, ' '), 'type', concat(' ', o_orderstatus, ' '), 'context', concat(' by ', o_custkey, ' ')))) WHEN 2 THEN to_json(named_struct('entity', named_struct('name', o_orderpriority))) WHEN 3 THEN to_json(named_struct('_entity', named_struct('name', ' ', 'type', '', 'context', '  '))) WHEN 4 THEN to_json(named_struct('_entity', named_struct('type', o_orderstatus), 'entity', named_struct('name', 'other'))) END",
    "source_quote": "CASE o_orderkey % 5 WHEN 2 THEN '' WHEN 4 THEN NULL ELSE concat('q', o_custkey) END",
}, ["name", "type", "context"], """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 IN (0, 2) THEN o_orderpriority ELSE 'Unknown Entity' END AS name, CASE WHEN o_orderkey % 5 IN (0, 4) THEN o_orderstatus END AS type, CASE WHEN o_orderkey % 5 = 0 THEN 'by ' || o_custkey WHEN o_orderkey % 5 IN (1, 3) THEN 'q' || o_custkey END AS context FROM orders""")
def entity_mentions(df):
    found = fact_ops.mentions(df.withColumns({"document_id": F.lit(1), "idx": F.lit(1)}))
    return found.withColumnRenamed("fact_id", "id")


@over("lineitem", "l_orderkey * 10 + l_linenumber", {
    "fact": "CASE l_linenumber % 2 WHEN 0 THEN concat('{\"confidence\":0.5,\"value\":', cast(l_quantity AS bigint), ',\"pageNumber\":', l_linenumber, ',\"unit\":\"kg\",\"entity\":{\"name\":\"S', l_suppkey, '\",\"type\":\"t\"}}') ELSE concat('{\"rawValue\":\"', l_shipdate, '\",\"qualifiers\":{\"flag\":\"', l_returnflag, '\"},\"entity\":null}') END",
}, ["confidence", "value", "raw_value", "page_number", "unit", "entity_name", "entity_type", "qualifiers"], """SELECT l_orderkey * 10 + l_linenumber AS id, CAST(CASE WHEN e THEN 0.5 ELSE 0 END AS DOUBLE) AS confidence, CASE WHEN e THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '' END AS value, CASE WHEN e THEN '' ELSE CAST(l_shipdate AS VARCHAR) END AS raw_value, CAST(CASE WHEN e THEN l_linenumber ELSE 8 END AS INTEGER) AS page_number,
  CASE WHEN e THEN 'kg' END AS unit, CASE WHEN e THEN 'S' || l_suppkey ELSE 'Unknown' END AS entity_name, CASE WHEN e THEN 't' ELSE 'Unknown' END AS entity_type, CASE WHEN e THEN '{}' ELSE '{"flag":"' || l_returnflag || '"}' END AS qualifiers FROM (SELECT *, l_linenumber % 2 = 0 AS e FROM lineitem)""")  # fmt: skip
def loose_facts(df):
    replies = df.select("id", F.concat(F.lit('```json\n{"facts":['), "fact", F.lit("]}\n```")).alias("reply"))
    return fact_ops.read_facts(replies, default_page=F.lit(8))


@query("""SELECT id, CASE m WHEN 0 THEN 'FY' || y WHEN 1 THEN 'FY' || substr(CAST(y AS VARCHAR), 1, 2) || substr(CAST(y + 1 AS VARCHAR), 3, 2) WHEN 2 THEN 'Q2-FY' || y WHEN 3 THEN 'CY' || y ELSE CAST(y AS VARCHAR) END AS period
FROM (SELECT o_orderkey AS id, year(o_orderdate) AS y, o_orderkey % 5 AS m FROM orders)""")
def period_labels(spark, d):
    y, m = F.year("o_orderdate"), F.col("o_orderkey") % 5
    s = lambda c: c.cast("string")
    raw = F.when(m == 0, F.concat(F.lit(" q1 fy "), s(y))).when(m == 1, F.concat(s(y), F.lit("-"), F.substring(s(y + 1), 3, 2))).when(m == 2, F.concat(F.lit("2Q"), s(y))).when(m == 3, F.concat(F.lit("cy "), s(y))).otherwise(F.concat(s(y), F.lit("-03-31")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), periods.normalize_period(raw).alias("period"))


PAIR_SQL = f"""{FACTS}, pairs AS (SELECT a.id AS id_a, b.id AS id_b, a.value AS va, b.value AS vb, a.time_scope AS ta, b.time_scope AS tb, a.fact_type_id AS qa, b.fact_type_id AS qb FROM facts a JOIN facts b ON b.id = a.id + 1),
ladder AS (SELECT *, CASE WHEN ta = tb AND va = vb THEN 1 WHEN ta <> tb THEN 4 WHEN qa <> qb THEN 5 ELSE 7 END AS r FROM pairs)"""


@query(f"""WITH {PAIR_SQL} SELECT id_a, id_b, CASE WHEN r = 1 THEN 'corroborates' WHEN r IN (4, 5) THEN 'reconciled' END AS relation_type, CASE WHEN r = 1 THEN 0.95::DOUBLE WHEN r IN (4, 5) THEN 0.9::DOUBLE END AS confidence, r = 7 AS escalate,
CASE r WHEN 1 THEN 'Both documents report identical values of "' || va || '" for quantity.' WHEN 4 THEN 'Values differ ("' || va || '" vs "' || vb || '") because they cover different time periods: "' || ta || '" vs "' || tb || '".'
WHEN 5 THEN 'Values differ ("' || va || '" vs "' || vb || '") due to different flag qualifier: "' || qa || '" vs "' || qb || '".' END AS explanation FROM ladder""")
def rule_decisions(spark, d):
    f, null = derived_facts(spark, d), F.lit(None).cast("string")
    # many facts say the same: what the rules compare is parsed once a text, and the lines take it from there
    texts = f.select(F.col("value").alias("v"), F.col("time_scope").alias("t")).distinct()
    texts = texts.withColumn("parsed", rules.parsed(F.col("v"), F.col("v"), null, null, F.col("t")))
    f = f.join(texts, F.col("value").eqNullSafe(F.col("v")) & F.col("time_scope").eqNullSafe(F.col("t")))
    side = F.struct("parsed", "id", "predicate", "value", F.col("value").alias("raw_value"), null.alias("unit"), null.alias("currency"), "time_scope", F.concat(F.lit('{"flag":"'), F.col("fact_type_id"), F.lit('"}')).alias("qualifiers"))
    pairs = f.select("id", side.alias("a")).join(f.select((F.col("id") - 1).alias("id"), side.alias("b")), "id").select("a", "b")
    return rules.rule_reconcile(pairs).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), "relation_type", "confidence", "escalate", "explanation")


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS entity_id, o_orderkey % 50 AS document_id, o_totalprice AS v, CAST(CAST(o_totalprice / 50000 AS BIGINT) AS VARCHAR) AS value, 'FY' || CAST(year(o_orderdate) AS VARCHAR) AS t FROM orders),
met AS (SELECT a.id AS a, b.id AS b, a.value AS va, b.value AS vb, a.t AS ta, b.t AS tb, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.v - b.v), b.id) AS n FROM f a JOIN f b ON a.entity_id = b.entity_id AND a.document_id <> b.document_id AND a.id <> b.id WHERE abs(a.v - b.v) < 100000),
firsts AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY a, n) AS first FROM met WHERE n <= 10)
SELECT least(a, b) AS fact_a_id, greatest(a, b) AS fact_b_id, CASE WHEN ta = tb AND va = vb THEN 'corroborates' WHEN ta <> tb THEN 'reconciled' ELSE 'uncertain' END AS relation_type, CASE WHEN ta = tb AND va = vb THEN 'rule' WHEN ta <> tb THEN 'rule' ELSE 'llm_judge' END AS method FROM firsts WHERE first = 1""")
def reconciled_candidates(spark, d):
    null = F.lit(None).cast("string")
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), (F.col("o_orderkey") % 50).alias("document_id"), F.lit("revenue").alias("predicate"), F.rint(F.col("o_totalprice") / 50000).cast("bigint").cast("string").alias("value"),
                                         F.lit("").alias("raw_value"), null.alias("unit"), null.alias("currency"), F.concat(F.lit("FY"), F.year("o_orderdate").cast("string")).alias("time_scope"), null.alias("qualifiers"), null.alias("fact_type_id"), F.col("o_totalprice").alias("vector"))
    pairs = reconcile.candidate_pairs(f, f, 10, None, 100000, line=True)
    return reconcile.relationship_rows(reconcile.evaluate(pairs)).select("fact_a_id", "fact_b_id", "relation_type", "method")


@query("""WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS entity_id, o_orderkey % 50 AS document_id, o_totalprice AS v FROM orders),
met AS (SELECT a.id AS a, b.id AS b, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.v - b.v), b.id) AS n FROM f a JOIN f b ON a.entity_id = b.entity_id AND a.document_id <> b.document_id AND a.id <> b.id AND abs(a.v - b.v) < 200)
SELECT DISTINCT least(a, b) AS fact_a_id, greatest(a, b) AS fact_b_id FROM met WHERE n <= 10""")
def hot_entity_candidates(spark, d):
    """A third of all facts belong to one entity."""
    null = F.lit(None).cast("string")
    entity = F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey"))
    f = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), entity.alias("entity_id"), (F.col("o_orderkey") % 50).alias("document_id"), F.lit("revenue").alias("predicate"), F.lit("1").alias("value"),
                                         F.lit("").alias("raw_value"), *[null.alias(c) for c in ("unit", "currency", "time_scope", "qualifiers", "fact_type_id")], F.col("o_totalprice").cast("double").alias("vector"))
    pairs = reconcile.candidate_pairs(f, f, 10, None, 200, line=True)
    return pairs.select(F.col("pair_a").alias("fact_a_id"), F.col("pair_b").alias("fact_b_id"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT v, u, s FROM (SELECT a.vec_id AS v, b.vec_id AS u, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id) WHERE s >= 0.3),
n AS MATERIALIZED (SELECT x.vec_id AS v, row_number() OVER (ORDER BY x.vec_id) AS i, list(e.u) AS us FROM embeddings x LEFT JOIN e ON e.v = x.vec_id GROUP BY x.vec_id),
r AS (SELECT 1 AS i, [v] AS leads FROM n WHERE i = 1 UNION ALL SELECT n.i, CASE WHEN list_has_any(n.us, r.leads) THEN r.leads ELSE list_append(r.leads, n.v) END FROM r JOIN n ON n.i = r.i + 1),
l AS (SELECT unnest(leads) AS u FROM (SELECT leads FROM r ORDER BY i DESC LIMIT 1)),
b AS (SELECT v, arg_min(u, (-s, u)) AS u FROM e WHERE u IN (SELECT u FROM l) GROUP BY v)
SELECT n.v, coalesce(b.u, n.v) AS leader FROM n LEFT JOIN b ON b.v = n.v""")
def leaders_in_order(spark, d):
    return in_order.followed(table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("q")), 0.3)


@query("""WITH n AS (SELECT p_partkey AS idx, p_brand AS document_id, lower(p_name) AS name FROM part) SELECT a.document_id, a.idx AS idx_a, b.idx AS idx_b FROM n a JOIN n b ON a.document_id = b.document_id AND a.idx < b.idx
WHERE a.name = b.name OR 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.85""")
def merging_names(spark, d):
    names = table(spark, d, "part").select(F.col("p_brand").alias("document_id"), F.col("p_partkey").alias("idx"), F.col("p_name").alias("name"))
    return similarity.merging_names(names)


@query("""WITH l AS (SELECT DISTINCT doc_id, lang, trim(line) AS line FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents))
SELECT lang, line, count(*) AS n_pages FROM l WHERE length(line) >= 6 GROUP BY lang, line HAVING count(*) >= 5""")
def repeated_lines(spark, d):
    p = table(spark, d, "documents").select("lang", F.col("doc_id").alias("page_number"), "text")
    return pages.repeated_lines(p, "lang", least=5)


@query("SELECT doc_id, CASE WHEN text = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY lang, substr(sha256(text), 1, 16)) END AS canonical_page FROM (SELECT doc_id, lang, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS text FROM documents)")
def duplicate_pages(spark, d):
    clean = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\f\r"))
    p = table(spark, d, "documents").select("lang", F.col("doc_id").alias("page_number"), clean.alias("text"))
    got = pages.deduplicate_pages(p, "lang")
    return got.select(F.col("page_number").alias("doc_id"), "canonical_page")


@query("""SELECT conv_id AS page_number, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS raw_text, bool_and(length(text) < 100) AS is_low_text, bool_or(role = 'user') AS needs_vision, min(turn) AS first_chunk_index FROM conversations GROUP BY conv_id""")
def grouped_chunks(spark, d):
    c = table(spark, d, "conversations").select(F.lit(0).alias("document_id"), F.col("conv_id").alias("page_number"), F.col("turn").alias("chunk_index"), F.col("text").alias("raw_text"), (F.length("text") < 100).alias("is_low_text"), F.lit(False).alias("is_table_heavy"), (F.col("role") == "user").alias("needs_vision"), F.col("turn").alias("id"))
    return pages.group_chunks(c).select("page_number", "raw_text", "is_low_text", "needs_vision", "first_chunk_index")


@query("""SELECT doc_id, CASE WHEN trim(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') = '' THEN 'skip' WHEN n_chars < 200 THEN 'defer-vision-disabled' WHEN contains(text, '|') THEN 'extract-text-table' ELSE 'extract-text' END AS route FROM documents""")
def routed_pages(spark, d):
    p = table(spark, d, "documents").withColumn("runs", F.when(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s", "")) == "", 0).otherwise(1))
    return p.select("doc_id", pages.route(F.col("text"), F.col("runs"), F.col("n_chars") < 200, F.contains("text", F.lit("|")), False).alias("route"))


@query("""WITH RECURSIVE p AS (SELECT l_orderkey AS document_id, l_linenumber AS page_number, greatest(400, CAST(floor(1.5 * CAST(l_quantity * 60 AS BIGINT) + 0.5) AS BIGINT)) AS cost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity)),
w AS (SELECT document_id, page_number, i, 0 AS batch, cost AS total, 1 AS n, cost >= 4000 AS closed FROM p WHERE i = 1
UNION ALL SELECT p.document_id, p.page_number, p.i, w.batch + CASE WHEN f THEN 1 ELSE 0 END, CASE WHEN f THEN p.cost ELSE w.total + p.cost END, CASE WHEN f THEN 1 ELSE w.n + 1 END, p.cost >= 4000
FROM w JOIN p ON p.document_id = w.document_id AND p.i = w.i + 1, LATERAL (SELECT p.cost >= 4000 OR w.closed OR w.total + p.cost > 4000 OR w.n >= 3 AS f) x) SELECT document_id, page_number, batch FROM w""")
def packed_pages(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number")).agg((F.min("l_quantity") * 60).cast("int").alias("token_estimate"))
    return pages.pack_pages(p, "document_id", 4000, 3)


@query("""SELECT b.bucket, count(q.bucket) AS n FROM (SELECT unnest(['0-100', '101-400', '401-1000', '1000+']) AS bucket) b
LEFT JOIN (SELECT CASE WHEN n <= 100 THEN '0-100' WHEN n <= 400 THEN '101-400' WHEN n <= 1000 THEN '401-1000' ELSE '1000+' END AS bucket FROM (SELECT length(trim(text)) AS n FROM documents)) q ON q.bucket = b.bucket GROUP BY b.bucket""")
def quote_buckets(spark, d):
    return fact_ops.quote_lengths(table(spark, d, "documents").select(F.trim("text").alias("source_quote")))


@query(f"WITH {FACTS}, g AS (SELECT count(*) AS n FROM facts GROUP BY entity_id, value, time_scope) SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(sum(n - 1) / sum(n), 6) AS rate FROM g")
def duplicate_triples(spark, d):
    got = fact_ops.duplicate_rate(derived_facts(spark, d).withColumn("predicate", F.col("entity_id")))
    return got.select("total", "duplicates", F.round("rate", 6).alias("rate"))


@query("""SELECT item_id, count(d.doc_id) AS n_documents, coalesce(min(d.doc_id), -1) AS first_document FROM (SELECT item_id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS q FROM benchmark) b LEFT JOIN documents d ON q <> '' AND contains(d.text, q) GROUP BY item_id""")
def quotes_found(spark, d):
    """Every benchmark text as a quote against the whole text of every document."""
    q = table(spark, d, "benchmark").select("item_id", F.regexp_replace(F.coalesce("text", F.lit("")), "^\\s+|\\s+$", "").alias("source_quote"))
    found = fact_ops.quotes_in_pages(q, table(spark, d, "documents").select("doc_id", F.col("text").alias("page_text")), "item_id", "doc_id")
    got = q.join(found, "item_id", "left").groupBy("item_id").agg(F.count("doc_id").alias("n_documents"), F.coalesce(F.min("doc_id"), F.lit(-1)).alias("first_document"))
    return got.select("item_id", "n_documents", "first_document")


@query("""SELECT doc_id, v AS source_quote_valid, CASE WHEN vision OR v THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS confidence, CASE WHEN vision THEN '{"a":1,"visionOnly":true}' WHEN v THEN '{"a":1}' ELSE '{"a":1,"quoteMismatch":true}' END AS qualifiers
FROM (SELECT doc_id, doc_id % 5 = 4 AS vision, doc_id % 5 < 3 AND trim(q, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '' AND contains(t, trim(q, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) AS v
FROM (SELECT doc_id, coalesce(text, '') AS t, CASE doc_id % 5 WHEN 0 THEN substr(coalesce(text, ''), 1, 60) WHEN 1 THEN substr(coalesce(text, ''), 11) WHEN 2 THEN upper(substr(coalesce(text, ''), 1, 20)) ELSE '' END AS q FROM documents))""")
def quote_checks(spark, d):
    """Quotes of several kinds against the page they come from: a head, a long tail, one in capitals, none, one of an image."""
    t, m = F.coalesce("text", F.lit("")), F.col("doc_id") % 5
    quote = F.when(m == 0, F.substring(t, 1, 60)).when(m == 1, F.substring(t, F.lit(11), F.length(t))).when(m == 2, F.upper(F.substring(t, 1, 20))).otherwise("")
    got = table(spark, d, "documents").select("doc_id", t.alias("page_text"), quote.alias("source_quote"), F.lit(0.8).alias("confidence"), F.lit('{"a":1}').alias("qualifiers"), (m == 4).alias("via_vision"))
    return fact_ops.check_quotes(got).select("doc_id", "source_quote_valid", "confidence", "qualifiers")


@query(f"""WITH {FACTS}, s AS (SELECT *, CASE WHEN source_page % 2 = 0 THEN value || ' units' ELSE 'none' END AS quote FROM facts ORDER BY extracted_at DESC, id LIMIT 30),
c AS (SELECT DISTINCT document_id, source_page FROM facts WHERE document_id % 3 = 0), v AS (SELECT CASE WHEN s.source_page = 1 THEN 'quoteWrong' WHEN c.document_id IS NOT NULL AND s.source_page % 2 = 1 THEN 'quoteWrong'
WHEN contains(quote, value) THEN 'correct' ELSE 'valueWrong' END AS verdict FROM s LEFT JOIN c ON c.document_id = s.document_id AND c.source_page = s.source_page)
SELECT count(*) AS total, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'quoteWrong') AS quote_wrong, count(*) FILTER (verdict = 'valueWrong') AS value_wrong, round(count(*) FILTER (verdict = 'correct') / count(*), 4) AS "precision" FROM v""")
def spot_check_score(spark, d):
    f = derived_facts(spark, d).withColumns({"source_chunk_index": F.lit(0), "raw_value": F.concat(F.lit(" "), F.col("value")), "source_quote": F.when(F.col("source_page") % 2 == 0, F.concat("value", F.lit(" Units "))).otherwise("none"), "source_quote_valid": F.col("source_page") != 1})
    # chunks of every third document: each holds every quote with "units" and no other
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda n: F.concat(n.cast("string"), F.lit(" units"))), ", ")
    chunks = f.where("document_id % 3 = 0").select("document_id", F.col("source_page").alias("page_number"), F.lit(0).alias("chunk_index"), words.alias("raw_text")).distinct()
    got = quality.score(quality.spot_check(f, chunks))
    return got.select("total", "correct", F.col("quoteWrong").alias("quote_wrong"), F.col("valueWrong").alias("value_wrong"), "precision")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS status, o_totalprice FROM orders")
def upserted_rows(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_totalprice")
    new = o.where("o_orderkey % 3 = 0").withColumns({"status": F.lit("U"), "o_totalprice": F.lit(0.0)})
    return sinks.upserted(o, new, ["o_orderkey"], keep=["o_totalprice"])


@query(f"WITH {FACTS}, n AS (SELECT entity_id, min(id) AS id FROM facts GROUP BY entity_id) SELECT entity_id, id FROM n WHERE entity_id % 5 <> 0")
def inserted_rows(spark, d):
    f = derived_facts(spark, d).select("entity_id", "id")
    return sinks.rows_to_insert(f.where("entity_id % 5 = 0"), f, ["entity_id"], ["id"]).select("entity_id", "id")


@query("SELECT o_orderkey AS document_id, CASE WHEN c_nationkey = 3 THEN -1 ELSE o_custkey END AS entity_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'")
def deleted_documents(spark, d):
    o = table(spark, d, "orders")
    left = sinks.without_documents(o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("entity_id")), o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id")))
    return sinks.detached(left, table(spark, d, "customer").where("c_nationkey = 3"), "entity_id", "c_custkey").select("document_id", F.coalesce("entity_id", F.lit(-1)).alias("entity_id"))


LAST = "SELECT user_id AS document_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id"


@query(LAST)
def latest_statuses(spark, d):
    got = progress.latest_status(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")
    return got.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("status"))


@query(LAST)
def streamed_statuses(spark, d):
    """The same from a stream that handles what has landed and ends."""
    from ..sources.scratch import scratch_dir

    rows, out = table(spark, d, "events"), scratch_dir(spark, "statuses")
    rows.write.parquet(f"{out}/landed")
    stream = spark.readStream.schema(rows.schema).parquet(f"{out}/landed")
    progress.run_available(progress.latest_status(stream, "user_id", "ts", "event_id", "event_type"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/checkpoint", "update")
    got = spark.read.parquet(f"{out}/rows")
    w = Window.partitionBy("user_id").orderBy(F.desc("batch"))
    return got.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("status"))


@query("SELECT user_id AS document_id, event_type AS stage, count(*) AS n_events, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS elapsed_ms FROM events GROUP BY user_id, event_type")
def stage_times(spark, d):
    return progress.stage_times(table(spark, d, "events"), "user_id", "event_type", "ts").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("stage"), "n_events", "elapsed_ms")


@over("events", "event_id", {
    "j": "concat('{\"status\":\"', CASE event_type WHEN 'click' THEN 'parsing' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'seen' ELSE 'pending' END, '\",\"elapsedMs\":', cast(floor(value) AS bigint) - 50, ',\"progress\":{\"current\":', user_id, ',\"total\":100}}')",
}, ["valid", "terminal"], """SELECT event_id AS id, event_type <> 'view' AND floor(value) >= 50 AS valid, event_type IN ('purchase', 'error') AS terminal FROM events""")
def checked_events(df):
    return df.withColumns({"valid": progress.is_valid_event(F.col("j")), "terminal": progress.is_terminal_payload(F.col("j"))})


@query("""SELECT o_orderkey AS id, CAST(round(100 * CASE WHEN c = 0 THEN 1.0 ELSE c END) AS INTEGER) AS percent, CASE WHEN k > 0 AND k < 7 THEN round(o_totalprice * (7 - k) / k, 4) END AS eta_ms, least(100, CAST(round(100.0 * k / 7) AS INTEGER)) AS progress
FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 9 AS k, (o_orderkey % 11) / 10.0 AS c FROM orders)""")
def display_figures(spark, d):
    k, c = F.col("o_orderkey") % 9, (F.col("o_orderkey") % 11) / 10
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), display.confidence_percent(c).alias("percent"), F.round(display.eta_ms(F.col("o_totalprice"), k, F.lit(7)), 4).alias("eta_ms"), display.progress_percent(k, F.lit(7)).alias("progress"))


@over("orders", "o_orderkey", {
    "said": "CASE o_orderkey % 6 WHEN 2 THEN concat('{\"relationType\":\"uncertain\",\"confidence\":0.9', o_custkey % 10, ',\"explanation\":\"', o_orderpriority, '\"} NO') WHEN 3 THEN concat('{\"relationType\":\"reconciled\",\"confidence\":', 2 + o_custkey, ',\"explanation\":\" \"}') WHEN 4 THEN concat('{\"relationType\":\"corroborates\",\"confidence\":-', 1 + o_custkey, ',\"explanation\":\" ', o_orderpriority, ' \"}') WHEN 5 THEN concat('{\"relationType\":\"other\",\"confidence\":0.', o_custkey % 10, '}') WHEN 0 THEN concat('```json\\n{\"relationType\":\"contradicts\",\"confidence\":0.', o_custkey % 10, ',\"explanation\":\"', o_orderpriority, '\",\"same\":', o_custkey % 2 = 0, '}\\n```') ELSE concat('Answer: ', if(o_custkey % 2 = 0, 'Yes', 'NO'), ', it is ', o_orderpriority) END",
}, ["relation_type", "confidence", "explanation", "same"], """SELECT o_orderkey AS id, CASE m WHEN 0 THEN 'contradicts' WHEN 3 THEN 'reconciled' WHEN 4 THEN 'corroborates' ELSE 'uncertain' END AS relation_type, CASE m WHEN 0 THEN o_custkey % 10 / 10.0 WHEN 2 THEN 0.6 WHEN 3 THEN 1.0 WHEN 4 THEN 0.0 ELSE 0.3 END::DOUBLE AS confidence, m < 2 AND o_custkey % 2 = 0 AS same,
  CASE WHEN m IN (0, 2, 4) THEN o_orderpriority WHEN m = 3 THEN 'Relationship classified by judge.' WHEN m = 5 THEN 'LLM judge returned unstructured or unparseable response: {"relationType":"other","confidence":0.' || o_custkey % 10 || '}' ELSE 'LLM judge returned unstructured or unparseable response: Answer: ' || CASE WHEN o_custkey % 2 = 0 THEN 'Yes' ELSE 'NO' END || ', it is ' || o_orderpriority END AS explanation FROM (SELECT *, o_orderkey % 6 AS m FROM orders)""")  # fmt: skip
def model_replies(df):
    j = text.judge_reply(F.col("said"))
    return df.withColumn("j", j).select("id", "j.*", F.coalesce(text.confirm_reply(F.col("said")), F.lit(False)).alias("same"))


@query(f"""WITH {FACTS}, best AS (SELECT document_id, source_page, max(confidence) AS c FROM facts WHERE fact_type_id = 'R' GROUP BY document_id, source_page)
SELECT p.document_id, p.source_page FROM (SELECT DISTINCT document_id, source_page FROM facts) p LEFT JOIN best USING (document_id, source_page) WHERE c IS NULL OR c < 0.99""")
def escalated_pages(spark, d):
    f = derived_facts(spark, d)
    p = f.select("document_id", "source_page").distinct().withColumn("is_table_heavy", F.lit(True))
    return fact_ops.escalation_pages(p, f.where("fact_type_id = 'R'"), ["document_id", "source_page"], 0.99).select("document_id", "source_page")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_documents(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("uploaded_at"), F.lit("/x").alias("file_path"))
    return views.recent_documents(o).select("id", "status")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def untracked_documents(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("parsing").alias("status"))
    return views.documents_with_status(o, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))).select("id")


@query("""SELECT r.id, r.other_id, r.role, s.s_name AS other_name FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS other_id, 'factB' AS role FROM lineitem WHERE l_partkey = 1
ORDER BY l_shipdate DESC, id LIMIT 100) r LEFT JOIN supplier s ON s.s_suppkey = r.other_id""")
def related_facts(spark, d):
    pairs = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("fact_a_id"), (F.col("l_suppkey") + 10**9).alias("fact_b_id"), F.col("l_shipdate").alias("created_at"))
    cards = table(spark, d, "supplier").select((F.col("s_suppkey") + 10**9).alias("id"), F.col("s_name").alias("name"))
    return views.related_facts(pairs, 1, cards).select("id", (F.col("other_id") - 10**9).alias("other_id"), "role", F.col("other.name").alias("other_name"))


@query("SELECT o_orderkey AS id, o_orderpriority AS surface_form, s_name AS filename FROM orders LEFT JOIN supplier ON s_suppkey = o_orderkey % 200 WHERE o_custkey = 7")
def aliases_of_entity(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("surface_form"), (F.col("o_orderkey") % 200).alias("document_id"), F.col("o_orderdate").alias("created_at"))
    return views.aliases_of(a, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("filename")), 7).select("id", "surface_form", "filename")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, s_name AS filename FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 10")
def facts_of_documents(spark, d):
    names = table(spark, d, "supplier").where("s_nationkey < 10").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("filename"))
    return views.facts_of_documents(derived_facts(spark, d), names).select("id", "filename")


@query(f"WITH {FACTS}, {RELATED} SELECT fact_a_id AS id FROM rels UNION SELECT fact_b_id FROM rels")
def facts_in_relationships(spark, d):
    facts = derived_facts(spark, d)
    return views.facts_in(derived_relationships(facts), views.shares(facts))


@query("""SELECT user_id AS document_id, count(*) AS total, count(*) FILTER (event_id % 4 > 0) AS done, count(*) FILTER (event_id % 4 = 2) AS failed FROM events GROUP BY user_id""")
def status_counts(spark, d):
    names = F.array(*map(F.lit, ("pending", "extracted", "extraction_failed", "extraction_deferred")))
    chunks = table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.get(names, (F.col("event_id") % 4).cast("int")).alias("extraction_status"))
    return views.status_counts(chunks)


@over("orders", "o_orderkey", {
    "words": "concat('Order|', o_orderpriority, '|was ', o_orderstatus)",
    "quote": "CASE o_orderkey % 3 WHEN 0 THEN upper(replace(o_orderpriority, ' ', '  ')) WHEN 1 THEN concat('WAS ', o_orderstatus) ELSE 'nothing' END",
}, ["found"], """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Order|' || o_orderpriority WHEN 1 THEN o_orderpriority || '|was ' || o_orderstatus ELSE '' END AS found FROM orders""")
def highlighted_runs(df):
    runs = F.transform(F.split("words", "[|]"), lambda w: F.struct(w.alias("text")))
    return df.withColumn("runs", runs).withColumn("found", F.array_join(F.transform(display.matching_runs(F.col("runs"), F.col("quote")), lambda r: r["text"]), "|"))


@over("documents", "doc_id", {
    "mime": "CASE WHEN doc_id % 3 > 0 THEN 'application/pdf' END",
    "size": "cast(n_chars AS bigint) * 20000",
}, ["status"], """SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 400 WHEN CAST(n_chars AS BIGINT) * 20000 > 104857600 THEN 413 ELSE 201 END AS status FROM documents""")
def upload_answers(df):
    return df.withColumn("status", display.upload_status(F.col("mime"), F.col("size")))


@over("pages", "page_id", {
    "name": "url",
}, ["file"], r"""SELECT page_id AS id, CASE WHEN trim(f) = '' THEN 'document.pdf' ELSE f END AS file FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^.*[/\\]', ''), '^\.+', ''), '[/\\?%*:|"<>]', '_', 'g') AS f FROM pages)""")
def file_names(df):
    return df.withColumn("file", text.safe_filename(F.col("name")))


@over("orders", "o_orderkey", {
    "valid": "o_orderkey % 6 <> 0",
    "quote": "o_orderpriority",
    "chunk": "CASE o_orderkey % 6 WHEN 1 THEN 'nothing of it' WHEN 4 THEN NULL WHEN 5 THEN concat(repeat('y', 51 + cast(o_custkey % 9 AS int)), lower(o_orderpriority), repeat('z', 60)) ELSE concat('... ', lower(o_orderpriority), ' ...') END",
    "raw": "CASE o_orderkey % 6 WHEN 2 THEN '99' WHEN 4 THEN NULL ELSE left(o_orderpriority, 1) END",
}, ["verdict", "snippet"], """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 2 THEN 'valueWrong' WHEN 0 THEN 'quoteWrong' WHEN 1 THEN 'quoteWrong' ELSE 'correct' END AS verdict, CASE o_orderkey % 6 WHEN 1 THEN 'nothing of it' WHEN 4 THEN NULL WHEN 5 THEN repeat('y', 50) || lower(o_orderpriority) || repeat('z', 50) ELSE '... ' || lower(o_orderpriority) || ' ...' END AS snippet FROM orders""")
def quote_verdicts(df):
    return df.withColumns({"verdict": quality.verdict(*map(F.col, ("valid", "quote", "chunk", "raw"))), "snippet": quality.snippet(F.col("quote"), F.col("chunk"))})


#: Lines of a task of the resolve job, about.
LINES = 150_000


@query("""SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, CASE WHEN l_orderkey % 2 = 0 THEN CASE WHEN l_linenumber = 4 THEN 'unknown entity' ELSE md5(CAST(l_partkey AS VARCHAR)) END END AS entity FROM lineitem""")
def resolved_facts(spark, d):
    """The resolve job over the documents of even keys: names in two spellings, and none on fourth lines. Lines are dealt by
    document before anything is made of them, which the job's own steps then keep to."""
    key = F.col("l_orderkey").cast("string")
    lines = table(spark, d, "lineitem")
    lines = lines.select(F.coalesce(key, F.lit("")).alias("document_id"), "l_linenumber", "l_partkey", "l_suppkey").repartition(1 + lines.count() // LINES, "document_id")
    name = F.md5(F.col("l_partkey").cast("string"))
    spelt = F.when(F.col("l_linenumber") % 2 == 0, F.upper(name)).otherwise(name)
    entity = F.when(F.col("l_linenumber") != 4, F.to_json(F.struct(F.struct(spelt.alias("name"), F.lit("part").alias("type")).alias("_entity"))))
    f = lines.select(F.concat_ws("-", F.nullif("document_id", F.lit("")), "l_linenumber", "l_partkey", "l_suppkey").alias("id"), "document_id", entity.alias("qualifiers"), F.lit("q").alias("source_quote"), F.lit(None).cast("string").alias("entity_id")).distinct()
    empty = lambda name: spark.createDataFrame([], TABLES[name])
    documents = written(table(spark, d, "lineitem").where("l_orderkey % 2 = 0").select(key.alias("document_id")).distinct(), "documents")
    none = lambda a, ca, b, cb: F.lit(False)
    vector = lambda c: F.when(c.isNotNull(), F.array(F.lit(1.0)).cast("array<float>"))
    got = jobs.resolve_documents(f, documents, empty("entities"), empty("entity_aliases"), vector, none)
    named = got["entities"].select(F.col("id").alias("entity_id"), F.lower("canonical_name").alias("entity"))
    without, resolved = (got["facts"].where(F.col("entity_id").isNull() if x else F.col("entity_id").isNotNull()) for x in (True, False))  # nulls would meet in one task
    return without.select("id", F.lit(None).cast("string").alias("entity")).unionByName(resolved.join(named, "entity_id", "left").select("id", "entity"))


@query("""SELECT doc_id, 'head' AS predicate, substr(text, 1, 1) AS value, true AS source_quote_valid, 0.9::DOUBLE AS confidence FROM documents WHERE n_chars >= 200 AND trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '' AND substr(text, 1, 1) NOT IN (chr(9), chr(10), chr(11), chr(12), chr(13), ' ')""")
def extracted_facts(spark, d):
    """The extract job over all documents as pages of a hundred files each, with an extractor that quotes a page's first
    character and a vision lane that is off."""

    def heads(pages):
        facts = [{"confidence": 0.9, "predicate": "head", "value": t[0], "rawValue": t[0], "sourceQuote": t[0], "pageNumber": n, "factTypeDescription": "head"} for n, t in pages if not t[0].isspace()]
        return facts, (len(pages), len(facts))

    c = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.floor(F.col("doc_id") / 100).cast("string").alias("document_id"), F.col("doc_id").cast("int").alias("page_number"), F.lit(0).alias("chunk_index"), F.coalesce("text", F.lit("")).alias("raw_text"), (F.col("n_chars") < 200).alias("is_low_text"), F.lit(False).alias("is_table_heavy"), F.lit(False).alias("needs_vision"), F.lit("pending").alias("extraction_status"))
    empty = lambda name: spark.createDataFrame([], TABLES[name])
    vector = lambda c: F.when(c.isNotNull(), F.array(F.lit(1.0)).cast("array<float>"))
    chunks = empty("page_chunks").unionByName(c, allowMissingColumns=True)
    got = jobs.extract_documents(chunks, empty("facts"), empty("fact_types"), heads, vector, skip_boilerplate=False)
    return got["facts"].select(F.col("source_page").cast("bigint").alias("doc_id"), "predicate", "value", "source_quote_valid", "confidence")
