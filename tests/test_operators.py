"""Operators on small tables."""

from pyspark.sql import functions as F

from factloom.operators import entities, facts, pages, quality
from factloom.sources import sinks


def test_packing(spark):
    def pack(tokens, target, most=None):
        df = spark.createDataFrame([("d", i, t) for i, t in enumerate(tokens)], "document_id string, page_number int, token_estimate int")
        got = {}
        for r in pages.pack_pages(df, target=target, most=most).collect():
            got.setdefault(r["batch"], []).append(r["page_number"])
        return [sorted(v) for _, v in sorted(got.items())]

    assert pack([500, 500, 500], 42_000) == [[0, 1, 2]]
    assert pack([500, 30_000, 500], 40_000) == [[0], [1], [2]]
    assert [len(b) for b in pack([100] * 10, 42_000, 4)] == [4, 4, 2]


def test_boilerplate_and_duplicates(spark):
    text = "Acme Corp Annual Report 2024\nPage {} content\nConfidential"
    df = spark.createDataFrame([("d", i, text.format(n)) for i, n in enumerate((1, 2, 3, 1), 1)], "document_id string, page_number int, text string")
    got = {r["page_number"]: (r["compacted_text"], r["canonical_page"]) for r in pages.deduplicate_pages(df).collect()}
    assert got == {1: ("Page 1 content", 1), 2: ("Page 2 content", 2), 3: ("Page 3 content", 3), 4: ("Page 1 content", 1)}
    off = pages.deduplicate_pages(df, enabled=False).where("canonical_page <> page_number or compacted_text <> text")
    assert off.count() == 0


def test_classes_and_splits(spark):
    run = "array<struct<text:string,x:double,y:double,width:double,height:double,fontName:string>>"
    table = [("123.45", 0.0, 0.0, 30.0, 10.0, "f")] * 12 + [("word", 0.0, 0.0, 30.0, 10.0, "f")] * 8
    big = [("x" * 270, 0.0, -20.0 * i, 500.0, 10.0, "f") for i in range(120)]
    df = spark.createDataFrame([(1, table), (2, big), (3, [])], f"id int, runs {run}")
    got = {r["id"]: r for r in df.select("id", pages.classify_page(F.col("runs"), pages.raw_text(F.col("runs")), F.lit(600.0)).alias("c"), pages.split_oversize(F.col("runs")).alias("s")).collect()}
    assert got[1]["c"]["is_table_heavy"] and got[1]["c"]["numeric_ratio"] == 0.6
    assert got[3]["c"]["is_low_text"] and got[3]["c"]["vision_flagged"]
    assert len(got[2]["s"]) > 1 and sum(map(len, got[2]["s"])) == 120
    assert len(got[1]["s"]) == 1


def test_clusters(spark):
    rows = [("d", f"f{i}", i, n, t, c) for i, (n, t, c) in enumerate([("Acme Corp", "company", "maker"), ("Acme Corporation", "company", "a maker of things"), ("The Acme Corporation", "", None), ("Globex Corp", "company", "x"), ("acme corp", "firm", "m")])]
    got = {r["canonical_name"]: r for r in entities.elect(spark.createDataFrame(rows, "document_id string, fact_id string, idx int, name string, type string, context string")).collect()}
    assert set(got) == {"Acme Corp", "Globex Corp"}
    assert got["Acme Corp"]["n_mentions"] == 4 and got["Acme Corp"]["entity_type"] == "company" and got["Acme Corp"]["context"] == "maker"


def test_quotes_replies_and_rates(spark):
    df = spark.createDataFrame([(1, "Revenue 5", 0.8, "{}", False, "x Revenue 5 y"), (2, "no", 0.8, '{"a":1}', False, "x"), (3, "no", 0.8, "{}", True, "x")], "id int, source_quote string, confidence double, qualifiers string, via_vision boolean, page_text string")
    got = {r["id"]: (r["source_quote_valid"], r["confidence"], r["qualifiers"]) for r in facts.check_quotes(df).collect()}
    assert got == {1: (True, 0.8, "{}"), 2: (False, 0.4, '{"a":1,"quoteMismatch":true}'), 3: (False, 0.8, '{"visionOnly":true}')}
    reply = '```json\n{"facts":[{"confidence":0.9,"entity":{"name":"A"},"predicate":"p","value":5,"pageNumber":2,"qualifiers":[{"key":"k","value":"1"},{"key":"k","value":"2"}]}]}\n```'
    rows = facts.read_facts(spark.createDataFrame([(reply,), ("nonsense",)], "reply string")).collect()
    assert [(r["entity_name"], r["value"], r["page_number"], r["qualifiers"], r["error"]) for r in rows][0] == ("A", "5", 2, '{"k":"2"}', None)
    assert rows[1]["error"] == "unreadable reply"
    triples = spark.createDataFrame([("total_revenue", "4200M", "FY2023")] * 2 + [("total_revenue", "4800M", "FY2024"), ("net_income", "890M", None)], "predicate string, value string, time_scope string")
    assert facts.duplicate_rate(triples).first() == (4, 1, 0.25)


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", "t1"), (2, "b", "t1")], "k int, v string, created string")
    new = spark.createDataFrame([(2, "B", "t2"), (3, "C", "t2")], "k int, v string, created string")
    up = sinks.upserted(old, new, ["k"], keep=["created"])
    assert sorted(map(tuple, up.collect())) == [(1, "a", "t1"), (2, "B", "t1"), (3, "C", "t2")]
    again = sinks.upserted(up, new, ["k"], keep=["created"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, up.collect()))


def test_scores(spark):
    df = spark.createDataFrame([("correct",)] * 2 + [("quoteWrong",)], "verdict string")
    r = quality.score(df).first()
    assert (r["total"], r["correct"], r["quoteWrong"], r["precision"], r["precision_percent"]) == (3, 2, 1, 0.6667, "66.7%")
