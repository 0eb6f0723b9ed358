"""Scalar functions and rules on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import display, numbers, periods, qualifiers, text, vectors
from factloom.operators.rules import rule_reconcile


def values(spark, column, rows, names="v string"):
    return [r[0] for r in spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], names).select(column.alias("x")).collect()]


def test_normal_values(spark):
    cases = {'  "1,000,000"  ': "1000000", "$4,200.50": "$4200.50", "50 bps": "0.5%", "150 basis points": "1.5%", "15 pct": "15%", "12  Percent": "12%", "1,2,3": "12,3", "": "", " A \u00a0 b ": "a b"}
    assert values(spark, text.normalize_value(F.col("v")), list(cases)) == list(cases.values())


def test_parsed_numbers(spark):
    rows = [("50K", None, None), ("$4.2M", None, None), ("2.5 billion", None, None), ("10 Cr", "crores", None), ("5 Lakh", "lakhs", None), ("₹500", None, None), ("N/A", None, None), ("-", None, None), ("None", None, None), ("Not available", None, None), ("", None, None), ("€100M", None, "USD"), ("5", "kg", None), ("(500)", None, None), ("12%", None, None)]
    got = values(spark, numbers.parse_numeric(F.col("v"), F.col("u"), F.col("c")), rows, "v string, u string, c string")
    assert [g and g["value"] for g in got] == [50e3, 4.2e6, 2.5e9, 1e8, 5e5, 500.0, None, None, None, None, None, 1e8, 5e3, 500.0, 12.0]
    assert [g and g["currency"] for g in got][:6] == [None, "USD", None, None, None, "INR"]
    assert got[11]["currency"] == "USD"
    assert got[14]["unit"] == "percent" and got[12]["physical_unit"] == "kg"


def test_periods(spark):
    cases = {"FY24": "FY2024", "FY 2024": "FY2024", "Fiscal 2024": "FY2024", "2023-24": "FY2024", "2023-2024": "FY2024", "FY23-24": "FY2024", "2024-03-31": "2024", "1998-99": "FY1999", "Q1 FY24": "FY2024", "1Q2024": "Q1-FY2024", "Q1'24": "Q1-FY2024", "2024-03": "FY2003", "1999-00": "FY1900", "CY 2024": "CY2024", "in 2021": "2021", "Long Ago": "long ago", None: "", "FY85": "FY1985"}
    assert values(spark, periods.normalize_period(F.col("v")), list(cases)) == list(cases.values())


def test_names(spark):
    rows = [("Acme Corp", "Acme Corporation"), ("Apple Inc.", "Apple Records"), ("Google LLC", "Alphabet Inc."), ("The Acme Corporation", "acme corp"), ("", "x"), ("甲", "乙")]
    assert values(spark, text.names_merge(F.col("a"), F.col("b")), rows, "a string, b string") == [True, False, False, True, False, True]
    assert values(spark, text.comparison_form(F.col("v")), ["The Acme Corporation", "Acme Incorporated", "X L.L.C."]) == ["acme corp", "acme inc", "x llc"]


def test_predicates(spark):
    rows = [("revenue", "net revenue"), ("revenue", "director of operations"), ("total_revenue", "total revenue"), ("", " ")]
    assert values(spark, text.predicates_match(F.col("a"), F.col("b")), rows, "a string, b string") == [True, False, True, True]


def test_vectors(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([], []), ([1.0], [1.0, 2.0]), ([0.0], [1.0])]
    assert values(spark, vectors.cosine_similarity(F.col("a"), F.col("b")), rows, "a array<double>, b array<double>") == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0]
    assert values(spark, vectors.l2_normalized(F.col("a")), [([3.0, 4.0],), ([0.0],)], "a array<double>") == [[0.6, 0.8], [0.0]]


def test_qualifiers(spark):
    rows = [('{"tags":["a"],"n":5,"x":" A "}', '{"n":"5","x":"a","tags":["b"],"_entity":1}'), (None, '{"a":""}'), ('{"geo":"NA"}', '{"geo":"Europe"}')]
    assert values(spark, qualifiers.differing_keys(F.col("a"), F.col("b")), rows, "a string, b string") == [["tags"], [], ["geo"]]


def test_replies(spark):
    got = values(spark, text.judge_reply(F.col("v")), ['{"relationType":"contradicts","confidence":0.9,"explanation":"e"}', '```json\n{"relationType":"uncertain","confidence":0.9,"explanation":"e"}\n```', "garbage", '{"relationType":"reconciled","confidence":7}'])
    assert [(g["relation_type"], g["confidence"]) for g in got] == [("contradicts", 0.9), ("uncertain", 0.6), ("uncertain", 0.3), ("reconciled", 1.0)]
    assert values(spark, text.confirm_reply(F.col("v")), ['{"same": true}', "YES they are", "Answer: NO, not", "hm"]) == [True, True, False, False]


def test_quotes_and_files(spark):
    rows = [("Revenue was 5", "… Revenue was 5."), ("revenue", "Revenue"), (" ", "x"), (None, "x")]
    assert values(spark, text.quote_is_valid(F.col("q"), F.col("p")), rows, "q string, p string") == [True, False, False, False]
    assert values(spark, text.quote_bucket(F.col("v")), ["x" * n for n in (50, 100, 101, 400, 401, 1000, 1001)]) == ["0-100", "0-100", "101-400", "101-400", "401-1000", "401-1000", "1000+"]
    assert values(spark, text.safe_filename(F.col("v")), ["../../a?b.pdf", "...", "c:\\d\\e.pdf", ""]) == ["a_b.pdf", "document.pdf", "e.pdf", "document.pdf"]


def test_paging():
    p = display.parse_paging
    assert [p(x, None).page for x in ("0", "-5", "not-a-number", "inf", None, "2.7")] == [1, 1, 1, 1, 1, 2]
    assert [p(1, x).limit for x in ("500", "0", "xyz", "15.9")] == [100, 1, 20, 15]
    assert p("2.7", "15.9").offset == 15


def fact(**more):
    return {"id": "1", "predicate": "revenue", "value": "1", "raw_value": None, "unit": None, "currency": None, "time_scope": "FY2024", "qualifiers": None} | more


@pytest.mark.parametrize(
    ("a", "b", "relation", "confidence"),
    [
        ({"value": "$4,200,000"}, {"value": "$4200000"}, "corroborates", 0.95),
        ({"value": "$4.2M"}, {"value": "4200000"}, "corroborates", 0.95),
        ({"value": "$100M", "currency": "USD"}, {"value": "€100M", "currency": "EUR"}, "reconciled", 0.9),
        ({"value": "$50"}, {"value": "50%"}, None, None),
        ({"value": "$1.5B"}, {"value": "$1500M"}, "corroborates", 0.95),
        ({"value": "5", "time_scope": "FY2023"}, {"value": "5"}, "reconciled", 0.9),
        ({"value": "500"}, {"value": "650"}, None, None),
        ({"value": "500", "time_scope": None}, {"value": "650"}, None, None),
        ({"value": "500", "qualifiers": json.dumps({"geography": "NA"})}, {"value": "650", "qualifiers": json.dumps({"geography": "Europe"})}, "reconciled", 0.9),
        ({"value": "good"}, {"value": "fine"}, None, None),
    ],
)
def test_rules(spark, a, b, relation, confidence):
    kind = "struct<id:string,predicate:string,value:string,raw_value:string,unit:string,currency:string,time_scope:string,qualifiers:string>"
    row = rule_reconcile(spark.createDataFrame([(fact(**a), fact(**b))], f"a {kind}, b {kind}")).first()
    assert (row["relation_type"], row["confidence"], row["escalate"]) == (relation, confidence, relation is None)
    assert (row["explanation"] is None) == (relation is None)
